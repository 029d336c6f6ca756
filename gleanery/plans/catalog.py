"""All demonstration queries with their SQL."""

from __future__ import annotations

from gleanery.plans.demo import DEMOS
from gleanery.plans import aggregates, joins, normalize, records, requests, sequences, tables  # noqa: F401, I001  (each registers its queries)


def queries():
    return {name: run for name, (run, _) in DEMOS.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in DEMOS.items() if sql}
