"""Registration of queries: a function of the tables, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import table

#: name -> (query, SQL or None)
DEMOS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """t.orders is the table of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def demo(sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]):
        DEMOS[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return register
