"""Columns worked out once for each combination of values."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import languages as L
from gleanery.operators.values import once_per_value


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k, *p) for k, p in enumerate([("es", "x"), ("es", None), (None, "x"), (None, None)] * 50)], "k int, a string, b string")


@pytest.mark.parametrize("most", [10, 0])
def test_each_row_has_the_columns_of_its_values(rows, most):
    out = once_per_value(rows, ["a", "b"], lambda r: r.withColumn("c", F.concat_ws("-", "a", "b")), most=most)
    assert out.columns == ["k", "a", "b", "c"]
    assert sorted((r["k"], r["c"]) for r in out.collect()) == [(r["k"], "-".join(filter(None, (r["a"], r["b"])))) for r in rows.orderBy("k").collect()]


def test_work_sees_each_combination_once(spark, rows):
    seen = []
    once_per_value(rows, ["a", "b"], lambda r: seen.append(r.count()) or r.withColumn("c", F.lit(1)))
    assert seen == [4]


def test_subtitles_are_cut_once_for_all_names(spark):
    """Not once for each pattern of a language, which took most of the time."""
    made = spark.range(1).select(L.language_set(F.lit(None).cast("string"), F.concat(F.lit("Castellano 1080p SUB ITA ENG "), "id")).alias("l"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2
    assert made.first()["l"] == ["es"]
