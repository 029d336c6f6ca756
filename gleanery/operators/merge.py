"""Merging records of one key: survivorship, first or latest wins, precedence, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivorship_merge(df: DataFrame, keys: list[str], order: list[Column], rank: str, latest: list[str], record_values: list[str], first_values: list[str] = (), unions: list[str] = ()) -> DataFrame:
    """One row per key, folded in the given order (which must be total).

    A row is a record if its rank (null as -1) is above that of all rows before it. rank and the latest columns come
    from the last record. record_values: from the last record that has one, else the first row that has one.
    first_values: the first there is. unions: distinct elements of arrays, in order.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__ord", F.row_number().over(by))
    height = F.coalesce(F.col(rank), F.lit(-1))
    before = F.max(height).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__rec", before.isNull() | (height > before))

    def at(c: str, which, when: Column) -> Column:
        return which(F.when(when, F.col(c)), F.when(when, F.col("__ord")))

    out = [at(c, F.max_by, F.col("__rec")).alias(c) for c in [rank, *latest]]
    for c in record_values:
        have = F.col(c).isNotNull()
        out.append(F.coalesce(at(c, F.max_by, F.col("__rec") & have), at(c, F.min_by, have)).alias(c))
    out += [at(c, F.min_by, F.col(c).isNotNull()).alias(c) for c in first_values]
    for c in unions:
        lists = F.sort_array(F.collect_list(F.struct("__ord", F.col(c).alias("v"))))
        out.append(F.array_distinct(F.flatten(F.transform(lists, lambda x: F.coalesce(x["v"], F.array())))).alias(c))
    return rows.groupBy(*keys).agg(*out)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def dedupe_fill(df: DataFrame, keys: list[str], order: Column, label: str, usable: Column, keep: list[str]) -> DataFrame:
    """The first row's kept columns per key, with the first usable label of any row."""
    return df.groupBy(*keys).agg(
        *(F.min_by(c, order).alias(c) for c in keep),
        F.coalesce(F.min_by(F.when(usable, F.col(label)), F.when(usable, order)), F.min_by(label, order)).alias(label),
        F.count("*").alias("n_rows"),
    )


def coalesce_enrich(base: DataFrame, key: str, sources: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Missing values from the sources in order of precedence; <column>_from names the source (null: none or own)."""
    out = base
    for name, source in sources:
        out = out.join(source.select(key, *(F.col(c).alias(f"__{name}_{c}") for c in columns)), key, "left")
    for c in columns:
        origin = F.lit(None).cast("string")
        for name, _ in reversed(sources):
            origin = F.when(F.col(f"__{name}_{c}").isNotNull(), F.lit(name)).otherwise(origin)
        out = out.withColumn(f"{c}_from", F.when(F.col(c).isNull(), origin)).withColumn(c, F.coalesce(c, *(f"__{name}_{c}" for name, _ in sources)))
    return out.select(*base.columns, *(f"{c}_from" for c in columns))


def source_hits(enriched: DataFrame, sources: list[str], columns: list[str]) -> DataFrame:
    """source, and for each column of coalesce_enrich's rows how many values came from it ('own': were there before, 'none': are missing)."""
    counts = [F.struct(F.lit(s).alias("source"), *(F.count_if(F.col(f"{c}_from") == s).alias(c) for c in columns)) for s in sources]
    own = F.struct(F.lit("own").alias("source"), *(F.count_if(F.col(f"{c}_from").isNull() & F.col(c).isNotNull()).alias(c) for c in columns))
    none = F.struct(F.lit("none").alias("source"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return enriched.agg(F.array(*counts, own, none).alias("s")).select(F.inline("s"))


def upsert(target: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """target with delta merged by key: an unknown (null) value never overwrites a known one; action tells what happened.

    delta has one row per key; columns that it lacks stay as they are.
    """
    values = [c for c in target.columns if c != key]
    new = delta.select(key, *(F.col(c).alias(f"__{c}") for c in values if c in delta.columns), F.lit(True).alias("__new"))
    old = target.withColumn("__old", F.lit(True))
    action = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "kept").otherwise("updated")
    return old.join(new, key, "full_outer").select(key, *(F.coalesce(f"__{c}", c).alias(c) if c in delta.columns else F.col(c) for c in values), action.alias("action"))


def prepared(delta: DataFrame, key: str, valid: Column, order: list[Column], seen: DataFrame | None = None) -> DataFrame:
    """delta with reason: 'invalid' for rows that aren't valid (null counts as not), 'seen' for those whose key is in seen, 'duplicate' for other
    rows of a key but the first in the given order, null for those that an upsert takes."""
    rows = delta.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    if seen is None:
        rows = rows.withColumn("__seen", F.lit(False))
    else:
        known = seen.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__seen", F.lit(True))
        rows = rows.join(known, key, "left").withColumn("__seen", F.coalesce("__seen", F.lit(False)))
    place = F.row_number().over(Window.partitionBy(key, "__ok").orderBy(*order))
    return rows.withColumn("reason", F.when(~F.col("__ok"), "invalid").when(F.col("__seen"), "seen").when(place > 1, "duplicate")).select(*delta.columns, "reason")


def upsert_checked(target: DataFrame, delta: DataFrame, key: str, valid: Column, order: list[Column], seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The upsert of the rows that are valid and first of their key, and the rejected rows with their reason."""
    rows = prepared(delta, key, valid, order, seen)
    return upsert(target, rows.filter("reason is null").drop("reason"), key), rows.filter("reason is not null")


def column_signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have which columns set."""
    return df.groupBy(F.concat_ws(",", F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns)))).alias("signature")).agg(F.count("*").alias("n_rows"))
