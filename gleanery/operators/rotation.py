"""Rotating a list of requests: what stays, what goes, and a batch filled up to its size with new ones by quotas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.choose import greedy_unique
from gleanery.operators.rank import ranked
from gleanery.sources.tables import saved

#: Share of series in what is added; one catalog gives a sixth of the need, two at least; how many catalogs are asked.
SERIES_SHARE, CATALOG_PARTS, LEAST_CATALOGS, SPARE_CATALOGS = 0.2, 6, 10, 4


def priority_quota(target: int, strata: int, cursor: int = 0) -> int:
    """How many of target go to priority strata: half, one a stratum at most; a target of one alternates with the general list."""
    if target <= 0 or strata <= 0:
        return 0
    if target == 1:
        return int(cursor % (strata + 1) < strata)
    return min(strata, target // 2)


def kind_targets(needed: int, size: int, *, series_kept: int = 0, others_kept: int = 0, series: bool = True, others: bool = True, most_series: int | None = None) -> dict[str, int]:
    """Whole numbers of 'series' and 'single' rows to add: a fifth are series, one at least in a list of two or more; a kind that is
    switched off gives its part to none but the other kind, and most_series bounds those kept and added."""
    if needed <= 0:
        return {"series": 0, "single": 0}
    if series and not others:
        n = needed
    elif series:
        n = max(1, int(needed * SERIES_SHARE + 0.5)) if size >= 2 else 0
        if series_kept and needed == 1 and not others_kept:
            n = 0
    else:
        n = 0
    if most_series is not None:
        n = min(n, max(0, most_series - series_kept))
    return {"series": n, "single": max(0, needed - n) if others else 0}


@dataclass
class _Batch:
    """Rows picked so far, and what they take."""

    rows: list[dict] = field(default_factory=list)
    ids: set = field(default_factory=set)
    titles: set = field(default_factory=set)

    def take(self, row: dict, stratum: str | None, kind: str) -> bool:
        if row["id"] in self.ids or (row["title"] is not None and row["title"] in self.titles):
            return False
        self.ids.add(row["id"])
        if row["title"] is not None:
            self.titles.add(row["title"])
        self.rows.append({**row, "stratum": stratum, "kind": kind})
        return True


def _lists(table: DataFrame, by: str, most: int) -> dict[tuple[str, str], tuple[list[dict], bool]]:
    """The first rows of each (kind, list) by pos, and whether there are more. At most so many rows a list reach the driver."""
    place = F.row_number().over(Window.partitionBy("kind", by).orderBy("pos", "id", "title"))
    rows = table.withColumn("__place", place).filter(F.col("__place") <= most + 1).select("kind", by, "id", "title", "pos", "__place").collect()
    out: dict[tuple[str, str], list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["__place"]):
        out.setdefault((r["kind"], r[by]), []).append({"id": r["id"], "title": r["title"]})
    return {k: (v[:most], len(v) > most) for k, v in out.items()}


class _Short(Exception):
    """A list ran out of rows that were fetched while it has more."""


def _fill(batch: _Batch, targets: dict[str, int], strata: list[str], catalogs: list[str], cursor: int, focus, general) -> None:
    count = dict.fromkeys(targets, 0)
    for kind, target in targets.items():
        quota, taken = priority_quota(target, len(strata), cursor), 0
        for g in range(len(strata)):
            if taken >= quota:
                break
            name = strata[(cursor + g) % len(strata)]
            rows, more = focus.get((kind, name), ([], False))
            hit = any(batch.take(row, name, kind) for row in rows)
            if not hit and more:
                raise _Short
            taken += hit
        count[kind] += taken
    for kind, target in targets.items():
        need = target - count[kind]
        if need <= 0:
            continue
        cap = need if need <= 3 else max(2, -(-need // CATALOG_PARTS))
        asked = len(catalogs) if need <= 3 else min(len(catalogs), max(LEAST_CATALOGS, -(-need // cap) + SPARE_CATALOGS))
        spare: list[dict] = []
        cut = False
        for k in range(asked):
            if count[kind] >= target:
                break
            rows, more = general.get((kind, catalogs[(cursor + k) % len(catalogs)]), ([], False))
            here = 0
            for row in rows:
                if here < cap and count[kind] < target:
                    if batch.take(row, None, kind):
                        here, count[kind] = here + 1, count[kind] + 1
                else:
                    spare.append(row)
            if more and here < cap and count[kind] < target:
                raise _Short
            cut = cut or more
        for k, row in enumerate(spare):
            if count[kind] >= target:
                break
            count[kind] += batch.take(row, None, kind)
        if count[kind] < target and cut:
            raise _Short


def discover(focus: DataFrame, general: DataFrame, targets: dict[str, int], strata: list[str], catalogs: list[str], *, cursor: int = 0, seen: DataFrame | None = None) -> list[dict]:
    """At most the target of each kind, in the order of picking: id, title, kind, stratum (null: general).

    focus: kind, stratum, pos, id, title; general: kind, catalog, pos, id, title; pos orders a list (ties by id, then title). seen: kind ('id' or
    'title') and value. No id or title comes twice; null ids are no candidates.

    Strata take turns from the cursor on, a row each until the quota is met, so a stratum without a row leaves its turn to the next.
    Then catalogs in their turns give as many as one may, and what they held back fills the rest. A batch is bounded by its size, and so is
    what the driver sees of each list: some rows more than the targets, and more only where rows that are taken use them up.
    """

    def unseen(table: DataFrame) -> DataFrame:
        table = table.filter("id is not null")
        if seen is not None:
            for column in ("id", "title"):
                known = seen.filter(F.col("kind") == column).select(F.col("value").alias(column)).filter(f"{column} is not null").distinct()
                table = table.withColumn(column, F.col(column).cast("string")).join(known, column, "left_anti")
        return table.select("kind", *(c for c in ("stratum", "catalog") if c in table.columns), "pos", F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title"))

    focus, general = saved(unseen(focus.filter(F.col("stratum").isin(strata)))), saved(unseen(general.filter(F.col("catalog").isin(catalogs))))
    most = 4 * sum(targets.values()) + 16
    while True:
        batch = _Batch()
        try:
            _fill(batch, targets, strata, catalogs, cursor, _lists(focus, "stratum", most), _lists(general, "catalog", most))
            return batch.rows
        except _Short:
            most *= 4


def rotate(current: DataFrame, seen: DataFrame, focus: DataFrame, general: DataFrame, *, size: int, strata: list[str], catalogs: list[str], protected: Column | None = None, cursor: int = 0, replace_all: bool = False, resumed: DataFrame | None = None, **kinds) -> tuple[DataFrame, DataFrame]:
    """(list, removed). list: place, action ('resumed', 'kept' or 'added'), ord, id, kind, title, major, stratum; removed: the rows of current
    that go, with their reason ('seen' or 'duplicate').

    current: ord (unique), id, kind ('series' or 'single'), title (a key of it, or null), major (null: the whole entity). seen: kind ('id', 'key' or
    'title') and value. A row is a duplicate if a kept one before it has its key (id, or id:major), or, for rows without a major,
    its id or title. Rows that protected is true for are kept though they are seen, all others go if they are seen: by key, or, without a
    major, by id or title. With replace_all only protected rows stay.

    resumed: id, title, of open entities; those that current has no row of come first, in order of id. Then new rows fill the
    list up to size; see discover and kind_targets, which takes the keywords. Order over all comes from ranges, not from one task.
    """
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("major").cast("string"))
    rows = current.filter("id is not null").withColumn("id", F.col("id").cast("string")).withColumn("__key", key)
    alone = F.col("major").isNull()
    rows = rows.withColumn("__id", F.when(alone, F.col("id"))).withColumn("__title", F.when(alone, F.col("title")))
    rows = rows.withColumn("__keep", F.coalesce(protected, F.lit(False)) if protected is not None else F.lit(False))
    probes = rows.select("ord", F.explode(F.array(F.struct(F.lit("key").alias("kind"), F.col("__key").alias("value")), F.struct(F.lit("id").alias("kind"), F.col("__id").alias("value")), F.struct(F.lit("title").alias("kind"), F.col("__title").alias("value")))).alias("p")).select("ord", "p.*")
    hit = probes.join(seen.select("kind", "value").distinct(), ["kind", "value"], "left_semi").select("ord").distinct().withColumn("__seen", F.lit(True))
    rows = saved(rows.join(hit, "ord", "left").withColumn("__seen", F.lit(replace_all) | F.coalesce("__seen", F.lit(False))))
    able = rows.filter("__keep or not __seen")
    kept = saved(greedy_unique(able, ["__key", "__id", "__title"], [F.col("ord")]))
    lost = able.join(kept.select("ord"), "ord", "left_anti").withColumn("reason", F.lit("duplicate"))
    removed = rows.filter("__seen and not __keep").withColumn("reason", F.lit("seen")).unionByName(lost).select(*current.columns, "reason")

    again = None
    if resumed is not None:
        again = saved(resumed.filter("id is not null").select(F.col("id").cast("string").alias("id"), "title").groupBy("id").agg(F.min("title").alias("title")).join(kept.select("id").distinct(), "id", "left_anti"))
    n_again = again.count() if again is not None else 0
    n = kept.agg(F.count("*"), F.count_distinct(F.when(F.col("kind") == "series", F.col("id"))), F.count_if(F.col("kind") != "series")).first()
    needed = size - n[0] - n_again
    targets = kind_targets(needed, size, series_kept=n[1] + n_again, others_kept=n[2], **kinds)
    known = seen.select("kind", "value").unionByName(kept.select(F.lit("id").alias("kind"), F.col("id").alias("value"))).unionByName(kept.select(F.lit("title").alias("kind"), F.col("title").alias("value")))
    if again is not None:
        known = known.unionByName(again.select(F.lit("id").alias("kind"), F.col("id").alias("value")))
    picks = discover(focus, general, targets, strata, catalogs, cursor=cursor, seen=known) if needed > 0 else []

    schema = "part int, ord bigint, id string, kind string, title string, major int, stratum string, action string"
    spark = current.sparkSession
    new = spark.createDataFrame([(2, k, p["id"], p["kind"], p["title"], None, p["stratum"], "added") for k, p in enumerate(picks)], schema)
    none = F.lit(None)
    out = kept.select(F.lit(1).alias("part"), F.col("ord").cast("bigint").alias("ord"), "id", F.when(F.col("__keep"), "series").otherwise(F.col("kind")).alias("kind"), "title", F.col("major").cast("int").alias("major"), none.cast("string").alias("stratum"), F.lit("kept").alias("action")).unionByName(new)
    if again is not None:
        out = out.unionByName(again.select(F.lit(0).alias("part"), none.cast("bigint").alias("ord"), "id", F.lit("series").alias("kind"), "title", none.cast("int").alias("major"), none.cast("string").alias("stratum"), F.lit("resumed").alias("action")))
    return ranked(out, [F.col("part"), F.col("ord"), F.col("id")]).drop("part"), removed
