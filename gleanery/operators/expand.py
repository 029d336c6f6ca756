"""Requests at three grains expanded to members, with a second output that says what was left out, and why.

A request asks for a whole group, for one of its majors, for one explicit member, or for a single entity without members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gleanery.functions import rules as R
from gleanery.operators.merge import first_rows
from gleanery.sources.tables import saved

#: Reasons of the second output. All but EXPANDED and LABEL_MISMATCH mean that the request gives no members.
TYPE_CONFLICT, NO_MEMBERS, ALL_DONE, EXPANDED, LABEL_MISMATCH, CAPPED = "type_conflict", "no_members", "all_done", "expanded", "label_mismatch", "capped"
MEMBER = ["kind", "entity", "major", "minor", "label", "ord"]


def available(members: DataFrame, now: Column) -> DataFrame:
    """entity, major, minor, title: the first row (by pos) of each member that is out by a day after now, or has no date."""
    out = members.filter(F.coalesce(F.col("released") <= now + F.expr("interval 1 day"), F.lit(True)) & F.col("minor").isNotNull())
    return first_rows(out, ["entity", "major", "minor"], [F.col("pos")]).select("entity", "major", "minor", "title")


def _expanded(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of asked (ord, entity, grain, want) with the members that they ask for. Majors below 1 only where asked for."""
    rows = asked.select("ord", "entity", "grain", F.col("major").alias("want"), "show").join(members, "entity")
    return rows.filter(((F.col("grain") == "whole") & (F.col("major") >= 1)) | ((F.col("grain") == "major") & (F.col("major") == F.col("want"))))


def capped(expanded: DataFrame, most: int | None, focus: object | None = None, single: bool = False) -> DataFrame:
    """Of expanded members at most so many: one of each entity in turn, entities by their first request.

    With focus (an entity), or single, all come from one entity: the one in focus if it has any, else the first. There is one row
    per entity behind that choice, and no more than most rows in the order over all.
    """
    if focus is not None or single:
        first = expanded.groupBy("entity").agg(F.min("ord").alias("__first"))
        wanted = F.col("entity") == F.lit(focus) if focus is not None else F.lit(False)
        one = first.orderBy(F.coalesce(wanted, F.lit(False)).desc(), "__first", "entity").limit(1).select("entity")
        expanded = expanded.join(F.broadcast(one), "entity", "left_semi")
        return expanded if most is None else expanded.orderBy("ord", "major", "minor").limit(most)
    if most is None:
        return expanded
    by = Window.partitionBy("entity")
    turn = expanded.withColumn("__turn", F.row_number().over(by.orderBy("ord", "major", "minor"))).filter(F.col("__turn") <= most)
    turn = turn.withColumn("__first", F.min("ord").over(by))
    return turn.orderBy("__turn", "__first", "entity").limit(most).drop("__turn", "__first")


def expand_requests(
    requests: DataFrame, entities: DataFrame, members: DataFrame, *, now: Column, fallback: DataFrame | None = None, done: DataFrame | None = None,
    most: int | None = None, focus: object | None = None, single: bool = False, observation: Observation | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(members, warnings), from one saved table.

    requests: ord (unique; their order), entity, kind ('group' or 'single'), major, minor, label. entities: entity (unique), kind,
    name, year, year_end. members and fallback: entity, major, minor, title, released, pos. done: entity, major, minor.

    - A 'single' request of an entity that is known as a group asks for the whole group. A 'group' request of one that is known
      as single is left out (type_conflict).
    - The whole group and one major have the members that are available; where members has none, those of fallback. None at all:
      no_members. Members that are done are left out; if all are: all_done.
    - An explicit member and a single entity always come, done or not, and take no part in the cap (see capped).
    - A member asked for twice comes once, at its first request, with the first label that is more than its id.

    members: kind, entity, major, minor, label, ord of the request; sort by ord, major, minor for their order. warnings: stage,
    entity, reason, detail, ord. Requests without an entity or ord give nothing, those
    without a kind are 'single'. observation gets the counts of requests,
    members and of each reason while the table is written.
    """
    known = entities.select("entity", F.col("kind").alias("is"), "name", "year", "year_end")
    asked = requests.filter("entity is not null and ord is not null").withColumn("kind", F.coalesce("kind", F.lit("single"))).join(known, "entity", "left")
    whole = F.when(F.col("kind") == "group", F.col("major").isNull()).otherwise(F.coalesce(F.col("is") == "group", F.lit(False)))
    conflict = (F.col("kind") == "group") & (F.col("is") == "single")
    grain = F.when(conflict, "conflict").when(whole, "whole").when(F.col("kind") != "group", "single").when(F.col("minor").isNotNull(), "member").otherwise("major")
    show = F.coalesce(R.base_name(F.col("label")), F.col("name"), F.col("entity").cast("string"))
    asked = saved(asked.withColumn("grain", grain).withColumn("show", show))

    needs, out = asked.filter("grain in ('whole', 'major')"), available(members, now)
    rows = saved(_expanded(needs, out))
    if fallback is not None:
        without = needs.join(rows.select("ord").distinct(), "ord", "left_anti")
        rows = saved(rows.unionByName(_expanded(without, available(fallback, now))))
    finished = (done.select("entity", "major", "minor").distinct() if done is not None else rows.select("entity", "major", "minor").limit(0)).withColumn("done", F.lit(True))
    rows = rows.join(finished, ["entity", "major", "minor"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    counts = rows.groupBy("ord").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("pending"), F.count_distinct(F.when(~F.col("done"), F.col("major"))).alias("majors"))

    def member_label(title: Column) -> Column:
        tagged = F.concat_ws(" ", "show", R.member_tag(F.col("major"), F.col("minor")))
        return F.concat(tagged, F.coalesce(F.concat(F.lit(" – "), title), F.lit("")))

    pending = rows.filter(~F.col("done")).select(F.lit("group").alias("kind"), "entity", "major", "minor", member_label(F.col("title")).alias("label"), "ord")
    kept = pending if most is None and focus is None and not single else saved(capped(pending, most, focus, single))
    explicit = asked.filter("grain = 'member'").join(out, ["entity", "major", "minor"], "left")
    explicit = explicit.select(F.lit("group").alias("kind"), "entity", "major", "minor", F.coalesce("label", member_label(F.col("title"))).alias("label"), "ord")
    named = F.concat("name", F.coalesce(F.concat(F.lit(" ("), "year", F.lit(")")), F.lit("")))
    none = F.lit(None).cast("int")
    alone = asked.filter("grain = 'single'").select(F.lit("single").alias("kind"), "entity", none.alias("major"), none.alias("minor"), F.coalesce("label", named).alias("label"), "ord")
    every = kept.unionByName(explicit).unionByName(alone)
    usable = F.col("label").isNotNull() & (F.col("label") != "") & (F.col("label") != F.col("entity").cast("string"))
    once = every.groupBy("kind", "entity", "major", "minor").agg(F.coalesce(F.min_by(F.when(usable, F.col("label")), F.when(usable, F.col("ord"))), F.min_by("label", "ord")).alias("label"), F.min("ord").alias("ord"))

    year = F.try_element_at(F.regexp_extract_all("label", F.lit("(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1), F.lit(-1)).cast("int")
    off = (F.col("grain") == "single") & ~year.between(F.col("year") - 1, F.coalesce("year_end", "year") + 1)
    judged = asked.join(counts, "ord", "left")
    n, left = F.coalesce("n", F.lit(0)), F.coalesce("pending", F.lit(0))
    expands = F.col("grain").isin("whole", "major")
    surprise = (F.col("grain") == "whole") & (F.col("kind") != "group") & (n == left)
    reason = F.when(F.col("grain") == "conflict", TYPE_CONFLICT).when(expands & (n == 0), NO_MEMBERS).when(expands & (left == 0), ALL_DONE).when(surprise, EXPANDED).when(off, LABEL_MISMATCH)
    detail = F.when(reason == NO_MEMBERS, F.when(F.col("is").isNull(), "not known").otherwise("none available")).when(reason == EXPANDED, F.format_string("%d majors, %d members", "majors", "pending")).otherwise(F.coalesce(named, F.col("entity").cast("string")))
    warnings = judged.select("entity", reason.alias("reason"), detail.alias("detail"), "ord").filter("reason is not null")
    if most is not None or focus is not None or single:
        lost = pending.groupBy("ord", "entity").agg(F.count("*").alias("n")).join(kept.groupBy("ord").agg(F.count("*").alias("k")), "ord", "left").select("entity", F.lit(CAPPED).alias("reason"), F.format_string("%d of %d", F.col("n") - F.coalesce("k", F.lit(0)), F.col("n")).alias("detail"), "ord", (F.col("n") > F.coalesce("k", F.lit(0))).alias("lost")).filter("lost").drop("lost")
        warnings = warnings.unionByName(lost)
    both = once.withColumn("reason", F.lit(None).cast("string")).unionByName(warnings, allowMissingColumns=True)
    if observation is not None:
        both = both.observe(observation, F.count_if(F.col("reason").isNull()).alias("members"), *(F.count_if(F.col("reason") == r).alias(r) for r in (TYPE_CONFLICT, NO_MEMBERS, ALL_DONE, EXPANDED, LABEL_MISMATCH, CAPPED)))
    both = saved(both)
    return both.filter("reason is null").select(*MEMBER), both.filter("reason is not null").select(F.lit("expand").alias("stage"), "entity", "reason", "detail", "ord")
