"""Lists of requests made from the orders of each customer, and options inside texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.plans.demo import demo
from gleanery.sources import requests as Q

#: A line of a customer's list by form; {n} is the order's number in seven digits or more, {c} the customer's.
_FORMS = [
    "concat('tt', n)", "concat('  TT', n, '  Some label # a note')", "concat('tt', n, ':s2:e', o_orderkey % 50 + 1)", "concat('no id ', n)", "'# --- Series ---'", "concat('tt', c, case when o_orderkey % 2 = 0 then ' Late' else '' end)",
    "''", "concat('tt', c, ':S03 Third')", "'# -- Películas y más'", "'   # only a note'", "concat('tt', n, 'x')",
]
_LINE = "CASE " + " ".join(f"WHEN form = {k} THEN {f}" for k, f in enumerate(_FORMS)) + " END"
_ROWS = f"x AS (SELECT *, {_LINE} AS line FROM (SELECT o_custkey AS file, o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS n, lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS c, o_orderkey // 3 % {len(_FORMS)} AS form, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders))"
_PARSED = f"""WITH {_ROWS}, h AS (SELECT *, last_value(CASE form WHEN 4 THEN 'series' WHEN 8 THEN 'single' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS section FROM x),
p AS (SELECT file, pos, trim(line) AS raw, form IN (0, 1, 2, 5, 7) AS ok, 'tt' || CASE WHEN form IN (5, 7) THEN c ELSE n END AS id, CASE form WHEN 2 THEN 2 WHEN 7 THEN 3 END AS major, CASE form WHEN 2 THEN o_orderkey % 50 + 1 END AS minor,
CASE WHEN form = 1 THEN 'Some label' WHEN form = 7 THEN 'Third' WHEN form = 5 AND o_orderkey % 2 = 0 THEN 'Late' END AS label, CASE WHEN form IN (2, 7) THEN 'series' ELSE section END AS hint FROM h WHERE form NOT IN (4, 6, 8, 9)),
r AS (SELECT file, id, major, minor, min(pos) AS ord, CASE WHEN major IS NULL THEN 'single' ELSE 'series' END AS kind, coalesce(arg_min(hint, pos) FILTER (pos = first), max(hint) FILTER (hint = 'series')) AS hint, arg_min(label, pos) FILTER (label IS NOT NULL) AS label, count(*) - 1 AS repeats
FROM (SELECT *, min(pos) OVER (PARTITION BY file, id, major, minor) AS first FROM p WHERE ok) GROUP BY file, id, major, minor)"""


def _parsed(t):
    line = F.lit(None).cast("string")
    for k, form in enumerate(_FORMS):
        line = F.when(F.col("form") == k, F.expr(form)).otherwise(line)
    key = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    rows = t.orders.select(F.col("o_custkey").alias("file"), "o_orderkey", key("o_orderkey", 8).alias("n"), key("o_custkey", 7).alias("c"), (F.floor(F.col("o_orderkey") / 3) % len(_FORMS)).alias("form")).withColumn("line", line)
    texts = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))).alias("l")).select("file", F.array_join(F.col("l.line"), "\r\n").alias("text"))
    return Q.parse_requests(texts, "file", "text")


@demo(f"{_PARSED} SELECT file, ord, id, kind, hint, major, minor, label, repeats FROM r")
def parse_requests(t):
    return _parsed(t)[0]


@demo(f"{_PARSED} SELECT file, pos, raw, 'no_id' AS reason FROM p WHERE NOT ok")
def parse_rejects(t):
    return _parsed(t)[1]


@demo(f"""{_PARSED} SELECT file, (SELECT count(*) FROM r WHERE r.file = f.file) AS valid, (SELECT coalesce(sum(repeats), 0) FROM r WHERE r.file = f.file)::BIGINT AS duplicates, (SELECT count(*) FROM p WHERE p.file = f.file AND NOT ok) AS invalid, (SELECT count(*) FROM r WHERE r.file = f.file AND kind = 'series' AND minor IS NULL) AS groups FROM (SELECT DISTINCT file FROM p) f""")
def parse_counts(t):
    return Q.line_counts(*_parsed(t))


_FOLLOW = {"one": ["1", "true", "yes", "si", "sí", "single"], "only": ["only", "solo", "exclusive", "serie"], "none": ["0", "false", "no", "off", "multi"]}
_SAID = ["yes", "OFF", "maybe", " Sí ", "only", ""]
_SIZES = ["12", "7 rows", "0", "-4", "99999", "many", "", "123456789012345678901234567890123456789012"]


@demo(f"""WITH x AS (SELECT c_custkey AS id, {_SAID}[c_custkey % {len(_SAID)} + 1] AS said, {_SIZES}[c_custkey % {len(_SIZES)} + 1] AS size, c_custkey % 5 AS form FROM customer)
SELECT id, CASE WHEN form = 0 THEN true ELSE said IN ('yes', ' Sí ') END AS dry_run, CASE WHEN form = 4 THEN 'none' WHEN said IN ('yes', ' Sí ') THEN 'one' WHEN said = 'only' THEN 'only' ELSE 'none' END AS follow,
CASE WHEN form = 4 THEN 1000 WHEN size = '12' THEN 12 WHEN size = '7 rows' THEN 7 WHEN size IN ('0', '-4') THEN 1 ELSE 1000 END AS batch_size, CASE WHEN form IN (1, 2) THEN 'tt' || lpad(CAST(id AS VARCHAR), 7, '0') ELSE '' END AS series_id, CASE form WHEN 3 THEN 'no fence' ELSE 'tt0000001 x' END AS first_line FROM x""")
def parse_options(t):
    # options stand outside of the fenced list; in form 4 they stand inside and tell nothing
    c, k = t.customer, F.col("c_custkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    form, key = k % 5, F.lpad(k.cast("string"), 7, "0")
    named = F.concat(F.lit("Follow_Series : "), pick(_SAID), F.lit("\r\n\tbatch_size="), pick(_SIZES), F.lit("\r\n"))
    dry = F.when(form == 0, "prueba: 1\r\n").otherwise(F.concat(F.lit("dry-run = "), pick(_SAID), F.lit("\r\n")))
    series = F.when(form == 1, F.concat(F.lit("series_id: https://x.org/TT"), key, F.lit("/\n"))).when(form == 2, F.concat(F.lit("series_id: tt"), key, F.lit(" name\n"))).when(form == 3, "series_id: tt12\n").otherwise("")
    fence = lambda inside: F.concat(F.lit("```Text \n"), inside, F.lit("tt0000001 x\n```\n"))
    text = F.when(form == 3, F.concat(F.lit("no fence\n"), dry, named, series)).when(form == 4, F.concat(dry, fence(named))).otherwise(F.concat(dry, fence(F.lit("")), named, series))
    inside, outside = Q.fenced(F.col("text"))
    rows = c.select(k.alias("id"), text.alias("text")).select("id", inside.alias("list"), outside.alias("outside"))
    o = lambda *names: Q.option(F.col("outside"), *names)
    first = F.array_compact(F.transform(F.split("list", "\n"), lambda x: F.nullif(F.trim(x), F.lit(""))))
    return rows.select("id", Q.flag(o("dry[-_ ]?run", "prueba"), False).alias("dry_run"), Q.choice(o("follow_series"), _FOLLOW, "none").alias("follow"), Q.whole_number(o("batch_size"), 1000, 1, 1000).alias("batch_size"), Q.first_id(o("series_id")).alias("series_id"), F.element_at(F.filter(first, lambda x: ~x.rlike("[:=]")), 1).alias("first_line"))
