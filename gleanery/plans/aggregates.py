"""Aggregations: merging by key, consensus, contributions, progress, facets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import rules as R
from gleanery.operators import checks as K
from gleanery.operators import choose as C
from gleanery.operators import merge as M
from gleanery.plans.demo import demo
from gleanery.plans.sequences import BREAKERS, breaker_outcomes

LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
_ORD = ", ".join(LINE_ORDER)


@demo(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORD}) AS ord, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS rnk, CASE WHEN l_discount > 0.03 THEN l_returnflag END AS quality, CASE WHEN l_tax > 0.04 THEN l_extendedprice END AS size FROM lineitem),
p AS (SELECT *, max(coalesce(rnk, -1)) OVER (PARTITION BY l_partkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM r), q AS (SELECT *, pm IS NULL OR coalesce(rnk, -1) > pm AS rec FROM p)
SELECT l_partkey, arg_max(rnk, ord) FILTER (rec AND rnk IS NOT NULL) AS rnk, arg_max(l_orderkey, ord) FILTER (rec) AS l_orderkey, coalesce(arg_max(quality, ord) FILTER (rec AND quality IS NOT NULL), arg_min(quality, ord) FILTER (quality IS NOT NULL)) AS quality,
coalesce(arg_max(size, ord) FILTER (rec AND size IS NOT NULL), arg_min(size, ord) FILTER (size IS NOT NULL)) AS size, arg_min(l_suppkey, ord) AS first_supp, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM q GROUP BY l_partkey""")
def survivorship_merge(t):
    rows = t.lineitem.withColumns({"rnk": F.when(F.col("l_quantity") <= 45, F.col("l_quantity")), "quality": F.when(F.col("l_discount") > 0.03, F.col("l_returnflag")), "size": F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice")), "first_supp": F.col("l_suppkey"), "flags": F.array("l_returnflag")})
    out = M.survivorship_merge(rows, ["l_partkey"], [F.col(c) for c in LINE_ORDER], "rnk", ["l_orderkey"], ["quality", "size"], ["first_supp"], ["flags"])
    return out.withColumn("flags", F.array_join(F.array_sort("flags"), ","))


@demo("""SELECT md5(text) AS key, min(doc_id) AS doc_id, coalesce(arg_min(source, doc_id) FILTER (source NOT LIKE 'src1%'), arg_min(source, doc_id)) AS source, count(*) AS n_rows FROM documents GROUP BY text""")
def dedupe_fill(t):
    rows = t.documents.select(F.md5("text").alias("key"), "doc_id", "source")
    return M.dedupe_fill(rows, ["key"], F.col("doc_id"), "source", ~F.col("source").like("src1%"), ["doc_id"])


@demo("""WITH c AS (SELECT l_partkey, year(l_shipdate) AS y, count(*) AS support FROM lineitem GROUP BY ALL), b AS (SELECT *, sum(support) OVER (PARTITION BY l_partkey) AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY support DESC, y) AS rn FROM c)
SELECT l_partkey, CASE WHEN support >= 3 AND 2 * support >= total THEN y END AS ship_year, support, CAST(total AS BIGINT) AS total FROM b WHERE rn = 1""")
def consensus_value(t):
    return C.consensus(t.lineitem.select("l_partkey", F.year("l_shipdate").alias("ship_year")), ["l_partkey"], "ship_year")


@demo("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT l_partkey, count(*) AS c FROM s GROUP BY 1) SELECT s_suppkey, count(s.l_partkey) AS picks, count_if(n.c = 1) AS unique_picks FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey LEFT JOIN n USING (l_partkey) GROUP BY 1""")
def source_contribution(t):
    pairs = t.lineitem.select("l_partkey", "l_suppkey").distinct().withColumn("n", F.count("*").over(Window.partitionBy("l_partkey")))
    found = pairs.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("p"), F.count_if(F.col("n") == 1).alias("u"))
    return t.supplier.select("s_suppkey").join(found, "s_suppkey", "left").select("s_suppkey", F.coalesce("p", F.lit(0)).alias("picks"), F.coalesce("u", F.lit(0)).alias("unique_picks"))


@demo(f"""{BREAKERS} SELECT f.user_id, count_if(did <> 's') AS requests, count_if(did = 'o') AS ok, count_if(did IN ('e', 'l')) AS errors, count_if(did = 'l') AS limited, count_if(did = 's') AS skipped, floor(avg(value) FILTER (did = 'o') + 0.5) AS mean_value FROM f JOIN r USING (user_id, rn) GROUP BY 1""")
def source_metrics(t):
    # what a source was asked, and what became of it after its breakers: limited rows are errors too; the mean of rows that went well, if there are any
    did = breaker_outcomes(t)
    n = lambda *kinds: F.count_if(F.col("did").isin(*kinds))
    mean = R.rounded(F.avg(F.when(F.col("did") == "ok", F.col("value"))), 0)
    return did.groupBy("user_id").agg(n("ok", "error", "limited").alias("requests"), n("ok").alias("ok"), n("error", "limited").alias("errors"), n("limited").alias("limited"), n("skipped").alias("skipped"), mean.alias("mean_value"))


@demo("SELECT count(DISTINCT source) AS entities, count(DISTINCT CASE WHEN lang = 'es' THEN source END) AS es_found, count(DISTINCT source) - count(DISTINCT CASE WHEN lang = 'es' THEN source END) AS es_missing, count_if(lang = 'en') AS en_rows FROM documents")
def slot_totals(t):
    by_source = t.documents.groupBy("source").agg(F.bool_or(F.col("lang") == "es").alias("es"), F.count_if(F.col("lang") == "en").alias("en"))
    return by_source.agg(F.count("*").alias("entities"), F.count_if("es").alias("es_found"), F.count_if(~F.col("es")).alias("es_missing"), F.sum("en").alias("en_rows"))


@demo("""SELECT l_orderkey, max(l_extendedprice) AS best, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(l_returnflag), x)), ',') AS missing FROM lineitem GROUP BY l_orderkey""")
def entity_summary(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"), F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return rows.select("l_orderkey", "best", F.array_join("f", ",").alias("flags"), F.array_join(F.array_except(F.array(*map(F.lit, "ANR")), "f"), ",").alias("missing"))


@demo("SELECT regexp_replace(url, '[0-9]+', '#', 'g') AS template, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1 ORDER BY n DESC, first_page LIMIT 30")
def template_group(t):
    return t.pages.groupBy(R.masked(F.col("url")).alias("template")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).orderBy(F.desc("n"), "first_page").limit(30)


@demo("""SELECT l_orderkey, count_if(l_linestatus = 'F') AS done, count(*) AS total, max(l_linenumber) FILTER (l_linestatus = 'F') AS last_done, min(l_linenumber) FILTER (l_linestatus <> 'F') AS next_pending, CASE WHEN count_if(l_linestatus = 'F') = count(*) THEN 'complete' WHEN count_if(l_linestatus = 'F') > 0 THEN 'active' ELSE 'new' END AS status FROM lineitem GROUP BY 1""")
def progress_track(t):
    done = F.col("l_linestatus") == "F"
    rows = t.lineitem.groupBy("l_orderkey").agg(F.count_if(done).alias("done"), F.count("*").alias("total"), F.max(F.when(done, F.col("l_linenumber"))).alias("last_done"), F.min(F.when(~done, F.col("l_linenumber"))).alias("next_pending"))
    return rows.withColumn("status", F.when(F.col("done") == F.col("total"), "complete").when(F.col("done") > 0, "active").otherwise("new"))


@demo("SELECT count(*) AS n, count_if(lang = 'en') AS en, count_if(lang = 'es') AS es, count_if(contains(text, '|')) AS tabular, max(n_chars) AS longest FROM documents")
def facet_counts(t):
    return t.documents.agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "es").alias("es"), F.count_if(F.contains("text", F.lit("|"))).alias("tabular"), F.max("n_chars").alias("longest"))


@demo("SELECT event_type, max(ts) AS latest, count(*) AS n FROM events GROUP BY 1")
def latest_seen(t):
    return t.events.groupBy("event_type").agg(F.max("ts").alias("latest"), F.count("*").alias("n"))


@demo("SELECT user_id, CASE WHEN count_if(event_type <> 'error') = 0 THEN 'down' WHEN count_if(event_type = 'error') = 0 THEN 'ok' WHEN count_if(event_type = 'purchase') = 0 THEN 'empty' ELSE 'partial' END AS health FROM events GROUP BY user_id")
def health_status(t):
    def n(k):
        return F.count_if(F.col("event_type") == k)

    rows = t.events.groupBy("user_id").agg(F.count("*").alias("n"), n("error").alias("bad"), n("purchase").alias("bought"))
    return rows.select("user_id", F.when(F.col("bad") == F.col("n"), "down").when(F.col("bad") == 0, "ok").when(F.col("bought") == 0, "empty").otherwise("partial").alias("health"))


@demo("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'error' WHEN bool_and(l_linestatus = 'O') THEN 'skipped' WHEN bool_or(l_linestatus = 'O') THEN 'unknown' WHEN sum(l_quantity) < 10 THEN 'empty' ELSE 'saved' END AS state FROM lineitem GROUP BY 1""")
def status_cascade(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_and(F.col("l_linestatus") == "O").alias("all_open"), F.bool_or(F.col("l_linestatus") == "O").alias("some_open"), F.sum("l_quantity").alias("q"))
    return rows.select("l_orderkey", F.when(F.col("r"), "error").when(F.col("all_open"), "skipped").when(F.col("some_open"), "unknown").when(F.col("q") < 10, "empty").otherwise("saved").alias("state"))


@demo("""SELECT 'quantity_not_negative' AS rule, count_if(l_quantity < 0) AS violations FROM lineitem UNION ALL SELECT 'flag_in_domain', count_if(l_returnflag NOT IN ('A', 'N')) FROM lineitem UNION ALL SELECT 'discount_range', count_if(l_discount > 0.09) FROM lineitem UNION ALL SELECT 'key_unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def dq_constraints(t):
    rules = {"quantity_not_negative": F.col("l_quantity") >= 0, "flag_in_domain": F.col("l_returnflag").isin("A", "N"), "discount_range": F.col("l_discount") <= 0.09}
    return K.violations(t.lineitem, rules, {"key_unique": ["l_orderkey", "l_linenumber"]})


def _keyed(t):
    """Documents with a hash of their text as key, some of them damaged: blanks and capitals, cut short, all zero."""
    form, key = F.col("doc_id") % 9, F.sha1("text")
    damaged = F.when(form == 1, F.concat(F.lit("  "), F.upper(key), F.lit(" "))).when(form == 2, F.left(key, F.lit(39))).when(form == 3, F.repeat(F.lit("0"), F.lit(40))).otherwise(key)
    return t.documents.select("doc_id", damaged.alias("key"))


_KEYED = "k AS (SELECT doc_id, sha1(text) AS own, doc_id % 9 AS form FROM documents)"


@demo(f"""WITH {_KEYED} SELECT 'key_canonical' AS rule, count_if(form = 1) AS violations FROM k UNION ALL SELECT 'key_format', count_if(form IN (1, 2, 3)) FROM k UNION ALL SELECT 'key_unique', count(*) FROM (SELECT 1 FROM k GROUP BY CASE form WHEN 1 THEN '  ' || upper(own) WHEN 2 THEN left(own, 39) WHEN 3 THEN '0' ELSE own END HAVING count(*) > 1)""")
def dq_keys(t):
    rows, key = _keyed(t), F.col("key")
    return K.violations(rows, {"key_canonical": key == F.lower(F.trim(key)), "key_format": key.rlike("^[0-9a-f]{40}$") & ~key.rlike("^0+$")}, {"key_unique": ["key"]})


@demo(f"""WITH {_KEYED}, r AS (SELECT doc_id, own AS key, row_number() OVER (PARTITION BY own ORDER BY doc_id) AS place FROM k WHERE form NOT IN (2, 3)) SELECT doc_id, key, NULL AS reason FROM r WHERE place = 1 UNION ALL SELECT doc_id, key, 'repeated' FROM r WHERE place > 1 UNION ALL SELECT doc_id, NULL, 'no_key' FROM k WHERE form IN (2, 3)""")
def dq_backfill(t):
    # keys in canonical form; what then has no key, or one that an earlier row has, is set aside
    rows, rejects = K.repaired(_keyed(t), "key", R.valid_key(F.col("key")), [F.col("doc_id")])
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects)


@demo("""WITH i AS (SELECT l_orderkey AS id, list(DISTINCT l_returnflag) AS slots, bool_or(l_linestatus = 'F') AS any_f FROM lineitem GROUP BY 1), x AS (SELECT i.*, lower(c_name || ' ' || o_orderpriority || ' ' || o_orderkey) AS hay FROM i JOIN orders ON id = o_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT id, len(slots) AS n_slots FROM x WHERE any_f AND list_contains(slots, 'A') AND len(slots) < 3 AND contains(hay, 'customer') AND contains(hay, 'high')""")
def facet_items(t):
    # items of orders: a pick of quality F, the slot A taken, not all three slots, and all terms in the text
    picks = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.struct(F.col("l_returnflag").alias("slot"), F.col("l_linestatus").alias("quality"))).alias("picks"))
    items = t.orders.withColumnRenamed("o_orderkey", "id").join(picks, "id").join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return R.faceted(items, "picks", text=["c_name", "o_orderpriority", "id"], terms="CUSTOMER high", quality="F", slot="A", fewer=3).select("id", F.size(F.array_distinct("picks.slot")).cast("bigint").alias("n_slots"))


@demo("SELECT concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_tax > 0.04 THEN 'tax' END) AS signature, count(*) AS n_rows FROM lineitem GROUP BY 1")
def column_signature(t):
    rows = t.lineitem.select(F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"))
    return M.column_signature(rows, ["discount", "tax"])


@demo("SELECT s.source, count(*) AS docs, sum(n_chars) AS chars FROM documents s GROUP BY ROLLUP (source)")
def run_report(t):
    return t.documents.rollup("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
