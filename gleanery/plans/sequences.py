"""Ranking, slots, caps, sampling, streaks, order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions.rules import rounded
from gleanery.operators import choose as C
from gleanery.operators import rotation as R
from gleanery.operators import streaks as S
from gleanery.operators.rank import ranked as ranked_rows
from gleanery.operators.state import sound_state
from gleanery.plans.demo import demo
from gleanery.plans.normalize import SCORED_SQL, scored

_CONF = "CASE WHEN n_chars >= 100 THEN 1.0 WHEN n_chars >= 50 THEN 0.6 ELSE 0.3 END"
_RANKED = f"SELECT *, floor((score + 0.2 * {_CONF}) * 100 + 0.5) / 100 AS rank, {_CONF} AS confidence FROM ({SCORED_SQL})"


def ranked(t):
    rows = scored(t).withColumn("confidence", F.when(F.col("n_chars") >= 100, 1.0).when(F.col("n_chars") >= 50, 0.6).otherwise(0.3))
    return rows.withColumn("rank", rounded(F.col("score") + 0.2 * F.col("confidence")))


def best():
    return [F.desc("rank"), F.desc("n_chars"), F.asc("doc_id")]


@demo(f"SELECT source, lang AS slot, doc_id, rank FROM ({_RANKED}) WHERE lang IN ('es', 'en') AND confidence >= 0.55 QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY rank DESC, n_chars DESC, doc_id) = 1")
def slot_select(t):
    rows = ranked(t).filter(F.col("lang").isin("es", "en") & (F.col("confidence") >= 0.55)).withColumn("slot", F.col("lang"))
    return C.slot_winners(rows, ["source"], "slot", best()).select("source", "slot", "doc_id", "rank")


@demo(f"""WITH r AS ({_RANKED}), a AS (SELECT source, doc_id FROM r WHERE confidence >= 0.55 QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank DESC, n_chars DESC, doc_id) = 1),
b AS (SELECT source, doc_id FROM r WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM a) QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank DESC, n_chars DESC, doc_id) = 1)
SELECT source, doc_id, 'any' AS slot FROM a UNION ALL SELECT source, doc_id, 'en' FROM b""")
def exclusive_slots(t):
    slots = [("any", F.col("confidence") >= 0.55, best()), ("en", F.col("lang") == "en", best())]
    return C.exclusive_slots(ranked(t), ["source"], "doc_id", slots).select("source", "doc_id", "slot")


def _greedy_sql(rounds: int) -> str:
    """The walk as rounds, one common table after another: rows first in both their groups stay, rows that share a key with one go.

    Rounds after the last that finds something find nothing; a table of 60,000 rows takes about ten.
    """
    tables = ["r0 AS MATERIALIZED (SELECT DISTINCT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)"]
    for k in range(rounds):
        tables.append(f"k{k} AS MATERIALIZED (SELECT * FROM r{k} QUALIFY place = min(place) OVER (PARTITION BY l_partkey) AND place = min(place) OVER (PARTITION BY l_orderkey))")
        tables.append(f"r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} WHERE l_partkey NOT IN (SELECT l_partkey FROM k{k}) AND l_orderkey NOT IN (SELECT l_orderkey FROM k{k}))")
    return "WITH " + ", ".join(tables) + " " + " UNION ALL ".join(f"SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM k{k}" for k in range(rounds))


@demo(_greedy_sql(30))
def greedy_two_key(t):
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    rows = t.lineitem.select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return C.greedy_unique(rows, ["l_partkey", "l_orderkey"], order)


@demo("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) SELECT p_partkey, p_brand, place FROM r ORDER BY place > 3, place, p_brand LIMIT 100""")
def cap_backfill(t):
    return C.cap_and_fill(t.part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 3, 100).select("p_partkey", "p_brand", "place")


@demo("""WITH s AS (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size > 20 THEN 'economy' WHEN p_type = 'PROMO' THEN 'promo' END AS stratum, row_number() OVER (PARTITION BY CASE WHEN p_type = 'ECONOMY' AND p_size > 20 THEN 'economy' WHEN p_type = 'PROMO' THEN 'promo' END ORDER BY p_partkey) AS rn FROM part),
k AS (SELECT p_partkey, stratum FROM s WHERE stratum IS NOT NULL AND rn <= 10) SELECT p_partkey, stratum AS kind FROM k UNION ALL SELECT * FROM (SELECT p_partkey, 'general' FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM k) ORDER BY p_partkey LIMIT 20)""")
def stratified_sample(t):
    stratum = F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") > 20), "economy").when(F.col("p_type") == "PROMO", "promo")
    reserved = C.top(t.part.select("p_partkey", stratum.alias("kind")).filter("kind is not null"), ["kind"], [F.asc("p_partkey")], 10).select("p_partkey", "kind")
    general = t.part.select("p_partkey").join(reserved.select("p_partkey"), "p_partkey", "left_anti").orderBy("p_partkey").limit(20).withColumn("kind", F.lit("general"))
    return reserved.unionByName(general)


#: Priority strata and catalogs of the rotation, in their order.
_STRATA, _CATALOGS = ["PROMO", "ECONOMY", "SMALL"], [f"Brand#{a}{b}" for a in range(1, 6) for b in range(1, 6)]
_CURSOR, _SIZE = 4, 1000


def _rotation(t):
    """Orders of some days as a list of requests (the customer asked for, with a major for every fourth), parts as candidates.

    Seen are customers of finished orders and every seventh part; urgent requests are protected; customers with open orders
    of the top priority whom the list has lost are resumed.
    """
    o = t.orders
    current = o.filter("o_orderkey % 10 < 1").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), "o_custkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, "series").otherwise("single").alias("kind"), F.lit(None).cast("string").alias("title"), F.when(F.col("o_orderkey") % 4 == 0, 1 + F.col("o_custkey") % 5).cast("int").alias("major"), (F.col("o_orderpriority").like("1%") & (F.col("o_orderkey") % 4 != 0)).alias("urgent"))
    done = o.filter("o_orderstatus = 'F' and o_orderkey % 10 >= 7").select(F.lit("id").alias("kind"), F.concat(F.lit("c"), "o_custkey").alias("value"))
    seen = done.unionByName(t.part.filter("p_partkey % 7 = 0").select(F.lit("id").alias("kind"), F.concat(F.lit("p"), "p_partkey").alias("value")))
    part = t.part.select(F.when(F.col("p_partkey") % 5 == 0, "series").otherwise("single").alias("kind"), "p_type", F.col("p_brand").alias("catalog"), F.col("p_size").alias("pos"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit(None).cast("string").alias("title"))
    first = F.split("p_type", " ")[0]
    focus = part.filter(first.isin(_STRATA)).select("kind", first.alias("stratum"), "pos", "id", "title")
    resumed = o.filter("o_orderstatus = 'P' and o_orderpriority like '1%' and o_custkey % 20 = 0").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.lit(None).cast("string").alias("title"))
    return R.rotate(current, seen, focus, part.drop("p_type"), size=_SIZE, strata=_STRATA, catalogs=_CATALOGS, protected=F.col("urgent"), cursor=_CURSOR, resumed=resumed)


_ROTATION = f"""WITH cur AS (SELECT o_orderkey AS ord, 'c' || o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'series' ELSE 'single' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 1 + o_custkey % 5 END AS major, o_orderpriority LIKE '1%' AND o_orderkey % 4 <> 0 AS urgent FROM orders WHERE o_orderkey % 10 < 1),
done AS (SELECT DISTINCT 'c' || o_custkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 >= 7),
c AS (SELECT *, major IS NULL AND id IN (SELECT id FROM done) AS seen FROM cur), able AS (SELECT *, row_number() OVER (PARTITION BY id, major ORDER BY ord) AS rn FROM c WHERE urgent OR NOT seen), kept AS (SELECT * FROM able WHERE rn = 1),
again AS (SELECT DISTINCT 'c' || o_custkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%' AND o_custkey % 20 = 0 AND 'c' || o_custkey NOT IN (SELECT id FROM kept)),
need AS (SELECT greatest({_SIZE} - (SELECT count(*) FROM kept) - (SELECT count(*) FROM again), 0) AS n), goal AS (SELECT unnest(['series', 'single']) AS kind, unnest([CASE WHEN n = 0 THEN 0 ELSE greatest(1, floor(n * 0.2 + 0.5)) END, CASE WHEN n = 0 THEN 0 ELSE n - greatest(1, floor(n * 0.2 + 0.5)) END])::BIGINT AS target FROM need),
p AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'series' ELSE 'single' END AS kind, string_split(p_type, ' ')[1] AS stratum, p_brand AS catalog, p_size AS pos, 'p' || p_partkey AS id FROM part WHERE p_partkey % 7 <> 0),
f AS (SELECT kind, stratum, id, row_number() OVER (PARTITION BY kind ORDER BY turn) AS nth FROM (SELECT *, (list_position({_STRATA}, stratum) - 1 - {_CURSOR} % 3 + 3) % 3 AS turn FROM p WHERE stratum IN {tuple(_STRATA)} QUALIFY row_number() OVER (PARTITION BY kind, stratum ORDER BY pos, id) = 1)),
fp AS (SELECT f.* FROM f JOIN goal USING (kind) WHERE nth <= CASE WHEN target <= 0 THEN 0 WHEN target = 1 THEN CASE WHEN {_CURSOR} % 4 < 3 THEN 1 ELSE 0 END ELSE least(3, target // 2) END),
g AS (SELECT kind, target - (SELECT count(*) FROM fp WHERE fp.kind = goal.kind) AS need FROM goal), h AS (SELECT kind, need, CASE WHEN need <= 3 THEN need ELSE greatest(2, ceil(need / 6)) END AS cap FROM g WHERE need > 0),
q AS (SELECT p.kind, p.id, need, cap, (list_position({_CATALOGS}, catalog) - 1 - {_CURSOR} + 25) % 25 AS turn, row_number() OVER (PARTITION BY p.kind, catalog ORDER BY pos, id) AS rn FROM p JOIN h USING (kind) WHERE id NOT IN (SELECT id FROM fp)),
gp AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY rn > cap, turn, rn) AS nth, need FROM q WHERE turn < CASE WHEN need <= 3 THEN 25 ELSE least(25, greatest(10, ceil(need / cap) + 4)) END),
added AS (SELECT kind, id, stratum, 0 AS phase, nth FROM fp UNION ALL SELECT kind, id, NULL, 1, nth FROM gp WHERE nth <= need),
u AS (SELECT 0 AS part, 0 AS o1, 0 AS o2, 0 AS o3, id, 'series' AS kind, NULL AS major, NULL AS stratum, 'resumed' AS action FROM again UNION ALL SELECT 1, ord, 0, 0, id, CASE WHEN urgent THEN 'series' ELSE kind END, major, NULL, 'kept' FROM kept
UNION ALL SELECT 2, phase, CASE kind WHEN 'series' THEN 0 ELSE 1 END, nth, id, kind, NULL, stratum, 'added' FROM added)"""


@demo(f"{_ROTATION} SELECT row_number() OVER (ORDER BY part, o1, o2, o3, id) AS place, action, id, kind, major, stratum FROM u")
def rotate_list(t):
    return _rotation(t)[0].select("place", "action", "id", "kind", "major", "stratum")


@demo(f"""{_ROTATION} SELECT action, count(*) AS n FROM (SELECT action FROM u UNION ALL SELECT CASE WHEN urgent OR NOT seen THEN 'duplicate' ELSE 'seen' END FROM c WHERE ord NOT IN (SELECT ord FROM kept)) GROUP BY 1""")
def rotation_plan(t):
    kept, removed = _rotation(t)
    return kept.select("action").unionByName(removed.select(F.col("reason").alias("action"))).groupBy("action").agg(F.count("*").alias("n"))


_TIERS = """SELECT o_custkey AS k, 1 AS tier, o_orderkey AS ord FROM orders WHERE o_orderkey = 33 UNION ALL SELECT * FROM (SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1)
UNION ALL SELECT o_custkey, 3, o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_custkey, 4, o_orderkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_custkey, 5, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey, 6, c_custkey FROM customer"""


@demo(f"SELECT k AS c_custkey, min((tier, ord))[1] AS tier, min((tier, ord))[2] AS ord, row_number() OVER (ORDER BY min((tier, ord)), k) AS place FROM ({_TIERS}) GROUP BY k")
def priority_union(t):
    # six tiers, the first that has a customer counts; places follow tiers and the order inside them
    def of(rows, key="o_custkey", order="o_orderkey"):
        return rows.select(F.col(key).alias("c_custkey"), F.col(order).alias("ord"))

    o = t.orders
    active = o.filter("o_orderstatus = 'P'").orderBy("o_orderkey").limit(1)
    tiers = [of(o.filter("o_orderkey = 33")), of(active), of(o.filter("o_orderpriority like '1%'")), of(o.filter("o_totalprice > 200000")), of(o.filter("o_orderstatus = 'O'")), of(t.customer, "c_custkey", "c_custkey")]
    return ranked_rows(C.priority_union(tiers, "c_custkey", "ord"), [F.col("tier"), F.col("ord"), F.col("c_custkey")])


@demo("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def active_pointer(t):
    return t.orders.filter("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_custkey", "o_orderkey")


@demo("""WITH x AS (SELECT 'c' || o_custkey AS entity, o_orderstatus AS st, o_orderkey AS k, CASE WHEN o_orderkey % 6 <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS updated_at FROM orders),
n AS (SELECT entity, CASE WHEN k % 4 = 0 THEN entity ELSE 'name ' || k END AS name, CASE WHEN st = 'F' THEN 'complete' ELSE 'open' END AS status, CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS done, k % 50 AS total, CASE WHEN k % 5 <> 0 THEN k % 9 END AS last_major, updated_at, k FROM x),
r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY entity ORDER BY coalesce(updated_at, '') DESC, status DESC, name DESC, done DESC) = 1)
SELECT entity, name, status, done, total, last_major, updated_at FROM r WHERE status = 'open' UNION ALL SELECT * FROM (SELECT entity, name, status, done, total, last_major, updated_at FROM r WHERE status = 'complete' ORDER BY coalesce(updated_at, '') DESC, entity LIMIT 50)""")
def retain_latest_n(t):
    # the state of customers as orders wrote it, with words where numbers should be, ids in all forms, and no time for some
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    id_ = F.concat(F.lit(" C"), "o_custkey", F.lit(" "))
    raw = t.orders.select(
        id_.alias("entity"), F.when(k % 4 != 0, F.concat(F.lit("name "), k)).alias("name"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 3 == 0, "many").otherwise(text(k)).alias("done"),
        text(k % 50).alias("total"), F.when(k % 5 == 0, "1.5").otherwise(text(k % 9)).alias("last_major"), *(F.lit(None).cast("string").alias(c) for c in ("last_minor", "next_major", "next_minor")), F.when(k % 6 != 5, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("updated_at"),
    )
    return sound_state(raw, keep_complete=50).select("entity", "name", "status", "done", "total", "last_major", "updated_at")


@demo("""WITH i AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i),
b AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' AND streak >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM s)
SELECT user_id, count_if(open = 0 AND event_type <> 'error') AS ok, count_if(open = 0 AND event_type = 'error') AS errors, count_if(open = 1) AS skipped FROM b GROUP BY 1""")
def failure_streaks(t):
    rows = S.failure_streaks(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 2)
    return rows.groupBy("user_id").agg(F.count_if(~F.col("skipped") & (F.col("event_type") != "error")).alias("ok"), F.count_if(~F.col("skipped") & (F.col("event_type") == "error")).alias("errors"), F.count_if("skipped").alias("skipped"))


_SKIP = "((k = 0 AND o0) OR (k = 1 AND o1))"


#: The walk of a source's rows, one after another: errors (e0, e1) and open breakers (o0, o1) of both kinds, strikes (st), and what became of the row (did).
BREAKERS = f"""WITH RECURSIVE r AS (SELECT user_id, value, event_id % 2 AS k, CASE event_type WHEN 'error' THEN 'e' WHEN 'view' THEN 'l' ELSE 'o' END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, 0 AS e0, 0 AS e1, false AS o0, false AS o1, 0 AS st, '' AS did FROM events
UNION ALL SELECT f.user_id, r.rn, CASE WHEN {_SKIP} OR k = 1 OR x = 'l' THEN e0 WHEN x = 'o' THEN 0 ELSE e0 + 1 END, CASE WHEN {_SKIP} OR k = 0 OR x = 'l' THEN e1 WHEN x = 'o' THEN 0 ELSE e1 + 1 END,
o0 OR (k = 0 AND ((x = 'e' AND e0 >= 1) OR (x = 'l' AND st >= 5))), o1 OR (k = 1 AND ((x = 'e' AND e1 >= 1) OR (x = 'l' AND st >= 5))), CASE WHEN {_SKIP} OR x = 'e' THEN st WHEN x = 'o' THEN 0 ELSE st + 1 END, CASE WHEN {_SKIP} THEN 's' ELSE x END
FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)"""


def breaker_outcomes(t):
    """user_id, value and did (ok, error, limited or skipped) of each event; users are sources, odd and even events their kinds."""
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "limited").otherwise("ok")
    rows = t.events.select("user_id", "ts", "event_id", "value", (F.col("event_id") % 2).alias("kind"), outcome.alias("outcome"))
    rows = S.breaker_streaks(rows, "user_id", "kind", [F.col("ts"), F.col("event_id")], "outcome", 2)
    return rows.select("user_id", "value", F.when(F.col("skipped"), "skipped").otherwise(F.col("outcome")).alias("did"))


@demo(f"{BREAKERS} SELECT user_id, count_if(did = 'o') AS ok, count_if(did = 'e') AS errors, count_if(did = 'l') AS limited, count_if(did = 's') AS skipped FROM f WHERE rn > 0 GROUP BY 1")
def breaker_streaks(t):
    did = F.col("did")
    return breaker_outcomes(t).groupBy("user_id").agg(*(F.count_if(did == k).alias(n) for k, n in (("ok", "ok"), ("error", "errors"), ("limited", "limited"), ("skipped", "skipped"))))


@demo("SELECT event_id, round FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round FROM events) ORDER BY round, user_id LIMIT 200")
def round_robin_cap(t):
    return C.round_robin(t.events, "user_id", [F.col("ts"), F.col("event_id")], 200).select("event_id", "round")


@demo("""WITH y AS (SELECT DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate) AS q FROM orders), b AS (SELECT q, q < 7977 AS tail, q // 8 AS bucket, row_number() OVER (PARTITION BY q < 7977, q // 8 ORDER BY q DESC) AS rn FROM y) SELECT q, tail, row_number() OVER (ORDER BY tail, CASE WHEN tail THEN 0 ELSE rn END, bucket DESC, q DESC) AS place FROM b""")
def interleave_buckets(t):
    # the newest of each two years in turn; quarters before 1994 are the tail and follow as they are, newest first
    q = F.col("q")
    quarters = t.orders.select((F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("q")).distinct().select("q", (q < 7977).alias("tail"), F.floor(q / 8).alias("bucket"))
    rows = quarters.withColumn("rn", F.row_number().over(Window.partitionBy("tail", "bucket").orderBy(F.desc("q"))))
    turn = F.when(F.col("tail"), 0).otherwise(F.col("rn"))
    # one row for each quarter of the calendar: the last window is small
    return rows.select("q", "tail", F.row_number().over(Window.orderBy("tail", turn, F.desc("bucket"), F.desc("q"))).alias("place"))


@demo("""WITH a AS (SELECT 'o' || o_orderkey AS name, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, 1 AS part FROM orders), n AS (SELECT greatest((SELECT count(*) FROM orders) // greatest((SELECT count(*) FROM customer), 1), 1) AS step),
b AS (SELECT 'c' || c_custkey AS name, row_number() OVER (ORDER BY c_custkey) * step AS i, 0 AS part FROM customer, n), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT name, row_number() OVER (ORDER BY i, part, name) AS place FROM u""")
def spread_merge(t):
    # one of b before every step-th of a; what is left of either stands at the end
    a = ranked_rows(t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("name"), "o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")], "i")
    b = ranked_rows(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("name"), "c_custkey"), [F.col("c_custkey")], "i")
    size = lambda rows: rows.agg(F.count("*").alias("n"))  # noqa: E731  (one row)
    step = size(a).crossJoin(size(b).withColumnRenamed("n", "m")).select(F.greatest(F.expr("n div greatest(m, 1)"), F.lit(1)).alias("step"))
    spread = b.crossJoin(F.broadcast(step)).select("name", (F.col("i") * F.col("step")).alias("i"), F.lit(0).alias("part"))
    rows = a.select("name", "i", F.lit(1).alias("part")).unionByName(spread)
    return ranked_rows(rows, [F.col("i"), F.col("part"), F.col("name")]).select("name", "place")


@demo("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1 - 7 + count(*) OVER ()) % count(*) OVER () AS place FROM orders")
def cursor_rotate(t):
    rows = ranked_rows(t.orders.select("o_orderkey"), [F.col("o_orderkey")], "i")
    total = rows.agg(F.count("*").alias("n"))  # one row
    return rows.crossJoin(F.broadcast(total)).select("o_orderkey", F.pmod(F.col("i") - 1 - 7, F.col("n")).alias("place"))


@demo("WITH b AS (SELECT o_orderkey, coalesce(max(l_extendedprice), -1) AS best FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT *, row_number() OVER (ORDER BY best DESC, o_orderkey) AS place FROM b ORDER BY place LIMIT 50")
def sort_nested_max(t):
    picks = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_extendedprice")).alias("picks"))
    best_pick = F.coalesce(F.array_max(F.transform("picks", lambda p: p["l_extendedprice"])), F.lit(-1.0))
    order = [F.desc("best"), F.asc("o_orderkey")]
    return _numbered(t.orders.select("o_orderkey").join(picks, "o_orderkey", "left").select("o_orderkey", best_pick.alias("best")).orderBy(*order).limit(50), order)


def _numbered(rows, order):
    """Places of a page of rows: few, whatever the table."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@demo("SELECT p_partkey, size, row_number() OVER (ORDER BY size DESC NULLS LAST, p_partkey) AS place FROM (SELECT p_partkey, CASE WHEN p_size <= 30 THEN p_size END AS size FROM part) QUALIFY place > (SELECT count(*) FROM part WHERE p_size <= 30) - 20 ORDER BY place LIMIT 40")
def null_order(t):
    # the page where values end and nulls begin
    rows = t.part.select("p_partkey", F.when(F.col("p_size") <= 30, F.col("p_size")).alias("size"))
    placed = ranked_rows(rows, [F.desc_nulls_last("size"), F.asc("p_partkey")])
    known = rows.agg(F.count("size").alias("known"))  # one row
    return placed.crossJoin(F.broadcast(known)).filter("place > known - 20").orderBy("place").limit(40).drop("known")


@demo("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def page_with_total(t):
    rows = t.orders.filter("o_orderstatus = 'F'")
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.select("o_orderkey").orderBy("o_orderkey").offset(40).limit(20).crossJoin(F.broadcast(total))


#: In the order of a Spanish dictionary: accents count after letters, small before capital, ñ is a letter behind n.
_DICTIONARY = ["árbol", "arca", "canción", "candado", "nube", "Nube", "nutria", "ñandú", "oca", "óptica", "zorro", "Zorro"]


@demo(f"SELECT p_partkey, row_number() OVER (ORDER BY (p_partkey * 7) % {len(_DICTIONARY)}, p_partkey) AS place FROM part")
def locale_sort(t):
    name = F.element_at(F.array(*map(F.lit, _DICTIONARY)), ((F.col("p_partkey") * 7) % len(_DICTIONARY) + 1).cast("int"))
    return ranked_rows(t.part.select("p_partkey", name.alias("name")), [F.collate("name", "es"), F.col("p_partkey")]).select("p_partkey", "place")


@demo("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey <> 33, o_orderdate, o_orderkey) AS place, greatest(count(*) OVER () - 10, 0) AS more FROM orders ORDER BY place LIMIT 10")
def pinned_first(t):
    # the active one, then the rest: ten of them, and how many more there are
    order = [F.col("o_orderkey") != 33, F.asc("o_orderdate"), F.asc("o_orderkey")]
    more = t.orders.agg(F.greatest(F.count("*") - 10, F.lit(0)).alias("more"))  # one row
    return _numbered(t.orders.orderBy(*order).limit(10), order).select("o_orderkey", "place").crossJoin(F.broadcast(more))


@demo("""SELECT c_custkey, array_to_string(list_concat(list_filter(['FRANCE', 'CHINA', 'PERU'], lambda x: x = n_name), list_filter(['FRANCE', 'CHINA', 'PERU'], lambda x: x <> n_name))[1:2], ',') AS allowed FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def allowlist_fill(t):
    allow = F.array(*(F.lit(n) for n in ("FRANCE", "CHINA", "PERU")))
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    mine = F.array("n_name")
    return rows.select("c_custkey", F.array_join(F.slice(F.concat(F.filter(allow, lambda x: F.array_contains(mine, x)), F.filter(allow, lambda x: ~F.array_contains(mine, x))), 1, 2), ",").alias("allowed"))
