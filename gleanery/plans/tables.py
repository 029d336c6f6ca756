"""Sinks, state and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.rules import csv_guarded
from gleanery.operators import merge as M
from gleanery.plans.demo import DEMOS, demo
from gleanery.sources.tables import scratch
from gleanery.streaming import stateful, streams
from gleanery.streaming.breakers import COUNTERS, breaker_stream
from gleanery.streaming.first_wins import first_wins
from gleanery.streaming.upserts import UpsertTable, upsert_stream

_DELTA = "SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0"


def delta(t):
    return t.orders.filter("o_orderkey % 2 = 0").select(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") + 10000000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))


@demo(f"""WITH d AS ({_DELTA}) SELECT o_orderkey, coalesce(d.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(d.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_custkey AS o_custkey, CASE WHEN o.o_custkey IS NULL THEN 'inserted' WHEN d.o_orderstatus IS NULL THEN 'kept' ELSE 'updated' END AS action FROM orders o FULL JOIN d USING (o_orderkey)""")
def upsert_coalesce(t):
    target = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    return M.upsert(target, delta(t), "o_orderkey")


@demo(f"WITH d AS ({_DELTA}) SELECT o_orderkey IN (SELECT o_orderkey FROM orders) AS existing, count(*) AS n FROM d GROUP BY 1")
def upsert_split(t):
    new, keys = delta(t), t.orders.select("o_orderkey")
    fresh, old = new.join(keys, "o_orderkey", "left_anti"), new.join(keys, "o_orderkey", "left_semi")
    return fresh.withColumn("existing", F.lit(False)).unionByName(old.withColumn("existing", F.lit(True))).groupBy("existing").agg(F.count("*").alias("n"))


_LINES = """d AS (SELECT CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END AS o_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS o_totalprice, l_linestatus AS o_orderstatus, l_quantity, row_number() OVER (PARTITION BY CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END, l_quantity >= 5 ORDER BY l_linenumber, l_extendedprice, l_returnflag, l_linestatus, l_quantity) AS place FROM lineitem), r AS (SELECT *, CASE WHEN l_quantity < 5 THEN 'invalid' WHEN place > 1 THEN 'duplicate' END AS reason FROM d)"""


def _from_lines(t, seen=None):
    """A delta of many rows a key, some of them not valid."""
    key = F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey") + 10000000).otherwise(F.col("l_orderkey"))
    new = t.lineitem.select(key.alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("o_totalprice"), F.col("l_linestatus").alias("o_orderstatus"), "l_quantity", "l_linenumber", "l_extendedprice", "l_returnflag")
    order = [F.col(c) for c in ("l_linenumber", "l_extendedprice", "l_returnflag", "o_orderstatus", "l_quantity")]
    return M.upsert_checked(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey"), new, "o_orderkey", F.col("l_quantity") >= 5, order, seen)


@demo(f"""WITH {_LINES}, k AS (SELECT * FROM r WHERE reason IS NULL) SELECT o_orderkey, coalesce(k.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(k.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_custkey AS o_custkey, CASE WHEN o.o_custkey IS NULL THEN 'inserted' WHEN k.place IS NULL THEN 'kept' ELSE 'updated' END AS action FROM orders o FULL JOIN k USING (o_orderkey)""")
def upsert_first_wins(t):
    return _from_lines(t)[0]


@demo(f"""WITH {_LINES}, x AS (SELECT o_orderkey, CASE WHEN reason = 'invalid' THEN reason WHEN o_orderkey % 13 = 0 THEN 'seen' ELSE reason END AS reason FROM r), a AS (SELECT coalesce(reason, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders) THEN 'updated' ELSE 'inserted' END) AS outcome FROM x)
SELECT outcome, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x WHERE reason IS NULL)""")
def upsert_report(t):
    # every row has one outcome: rejected, seen before, a repeat, or written; and what the table keeps as it is
    merged, rejected = _from_lines(t, t.lineitem.filter("l_orderkey % 13 = 0").select(F.col("l_orderkey").alias("o_orderkey")).unionByName(t.lineitem.select((F.col("l_orderkey") + 10_000_000).alias("o_orderkey")).filter("o_orderkey % 13 = 0")))
    return merged.select(F.col("action").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@demo("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_wins(t):
    return M.first_rows(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "ts", "event_id")


@demo("SELECT event_id, CASE WHEN regexp_matches(cell, '^[=+@-]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '=' ELSE '' END || event_type AS cell FROM events)")
def csv_guard(t):
    return t.events.select("event_id", csv_guarded(F.concat(F.when(F.col("event_type") == "error", "=").otherwise(""), "event_type")).alias("cell"))


@demo("""SELECT source, lang, CASE lang WHEN 'es' THEN 'Español' ELSE 'English' END AS label, min(doc_id) AS doc_id FROM documents WHERE lang IN ('en', 'es') GROUP BY ALL""")
def flat_export(t):
    labels = F.create_map(*(F.lit(x) for x in ("es", "Español", "en", "English")))
    picks = t.documents.filter(F.col("lang").isin("en", "es")).groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    items = picks.groupBy("source").agg(F.collect_list(F.struct("lang", "doc_id")).alias("picks"))
    return items.select("source", F.inline("picks")).select("source", "lang", F.element_at(labels, F.col("lang")).alias("label"), "doc_id")


@demo("SELECT '# ' || p_name || chr(10) || p_partkey AS value FROM part")
def text_export(t):
    return t.part.select(F.format_string("# %s\n%d", "p_name", "p_partkey").alias("value"))


@demo("SELECT lang AS kind, source, min(doc_id) AS doc_id FROM documents WHERE n_chars > 500 GROUP BY ALL")
def catalog_rollup(t):
    return M.first_rows(t.documents.filter("n_chars > 500"), ["lang", "source"], [F.col("doc_id")]).select(F.col("lang").alias("kind"), "source", "doc_id")


@demo("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500")
def bounded_scan(t):
    return t.orders.select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(500)


@demo("SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION SELECT 'order', CAST(l_orderkey AS VARCHAR) FROM lineitem UNION SELECT 'part', CAST(l_partkey AS VARCHAR) FROM lineitem")
def seen_union(t):
    def of(rows, kind, c):
        return rows.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))

    return of(t.orders, "order", "o_orderkey").unionByName(of(t.lineitem, "order", "l_orderkey")).unionByName(of(t.lineitem, "part", "l_partkey")).distinct()


@demo("""WITH n AS (SELECT user_id, count(*) AS done, max(event_id) AS last_id FROM events WHERE event_id % 2 = 1 GROUP BY 1), o AS (SELECT user_id, count(*) AS done, max(event_id) AS last_id, min(ts) AS started_at FROM events WHERE event_id % 2 = 0 GROUP BY 1), s AS (SELECT user_id, min(ts) AS started_at FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, coalesce(o.done, 0) + coalesce(n.done, 0) AS done, greatest(coalesce(o.last_id, -1), coalesce(n.last_id, -1)) AS last_id, coalesce(o.started_at, s.started_at) AS started_at, CASE WHEN coalesce(o.done, 0) + coalesce(n.done, 0) >= 60 THEN 'complete' ELSE 'active' END AS status FROM o FULL JOIN n USING (user_id) LEFT JOIN s USING (user_id)""")
def progress_advance(t):
    def state(rows):
        return rows.groupBy("user_id").agg(F.count("*").alias("done"), F.max("event_id").alias("last_id"), F.min("ts").alias("started_at"))

    return streams.advanced(state(t.events.filter("event_id % 2 = 0")), state(t.events.filter("event_id % 2 = 1")), "user_id", complete_at=60)


@demo("SELECT count(*) AS n, sum(event_id) AS ids FROM events")
def stream_ingest(t):
    return streams.ingested(t.spark, f"{t.sf_dir}/events.parquet").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_ADMITTED = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_type, ts, event_id, value, rn, ts AS won_at, true AS won FROM r WHERE rn = 1
UNION ALL SELECT r.user_id, r.event_type, r.ts, r.event_id, r.value, r.rn, CASE WHEN r.ts >= won_at + INTERVAL 2 DAY THEN r.ts ELSE won_at END, r.ts >= won_at + INTERVAL 2 DAY FROM f JOIN r ON r.user_id = f.user_id AND r.event_type = f.event_type AND r.rn = f.rn + 1)
SELECT user_id, event_type, ts, event_id, value FROM f WHERE won"""


@demo(_ADMITTED)
def stream_dedupe(t):
    # of each user and kind the first event wins for two days; events come in three batches by time
    events = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    rows = streams.in_slices(events.withColumn("day", F.unix_date(F.to_date("ts"))), "day", 3).drop("day")
    won = first_wins(rows, ["user_id", "event_type"], "ts", "event_id", within=2 * 86_400_000_000)
    return won.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_SLICED = "s AS (SELECT *, event_id // ((SELECT max(event_id) - min(event_id) FROM events) // 3 + 1) AS slice FROM events)"


@demo("""WITH s AS (SELECT *, event_id * 7 % 3 AS slice FROM events), m AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 20 DAY AS mark FROM s GROUP BY slice)
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS total FROM s JOIN m USING (slice) WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY ALL""")
def stream_metrics(t):
    # three batches that each go through all days again. Windows over twenty days behind what a batch has seen are closed when the next one
    # is through: the third batch's rows of such windows are dropped
    rows = streams.in_slices(t.events.withColumn("part", F.col("event_id") * 7 % 3), "part", 3)
    return streams.windowed_metrics(rows, "1 hour", late="20 days").select("event_type", F.col("start").cast("timestamp_ntz").alias("hour"), "n", "total")


_FIRST = "(SELECT user_id, CASE WHEN event_type <> 'view' THEN value END AS value, event_type, ts, event_id // ((SELECT max(event_id) - min(event_id) FROM events) // 3 + 1) AS slice FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY slice, user_id ORDER BY ts, event_id) = 1)"


@demo(f"""WITH b AS {_FIRST} SELECT user_id, arg_max(value, slice) AS value, arg_max(event_type, slice) AS event_type, arg_max(ts, slice) AS ts FROM b GROUP BY user_id""")
def stream_upsert(t):
    return _upserted(t).rows().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@demo(f"""WITH s AS (SELECT *, event_id // ((SELECT max(event_id) - min(event_id) FROM events) // 3 + 1) AS slice FROM events), b AS {_FIRST},
o AS (SELECT slice, CASE WHEN EXISTS (SELECT 1 FROM b e WHERE e.user_id = b.user_id AND e.slice < b.slice) THEN 'updated' ELSE 'inserted' END AS outcome FROM b
UNION ALL SELECT slice, 'invalid' FROM s WHERE event_type = 'error'
UNION ALL SELECT slice, 'duplicate' FROM (SELECT slice, row_number() OVER (PARTITION BY slice, user_id ORDER BY ts, event_id) AS rn FROM s WHERE event_type <> 'error') WHERE rn > 1)
SELECT slice AS batch, outcome, count(*) AS n FROM o GROUP BY ALL""")
def stream_upsert_counters(t):
    return _upserted(t).counters()


def _upserted(t):
    """One row per user after three batches by event_id: of a batch the user's first event that is no error; a view tells no value."""
    rows = streams.in_slices(t.events, "event_id", 3)
    rows = rows.select("user_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), "event_type", "ts", "event_id")
    state = UpsertTable(t.spark, scratch(t.spark), "user_id bigint, value double, event_type string, ts timestamp", "user_id", buckets=16)
    return upsert_stream(rows, state, F.col("event_type") != "error", [F.col("ts"), F.col("event_id")])


@demo("""WITH RECURSIVE r AS (SELECT user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, 0 AS ok, 0 AS errors, 0 AS skipped, 0 AS opened, 0 AS streak, TIMESTAMP '1900-01-01' AS until FROM events
UNION ALL SELECT f.user_id, r.rn, ok + (ts >= until AND NOT bad)::INT, errors + (ts >= until AND bad)::INT, skipped + (ts < until)::INT, opened + (ts >= until AND bad AND streak = 1)::INT,
CASE WHEN ts < until THEN 0 WHEN bad AND streak = 0 THEN 1 ELSE 0 END, CASE WHEN ts >= until AND bad AND streak = 1 THEN ts + INTERVAL 1 DAY ELSE until END
FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
SELECT user_id, max(ok) AS ok, max(errors) AS errors, max(skipped) AS skipped, max(opened) AS opened FROM f GROUP BY user_id""")
def stream_breaker(t):
    # two errors in a row stop a user for a day; then the user may try again. Events come in two batches by time
    rows = streams.in_slices(t.events.select("user_id", "ts", "event_id", "event_type", F.unix_date(F.to_date("ts")).alias("day")), "day", 2)
    found = breaker_stream(rows, "user_id", "ts", "event_id", F.col("event_type") == "error", most=2, cool_down=86_400_000_000)
    return found.select("user_id", *COUNTERS)


@demo(DEMOS["failure_streaks"][1])
def stream_failures(t):
    return stateful.streak_stream(t.spark, f"{t.sf_dir}/events.parquet", 2)


@demo(f"""WITH {_SLICED}, f AS (SELECT user_id, min(ts) AS started_at FROM s JOIN (SELECT user_id, min(slice) AS slice FROM s GROUP BY 1) USING (user_id, slice) GROUP BY 1)
SELECT user_id, count(*) AS done, max(event_id) AS last_id, any_value(started_at) AS started_at, CASE WHEN count(*) >= 60 THEN 'complete' ELSE 'active' END AS status FROM s JOIN f USING (user_id) GROUP BY user_id""")
def stream_progress(t):
    # three batches: the start is that of the first batch, counts add up
    return stateful.progress_stream(streams.in_slices(t.events, "event_id", 3), 60)
