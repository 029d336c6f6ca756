"""Joins and expansions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import rules as R
from gleanery.operators import merge as M
from gleanery.operators.expand import expand_requests as expanded_requests
from gleanery.operators.rank import ranked
from gleanery.operators.ranges import range_join as joined_by_range
from gleanery.plans.demo import demo


@demo("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def left_enrich(t):
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return t.orders.join(known, "o_custkey", "left").select("o_orderkey", "c_name", "c_mktsegment")


@demo("SELECT u.user_id, k.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) k LEFT JOIN events e USING (user_id, event_type) GROUP BY ALL")
def coverage_matrix(t):
    known = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    # every kind that there is, as one row; the matrix has a cell for each of them
    kinds = known.select("event_type").distinct().agg(F.collect_list("event_type").alias("kinds"))
    return known.select("user_id").distinct().join(F.broadcast(kinds)).select("user_id", F.explode("kinds").alias("event_type")).join(known, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("c", F.lit(0)).alias("n"))


@demo("""SELECT c_custkey, m AS month FROM customer, (SELECT unnest(range(1, 13)) AS m) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND month(o_orderdate) = m)""")
def pending_members(t):
    done = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.month("o_orderdate").alias("month")).distinct()
    expected = t.customer.select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return expected.join(done, ["c_custkey", "month"], "left_anti").select("c_custkey", F.col("month").cast("bigint").alias("month"))


@demo("""WITH seen AS (SELECT doc_id, text AS key FROM documents WHERE doc_id % 10 = 0) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.key = d.text)""")
def multi_key_anti(t):
    # one equi join over (kind, value) probes in place of a join on either of two keys
    probes = t.documents.select("doc_id", F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("doc_id").cast("string").alias("value")), F.struct(F.lit("key").alias("kind"), F.md5("text").alias("value")))).alias("p")).select("doc_id", "p.*")
    seen = probes.filter("doc_id % 10 = 0").select("kind", "value").distinct()
    return t.documents.select("doc_id").join(probes.join(seen, ["kind", "value"], "left_semi").select("doc_id").distinct(), "doc_id", "left_anti")


@demo("SELECT o_orderkey, o_custkey FROM orders WHERE abs(year(o_orderdate) - (1993 + o_orderkey % 3)) <= 1 OR abs(year(o_orderdate) - (1997 + o_orderkey % 3)) <= 1")
def band_match(t):
    expected = F.array(1993 + F.col("o_orderkey") % 3, 1997 + F.col("o_orderkey") % 3)
    return t.orders.filter(F.exists(expected, lambda e: F.abs(F.year("o_orderdate") - e) <= 1)).select("o_orderkey", "o_custkey")


@demo("""WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) SELECT s_suppkey, coalesce((SELECT n FROM g WHERE l_suppkey = s_suppkey), (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 40)) AS n, s_suppkey IN (SELECT l_suppkey FROM g) AS own FROM supplier""")
def fallback_group(t):
    primary = t.lineitem.filter("l_quantity > 49").select("l_suppkey", F.lit(True).alias("own"))
    secondary = t.lineitem.filter("l_quantity > 40").select("l_suppkey", F.lit(False).alias("own")).join(primary.select("l_suppkey").distinct(), "l_suppkey", "left_anti")
    members = primary.unionByName(secondary).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.bool_or("own").alias("own"))
    return t.supplier.select("s_suppkey").join(members, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("own", F.lit(False)).alias("own"))


@demo("""WITH n AS (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY 1), r AS (SELECT n_regionkey AS k, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey, CASE WHEN coalesce(n.c, 0) >= 5 THEN n.c ELSE coalesce(r.c, 0) END AS suppliers, CASE WHEN coalesce(n.c, 0) >= 5 THEN 'nation' ELSE 'region' END AS origin FROM nation LEFT JOIN n ON n.k = n_nationkey LEFT JOIN r ON r.k = n_regionkey""")
def fallback_source(t):
    own = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("own"))
    region = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("of_region"))
    rows = t.nation.select("n_nationkey", "n_regionkey").join(own, "n_nationkey", "left").join(region, "n_regionkey", "left")
    enough = F.coalesce("own", F.lit(0)) >= 5
    return rows.select("n_nationkey", F.when(enough, F.col("own")).otherwise(F.coalesce("of_region", F.lit(0))).alias("suppliers"), F.when(enough, "nation").otherwise("region").alias("origin"))


_ENRICHED = """b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM orders), s1 AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), s2 AS (SELECT l_orderkey AS k, sum(l_quantity) AS price FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey, round(coalesce(b.price, s1.price, s2.price), 2) AS price, CASE WHEN b.price IS NOT NULL THEN NULL WHEN s1.price IS NOT NULL THEN 'lines' WHEN s2.price IS NOT NULL THEN 'quantity' END AS price_from FROM b LEFT JOIN s1 ON s1.k = o_orderkey LEFT JOIN s2 ON s2.k = o_orderkey)"""


@demo(f"WITH {_ENRICHED} SELECT o_orderkey, price, price_from FROM e")
def coalesce_enrich(t):
    base = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    sources = [("lines", lines.filter("l_returnflag = 'A'").groupBy("o_orderkey").agg(F.sum("l_extendedprice").alias("price"))), ("quantity", lines.groupBy("o_orderkey").agg(F.sum("l_quantity").alias("price")))]
    return M.coalesce_enrich(base, "o_orderkey", sources, ["price"]).withColumn("price", F.round("price", 2))


@demo(f"WITH {_ENRICHED} SELECT coalesce(s.source, e.source) AS source, coalesce(n, 0) AS price FROM (SELECT unnest(['lines', 'quantity', 'own', 'none']) AS source) s LEFT JOIN (SELECT coalesce(price_from, CASE WHEN price IS NULL THEN 'none' ELSE 'own' END) AS source, count(*) AS n FROM e GROUP BY 1) e USING (source)")
def enrich_hits(t):
    return M.source_hits(coalesce_enrich(t), ["lines", "quantity"], ["price"])


@demo("""WITH w AS (SELECT c_custkey AS id, c_custkey AS ord FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_custkey AS id, min(o_orderdate) AS since, count(*) AS open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
m AS (SELECT id, since, open FROM o WHERE id NOT IN (SELECT id FROM w)), u AS (SELECT 0 AS part, id, since, open FROM m UNION ALL SELECT 1, w.id, o.since, coalesce(o.open, 0) FROM w LEFT JOIN o USING (id))
SELECT row_number() OVER (ORDER BY part, CASE WHEN part = 0 THEN since END, id) AS place, id, part = 0 AS resumed, open FROM u""")
def reinject_missing(t):
    # open entities that the list of requests has lost come first again, the longest open one before; then the list as it is
    wanted = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    state = t.orders.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("since"), F.count("*").alias("open"))
    lost = state.join(wanted, "id", "left_anti").select(F.lit(True).alias("resumed"), "id", "since", "open")
    rows = lost.unionByName(wanted.join(state, "id", "left").select(F.lit(False).alias("resumed"), "id", F.lit(None).cast("timestamp_ntz").alias("since"), F.coalesce("open", F.lit(0)).alias("open")))
    return ranked(rows, [F.desc("resumed"), F.asc("since"), F.asc("id")]).select("place", "id", "resumed", "open")


@demo("""WITH a AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL) SELECT DISTINCT e.user_id, coalesce(h.event_type, o.event_type) AS event_type FROM events e LEFT JOIN a h ON h.user_id = e.user_id AND h.event_type = 'signup' LEFT JOIN a o ON o.user_id = e.user_id AND o.event_type = 'purchase'""")
def hinted_lookup(t):
    known = t.events.filter("event_type in ('signup', 'purchase')").select("user_id", "event_type").distinct()
    best = known.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_type") != "signup"))).filter("rn = 1").drop("rn")
    return t.events.select("user_id").distinct().join(best, "user_id", "left")


@demo("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders) SELECT r_name, n_name, c_custkey, count(o_orderkey) AS n_members FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey AND o_orderkey % 5 <> 0 WHERE r_name = 'ASIA' OR n_nationkey = 3 OR c_custkey = 7 GROUP BY ALL""")
def expand_members(t):
    # requests at three grains: a region, a nation, a customer; what is done (every fifth order) is left out
    people = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_nationkey", "n_name", "c_custkey")
    asked = people.filter("r_name = 'ASIA'").unionByName(people.filter("n_nationkey = 3")).unionByName(people.filter("c_custkey = 7")).distinct()
    done = t.orders.filter("o_orderkey % 5 = 0").select("o_orderkey")
    pending = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(done.distinct(), "o_orderkey", "left_anti")
    return asked.join(pending, "c_custkey", "left").groupBy("r_name", "n_name", "c_custkey").agg(F.count("o_orderkey").alias("n_members"))


@demo("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_shipdate) <= TIMESTAMP '1997-01-01' AS available FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1 GROUP BY ALL")
def members_first(t):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")]
    rows = M.first_rows(t.lineitem, ["l_orderkey", "l_linenumber"], order)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_shipdate") <= F.expr("timestamp_ntz'1997-01-01 00:00:00'")).alias("available"))


@demo("""WITH j AS (SELECT doc_id, source, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM documents), w AS (SELECT * FROM j WHERE length(word) >= 3), g AS (SELECT source, CASE WHEN count(*) >= 10 THEN 3 ELSE 2 END AS least FROM documents GROUP BY 1), f AS (SELECT source, word FROM w JOIN g USING (source) GROUP BY source, word, least HAVING count(*) >= least), m AS (SELECT w.doc_id, count(f.word) AS shared FROM w LEFT JOIN f USING (source, word) GROUP BY 1)
SELECT d.doc_id, coalesce(m.shared = 0, false) AND d.source IN (SELECT source FROM f) AS off_topic FROM documents d LEFT JOIN m USING (doc_id)""")
def off_topic(t):
    # a word of a group's vocabulary is in three of its texts, in two where it has fewer than ten; texts without words
    # that can be judged, and groups without a vocabulary, are left alone
    words = t.documents.select("doc_id", "source", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word")).filter("length(word) >= 3")
    least = t.documents.groupBy("source").agg(F.when(F.count("*") >= 10, 3).otherwise(2).alias("least"))
    vocabulary = words.groupBy("source", "word").agg(F.count("*").alias("n")).join(least, "source").filter("n >= least").select("source", "word", F.lit(1).alias("known"))
    shared = words.join(vocabulary, ["source", "word"], "left").groupBy("doc_id").agg(F.count("known").alias("shared"))
    groups = vocabulary.select("source").distinct().withColumn("judged", F.lit(True))
    rows = t.documents.select("doc_id", "source").join(shared, "doc_id", "left").join(groups, "source", "left")
    return rows.select("doc_id", F.coalesce((F.col("shared") == 0) & F.col("judged"), F.lit(False)).alias("off_topic"))


def _members(t):
    """The first row of each member (order, line) with the name of its part, if it has one."""
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")]
    rows = M.first_rows(t.lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return rows.join(t.part.filter("p_size > 10").select("p_partkey", "p_name"), "p_partkey", "left")


_MEMBERS = "m AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn FROM lineitem) LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 10) ON p_partkey = l_partkey WHERE rn = 1)"


@demo(f"""WITH {_MEMBERS} SELECT l_orderkey, l_linenumber, 'Order ' || l_orderkey || ' ' || printf('S%02dE%02d', 1 + l_orderkey % 120, l_linenumber) || coalesce(' – ' || p_name, '') AS label FROM m""")
def member_labels(t):
    # the label of one member: show, tag and title, the title only where it is known
    tag = R.member_tag(1 + F.col("l_orderkey") % 120, F.col("l_linenumber"))
    show = F.concat(F.lit("Order "), F.col("l_orderkey"), F.lit(" "), tag)
    return _members(t).select("l_orderkey", "l_linenumber", F.concat(show, F.coalesce(F.concat(F.lit(" – "), "p_name"), F.lit(""))).alias("label"))


@demo(f"""WITH {_MEMBERS} SELECT o_custkey, count(DISTINCT l_orderkey) AS majors, count(*) AS members FROM m JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def expansion_counts(t):
    rows = _members(t).withColumnRenamed("l_orderkey", "o_orderkey").join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    # members are one row each, so majors are counted by two sums and not by a distinct over all rows
    return rows.groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.count("*").alias("majors"), F.sum("n").alias("members"))


@demo("""WITH w AS (SELECT unnest([3, 1, 7, 99, 20]) AS k, unnest([1, 2, 3, 4, 5]) AS place), u AS (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT place, n_nationkey, n_name, n AS suppliers FROM w JOIN nation ON n_nationkey = k JOIN u ON s_nationkey = k""")
def registry_filter(t):
    # asked sources in the order asked for: those that are registered and usable, with what may be shown of them
    asked = t.spark.createDataFrame([(k, place) for place, k in enumerate([3, 1, 7, 99, 20], 1)], "n_nationkey bigint, place int")
    usable = t.supplier.filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return t.nation.select("n_nationkey", "n_name").join(F.broadcast(asked), "n_nationkey").join(usable, "n_nationkey").select("place", "n_nationkey", "n_name", "suppliers")


@demo("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def keep_pending(t):
    pending = t.orders.filter("o_orderstatus = 'P'").select("o_custkey").distinct()
    return t.orders.join(pending, "o_custkey", "left_semi").select("o_orderkey")


_WINDOWS = "SELECT o_custkey, o_orderkey AS opener, o_orderdate AS opens, CASE WHEN o_orderkey % 7 = 0 THEN 900 ELSE o_orderkey % 23 END AS days FROM orders WHERE o_orderpriority LIKE '1%'"


def _windows(t):
    """Urgent orders open a window for their customer: some days for most, years for every seventh."""
    day = F.datediff("o_orderdate", F.lit("1970-01-01"))
    days = F.when(F.col("o_orderkey") % 7 == 0, 900).otherwise(F.col("o_orderkey") % 23)
    ranges = t.orders.filter("o_orderpriority like '1%'").select("o_custkey", F.col("o_orderkey").alias("opener"), day.alias("low"), (day + days).alias("high"))
    return t.orders.select("o_custkey", "o_orderkey", day.alias("day")), ranges


@demo(f"WITH w AS ({_WINDOWS}) SELECT o_orderkey, opener FROM orders JOIN w USING (o_custkey) WHERE date_diff('day', opens, o_orderdate) BETWEEN 0 AND days")
def range_join(t):
    points, ranges = _windows(t)
    return joined_by_range(points, ranges, ["o_custkey"], "day", "low", "high").select("o_orderkey", "opener")


@demo(f"WITH w AS ({_WINDOWS}) SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.o_custkey = o.o_custkey AND date_diff('day', opens, o_orderdate) BETWEEN 0 AND days)")
def range_anti_join(t):
    points, ranges = _windows(t)
    return joined_by_range(points, ranges, ["o_custkey"], "day", "low", "high", "left_anti").select("o_orderkey")


_EXPANSION = """WITH ent AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 7 = 0 THEN 'single' ELSE 'group' END AS kind, c_name AS name, 1992 + c_nationkey % 7 AS year FROM customer WHERE c_custkey % 11 <> 3),
req AS (SELECT c_custkey AS entity, c_custkey AS ord, CASE WHEN c_custkey % 6 = 3 THEN 'single' ELSE 'group' END AS kind, CASE c_custkey % 6 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 0 END AS major, CASE WHEN c_custkey % 6 = 2 THEN 5 END AS minor,
CASE c_custkey % 3 WHEN 1 THEN 'Label ' || c_custkey || ' S02E01' WHEN 2 THEN c_name || ' (' || (1992 + c_nationkey % 7 + 3) || ')' END AS label FROM customer WHERE c_custkey % 5 <> 4
UNION ALL SELECT c_custkey, 1000000000 + c_custkey, 'group', 1, 3, 'Extra' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 2000000000 + c_custkey, 'single', NULL, NULL, c_name || ' (2020)' FROM customer WHERE c_custkey % 14 = 0),
mem AS (SELECT o_custkey AS entity, year(o_orderdate) - 1992 AS major, month(o_orderdate) AS minor, arg_min(o_orderpriority, o_orderkey) AS title FROM orders WHERE o_orderdate <= TIMESTAMP '1997-07-01' GROUP BY ALL),
fal AS (SELECT c_custkey AS entity, m // 10 AS major, m % 10 AS minor, NULL AS title FROM customer, (SELECT unnest([11, 12, 13, 21]) AS m) WHERE c_custkey % 2 = 0),
don AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) - 1992 AS major, month(o_orderdate) AS minor FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0),
ask AS (SELECT r.*, e.kind AS known, e.name, e.year, CASE WHEN r.kind = 'group' AND e.kind = 'single' THEN 'conflict' WHEN r.kind = 'group' AND major IS NULL OR r.kind = 'single' AND e.kind = 'group' THEN 'whole' WHEN r.kind = 'single' THEN 'single' WHEN minor IS NOT NULL THEN 'member' ELSE 'major' END AS grain,
coalesce(CASE WHEN label LIKE 'Label %' THEN 'Label ' || r.entity WHEN label LIKE '% (%' THEN left(label, length(label) - 7) ELSE label END, e.name, CAST(r.entity AS VARCHAR)) AS shown FROM req r LEFT JOIN ent e USING (entity)),
own AS (SELECT ord, entity, shown, m.major, m.minor, title FROM ask JOIN mem m USING (entity) WHERE grain = 'whole' AND m.major >= 1 OR grain = 'major' AND m.major = ask.major),
exp AS (SELECT * FROM own UNION ALL SELECT ord, entity, shown, m.major, m.minor, title FROM ask JOIN fal m USING (entity) WHERE ord NOT IN (SELECT ord FROM own) AND (grain = 'whole' AND m.major >= 1 OR grain = 'major' AND m.major = ask.major)),
pen AS (SELECT exp.* FROM exp ANTI JOIN don USING (entity, major, minor)),
cnt AS (SELECT ord, count(*) AS n, (SELECT count(*) FROM pen WHERE pen.ord = exp.ord) AS pending, (SELECT count(DISTINCT major) FROM pen WHERE pen.ord = exp.ord) AS majors FROM exp GROUP BY ord)"""


def _requests(t, **limits):
    """Customers as entities, their orders as members (year, month): requests of every grain, conflicts and repeats among them."""
    c, key = t.customer, F.col("c_custkey")
    year, entity = (1992 + F.col("c_nationkey") % 7).cast("int"), key.alias("entity")
    entities = c.filter("c_custkey % 11 <> 3").select(entity, F.when(key % 7 == 0, "single").otherwise("group").alias("kind"), F.col("c_name").alias("name"), year.alias("year"), F.lit(None).cast("int").alias("year_end"))
    label = F.when(key % 3 == 1, F.concat(F.lit("Label "), key, F.lit(" S02E01"))).when(key % 3 == 2, F.concat("c_name", F.lit(" ("), year + 3, F.lit(")")))
    major = F.when(key % 6 == 1, 2).when(key % 6 == 2, 3).when(key % 6 == 4, 0)
    requests = c.filter("c_custkey % 5 <> 4").select(entity, key.alias("ord"), F.when(key % 6 == 3, "single").otherwise("group").alias("kind"), major.alias("major"), F.when(key % 6 == 2, 5).alias("minor"), label.alias("label"))
    none = F.lit(None).cast("int")
    requests = requests.unionByName(c.filter("c_custkey % 4 = 0").select(entity, (1_000_000_000 + key).alias("ord"), F.lit("group").alias("kind"), F.lit(1).alias("major"), F.lit(3).alias("minor"), F.lit("Extra").alias("label")))
    requests = requests.unionByName(c.filter("c_custkey % 14 = 0").select(entity, (2_000_000_000 + key).alias("ord"), F.lit("single").alias("kind"), none.alias("major"), none.alias("minor"), F.concat("c_name", F.lit(" (2020)")).alias("label")))
    at = [F.col("o_custkey").alias("entity"), (F.year("o_orderdate") - 1992).alias("major"), F.month("o_orderdate").alias("minor")]
    members = t.orders.select(*at, F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("released"), F.col("o_orderkey").alias("pos"))
    spare = F.explode(F.array(*(F.struct(F.lit(a).alias("major"), F.lit(b).alias("minor")) for a, b in ((1, 1), (1, 2), (1, 3), (2, 1))))).alias("m")
    fallback = c.filter("c_custkey % 2 = 0").select(entity, spare).select("entity", "m.*", F.lit(None).cast("string").alias("title"), F.lit(None).cast("timestamp_ntz").alias("released"), F.lit(0).alias("pos"))
    done = t.orders.filter("o_orderstatus = 'F' and o_orderkey % 3 = 0").select(*at)
    return expanded_requests(requests, entities, members, now=F.expr("timestamp_ntz'1997-06-30 00:00:00'"), fallback=fallback, done=done, **limits)


_TAG = "shown || printf(' S%02dE%02d', {0}.major, {0}.minor) || coalesce(' – ' || title, '')"
_ALONE = f"""one AS (SELECT 'group' AS kind, ask.entity, ask.major, ask.minor, coalesce(label, {_TAG.format("ask")}) AS label, ord FROM ask LEFT JOIN mem m ON m.entity = ask.entity AND m.major = ask.major AND m.minor = ask.minor WHERE grain = 'member'
UNION ALL SELECT 'single', entity, NULL, NULL, coalesce(label, name || ' (' || year || ')'), ord FROM ask WHERE grain = 'single')"""
_ONCE = "SELECT kind, entity, major, minor, coalesce(arg_min(label, ord) FILTER (label <> CAST(entity AS VARCHAR) AND label <> ''), arg_min(label, ord)) AS label, min(ord) AS ord FROM every GROUP BY kind, entity, major, minor"


@demo(f"""{_EXPANSION}, {_ALONE}, every AS (SELECT 'group' AS kind, entity, major, minor, {_TAG.format("pen")} AS label, ord FROM pen UNION ALL SELECT * FROM one) {_ONCE}""")
def expand_requests(t):
    return _requests(t)[0]


@demo(f"""{_EXPANSION}, {_ALONE}, cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ord, major, minor) AS turn, min(ord) OVER (PARTITION BY entity) AS first FROM pen) ORDER BY turn, first, entity LIMIT 230),
every AS (SELECT 'group' AS kind, entity, major, minor, {_TAG.format("cap")} AS label, ord FROM cap UNION ALL SELECT * FROM one) {_ONCE}""")
def expand_capped(t):
    # the cap shares expanded members out among entities; explicit ones come in any case
    return _requests(t, most=230)[0]


@demo(f"""{_EXPANSION}, w AS (SELECT entity, ord, name, year, label, known, coalesce(n, 0) AS n, coalesce(pending, 0) AS pending, majors, CASE WHEN grain = 'conflict' THEN 'type_conflict' WHEN grain IN ('whole', 'major') AND coalesce(n, 0) = 0 THEN 'no_members' WHEN grain IN ('whole', 'major') AND pending = 0 THEN 'all_done'
WHEN grain = 'whole' AND kind = 'single' AND n = pending THEN 'expanded' WHEN grain = 'single' AND regexp_extract(label, '[(]([0-9]{{4}})[)]', 1) <> '' AND NOT CAST(regexp_extract(label, '[(]([0-9]{{4}})[)]', 1) AS INT) BETWEEN year - 1 AND year + 1 THEN 'label_mismatch' END AS reason FROM ask LEFT JOIN cnt USING (ord))
SELECT 'expand' AS stage, entity, reason, CASE reason WHEN 'no_members' THEN CASE WHEN known IS NULL THEN 'not known' ELSE 'none available' END WHEN 'expanded' THEN majors || ' majors, ' || pending || ' members' ELSE coalesce(name || ' (' || year || ')', CAST(entity AS VARCHAR)) END AS detail, ord FROM w WHERE reason IS NOT NULL""")
def expansion_warnings(t):
    return _requests(t)[1]
