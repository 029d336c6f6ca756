"""Projections and filters: one query for each normalisation job."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import metadata as MD
from gleanery.functions import notations as N
from gleanery.functions import rules as R
from gleanery.functions import titles as TT
from gleanery.operators.values import once_per_value
from gleanery.plans.demo import demo
from gleanery.sources import tables as T

METAL = [("copper", "COPPER"), ("steel", "STEEL"), ("brass", "BRASS"), ("tin", "TIN"), ("nickel", "NICKEL")]
FINISH = [("economy", "ECONOMY"), ("promo", "PROMO"), ("standard", "STANDARD"), ("small", "SMALL"), ("medium", "MEDIUM"), ("large", "LARGE")]
#: Words that tell a language; the patterns stay within what all regex engines share.
LANG_WORDS = [("en", "(^|[^a-z])(the|and|of)([^a-z]|$)"), ("de", "(^|[^a-z])(der|und|die)([^a-z]|$)"), ("fr", "(^|[^a-z])(les|une|des)([^a-z]|$)"), ("es", "(^|[^a-z])(los|las|que)([^a-z]|$)")]


def _case(rules, text):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{label}'" for label, p in rules) + " END"


@demo("SELECT doc_id, sha1(text) AS key, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha1(text) END AS valid_key FROM documents")
def key_validate(t):
    raw = F.when(F.col("doc_id") % 7 == 0, F.left(F.sha1("text"), F.lit(39))).otherwise(F.concat(F.lit(" "), F.upper(F.sha1("text"))))
    return t.documents.select("doc_id", F.sha1("text").alias("key"), R.valid_key(raw).alias("valid_key"))


@demo("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(coalesce(CASE WHEN l_discount > 0.05 AND l_quantity > 3 THEN l_quantity END, CASE WHEN l_returnflag = 'R' THEN l_partkey END, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END) AS BIGINT) AS chosen,
CASE WHEN l_discount > 0.05 AND l_quantity > 3 THEN 'field' WHEN l_returnflag = 'R' THEN 'text' WHEN l_suppkey % 3 > 0 THEN 'weak' END AS origin FROM lineitem""")
def priority_coalesce(t):
    # a number of its own beats one in the first line of a text, which beats one further down; '?' is unknown, and 3 or less is no valid field
    field = F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))
    text = F.concat(F.lit("n: "), F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")).otherwise("?"), F.lit("\nelse n="), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey").cast("string")).otherwise("?"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(field > 3, field).cast("bigint").alias("field"), text.alias("text"))
    found = lambda pattern: F.regexp_extract("text", pattern, 1).try_cast("bigint")
    strong, weak = found("^n: ([0-9]+)"), found("\\nelse n=([0-9]+)")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("field", strong, weak).alias("chosen"), F.when(F.col("field").isNotNull(), "field").when(strong.isNotNull(), "text").when(weak.isNotNull(), "weak").alias("origin"))


@demo("""WITH s AS (SELECT *, l_quantity * (1 + l_partkey % 5) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(q * 1073741824.0 + 0.5) AS BIGINT) AS bytes, CASE WHEN q >= 100 THEN printf('%d GB', CAST(q AS BIGINT)) ELSE printf('%.1f GB', q) END AS shown FROM s""")
def size_units(t):
    text = F.concat(F.replace(F.format_string("%.1f", F.col("l_quantity") * (1 + F.col("l_partkey") % 5)), F.lit("."), F.lit(",")), F.lit(" GiB"))
    size = R.size_bytes(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", size.cast("bigint").alias("bytes"), R.size_text(size).alias("shown"))


@demo(f"SELECT p_partkey, {_case(METAL, 'p_type')} AS metal, coalesce({_case(FINISH, 'p_type')}, {_case(FINISH, 'upper(p_name)')}) AS finish FROM part")
def classify_first(t):
    return t.part.select("p_partkey", R.first_match(METAL, F.col("p_type")).alias("metal"), R.first_match(FINISH, F.col("p_type"), F.upper("p_name")).alias("finish"))


@demo("""WITH m AS (SELECT doc_id, regexp_matches(text, '[|]') AS tbl, regexp_matches(text, '!!') AS shout, regexp_matches(text, '[#$%&*]') AS signs, regexp_matches(text, '[A-Z]{4}') AS caps, regexp_matches(text, '[0-9]') AS digits FROM documents),
l AS (SELECT doc_id, list_filter([CASE WHEN tbl THEN 'table' END, CASE WHEN shout THEN 'shout' END, CASE WHEN signs THEN 'signs' END, CASE WHEN caps AND NOT shout THEN 'caps' END, CASE WHEN digits THEN 'digits' END], lambda x: x IS NOT NULL)[1:3] AS tags FROM m)
SELECT doc_id, array_to_string(tags, ' · ') AS label FROM l""")
def tag_all(t):
    rules = [("table", "[|]"), ("shout", "!!"), ("signs", "[#$%&*]"), ("caps", "[A-Z]{4}"), ("digits", "[0-9]")]
    return t.documents.select("doc_id", F.concat_ws(" · ", R.all_tags(rules, F.col("text"), {"shout": ["caps"]}, 3)).alias("label"))


_LANGS = ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{label}' END" for label, p in LANG_WORDS)


@demo(f"""WITH d AS (SELECT doc_id, lang, regexp_replace(lower(text), 'licensed under[^\\n]*', ' ', 'g') AS x FROM documents)
SELECT doc_id, array_to_string(list_filter([{_LANGS}], lambda v: v IS NOT NULL), ',') AS found, list_contains([{_LANGS}], lang) AS agrees FROM d""")
def lang_detect(t):
    # notices of a license don't tell the text's language: they go first
    found = R.all_tags(LANG_WORDS, F.regexp_replace(F.lower("text"), "licensed under[^\\n]*", " "))
    return t.documents.select("doc_id", F.concat_ws(",", found).alias("found"), F.array_contains(found, F.col("lang")).alias("agrees"))


@demo("""SELECT doc_id, source, array_to_string(CASE WHEN source IN ('src1', 'src2', 'src3') AND lang <> 'pt' AND NOT contains(source, '2') THEN [lang, 'pt'] ELSE [lang] END, '+') AS langs FROM documents""")
def source_defaults(t):
    dim = t.spark.createDataFrame([("src1", ["pt"], ["src2"]), ("src2", ["pt"], ["2"]), ("src3", ["pt"], [])], "source string, defaults array<string>, unless array<string>")
    rows = t.documents.select("doc_id", "source", "lang").join(F.broadcast(dim), "source", "left")
    named = F.when(F.col("defaults").isNotNull() & ~F.exists("unless", lambda x: F.contains(F.col("source"), x)), F.array_union(F.array("lang"), "defaults")).otherwise(F.array("lang"))
    return rows.select("doc_id", "source", F.concat_ws("+", named).alias("langs"))


@demo("""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^(Licensed|Released)')), chr(10))) AS kept FROM documents""")
def line_filter(t):
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~line.rlike("^(Licensed|Released)")), "\n")
    return t.documents.select("doc_id", F.md5(kept).alias("kept"))


@demo("""WITH p AS (SELECT page_id, string_split(split_part(split_part(url, '#', 1), '?', 2), '&') AS kv FROM pages)
SELECT page_id, array_to_string(list_distinct(list_transform(list_filter(kv, lambda x: starts_with(x, 'utm_source=')), lambda x: substr(x, 12))), ',') AS utm_source,
array_to_string(list_transform(list_filter(kv, lambda x: starts_with(x, 'page=')), lambda x: substr(x, 6)), ',') AS page_no FROM p""")
def url_params(t):
    return t.pages.select("page_id", F.concat_ws(",", R.param_values(F.col("url"), "utm_source")).alias("utm_source"), F.concat_ws(",", R.param_values(F.col("url"), "page")).alias("page_no"))


#: Behind the first line of a text, by its id.
_SUFFIXES = ["", " (2001–2004)", " S01E02 more", " – season 2 x", " 1x02", " Temporada 3", " (1999)", " s04"]


@demo(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] || [{", ".join(f"'{x}'" for x in _SUFFIXES)}][doc_id % {len(_SUFFIXES)} + 1] AS t FROM documents),
k AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(strip_accents(t), '{TT.YEARS}', ' ', 'g'), '{TT.TAG}', ' ')), '[^a-z0-9]+', ' ', 'g')) AS k FROM d) SELECT doc_id, CASE WHEN k <> '' AND NOT regexp_full_match(k, 'tt[0-9]{{7,10}}') THEN k END AS title_key FROM k""")
def title_key(t):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % len(_SUFFIXES) + 1).cast("int"))
    return t.documents.select("doc_id", TT.title_key(F.concat(F.split("text", "\n")[0], suffix)).alias("title_key"))


@demo("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(':', l_orderkey, l_linenumber) AS item_key, 'S' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || 'E' || CASE WHEN length(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) < 2 THEN lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 2, '0') ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS tag FROM lineitem""")
def composite_key(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.composite_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("item_key"), R.member_tag(F.col("l_linenumber"), F.col("l_quantity").cast("bigint")).alias("tag"))


_STOP = ["the", "and", "les", "des", "der", "die", "und", "que"]


@demo(f"""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({_STOP}, w))) AS w FROM documents)
SELECT doc_id, len(w) AS n_words, list_max(w) AS last_word FROM d""")
def sig_words(t):
    words = TT.significant_words(F.col("text"), _STOP)
    return t.documents.select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.array_max("w").alias("last_word"))


@demo("""SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1995 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS years FROM orders""")
def year_mentions(t):
    text = F.concat(F.lit("order "), F.col("o_orderkey") % 1000, F.lit(" of "), F.date_format("o_orderdate", "yyyy/MM/dd"))
    years = R.years_in(text, F.array(F.lit(1995)), 1970, 2030)
    return t.orders.select("o_orderkey", F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"))


#: Texts of a record (file, title) that name members a to b of major s, or majors s to u, by notation; and what they name,
#: as (major low, major high, minor low, minor high), null: nothing. The SQL knows the numbers and never reads the text.
_NAMED = [
    ("NULL", "format_string('Show.S%02dE%02d-E%02d.x264', s, a, b)", "s, s, a, CASE WHEN b BETWEEN a AND a + 50 THEN b ELSE a END"),
    ("format_string('show.%dx%02d.mkv', s, a)", "'Show S09E09 pack'", "s, s, a, a"),
    ("'5.1x264'", "format_string('Show %dx%02d-%02d', s, a, b)", "s, s, a, CASE WHEN b BETWEEN a AND a + 50 THEN b ELSE a END"),
    ("'plain'", "format_string('Show [Cap.%d%02d_%d%02d]', s, a, s, b)", "s, s, a, CASE WHEN b BETWEEN a AND a + 50 THEN b ELSE a END"),
    ("format_string('s%de%d', s, a)", "NULL", "s, s, a, a"),
    ("'x'", "format_string('Show S%02d-S%02d 1080p', s, u)", "s, u, NULL, NULL"),
    ("NULL", "format_string('Show temporadas %d a %d', s, u)", "s, u, NULL, NULL"),
    ("NULL", "format_string('Show T%02d completa', s)", "s, s, NULL, NULL"),
    ("'T4 in a file name tells nothing'", "'H.264 5.1x264 (2004)'", "NULL, NULL, NULL, NULL"),
    ("NULL", "format_string('S%02dE%02dE%02d', s, a, b)", "s, s, a, CASE WHEN b BETWEEN a AND a + 50 THEN b ELSE a END"),
]
_MEMBERS = "1 + l_orderkey % 4 AS s, 3 + l_orderkey % 4 AS u, 2 + l_suppkey % 30 AS a, CASE WHEN l_partkey % 11 = 0 THEN 99 ELSE 2 + l_partkey % 40 END AS b, 1 + l_partkey % 5 AS major, 1 + l_suppkey % 37 AS minor"
_SPANS = " ".join(f"WHEN {k} THEN [{named}]" for k, (_, _, named) in enumerate(_NAMED))


@demo(f"""WITH m AS (SELECT *, {_MEMBERS} FROM lineitem), r AS (SELECT *, CASE (l_partkey + l_linenumber) % {len(_NAMED)} {_SPANS} END AS r FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN r[1] IS NULL OR l_suppkey % 17 = 0 THEN 'unknown' WHEN major BETWEEN r[1] AND r[2] AND (r[3] IS NULL OR minor BETWEEN r[3] AND r[4]) THEN 'match' ELSE 'mismatch' END AS evidence FROM r""")
def range_match(t):
    # members are named in the file name or the title, in many notations; every 17th supplier's member is not known
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_MEMBERS.split(", "))
    form = (F.col("l_partkey") + F.col("l_linenumber")) % len(_NAMED)
    file, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (f, x, _) in enumerate(_NAMED):
        file, title = F.when(form == k, F.expr(f)).otherwise(file), F.when(form == k, F.expr(x)).otherwise(title)
    minor = F.when(F.col("l_suppkey") % 17 != 0, F.col("minor"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "major", minor.alias("minor"), file.alias("file"), title.alias("title"))
    # a file name or title comes again and again: what it names is read once for each
    rows = once_per_value(rows, ["file"], lambda r: r.withColumn("of_file", N.member_ranges(F.col("file"))))
    rows = once_per_value(rows, ["title"], lambda r: r.withColumns({"of_title": N.member_ranges(F.col("title")), "majors": N.major_ranges(F.col("title"))}))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.evidence_of(*map(F.col, ("major", "minor", "of_file", "of_title", "majors"))).alias("evidence"))


@demo("""SELECT doc_id, CASE WHEN lang = 'es' AND source = 'src1' THEN 3 WHEN lang = 'es' THEN 2 WHEN contains(text, 'que') THEN 1 ELSE 0 END AS es_tier, CASE WHEN lang = 'en' THEN 2 WHEN contains(text, 'the') THEN 1 ELSE 0 END AS en_tier FROM documents""")
def tiers(t):
    es = F.when((F.col("lang") == "es") & (F.col("source") == "src1"), 3).when(F.col("lang") == "es", 2).when(F.contains("text", F.lit("que")), 1).otherwise(0)
    return t.documents.select("doc_id", es.alias("es_tier"), F.when(F.col("lang") == "en", 2).when(F.contains("text", F.lit("the")), 1).otherwise(0).alias("en_tier"))


SCORE_SQL = """floor((CASE WHEN coalesce(quality, 0) = 1 THEN 3.25 ELSE 1.5 END + 1.5 * log10(least(n_chars, 100) + 1) + CASE WHEN contains(text, '|') THEN 0.12 WHEN contains(text, '!') THEN 0.1 ELSE 0 END - CASE WHEN coalesce(toxic, 0) = 1 THEN 4 ELSE 0 END) * 100 + 0.5) / 100"""


def score():
    """Category points, a capped logarithm, the first bonus that fits, penalties."""
    points = F.when(F.coalesce("quality", F.lit(0)) == 1, 3.25).otherwise(1.5) + 1.5 * F.log10(F.least("n_chars", F.lit(100)) + 1)
    bonus = F.when(F.contains("text", F.lit("|")), 0.12).when(F.contains("text", F.lit("!")), 0.1).otherwise(0)
    return R.rounded(points + bonus - F.when(F.coalesce("toxic", F.lit(0)) == 1, 4).otherwise(0))


def scored(t):
    return t.documents.join(t.labels, "doc_id", "left").withColumn("score", score())


SCORED_SQL = f"SELECT d.*, quality, toxic, {SCORE_SQL} AS score FROM documents d LEFT JOIN labels USING (doc_id)"


@demo(f"SELECT doc_id, score FROM ({SCORED_SQL})")
def additive_score(t):
    return scored(t).select("doc_id", "score")


@demo("""WITH v AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents)
SELECT doc_id, CAST(least(0.15, 0.03 * len(list_intersect(w, (SELECT list(w) FROM v)))) AS DOUBLE) AS bonus FROM d""")
def overlap_bonus(t):
    expected = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    shared = words.join(expected, "w", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    return t.documents.select("doc_id").join(shared, "doc_id", "left").select("doc_id", F.least(F.lit(0.15), 0.03 * F.coalesce("n", F.lit(0))).alias("bonus"))


@demo("""SELECT o_orderkey, 'tt' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id, CASE WHEN o_orderkey % 7 IN (2, 4, 5) THEN 1 + o_orderkey % 9 END AS major, CASE WHEN o_orderkey % 7 IN (2, 4) THEN 1 + o_orderkey % 20 END AS minor, CASE o_orderkey % 7 WHEN 1 THEN 'a label: 3:4' WHEN 4 THEN 'named' END AS label FROM orders WHERE o_orderkey % 7 < 6
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 6""")
def target_parse(t):
    # an id alone, with a label, with coordinates in both forms, in a url, and what is no id
    plain = F.concat(F.lit("tt"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    form, major, minor = F.col("o_orderkey") % 7, 1 + F.col("o_orderkey") % 9, 1 + F.col("o_orderkey") % 20
    text = F.when(form == 0, plain).when(form == 1, F.concat(F.upper(plain), F.lit("  a label: 3:4 "))).when(form == 2, F.concat_ws(":", plain, major, minor)).when(form == 3, F.concat(F.lit("https://x.org/title/"), plain, F.lit("/?ref=1")))
    text = text.when(form == 4, F.concat(plain, F.lit(":s"), major, F.lit(":E"), minor, F.lit(" named"))).when(form == 5, F.concat(plain, F.lit(":S"), major)).otherwise(F.concat(plain, F.lit("x:s1")))
    return t.orders.select("o_orderkey", R.target(text).alias("t")).select("o_orderkey", "t.*")


#: Behind a name, or alone where the name is missing.
_TAGS = [" (1999–2004)", " S01E02 – a title", " – Temporada 1 completa", ": season 2", " T4", ", 1x02 x", "", " S03", " | seasons complete"]


@demo(f"SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 AND p_partkey % {len(_TAGS)} IN (2, 3, 5, 8) THEN 'known ' || p_partkey ELSE p_name END AS base FROM part WHERE p_partkey % 10 < 9 OR p_partkey % {len(_TAGS)} IN (2, 3, 5, 8)")
def base_name(t):
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("p_partkey") % len(_TAGS) + 1).cast("int"))
    bare = F.col("p_partkey") % 10 == 9  # no name before the tag: the known one
    rows = t.part.filter(~bare | (F.col("p_partkey") % len(_TAGS)).isin(2, 3, 5, 8))
    return rows.select("p_partkey", R.base_name(F.concat(F.when(bare, "").otherwise(F.col("p_name")), tag), F.concat(F.lit("known "), "p_partkey")).alias("base"))


@demo("""SELECT o_orderkey, year(o_orderdate) + o_orderkey % 4 AS label_year, NOT (year(o_orderdate) + o_orderkey % 4 BETWEEN year(o_orderdate) - 1 AND CASE WHEN o_orderstatus = 'O' THEN 9999 ELSE year(o_orderdate) + 1 END) AS mismatch FROM orders""")
def label_mismatch(t):
    label = F.concat(F.lit("No. 12 ("), F.year("o_orderdate") + F.col("o_orderkey") % 4, F.lit(")"))
    year = F.try_element_at(F.regexp_extract_all(label, F.lit("([0-9]{4})"), 1), F.lit(-1)).cast("bigint")
    end = F.when(F.col("o_orderstatus") == "O", 9999).otherwise(F.year("o_orderdate") + 1)
    return t.orders.select("o_orderkey", year.alias("label_year"), (~year.between(F.year("o_orderdate") - 1, end)).alias("mismatch"))


@demo("""SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS role, least(coalesce(try_cast(regexp_extract(text, '([0-9]+)', 1) AS INT), 60), 120) AS bounded FROM conversations""")
def kv_extract(t):
    first = F.nullif(F.regexp_extract("text", "([0-9]+)", 1), F.lit(""))
    return t.conversations.select("conv_id", "turn", F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("other").alias("role"), R.bounded_int(first, 60, 0, 120).alias("bounded"))


@demo("""SELECT doc_id, source AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS n, CASE WHEN lang = 'en' THEN 'A,B' ELSE 'B' END AS tags FROM documents WHERE doc_id % 11 <> 0""")
def schema_upgrade(t):
    # an old form: numbers as text, a first element that a flag marks as not the row's own
    old = t.documents.select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("id"), F.when(F.col("doc_id") % 5 == 0, "?").otherwise(F.col("n_chars").cast("string")).alias("n"), F.when(F.col("lang") == "en", F.split(F.lit("A,B"), ",")).otherwise(F.split(F.lit("X,B"), ",")).alias("tags"), (F.col("lang") != "en").alias("foreign_first"))
    new = old.filter("id is not null")
    return new.select("doc_id", "id", F.col("n").try_cast("bigint").alias("n"), F.concat_ws(",", F.when(F.col("foreign_first"), F.slice("tags", 2, 99)).otherwise(F.col("tags"))).alias("tags"))


@demo("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'URGENT,' ELSE '' END || o_orderstatus AS langs, o_orderstatus || ' · ' || o_orderpriority AS display FROM orders""")
def output_shape(t):
    slot = F.when(F.col("o_orderpriority").like("1%"), F.array(F.lit("URGENT"))).otherwise(F.array().cast("array<string>"))
    return t.orders.select("o_orderkey", F.concat_ws(",", F.array_union(slot, F.array("o_orderstatus"))).alias("langs"), F.concat_ws(" · ", "o_orderstatus", "o_orderpriority").alias("display"))


@demo("""SELECT p_partkey, left(p_name, 12) AS name, CASE WHEN p_size < 40 THEN p_size END AS size, regexp_replace(p_type, ' ', '-', 'g') AS tags, p_size >= 40 AS rejected FROM part""")
def to_record(t):
    bracketed = F.concat(F.lit("x ["), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit("] y"))
    tags = F.split(F.regexp_extract(bracketed, r"\[([^\]]*)\]", 1), "-")
    size = F.when(F.col("p_size") < 40, F.col("p_size").cast("string")).otherwise("n/a").try_cast("int")
    return t.part.select("p_partkey", F.left("p_name", F.lit(12)).alias("name"), size.alias("size"), F.array_join(tags, "-").alias("tags"), size.isNull().alias("rejected"))


@demo("""WITH w AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS alias, generate_subscripts(string_split(p_type, ' '), 1) AS pos FROM part), m AS (SELECT p_partkey, CASE alias WHEN 'SMALL' THEN 'size' WHEN 'MEDIUM' THEN 'size' WHEN 'LARGE' THEN 'size' WHEN 'STEEL' THEN 'metal' WHEN 'BRASS' THEN 'metal' WHEN 'COPPER' THEN 'metal' END AS canon, pos FROM w),
f AS (SELECT p_partkey, canon, min(pos) AS pos FROM m WHERE canon IS NOT NULL GROUP BY ALL) SELECT p.p_partkey, coalesce(string_agg(canon, ',' ORDER BY pos), 'default') AS resolved FROM part p LEFT JOIN f USING (p_partkey) GROUP BY ALL""")
def alias_resolve(t):
    dim = t.spark.createDataFrame([("SMALL", "size"), ("MEDIUM", "size"), ("LARGE", "size"), ("STEEL", "metal"), ("BRASS", "metal"), ("COPPER", "metal")], "alias string, canon string")
    words = t.part.select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("pos", "alias")).join(F.broadcast(dim), "alias")
    first = words.groupBy("p_partkey", "canon").agg(F.min("pos").alias("pos")).groupBy("p_partkey").agg(F.sort_array(F.collect_list(F.struct("pos", "canon"))).alias("c"))
    return t.part.select("p_partkey").join(first, "p_partkey", "left").select("p_partkey", F.coalesce(F.array_join(F.col("c.canon"), ","), F.lit("default")).alias("resolved"))


@demo("SELECT event_id, regexp_extract(event_type || '=' || CAST(user_id AS VARCHAR), '=([0-9]+)', 1) AS marked FROM events")
def marker_extract(t):
    # each kind of event has a marker of its own, and the value stands behind it
    dim = t.events.select("event_type").distinct().withColumn("marker", F.concat("event_type", F.lit("=([0-9]+)")))
    text = t.events.select("event_id", "event_type", F.concat("event_type", F.lit("="), "user_id").alias("text"))
    return text.join(F.broadcast(dim), "event_type").select("event_id", F.expr("regexp_extract(text, marker, 1)").alias("marked"))


@demo("SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '[\\x00-\\x1F\\x7F]', ' ', 'g'), ' +', ' ', 'g')), 80) AS shown FROM pages")
def clean_text(t):
    return t.pages.select("page_id", R.clean(F.col("html"), 80).alias("shown"))


@demo("SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(source || ' ' || text), 'the') AND contains(lower(source || ' ' || text), 'src1')")
def facet_search(t):
    hay = F.lower(F.concat_ws(" ", "source", "text"))
    terms = F.split(F.lit("the src1"), " ")
    return t.documents.filter((F.col("lang") == "en") & F.forall(terms, lambda x: F.contains(hay, x))).select("doc_id")


@demo("SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%s%' AND NOT p_name ILIKE '%a\\_b%' ESCAPE '\\' AND list_contains(string_split(p_type, ' '), p_type)")
def table_search(t):
    return t.part.filter(F.col("p_type").ilike("%s%") & ~F.col("p_name").ilike("%a\\_b%") & F.array_contains(F.split("p_type", " "), F.col("p_type"))).select("p_partkey", "p_name")


@demo("SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END) IS NULL OR o_orderdate <= TIMESTAMP '1996-01-02 00:00:00'")
def availability_filter(t):
    released = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return t.orders.filter(F.coalesce(released <= F.expr("timestamp_ntz'1996-01-01 00:00:00' + interval 1 day"), F.lit(True))).select("o_orderkey")


@demo("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props(t):
    # a payload of elements: those without a value go, a missing list is an empty one
    payload = F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k:bigint>>")
    return t.events.select("event_id", F.explode(payload).alias("e")).filter("e.k is not null").select("event_id", "e.k")


@demo("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, last_value(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+[.]') THEN regexp_extract(line, '^([A-Z][a-z]+)[.]', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l""")
def line_sections(t):
    head = F.nullif(F.regexp_extract("line", "^([A-Z][a-z]+)[.]", 1), F.lit(""))
    return T.carry_section(T.lines(t.documents, "text", ["doc_id"]), ["doc_id"], "pos", head).select("doc_id", "pos", "section")


@demo("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(*) AS n_lines, count_if(regexp_matches(line, '^[A-Z]')) AS valid, count_if(NOT regexp_matches(line, '^[A-Z]')) AS rejected FROM l JOIN documents USING (doc_id) GROUP BY source""")
def parse_quality_counts(t):
    ok = F.col("line").rlike("^[A-Z]")
    return T.lines(t.documents, "text", ["doc_id", "source"]).groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"))


@demo("""WITH u AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')) AS key FROM pages WHERE regexp_matches(url, '^https?://')) SELECT key, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM u GROUP BY key""")
def url_list_dedupe(t):
    # lists are pasted from pages: signs without width and blanks around an url are no part of it
    pasted = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\ufeff "), "url", F.lit("\u200b"))).when(F.col("page_id") % 3 == 1, F.concat(F.left("url", F.lit(9)), F.lit("\u200d"), F.substring("url", 10, 1 << 20))).otherwise(F.col("url"))
    rows = t.pages.select("page_id", F.trim(F.regexp_replace(pasted, "[\u200B-\u200D\uFEFF]", "")).alias("url"))
    key = F.lower(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    rows = rows.filter(F.col("url").rlike("^https?://")).select(key.alias("key"), "page_id", "url")
    return rows.groupBy("key").agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"))


@demo("""WITH r AS (SELECT o_orderkey, o_orderdate, o_orderkey % 8 AS form, 1900 + (o_orderkey % 8) * 30 AS year FROM orders)
SELECT 'tt' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id, CASE WHEN form = 4 THEN 'group' ELSE 'single' END AS kind, 'Name ' || o_orderkey AS name, CASE WHEN form <> 7 THEN year END AS year, 'Name ' || o_orderkey || CASE WHEN form NOT IN (4, 7) THEN ' (' || year || ')' ELSE '' END AS label
FROM r WHERE form NOT IN (0, 1, 5) AND (form = 3 OR o_orderdate <= TIMESTAMP '1996-07-02')""")
def catalog_clean(t):
    # years out of range (form 0, 1), no name (5), no date (3), no proper year (7); as of the first of July
    form, key = F.col("o_orderkey") % 8, F.col("o_orderkey")
    raw = t.orders.select(
        F.concat(F.lit(" TT"), F.lpad(key.cast("string"), 8, "0"), F.lit(" ")).alias("id"), F.when(form == 4, "group").otherwise("other").alias("kind"), F.when(form == 5, "  ").otherwise(F.concat(F.lit(" Name "), key)).alias("name"),
        F.when(form == 7, "12110").otherwise(F.concat(F.lit("("), 1900 + form * 30, F.lit("–)"))).alias("year"), F.when(form != 3, F.col("o_orderdate")).alias("released"),
    )
    return MD.catalog_records(raw, F.expr("timestamp_ntz'1996-07-01 00:00:00'"))


@demo("""WITH v AS (SELECT l_orderkey AS id, count(*) FILTER (l_quantity >= 10 AND l_linenumber <> 3) AS n, min(l_linenumber) FILTER (l_quantity >= 10 AND l_linenumber <> 3) AS first_minor, count(*) FILTER (l_quantity >= 10 AND l_linenumber <> 3 AND l_partkey % 4 > 0) AS titled FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'single' ELSE 'group' END AS kind, 'Name ' || o_orderkey AS name, CASE WHEN o_orderkey % 5 <> 4 THEN year(o_orderdate) END AS year, CASE WHEN o_orderkey % 5 = 1 THEN year(o_orderdate) + 4 WHEN o_orderkey % 5 <> 4 AND o_orderkey % 3 = 0 THEN year(o_orderdate) END AS year_end,
CASE WHEN o_orderkey % 3 > 0 THEN coalesce(n, 0) END AS n_members, CASE WHEN o_orderkey % 3 > 0 THEN first_minor END AS first_minor, CASE WHEN o_orderkey % 3 > 0 THEN coalesce(titled, 0) END AS titled FROM orders LEFT JOIN v ON id = o_orderkey WHERE o_orderkey % 11 > 0""")
def meta_normalize(t):
    # members of line 3 have no whole number, those of small quantity none at all; every eleventh order has no name
    text = lambda c: F.col(c).cast("string")
    number = F.when(F.col("l_quantity") >= 10, text("l_linenumber")).otherwise("0")
    video = F.struct(F.lit("1").alias("season"), F.when(F.col("l_linenumber") == 3, "3.5").when(F.col("l_linenumber") % 2 == 0, number).alias("episode"), number.alias("number"), F.when(F.col("l_partkey") % 4 == 1, F.lit(" a ")).alias("name"), F.when(F.col("l_partkey") % 4 > 0, "b").otherwise(" ").alias("title"), F.lit(None).cast("string").alias("released"), text("l_shipdate").alias("first"))
    videos = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(video).alias("videos"))
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    said = F.when(key % 5 == 1, F.concat(year, F.lit("–"), year + 4)).when(key % 5 == 4, "soon").otherwise(F.concat(F.lit("("), year, F.lit("–)")))
    raw = t.orders.select(key.alias("id"), F.when(key % 2 == 0, F.when(key % 3 == 0, "single").otherwise("group")).otherwise("video").alias("kind"), F.when(key % 3 == 0, "single").otherwise("group").alias("requested"), F.when(key % 11 > 0, F.concat(F.lit(" Name "), key)).otherwise(" ").alias("name"), said.alias("year"))
    rows = MD.metadata_records(raw.join(videos, "id", "left"))
    members = F.coalesce("members", F.when(F.col("kind") == "group", F.array().cast("array<struct<major:int,minor:int,title:string,released:string>>")))
    return rows.withColumn("m", members).select("id", "kind", "name", "year", "year_end", F.size("m").cast("bigint").alias("n_members"), F.array_min(F.col("m.minor")).alias("first_minor"), F.size(F.filter("m", lambda x: x["title"].isNotNull())).cast("bigint").alias("titled"))
