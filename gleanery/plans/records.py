"""Records with texts of many forms, made from lines of orders: language sets, tiers, confidence, scores by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import languages as L
from gleanery.functions import scoring as S
from gleanery.operators.values import once_per_value
from gleanery.plans.demo import demo

_DECLARED = ["", "es", "Spanish, ENG", "por|fra", "xx+deu", "Klingon toolong", "\U0001f1f2\U0001f1fd", "ita/en", "eng", "LATINO"]
_TITLES = [
    "Show 1080p", "Show Castellano", "Show SUB ITA ENG", "Show Spanish Subs", "Show [Español-Inglés]", "Show \U0001f1ec\U0001f1e7 / \U0001f1ee\U0001f1f3", "Show Subtítulos en español", "Show TRUEFRENCH VFF", "Show Multi Dual Latino",
    "Show Кино", "Show ESPN ingle", "Show Hindi \U0001f1fd\U0001f1fd", "Show VOSE Deutsch", "Show es-mx", "Show en-US temporada 2", "Show ENGLISH sub eng", "Show dual lat", "Show_eng_ita", "éeng ñspa", "Show Alemán PORTUGUÊS",
]
_MORE = ["", " BluRay REMUX TrueHD", " WEB-DL aac", " webrip 10bit", " HDTV H-SBS", " AI-enhanced HDR10+", " hardsub BDRip flac", " Web Dolby Vision"]
_SQL_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_CATEGORIES = ["4K", "1080p", "720p", "480p", "other"]


def _records(t):
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    line = t.lineitem
    text = F.concat(pick(_TITLES, F.col("l_partkey") + F.col("l_linenumber")), pick(_MORE, F.col("l_suppkey")))
    category = pick(_CATEGORIES, F.col("l_orderkey"))
    measure = F.when(F.col("l_partkey") % 9 == 0, None).otherwise(F.col("l_partkey") % 160 - 5)
    size = (F.col("l_quantity") * S.GIB).cast("bigint")
    return line.select(*_KEYS.split(", "), pick(_DECLARED, F.col("l_orderkey") + F.col("l_suppkey")).alias("declared"), text.alias("text"), category.alias("category"), measure.alias("measure"), size.alias("size"), (F.col("l_suppkey") % 13 == 0).alias("trusted"))


def _with_languages(rows):
    return rows.withColumn("languages", L.language_set(F.col("declared"), F.col("text")))


def _matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern}')"


_ALIASES = " ".join(f"WHEN t IN ({', '.join(repr(a) for a in names)}) THEN '{code}'" for code, names in L.ALIASES.items())
_FLAGS = "MAP {" + ", ".join(f"'{''.join(chr(0x1F1E6 + ord(c) - 65) for c in region)}': '{code}'" for region, code in L.REGIONS.items()) + "}"
_NAMED = ", ".join(f"CASE WHEN {_matches('heard', p)} THEN '{code}' END" for code, p in L.NAMES)
_RECORDS = f"""WITH x AS (SELECT {_KEYS}, {_SQL_LIST(_DECLARED)}[(l_orderkey + l_suppkey) % {len(_DECLARED)} + 1] AS declared, {_SQL_LIST(_TITLES)}[(l_partkey + l_linenumber) % {len(_TITLES)} + 1] || {_SQL_LIST(_MORE)}[l_suppkey % {len(_MORE)} + 1] AS text,
{_SQL_LIST(_CATEGORIES)}[l_orderkey % {len(_CATEGORIES)} + 1] AS category, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey % 160 - 5 END AS measure, CAST(l_quantity * {S.GIB} AS BIGINT) AS size, l_suppkey % 13 = 0 AS trusted FROM lineitem),
h AS (SELECT *, regexp_replace(regexp_replace(text, '(?i){L.SUBTITLES_FIRST}', ' ', 'g'), '(?i){L.LANGUAGE_FIRST}', ' ', 'g') AS heard FROM x),
r AS (SELECT *, list_filter(list_concat(list_transform(list_filter(regexp_split_to_array(lower(declared), '[,+\\s/|]+'), lambda t: t <> ''), lambda t: CASE {_ALIASES} WHEN regexp_full_match(t, '[a-z]{{2,3}}') THEN t END),
list_transform(regexp_extract_all(text || ' ' || declared, '[\\x{{1F1E6}}-\\x{{1F1FF}}]{{2}}'), lambda f: ({_FLAGS})[f]), [{_NAMED}]), lambda c: c IS NOT NULL) AS every FROM h),
l AS (SELECT *, list_filter(every, lambda c, i: list_position(every, c) = i) AS languages FROM r),
e AS (SELECT *, CASE WHEN NOT list_contains(languages, 'es') THEN 0 WHEN trusted OR {_matches("heard", L.ES_AUDIO)} THEN CASE WHEN len(list_filter(languages, lambda c: c NOT IN ('es', 'en'))) = 0 THEN 3 ELSE 2 END WHEN {_matches("text", L.ES_SUBTITLES)} THEN 0 WHEN len(languages) = 1 THEN 2 ELSE 1 END AS es_tier,
len(list_filter(languages, lambda c: c NOT IN ('es', 'en'))) > 0 OR regexp_matches(text, '{L.OTHER_SCRIPTS}') OR {_matches("text", L.OTHERS)} AS foreign_, {_matches("text", L.MIXED)} OR list_contains(languages, 'es') AS mixed FROM l),
n AS (SELECT *, CASE WHEN es_tier >= 2 THEN CASE WHEN list_contains(languages, 'en') THEN 1 ELSE 0 END WHEN list_contains(languages, 'en') THEN CASE WHEN foreign_ OR mixed THEN 1 ELSE 2 END WHEN len(languages) = 0 AND NOT foreign_ THEN CASE WHEN mixed THEN 1 ELSE 2 END ELSE 0 END AS en_tier FROM e)"""


@demo(f"{_RECORDS} SELECT {_KEYS}, array_to_string(languages, '+') AS languages FROM l")
def language_sets(t):
    rows = once_per_value(_records(t), ["declared", "text"], _with_languages)
    return rows.select(*_KEYS.split(", "), F.concat_ws("+", "languages").alias("languages"))


@demo(f"""{_RECORDS} SELECT {_KEYS}, es_tier, en_tier,
CAST(CASE WHEN {_matches("text", L.ES_SUBTITLES)} THEN 0 WHEN {_matches("heard", L.ES_SURE)} THEN 1 WHEN list_contains(languages, 'es') THEN CASE WHEN es_tier >= 2 THEN 0.9 ELSE 0.55 END WHEN trusted THEN 0.8 ELSE 0 END AS DOUBLE) AS es_confidence,
CAST(CASE WHEN {_matches("heard", L.OTHERS)} AND NOT {_matches("heard", L.EN_SOME)} THEN 0.1 WHEN {_matches("heard", L.EN_SURE)} THEN 1 WHEN list_contains(languages, 'en') THEN CASE WHEN en_tier >= 2 THEN 0.95 ELSE 0.75 END WHEN len(languages) = 0 AND NOT regexp_matches(heard, '{L.OTHER_SCRIPTS}') THEN 0.55 ELSE 0 END AS DOUBLE) AS en_confidence FROM n""")
def language_tiers(t):
    text, own, trusted = F.col("text"), F.col("languages"), F.col("trusted")

    def judged(rows):
        rows = _with_languages(rows).withColumn("es_tier", L.es_tier(own, text, trusted))
        rows = rows.withColumn("en_tier", L.en_tier(own, text, F.col("es_tier")))
        return rows.withColumns({"es_confidence": L.es_confidence(own, text, trusted, F.col("es_tier")), "en_confidence": L.en_confidence(own, text, F.col("en_tier"))})

    rows = once_per_value(_records(t), ["declared", "text", "trusted"], judged)
    return rows.select(*_KEYS.split(", "), "es_tier", "en_tier", "es_confidence", "en_confidence")


_CATEGORY = " ".join(f"WHEN category = '{c}' THEN {p}" for c, p in S.CATEGORY.items())
_SOURCE = " ".join(f"WHEN {_matches('text', p)} THEN {v}" for _, p, v in S.SOURCES)
_FEATURES = " + ".join(f"CASE WHEN {_matches('text', p)} THEN {v} ELSE 0 END" for _, p, v in S.FEATURES)
_PENALTIES = " + ".join(f"CASE WHEN {_matches('text', p)} THEN {v} ELSE 0 END" for _, p, v in S.PENALTIES)


@demo(f"""{_RECORDS}, p AS (SELECT {_KEYS}, CAST(CASE WHEN category = '4K' AND {_matches("text", S.UPSCALED_TEXT)} THEN {S.UPSCALED} {_CATEGORY} ELSE {S.UNKNOWN_CATEGORY} END AS DOUBLE) AS of_category, CAST(CASE WHEN measure IS NULL THEN 0 WHEN measure <= 0 THEN -3 ELSE 1.5 * log10(least(measure, 100) + 1) END AS DOUBLE) AS of_measure,
CAST(CASE {_SOURCE} ELSE 0 END AS DOUBLE) + ({_FEATURES}) AS of_features, CAST(CASE WHEN l_partkey % 19 = 0 THEN {S.OFF_TOPIC} ELSE 0 END + CASE WHEN l_partkey % 23 = 0 THEN {S.WRONG} ELSE 0 END + {_PENALTIES} + CASE WHEN size > {40 * S.GIB} THEN {S.HUGE} WHEN size > {25 * S.GIB} THEN {S.LARGE} ELSE 0 END AS DOUBLE) AS penalties FROM x)
SELECT {_KEYS}, floor((of_category + of_measure + of_features + penalties) * 100 + 0.5) / 100 AS score, of_category, floor(of_measure * 100 + 0.5) / 100 AS of_measure, floor(of_features * 100 + 0.5) / 100 AS of_features, penalties FROM p""")
def rule_scores(t):
    # the score of the default table, and what groups of its rules gave
    rows = once_per_value(_records(t), ["text"], lambda r: r.withColumn("found", S.text_matches(F.col("text"))))
    rules = S.record_rules(F.col("category"), F.col("measure"), F.col("size"), F.col("text"), F.col("l_partkey") % 19 == 0, F.col("l_partkey") % 23 == 0, F.col("found"))
    rows = rows.withColumn("given", S.parts(rules))
    of = lambda pick: S.total(F.col("given"), [r for r in rules if pick(r)])
    lost = lambda r: r.group == "size" or r.name in ("off_topic", "wrong", *(n for n, *_ in S.PENALTIES))
    category, measure = (lambda r: r.group == "category"), (lambda r: r.name == "measure")
    features = lambda r: not (lost(r) or category(r) or measure(r))
    return rows.select(*_KEYS.split(", "), of(lambda r: True).alias("score"), of(category).alias("of_category"), of(measure).alias("of_measure"), of(features).alias("of_features"), of(lost).alias("penalties"))
