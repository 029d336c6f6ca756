"""Languages, tiers and scores against loops over the same tables of rules."""

import math
import random
import re

from pyspark.sql import functions as F

from gleanery.functions import languages as L
from gleanery.functions import scoring as S


def found(pattern, text):
    return re.search(pattern, text, re.I | re.A) is not None or re.search(pattern.replace(r"\b", L._EDGE), text, re.I) is not None


def heard(text):
    cut = lambda p, t: re.sub(p.replace(r"\b", L._EDGE), " ", t, flags=re.I)
    return cut(L.LANGUAGE_FIRST, cut(L.SUBTITLES_FIRST, text))


def plain_set(declared, text):
    declared, text = declared or "", text or ""
    out = []
    for token in [t for t in re.split(r"[,+ \t\n\x0b\f\r/|]+", declared.lower()) if t]:
        code = next((c for c, names in L.ALIASES.items() if token in names), None)
        out.append(code or (token if re.fullmatch("[a-z]{2,3}", token) else None))
    for pair in re.findall("[\U0001f1e6-\U0001f1ff]{2}", text + " " + declared):
        out.append(L.REGIONS.get("".join(chr(ord(c) - 0x1F1E6 + 65) for c in pair)))
    out += [code for code, p in L.NAMES if found(p, heard(text))]
    return list(dict.fromkeys(c for c in out if c))


PARTS = ["Castellano", "ESPAÑOL", "español", "Sub", "subs", "Subtítulos en", "ITA", "ENG", "eng.ita", "VOSE", "Latino", "dual.lat", "\U0001f1ea\U0001f1f8", "\U0001f1fa\U0001f1f8", "\U0001f1ef", "Hindi", "éeng", "engé", "spa_", "Кино", "multi", "french", "1080p", "Inglés", "x", "ger", "legendado", "napisy pol"]


def test_languages_are_the_loop(spark):
    rng = random.Random(14)
    rows = []
    for n in range(1200):
        text = rng.choice([None, "", "".join(rng.choice(PARTS) + rng.choice([" ", ".", "-", "_", ""]) for _ in range(rng.randrange(6)))])
        declared = rng.choice([None, "", "es", "Spanish,xx", "a|eng", "\U0001f1eb\U0001f1f7 it", "toolong"])
        rows.append((n, declared, text, rng.random() < 0.2))
    df = spark.createDataFrame(rows, "n int, declared string, text string, trusted boolean").repartition(4)
    df = df.withColumn("own", L.language_set(F.col("declared"), F.col("text"))).withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("es", L.es_tier(F.col("own"), F.col("text"), F.col("trusted"))).withColumn("en", L.en_tier(F.col("own"), F.col("text"), F.col("es")))
    df = df.withColumn("es_c", L.es_confidence(F.col("own"), F.col("text"), F.col("trusted"), F.col("es"))).withColumn("en_c", L.en_confidence(F.col("own"), F.col("text"), F.col("en")))
    scripts = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), L.OTHER_SCRIPTS)
    for r in df.collect():
        n, declared, text, trusted = rows[r["n"]]
        own, text = plain_set(declared, text), text or ""
        assert r["own"] == own, rows[n]
        others = [c for c in own if c not in ("es", "en")]
        es = 0
        if "es" in own:
            if trusted or found(L.ES_AUDIO, heard(text)):
                es = 2 if others else 3
            elif not found(L.ES_SUBTITLES, text):
                es = 2 if len(own) == 1 else 1
        foreign, mixed = bool(others) or re.search(scripts, text) is not None or found(L.OTHERS, text), found(L.MIXED, text) or "es" in own
        en = int("en" in own) if es >= 2 else (1 if foreign or mixed else 2) if "en" in own else (1 if mixed else 2) if not own and not foreign else 0
        es_c = 0 if found(L.ES_SUBTITLES, text) else 1 if found(L.ES_SURE, heard(text)) else (0.9 if es >= 2 else 0.55) if "es" in own else 0.8 if trusted else 0
        en_c = 0.1 if found(L.OTHERS, heard(text)) and not found(L.EN_SOME, heard(text)) else 1 if found(L.EN_SURE, heard(text)) else (0.95 if en >= 2 else 0.75) if "en" in own else 0.55 if not own and not re.search(scripts, heard(text)) else 0
        assert (r["es"], r["en"], r["es_c"], r["en_c"]) == (es, en, es_c, en_c), rows[n]


def test_scores_are_the_sum_of_what_rules_gave(spark):
    rules = [S.Rule("first", F.col("a") > 5, 2.0, "g"), S.Rule("second", F.col("a") > 1, 1.25, "g"), S.Rule("always", F.lit(True), S.measure_points(F.col("m"))), S.Rule("own", F.col("b"), F.col("p")), S.Rule("lost", F.col("a").isNull(), -4)]
    rows = [(0, 9, None, True, 0.5), (1, 3, 0, None, 0.5), (2, None, 50, True, None), (3, 0, 1000, False, 9.0), (4, 6, -2, True, -0.005)]
    df = spark.createDataFrame(rows, "n int, a int, m int, b boolean, p double").withColumn("given", S.parts(rules)).withColumn("score", S.total(F.col("given"), rules))
    for r in df.collect():
        n, a, m, b, p = rows[r["n"]]
        measure = 0 if m is None else -3 if m <= 0 else 1.5 * math.log10(min(m, 100) + 1)
        given = (2.0 if (a or 0) > 5 else 0, 1.25 if 1 < (a or 0) <= 5 else 0, measure, (p or 0) if b else 0, -4 if a is None else 0)
        assert all(abs(x - y) < 1e-12 for x, y in zip(r["given"], given, strict=True))
        assert abs(r["score"] - math.floor(sum(given) * 100 + 0.5) / 100) < 1e-9


def test_the_default_table(spark):
    rows = [("4K", None, 0, "x AI-enhanced web-dl"), ("4K", 100, 41 * S.GIB, "BluRay remux TrueHD 10bit HC"), ("other", 0, 26 * S.GIB, "webrip hdr10"), (None, 9, None, "")]
    df = spark.createDataFrame(rows, "category string, measure int, size bigint, text string").coalesce(1)
    rules = S.record_rules(*(F.col(c) for c in ("category", "measure", "size", "text")), F.lit(False), F.lit(None).cast("boolean"))
    got = [r[0] for r in df.select(S.total(S.parts(rules), rules)).collect()]
    want = [2.75 + 0.10, 3.25 + 1.5 * math.log10(101) + 0.12 + 0.04 + 0.03 + 0.02 - 1 - 2.5, 1 - 3 + 0.06 + 0.03 - 1, 1 + 1.5]
    assert got == [math.floor(x * 100 + 0.5 + 1e-9) / 100 for x in want]
