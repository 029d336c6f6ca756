"""One query for each operator over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, centroids, decontaminate, filter_audit, licenses, line_dedup, ngram_join, pu_quality, quality, substring, token_files, toxicity, urls
from gleanery.llm.shared import saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and rejected of each row; see score_toxicity. Held-out labels take no part in the fit."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.filter(~held_out()))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near and near_items (comma-joined) of each row; see contamination."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near", F.concat_ws(",", "near_items").alias("near_items"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, licenses (names, comma-joined), n_licenses."""
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, notice string")
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"), templates)
    return found.select("doc_id", F.concat_ws(",", "licenses").alias("licenses"), F.size("licenses").cast("bigint").alias("n_licenses"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept, failed_rules and certified_rules (comma-joined) of each row; see judge_quality."""
    features = saved(quality.quality_features(_table(spark, sf_dir, "documents")), "features")
    cutoffs = quality.certified_cutoffs(features, _table(spark, sf_dir, "labels"))
    return quality.judge_quality(features, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"), F.concat_ws(",", "certified_rules").alias("certified_rules"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; see encode_and_decode."""
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: The rules of the query: verdict, host, path.
URL_RULES = [("allow", "com", ""), ("block", "example.com", "en/"), ("allow", "www.example.com", "en/"), ("block", "net", "es/"), ("block", "net", "fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of each row; see judge_urls."""
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; see ngram_classes."""
    return ngram_join.ngram_classes(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; see repeated_passages."""
    return substring.repeated_passages(_table(spark, sf_dir, "documents"), width=13).drop("removed")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from its token files; see token_round_trip."""
    return token_files.token_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left)."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector; see centroid_clusters."""
    assigned, last = centroids.centroid_clusters(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256, seed=2)
    return centroids.with_inertia(assigned, last).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def quality_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; see score_quality. Neither labels nor unlabelled texts of the fit are held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    models = pu_quality.fit_quality(docs.filter(~quality_held_out()), labels.filter(~quality_held_out()))
    scored = pu_quality.score_quality(docs, models)
    return scored.select("doc_id", quality_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per language, order of the five filters and step; see filter_audit."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_license_scan, op4_quality_rules, op5_bpe, op6_url_filter, op7_ngram_join, op8_substring_dedup, op9_token_files, op10_line_dedup, op11_centroids, op12_pu_quality, op13_filter_audit)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS p, len(w[s:s + 9]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT DISTINCT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.p = bw.p
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
), freq AS (
  SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t
), sets AS (
  SELECT p, t FROM (SELECT p, unnest(list_distinct(p)) AS t FROM (SELECT DISTINCT p FROM bw)) LEFT JOIN freq USING (t) QUALIFY row_number() OVER (PARTITION BY p ORDER BY coalesce(n, 0), t) = 1
), seen AS (
  SELECT doc_id, t, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = t)) AS pos, w FROM (SELECT doc_id, w, unnest(list_distinct(w)) AS t FROM d) WHERE t IN (SELECT t FROM sets)
), close AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, p, pos, w, unnest(range(greatest(pos - 19, 1), pos + 1)) AS s FROM seen JOIN sets USING (t) WHERE list_has_all(w[greatest(pos - 19, 1):pos + 19], p)) WHERE list_has_all(w[s:s + 19], p)
), near AS (
  SELECT doc_id, count(*) AS n_near FROM close GROUP BY doc_id
), near_items AS (
  SELECT doc_id, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM close JOIN bw USING (p)) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""

OP7_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), l AS (
  SELECT x, y FROM p UNION SELECT y, x FROM p
), r AS (
  SELECT x AS doc, y AS reached FROM l UNION SELECT r.doc, l.y FROM r JOIN l ON r.reached = l.x
)
SELECT doc_id, len(s) AS n_shingles, coalesce(least(doc_id, (SELECT min(reached) FROM r WHERE doc = doc_id)), doc_id) AS component_id FROM s
"""
OP8_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), v AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM w)
), f AS (
  SELECT p, min(doc_id) AS first FROM v GROUP BY p
), g AS (
  SELECT doc_id, list(DISTINCT place) AS gone FROM (SELECT doc_id, unnest(range(s, s + 13)) AS place FROM v JOIN f USING (p) WHERE first < doc_id) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

OP10_SQL = """
WITH x AS (
  SELECT doc_id, spot, doc_id * 1000000 + spot AS place, raw, trim(regexp_replace(regexp_replace(lower(raw), '[\\t\\r\\x0B\\x0C]', ' ', 'g'), ' {2,}', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, ls, ls[spot + 1] AS raw, spot FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS spot FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))
), f AS (
  SELECT line, min(place) AS first, string_split(line, ' ') AS w FROM x WHERE line <> '' GROUP BY line
), d AS (
  SELECT line, first, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM f WHERE len(w) >= 5
), e AS (
  SELECT line, first, len(s) AS n, unnest(s) AS t FROM d
), l AS (
  SELECT DISTINCT line FROM (SELECT b.line, b.first FROM e a JOIN e b ON a.t = b.t AND a.first < b.first GROUP BY a.first, b.first, b.line, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*)))
), k AS (
  SELECT x.doc_id, x.spot, x.raw, x.line <> '' AND (l.line IS NOT NULL OR x.place > f.first) AS gone FROM x LEFT JOIN f USING (line) LEFT JOIN l USING (line)
)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(gone) AS m, string_agg(raw, chr(10) ORDER BY spot) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id) USING (doc_id)
"""


def _rounds_sql(rounds: int, k: int) -> str:
    """Assignment and centroids of each round as one common table after another."""
    assigned = """a{r} AS (
  SELECT id, v, c, d FROM (SELECT id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM kept, c{r}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1
)"""
    moved = """s{r} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i
), c{next} AS (
  SELECT c{r}.c, coalesce(f.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c) f ON f.c = c{r}.c
)"""
    first = f"""c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('2:' || id) AS h, v FROM kept ORDER BY h LIMIT {k})
)"""
    each = [assigned.format(r=r) + (",\n" + moved.format(r=r, next=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return ",\n".join([first, *each])


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), {_rounds_sql(5, 40)}
SELECT id AS vec_id, a5.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON a5.c = c5.c
"""

OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), j AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN l USING (doc_id)
), o AS (
  SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)
), s AS (
  SELECT filter_order, step, filter_order[step:step] AS f, filter_order[1:step - 1] AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)
), c AS (
  SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM j GROUP BY part, failed
), r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(failed, before || f, '') = failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op7_ngram_join": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op10_line_dedup": OP10_SQL, "op11_centroids": OP11_SQL, "op13_filter_audit": OP13_SQL}
