"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The index holds (term, doc_id, at) for the words of the training texts. A phrase of the benchmark is searched from its
rarest terms: their posting lists, shifted by the terms' places in the phrase, are intersected, and the places that
remain are compared word by word. Phrases may be of any length; a proximity search returns places where all words of a
phrase stand close together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.shared import BROADCAST_IDS, checked_broadcast, lower_ascii, saved, words_of

#: Everything in ASCII but digits and letters stands between words (A-Z are lower-cased before).
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def benchmark_words(text: Column) -> Column:
    return words_of(lower_ascii(text), APART)


def phrases_of(benchmark: DataFrame, width: int, *, text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Distinct windows of the items as (phrase, words), and the items (phrase, item) that have them.

    phrase is the words joined by a blank. An item of fewer words is one window; an item without words has none.
    """
    words = benchmark.select(F.col(item_id).alias("item"), benchmark_words(F.col(text)).alias("w")).filter("size(w) > 0")
    each = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))), lambda s: F.slice("w", s, width))).alias("words"))
    each = each.withColumn("phrase", F.array_join("words", " "))
    return each.select("phrase", "words").dropDuplicates(["phrase"]), each.select("phrase", "item").distinct()


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc, at) of the given terms; docs has doc and words. At most so many rows as the texts have words."""
    return docs.select("doc", F.posexplode("words").alias("at", "term")).join(checked_broadcast(terms), "term")


#: A list that is longer than the rarest term's by more than this factor costs more than comparing the words of places.
LIST_FACTOR = 16


def rarest_terms(docs: DataFrame, phrases: DataFrame, count: int) -> DataFrame:
    """(phrase, term, offset, rank): the rarest terms of each phrase by their counts over all texts.

    At most count terms, and after the first only those with lists of up to LIST_FACTOR times its length. A term of several places in a phrase is taken at its first. Terms that no text has make the phrase impossible; such
    phrases are left out.
    """
    places = phrases.select("phrase", F.posexplode("words").alias("offset", "term")).groupBy("phrase", "term").agg(F.min("offset").alias("offset"))
    wanted = places.select("term").distinct()
    counts = docs.select(F.explode("words").alias("term")).join(checked_broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("n"))
    rare = Window.partitionBy("phrase").orderBy("n", "term")
    ranked = places.join(counts, "term", "left").withColumn("absent", F.max(F.col("n").isNull()).over(Window.partitionBy("phrase")))
    ranked = ranked.filter("not absent").withColumn("rank", F.row_number().over(rare)).withColumn("least", F.min("n").over(Window.partitionBy("phrase")))
    return ranked.filter((F.col("rank") <= count) & ((F.col("rank") == 1) | (F.col("n") <= LIST_FACTOR * F.col("least")))).select("phrase", "term", "offset", "rank")


def _index(docs: DataFrame, phrases: DataFrame, anchors: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases with a number p, the rarest terms of each number, their postings), each a table. What is shuffled are numbers."""
    numbered = saved(phrases.select("phrase", "words").withColumn("p", F.monotonically_increasing_id()), "numbered")
    terms = saved(rarest_terms(docs, numbered.select(F.col("p").alias("phrase"), "words"), anchors).withColumnRenamed("phrase", "p"), "terms")
    return numbered, terms, saved(positional_index(docs, terms.select("term").distinct()), "postings")


def phrase_matches(docs: DataFrame, phrases: DataFrame, *, anchors: int = 3) -> DataFrame:
    """(phrase, doc, start, length) for every place where a phrase stands in a text; docs has doc and words.

    anchors is how many of the rarest terms are intersected before the words of a place are compared. Rows of docs
    without doc match nothing; rows that repeat a doc may each match.
    """
    docs = docs.filter("doc is not null").select("doc", "words")
    return _phrases(docs, *_index(docs, phrases, anchors))


def _phrases(docs: DataFrame, numbered: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    # the list of the rarest term gives the places, each further list is shifted by its own offset and must agree; a term has
    # one offset and one posting a place, so each rank is there once
    places = postings.join(checked_broadcast(terms), "term").select("p", "doc", (F.col("at") - F.col("offset")).alias("start"), "rank").filter("start >= 0")
    needed = terms.groupBy("p").agg(F.max("rank").alias("needed")).join(numbered.select("p", F.size("words").alias("length")), "p")
    places = places.groupBy("p", "doc", "start").agg(F.count("*").alias("have")).join(checked_broadcast(needed), "p").filter("have = needed").select("p", "doc", "start", "length")
    places = saved(places, "places")
    asked = docs.join(checked_broadcast(places.select("doc").distinct(), BROADCAST_IDS), "doc", "left_semi")
    # the words of each place are cut out where the text is: no text goes on with its places
    found = asked.join(places.groupBy("doc").agg(F.collect_list(F.struct("p", "start", "length")).alias("places")), "doc")
    cut = F.transform("places", lambda p: F.struct(p["p"].alias("p"), p["start"].alias("start"), p["length"].alias("length"), F.array_join(F.slice("words", p["start"] + 1, p["length"]), " ").alias("found")))
    same = found.select("doc", F.inline(cut)).join(checked_broadcast(numbered.select("p", "phrase")), "p").filter("found = phrase")
    return same.select("phrase", "doc", "start", "length").distinct()


def _near(docs: DataFrame, numbered: DataFrame, terms: DataFrame, postings: DataFrame, span: int) -> DataFrame:
    """(phrase, doc) where all distinct words of a phrase stand within span words, in any order.

    Places of the rarest term fall into buckets of span words, those of the second rarest into their own and the next ones; where
    both meet, the words around the bucket are looked at, every window of them that starts with a word of the phrase.
    """
    two = terms.filter("rank <= 2")
    wanted = two.groupBy("p").agg(F.bit_or(F.col("rank")).alias("wanted"))  # ranks are 1 and 2: one bit each
    own = F.floor(F.col("at") / span)
    buckets = F.when(F.col("rank") == 1, F.array(own)).otherwise(F.array(own - 1, own, own + 1))
    rows = postings.join(checked_broadcast(two), "term").select("p", "doc", "rank", F.explode(buckets).alias("b"))
    met = rows.groupBy("p", "doc", "b").agg(F.bit_or("rank").alias("have")).join(checked_broadcast(wanted), "p").filter("have = wanted")
    met = saved(met.select("p", "doc", "b"), "near")
    asked = docs.join(checked_broadcast(met.select("doc").distinct(), BROADCAST_IDS), "doc", "left_semi")
    found = asked.join(met.groupBy("doc").agg(F.collect_list(F.struct("p", "b")).alias("places")), "doc")
    low = lambda b: F.greatest((b - 1) * span, F.lit(0))
    area = F.transform("places", lambda p: F.struct(p["p"].alias("p"), F.slice("words", (low(p["b"]) + 1).cast("int"), ((p["b"] + 2) * span - low(p["b"])).cast("int")).alias("area")))
    sets = numbered.select("p", "phrase", F.array_distinct("words").alias("set"))
    both = found.select("doc", F.inline(area)).join(checked_broadcast(sets), "p").filter(F.size(F.array_except("set", "area")) == 0)
    here = lambda s: F.array_contains("set", F.get("area", s)) & (F.size(F.array_except("set", F.slice("area", s + 1, span))) == 0)
    return both.filter(F.exists(F.sequence(F.lit(0), F.size("area") - 1), here)).select("phrase", "doc").distinct()


def proximity_matches(docs: DataFrame, phrases: DataFrame, *, span: int) -> DataFrame:
    """(phrase, doc, start) where all distinct words of a phrase stand within span words from start, in any order.

    docs has doc and words. start is a place of the phrase's rarest term minus up to span - 1; each such place that is
    the first word of a match is returned once.
    """
    docs = docs.filter("doc is not null")
    distinct = phrases.select("phrase", F.array_distinct("words").alias("set"))
    terms = saved(rarest_terms(docs, phrases, 1), "terms")
    postings = positional_index(docs, terms.select("term").distinct()).join(checked_broadcast(terms.select("phrase", "term")), "term").select("phrase", "doc", "at").distinct()
    found = docs.join(postings, "doc").join(checked_broadcast(distinct), "phrase")
    starts = found.select("phrase", "doc", "words", "set", F.explode(F.sequence(F.greatest(F.col("at") - span + 1, F.lit(0)), F.col("at"))).alias("start"))
    window = F.slice("words", F.col("start") + 1, span)
    return starts.filter(F.array_contains("set", F.get("words", F.col("start"))) & (F.size(F.array_except("set", window)) == 0)).select("phrase", "doc", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, span: int | None = None, anchors: int = 3, text: str = "text", doc_id: str = "doc_id", bench_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of an item's window), n_items, items (array, sorted as
    strings), n_near (windows whose distinct words all stand within span words, by default twice the width, in any order; exact
    ones among them) and near_items (items with such a window), for each row of docs.

    A null text has no words. Every row is judged by its own text, whatever its doc_id: rows that repeat one, and rows
    without one, have their own matches. Items that repeat an item_id count as one item, items without one are searched
    and hit words but aren't counted. Ties have no say. Other columns of either table are not read.
    """
    cut = docs.select(F.col(doc_id).alias("id"), benchmark_words(F.col(text)).alias("words"))
    # rows are numbered once, in a table
    cut = saved(cut.select(F.monotonically_increasing_id().alias("doc"), "id", "words", F.size("words").cast("bigint").alias("n_words")), "words")
    phrases, items = phrases_of(benchmark, width, text=bench_text, item_id=item_id)
    phrases, items = saved(phrases, "phrases"), saved(items, "items")
    rows = cut.select("doc", "words")
    index = _index(rows, phrases, anchors)
    matches = saved(_phrases(rows, *index), "matches")
    near = saved(_near(rows, *index, span or 2 * width), "near-matches")
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = matches.select("doc", "start", (F.col("start") + F.col("length")).alias("end")).distinct().withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = runs.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("bigint").alias("n_hit"))

    def named(found: DataFrame, name: str) -> DataFrame:
        return found.join(checked_broadcast(items), "phrase").groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias(name))

    close = near.groupBy("doc").agg(F.count("*").alias("n_near")).join(named(near, "near_items"), "doc", "left")
    out = cut.select("doc", "id", "n_words").join(hit.join(named(matches.select("doc", "phrase").distinct(), "items"), "doc", "left"), "doc", "left").join(close, "doc", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    items_col = F.coalesce("items", none)
    return out.select(F.col("id").alias(doc_id), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(items_col).cast("bigint").alias("n_items"), items_col.alias("items"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("near_items", none).alias("near_items"))
