"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

Tokens of a line are its distinct runs of words, ordered by the hash of their first two words. Each line puts a prefix of
its tokens into an index, and lines of the least similarity share a token there. Pairs that share too few of them for what is
left of their lines are left out, the others are verified exactly. A line goes if it is similar to one that comes earlier in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.links import later, similar
from gleanery.llm.shared import BROADCAST_IDS, saved

#: A line that has at least one in so many of all lines is indexed at its first place only; there are no more such lines.
HOT_SHARE = 100_000
#: Larger buckets are dealt by bands of lengths.
BANDED = 32
#: Rows of a bucket, or of a band of it, of which all pairs are counted.
PAIRED = 512
_LONG = 1 << 20


def with_plain(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with a column of the text in lower case, with single blanks for white space within lines; line ends stay.

    In steps: each is named several times by the next, so it is computed once a text.
    """
    docs = docs.withColumn(name, F.lower(text))
    odd = F.lit(False)
    for sign in "\t\r\x0b\x0c":
        odd = odd | F.contains(F.col(name), F.lit(sign))
    docs = docs.withColumn(name, F.when(odd, F.regexp_replace(name, "[\\t\\r\\x0B\\f]", " ")).otherwise(F.col(name)))
    return docs.withColumn(name, F.when(F.contains(F.col(name), F.lit("  ")), F.regexp_replace(name, " {2,}", " ")).otherwise(F.col(name)))


def lines_of(docs: DataFrame) -> DataFrame:
    """i, at (place of the line), line (plain) and lh (its hash) for docs (i, t); lines without words are left out."""
    lines = with_plain(docs, "t", "p").select("i", F.posexplode(F.split("p", "\n")).alias("at", "line"))
    return lines.withColumn("line", F.trim("line")).filter("line <> ''").withColumn("lh", F.xxhash64("line"))


def hashed_words(lines: DataFrame, width: int) -> DataFrame:
    """lines (with line) and h (hashes of the words) and runs (their number; 0 for a line of less than width words)."""
    cut = lines.withColumn("h", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)))
    return cut.withColumn("runs", F.greatest(F.size("h") - (width - 1), F.lit(0))).drop("line")


def combined(width: int) -> Column:
    """For each run of h and runs the hash of its first width words."""
    out = F.slice("h", 1, F.col("runs"))
    for k in range(1, width):
        out = F.zip_with(out, F.slice("h", k + 1, F.col("runs")), lambda a, b: F.xxhash64(a, b))
    return out


def tokens(width: int) -> Column:
    """The tokens of h and runs, in order."""
    return F.sort_array(F.array_distinct(combined(width)))


def prefix_size(n: Column, percent: float) -> Column:
    """So many first tokens of a set hold one of any similar set."""
    return (n - F.ceil(n * percent / 100 - 1e-9) + 1).cast("int")


def index(lines: DataFrame, width: int, percent: int) -> DataFrame:
    """key, lh, line and sketch for lines (lh, h, runs): the keys of the first tokens, of which similar lines share one, and the
    line in figures (see figures); repeated runs of a line may give repeated rows.

    Tokens are in order of the hash of their first two words, and all up to the wanted number of different hashes are taken. So
    there are as many different tokens at least, whatever runs are repeated in a line; and whole runs are hashed only where taken.
    Of a line that repeats most of its hashes all tokens are taken, once each. The sketch has a bit for each 64th of the hashes,
    set where their number is odd: two sketches differ in no more bits than the lines in tokens.
    """
    run = lambda at: F.xxhash64(*(F.get("h", at + k) for k in range(width)))
    cut = lines.withColumn("order", combined(min(2, width))).withColumn("firsts", F.array_distinct(F.sort_array("order"))).withColumn("distinct", F.size("firsts"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(63).cast("int"))
    sketch = F.aggregate("firsts", F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseXOR(bit(x)))
    all_runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("runs") - 1), run))
    cut = cut.select("lh", "h", "runs", "order", "firsts", "distinct", sketch.alias("sketch"), F.when(2 * F.col("distinct") < F.col("runs"), all_runs).alias("all"))
    most = F.get("firsts", F.least(prefix_size(F.col("runs"), percent), "distinct") - 1)
    cut = cut.withColumn("whole", F.col("all").isNotNull()).withColumn("most", F.when(F.col("whole"), (1 << 63) - 1).otherwise(most))
    n, least = F.when(F.col("whole"), F.size("all")).otherwise(F.col("runs")), F.when(F.col("whole"), F.size("all")).otherwise(F.col("distinct"))
    packed = F.when(n < _LONG, n).otherwise(_LONG - 1).cast("bigint"), F.when(n < _LONG, least).otherwise(0).cast("bigint"), F.shiftright("most", 42) + (1 << 21)
    cut = cut.withColumn("line", F.shiftleft(packed[0], 42).bitwiseOR(F.shiftleft(packed[1], 22)).bitwiseOR(packed[2]))
    # an inner explode, or a comparison as it is, would make the arrays twice, for a filter on what is not null
    rows = cut.select("lh", "h", "whole", "most", "line", "sketch", F.posexplode_outer(F.when(F.col("whole"), F.col("all")).otherwise(F.col("order"))).alias("at", "order"))
    rows = rows.filter(F.coalesce(F.col("order") <= F.col("most"), F.col("most").isNotNull()))
    return rows.select(F.when(F.col("whole"), F.col("order")).otherwise(run(F.col("at"))).alias("key"), "lh", "line", "sketch")


def figures(line: Column) -> tuple[Column, Column, Column]:
    """Of a line of the index: its runs, at least so many different ones, and the top of the order of its last token there.

    Lines of _LONG runs or more are said to have none different at least, which allows all that their number would.
    """
    low = _LONG - 1
    return F.shiftright(line, 42).cast("int"), F.shiftright(line, 22).bitwiseAND(low).cast("int"), line.bitwiseAND((1 << 22) - 1)


def wanted(a: Column, b: Column, percent: int) -> Column:
    """So many tokens two lines of the index have in common at least, if they are similar."""
    least_a, least_b = figures(a)[1], figures(b)[1]
    return F.greatest((least_a + least_b) * percent / (100 + percent), F.greatest(least_a, least_b) * percent / 100)


def may_be_similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether lines (of the index) that share so many keys can be similar.

    What they share up to where the index of one ends are keys of both, so beyond the shared keys there is no more than what
    the line whose index ends first has after it: ceil(t * runs) - 1.
    """
    (runs_a, _, top_a), (runs_b, _, top_b) = figures(a), figures(b)
    rest_a, rest_b = runs_a - prefix_size(runs_a, percent), runs_b - prefix_size(runs_b, percent)
    rest = F.when(top_a < top_b, rest_a).when(top_a > top_b, rest_b).otherwise(F.greatest(rest_a, rest_b))
    return shared + rest >= wanted(a, b, percent) - 1e-6


def bands(line: Column, percent: int) -> tuple[Column, Column]:
    """The first and the last of the bands of lengths in which a line of the index meets similar ones; two of them meet in
    the greater of their first ones."""
    runs, least, _ = figures(line)
    # bands are a little wider than similar lengths differ, for rounding
    band = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(100.01 / percent))).cast("int")
    return band(least), band(runs) + 1


def met_lines(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lines that share enough keys of the index (key, lh, line, sketch) to be similar, and buckets (key, lh).

    Of a bucket of up to BANDED rows all pairs are counted. A larger one is dealt by bands of lengths, and those of up to PAIRED
    rows are counted alike; what then still is larger is returned as buckets: similar lines are a pair, or share one of these.
    """
    whole = Window.partitionBy("key")
    met = rows.withColumn("least", F.min("lh").over(whole)).withColumn("most", F.max("lh").over(whole)).withColumn("n", F.count("*").over(whole)).filter("least <> most")
    met = saved(met.select("key", "lh", "line", "sketch", (F.col("n") > min(BANDED, PAIRED)).alias("large")).distinct(), "met")
    first, last = bands(F.col("line"), percent)
    small = met.filter("not large").select("key", "lh", "line", "sketch", F.lit(0).alias("first"), F.lit(0).alias("band"))
    large = met.filter("large").select("key", "lh", "line", "sketch", first.alias("first"), F.explode(F.sequence(first, last)).alias("band"))
    large = saved(large.withColumn("n", F.count("*").over(Window.partitionBy("key", "band"))).filter("n > 1"), "banded")
    few = small.unionByName(large.filter(F.col("n") <= PAIRED).drop("n"))
    a, b = (few.select("key", "band", *(F.col(c).alias(c + s) for c in ("lh", "line", "sketch", "first"))) for s in "ab")
    both = a.join(b, ["key", "band"]).filter((F.col("lha") < F.col("lhb")) & (F.col("band") == F.greatest("firsta", "firstb")))
    runs = [figures(F.col(c))[0] for c in ("linea", "lineb")]
    both = both.filter(F.least(*runs) >= wanted(F.col("linea"), F.col("lineb"), percent) - 1e-6)
    # similar lines differ in so many tokens at most; of _LONG lines the number is not known
    differ = (runs[0] + runs[1]) * (100 - percent) / (100 + percent) + 1e-6
    both = both.filter((F.bit_count(F.col("sketcha").bitwiseXOR(F.col("sketchb"))) <= differ) | (F.greatest(*runs) >= _LONG - 1))
    pairs = both.groupBy(F.col("lha").alias("a"), F.col("lhb").alias("b"), "linea", "lineb").agg(F.count("*").alias("shared"))
    pairs = pairs.filter(may_be_similar(F.col("shared"), F.col("linea"), F.col("lineb"), percent)).select("a", "b")
    # what still is large is dealt by bands
    return saved(pairs, "pairs"), large.filter(F.col("n") > PAIRED).select(F.xxhash64("key", "band").alias("key"), "lh")


def later_lines(docs: DataFrame, *, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """i, at, lh: the lines (places from 0 between line ends, and the hash of the plain line) that go.

    Lines are compared in lower case with white space as single blanks. Tokens are runs of width words; a line of fewer
    words is one token, so it is similar to equal lines only. A line goes if the Jaccard similarity of its token set and
    that of an earlier line is at least so many per cent, whether or not the earlier line goes itself. Earlier is by doc_id,
    then place. Lines without words never go, and rows without text or doc_id lose nothing. Equal lines of rows that repeat
    a doc_id are equally early at the same place: neither removes the other; of similar ones there the one of greater hash
    goes. Lines are known by 64-bit hashes. Jobs run while the result is made.
    """
    picked = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    lines = lines_of(picked)
    places = saved(lines.select("i", "at", "lh"), "places")
    firsts = saved(places.groupBy("lh").agg(F.min(F.struct("i", "at")).alias("first"), F.count("*").alias("weight")), "lines")
    repeated = not picked.groupBy("i").count().filter("count > 1").isEmpty()
    # hot lines are so few by what hot means
    total = firsts.agg(F.sum("weight")).first()[0] or 0
    hot = F.broadcast(firsts.filter(F.col("weight") >= max(2, total / HOT_SHARE)).select("lh", "first"))
    once = lines.join(hot, "lh", "left").filter(F.col("first").isNull() | (F.struct("i", "at") == F.col("first"))).select("lh", "line")
    pairs, buckets = met_lines(index(hashed_words(once, width), width, percent), percent)
    # in the order of ids earlier lines come first
    known = firsts.select("lh", F.struct(F.col("first.i").alias("i"), F.col("first.at").alias("at"), "lh").alias("id"))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("lh")).unionByName(buckets.select("lh")).distinct().join(known, "lh")
    # only the texts of lines that are asked for are made plain and cut
    asked = saved(asked.groupBy("id.i").agg(F.collect_list("id").alias("ids")), "asked")
    few = (asked.agg(F.sum(F.size("ids"))).first()[0] or 0) <= BROADCAST_IDS
    found = with_plain(picked.join(F.broadcast(asked) if few else asked, "i"), "t", "p").withColumn("p", F.split("p", "\n"))
    found = found.select("p", F.explode("ids").alias("id")).select("id", F.trim(F.get("p", F.col("id.at"))).alias("line"))
    # only of rows that repeat a doc_id some have another line at the place, or the same
    found = found.filter(F.xxhash64("line") == F.col("id.lh")).dropDuplicates(["id"]) if repeated else found
    sets = saved(hashed_words(found, width).select("id", tokens(width).alias("tokens")), "sets")
    x, y = (sets.select(F.col("id.lh").alias(k), F.col("id").alias(k + "_id"), F.col("tokens").alias(k + "_set")) for k in "ab")
    alike = similar(F.size(F.array_intersect("a_set", "b_set")), F.size("a_set"), F.size("b_set"), percent)
    gone = pairs.join(x, "a").join(y, "b").filter(alike).select(F.greatest("a_id", "b_id")["lh"].alias("lh"))
    if not buckets.isEmpty():
        buckets = saved(buckets.join(known, "lh").select("key", "id"), "buckets")
        gone = gone.unionByName(later(buckets, lambda some: sets.join(some, "id"), percent).select("id.lh"))
    gone = saved(gone.distinct().withColumn("gone", F.lit(True)), "gone")
    several = firsts.join(gone, "lh", "left").filter("gone or weight > 1")
    return places.join(several, "lh").filter(F.coalesce("gone", F.lit(False)) | (F.struct("i", "at") > F.col("first"))).select("i", "at", "lh")


def dedup_lines(docs: DataFrame, *, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without its later lines (see later_lines): all its rows and columns, with the text cut, and before them
    the columns __n_lines and __n_removed.

    A null text stays null and has no lines; an empty text has one; a text all of whose lines go is empty.
    """
    found = later_lines(docs, width=width, percent=percent, text=text, doc_id=doc_id)
    gone = saved(found.groupBy("i").agg(F.collect_set(F.struct("at", "lh")).alias("gone")), "later-lines")
    out = docs.select(F.col(doc_id).alias("i"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(gone, "i", "left")
    own = F.col("row").getField(text)
    # texts that lose nothing need no plain one
    out = with_plain(out.withColumn("__cut", F.when(F.col("gone").isNotNull(), own)), "__cut", "plain")
    out = out.withColumn("lines", F.split(own, "\n")).withColumn("plain", F.split("plain", "\n"))
    # rows that repeat a doc_id lose only what they have; plain is named twice, so that it is computed once a text
    mine = F.filter("gone", lambda g: F.col("plain").isNotNull() & (F.xxhash64(F.trim(F.get("plain", g["at"]))) == g["lh"]))
    out = out.withColumn("mine", F.transform(mine, lambda g: g["at"])).withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "mine"))
    cut = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(F.transform("kept", lambda k: F.get("lines", k)), "\n"))
    removed = F.size(F.coalesce("mine", F.array().cast("array<int>"))).cast("bigint")
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    return out.select(n_lines.alias("__n_lines"), removed.alias("__n_removed"), *((cut if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))
