"""Line lists of requests, and options with a fenced list inside free text: parsed, validated, with what was rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.rules import composite_key
from gleanery.sources.tables import carry_section, lines

#: The form of a line (id, major, minor, label), and headers of sections.
LINE = r"(?i)^(tt[0-9]{7,10})(?::s([0-9]{1,2})(?::e([0-9]{1,3}))?)?(?:\s+(.*))?$"
SECTIONS = [("series", r"(?iu)^#\s*[-–—]+\s*series(?![A-Za-z0-9_])"), ("single", r"(?iu)^#\s*[-–—]+\s*(?:pel[ií]culas|movies)(?![A-Za-z0-9_])")]
#: Words of flags, and fences that hold a list.
TRUE_WORDS, FALSE_WORDS = ["1", "true", "si", "sí", "yes", "y", "x", "on"], ["0", "false", "no", "off"]
FENCE = r"(?is)```[ \t]*(?:watchlist|txt|text|plain)?[ \t]*\n(.*?)```"


def _group(pattern: str, k: int, text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, k)), F.lit(""))


def parsed_lines(files: DataFrame, file: str, text: str) -> DataFrame:
    """One row for each line that is neither blank nor only a comment: file, pos, raw, ok, id, major, minor, label, kind, hint, key.

    Sections set the hint for the lines below them; a line with coordinates hints at a series by itself.
    """
    rows = lines(files.select(F.col(file).alias("file"), F.col(text).alias("__text")), "__text", ["file"])
    header = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS):
        header = F.when(F.trim("line").rlike(pattern), name).otherwise(header)
    rows = carry_section(rows, ["file"], "pos", header)
    rows = rows.select("file", "pos", F.trim("line").alias("raw"), "section", F.trim(F.regexp_replace("line", "#.*$", "")).alias("__line")).filter("__line <> ''")
    part = lambda k: _group(LINE, k, F.col("__line"))
    rows = rows.select("file", "pos", "raw", "section", F.col("__line").rlike(LINE).alias("ok"), F.lower(part(1)).alias("id"), part(2).cast("int").alias("major"), part(3).cast("int").alias("minor"), part(4).alias("label"))
    deep = F.col("major").isNotNull()
    rows = rows.withColumn("kind", F.when(deep, "series").otherwise("single")).withColumn("hint", F.when(deep, "series").otherwise(F.col("section")))
    return rows.withColumn("key", F.when(F.col("ok"), composite_key(F.col("id"), F.concat(F.lit("s"), "major"), F.concat(F.lit("e"), "minor")))).drop("section")


def parse_requests(files: DataFrame, file: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects). requests: file, ord (line of the first of its key), id, kind, hint, major, minor, label, repeats; rejects: file,
    pos, raw, reason.

    Of lines of one key in a file the first counts, with the first label that any has, and with a later hint at a series where it
    has none. Null texts have no lines.
    """
    rows = parsed_lines(files, file, text)
    good = rows.filter("ok")
    first = F.min_by(F.struct("id", "kind", "major", "minor", "hint"), "pos")
    labelled = F.col("label").isNotNull()
    once = good.groupBy("file", "key").agg(F.min("pos").alias("ord"), first.alias("f"), F.min_by(F.when(labelled, F.col("label")), F.when(labelled, F.col("pos"))).alias("label"), F.max(F.when(F.col("hint") == "series", F.col("hint"))).alias("late"), (F.count("*") - 1).alias("repeats"))
    found = once.select("file", "ord", "f.id", "f.kind", F.coalesce("f.hint", "late").alias("hint"), "f.major", "f.minor", "label", "repeats")
    return found, rows.filter("not ok").select("file", "pos", "raw", F.lit("no_id").alias("reason"))


def line_counts(requests: DataFrame, rejects: DataFrame) -> DataFrame:
    """file, valid, duplicates, invalid, groups (requests of a whole major) for each file with a line."""
    good = requests.groupBy("file").agg(F.count("*").alias("valid"), F.sum("repeats").alias("duplicates"), F.count_if((F.col("kind") == "series") & F.col("minor").isNull()).alias("groups"))
    bad = rejects.groupBy("file").agg(F.count("*").alias("invalid"))
    zero = F.lit(0).cast("bigint")
    return good.join(bad, "file", "full_outer").select("file", *(F.coalesce(c, zero).alias(c) for c in ("valid", "duplicates", "invalid", "groups")))


def fenced(text: Column) -> tuple[Column, Column]:
    """(list, outside): the first fenced block that may hold a list, and the text without it; without one both are the text."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    has = plain.rlike(FENCE)
    whole = F.regexp_extract(plain, FENCE, 0)
    at = F.instr(plain, whole)
    outside = F.concat(F.substring(plain, F.lit(1), at - 1), F.substring(plain, at + F.length(whole), F.length(plain)))
    return F.when(has, F.regexp_extract(plain, FENCE, 1)).otherwise(plain), F.when(has, outside).otherwise(plain)


def option(text: Column, *names: str) -> Column:
    """The value of the first line 'name: value' or 'name = value'; null without one or where it is blank."""
    return _group(rf"(?im)^[ \t]*(?:{'|'.join(names)})[ \t]*[:=][ \t]*([^\n]*)$", 1, text)


def flag(value: Column, default: bool) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(default)


def whole_number(value: Column, default: int, least: int, most: int) -> Column:
    """The number that a value starts with, within bounds; the default without one."""
    digits = F.nullif(F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1), F.lit(""))
    n = F.coalesce(digits.try_cast("decimal(38,0)"), F.when(digits.isNotNull(), F.when(F.startswith(digits, F.lit("-")), least).otherwise(most)).cast("decimal(38,0)"), F.lit(default).cast("decimal(38,0)"))
    return F.greatest(F.least(n, F.lit(most)), F.lit(least)).cast("int")


def choice(value: Column, words: dict[str, list[str]], default: str) -> Column:
    word, out = F.lower(F.trim(value)), F.lit(default)
    for name, aliases in words.items():
        out = F.when(word.isin(aliases), name).otherwise(out)
    return out


def first_id(value: Column) -> Column:
    """The first id inside a value, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), r"(?i)(?<![A-Za-z0-9_])(tt[0-9]{7,10})(?![A-Za-z0-9_])", 1))
