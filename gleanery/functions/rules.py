"""Rule tables compiled to columns: normalisation of messy text without any Python in the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def first_match(rules: list[tuple[str, str]], *texts: Column) -> Column:
    """Label of the first rule (label, pattern) that the first text matches, else by the next text, else null.

    Patterns should avoid \\b, which regex engines read differently; write (^|[^a-z]) and the like.
    """
    each = []
    for text in texts:
        out = F.lit(None).cast("string")
        for label, pattern in reversed(rules):
            out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
        each.append(out)
    return F.coalesce(*each)


def all_tags(rules: list[tuple[str, str]], text: Column, hides: dict[str, list[str]] | None = None, most: int | None = None) -> Column:
    """Labels of all rules that match, in the order of the rules; a label hides others; at most so many stay."""
    tags = F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules)))
    for label, hidden in (hides or {}).items():
        tags = F.when(F.array_contains(tags, label), F.array_except(tags, F.array(*map(F.lit, hidden)))).otherwise(tags)
    return F.slice(tags, 1, most) if most else tags


def bounded_int(text: Column, default: int, least: int, most: int) -> Column:
    """A whole number from text, or the default; clamped."""
    return F.greatest(F.least(F.coalesce(text.try_cast("int"), F.lit(default)), F.lit(most)), F.lit(least))


def valid_key(key: Column, digits: int = 40) -> Column:
    """Lower-cased, trimmed key if it is that many hex digits and not all zero, else null."""
    clean = F.lower(F.trim(key))
    return F.when(clean.rlike(f"^[0-9a-f]{{{digits}}}$") & ~clean.rlike("^0+$"), clean)


def size_bytes(text: Column) -> Column:
    """Bytes from text like '1,5 GB', '700MiB' or '700 B' (1024-based, decimal comma or point); null without a size."""
    pattern = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(?:([kmgt])i?)?b(?![a-z])"
    number, unit = F.regexp_extract(text, pattern, 1), F.upper(F.regexp_extract(text, pattern, 2))
    power = F.when(unit == "", 0).when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4)
    return F.floor(F.replace(number, F.lit(","), F.lit(".")).try_cast("double") * F.pow(F.lit(1024.0), power) + 0.5)


def size_text(size: Column) -> Column:
    """'1.5 GB' and the like: one decimal from KB on, none from 100 on; null for nothing and less."""
    out = F.format_string("%d B", size.cast("bigint"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        value = size / float(1024**power)
        shown = F.when(value >= 100, F.format_string("%d", F.floor(value + 0.5))).otherwise(F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10))
        out = F.when(size >= 1024**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.when(size > 0, out)


#: Fixed value: tags behind a name, and all that follows them.
NAME_TAG = r"(?i)\s*[-–—:|,]?\s*(?:(?:temporadas?|seasons?|temp\.?|saison)(?:\s*[0-9]|\s+complet)|t[0-9]{1,2}(?![A-Za-z0-9_])|s[0-9]{1,2}(?:\s*e[0-9]{1,3})?(?![A-Za-z0-9_])|[0-9]{1,2}x[0-9]{2,3}(?![A-Za-z0-9_])).*$"


def base_name(text: Column, known: Column | None = None) -> Column:
    """A name without what qualifies it: a member or major tag ('S01E02', 'season 2', 'T4', '1x02') and what follows it, or a
    year in brackets at its end; the known name, or null, where nothing is left."""
    name = F.regexp_replace(text, NAME_TAG, "")
    name = F.nullif(F.trim(F.regexp_replace(name, r"\s*\([0-9]{4}(?:[-–][0-9]{0,4})?\)\s*$", "")), F.lit(""))
    return name if known is None else F.coalesce(name, known)


def target(text: Column) -> Column:
    """struct(id, major, minor, label) of an id alone, with coordinates (id:s1, id:s1:e2 or id:1:2), with a label behind it, or in a url."""
    pattern = r"(?i)^(?:https?://\S*/)?(tt[0-9]{7,10})(?::s?([0-9]{1,2})(?::e?([0-9]{1,3}))?)?(?:(?:\s+(.*))|(?:[/?#]\S*))?$"
    part = lambda k: F.nullif(F.trim(F.regexp_extract(F.trim(text), pattern, k)), F.lit(""))
    return F.struct(F.lower(part(1)).alias("id"), part(2).cast("bigint").alias("major"), part(3).cast("bigint").alias("minor"), part(4).alias("label"))


def composite_key(*parts: Column) -> Column:
    """Parts joined by ':', nulls left out."""
    return F.concat_ws(":", *(p.cast("string") for p in parts))


def member_tag(major: Column, minor: Column) -> Column:
    """S01E02: two digits at least."""

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), F.greatest(F.lit(2), F.length(x.cast("string"))), F.lit("0"))

    return F.concat(F.lit("S"), two(major), F.lit("E"), two(minor))


def years_in(text: Column, known: Column | None = None, least: int = 1900, most: int = 2100) -> Column:
    """Distinct four-digit numbers in range that are not in known (array of int)."""
    years = F.filter(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda y: y.try_cast("int")), lambda y: y.between(least, most))
    return F.array_except(F.array_distinct(years), known) if known is not None else F.array_distinct(years)


def masked(text: Column) -> Column:
    """Runs of digits as '#': a template of messages that differ in numbers only."""
    return F.regexp_replace(text, "[0-9]+", "#")


def csv_guarded(cell: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets a leading quote."""
    return F.when(cell.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def clean(text: Column, most: int) -> Column:
    """Control characters as blanks, runs of blanks as one, trimmed, cut to a length."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", " "), " +", " ")), F.lit(most))


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up, towards plus infinity, as scores are compared."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def param_values(url: Column, name: str) -> Column:
    """Decoded values of a repeated query parameter, distinct, in order."""
    query = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    pairs = F.filter(F.split(query, "&"), lambda p: F.startswith(p, F.lit(f"{name}=")))
    return F.array_distinct(F.array_compact(F.transform(pairs, lambda p: F.try_url_decode(F.substring(p, len(name) + 2, 1 << 20)))))


def faceted(items: DataFrame, picks: str, *, text: list[str], terms: str = "", quality: str | None = None, slot: str | None = None, fewer: int | None = None) -> DataFrame:
    """Items of which some pick (slot, quality) has the quality, which have the slot, have fewer distinct slots than asked, and whose
    text columns together hold all terms, whatever their case. A facet that is not given lets all through."""
    hay = F.lower(F.concat_ws(" ", *text))
    out = items
    if quality is not None:
        out = out.filter(F.exists(picks, lambda p: p["quality"] == quality))
    if slot is not None:
        out = out.filter(F.exists(picks, lambda p: p["slot"] == slot))
    if fewer is not None:
        out = out.filter(F.size(F.array_distinct(F.transform(picks, lambda p: p["slot"]))) < fewer)
    for term in terms.lower().split():
        out = out.filter(F.contains(hay, F.lit(term)))
    return out
