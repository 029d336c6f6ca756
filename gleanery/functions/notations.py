"""Coordinates (major, minor) and their ranges in free text, by a table of notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Notations of members. Groups: major, first minor, last minor (may be missing).
MEMBER_NOTATIONS = [
    ("S01E01-E03", r"(?i)(?<![A-Za-z0-9_])s([0-9]{1,2})[\s._-]*e([0-9]{1,3})(?:[._]?(?:-|e)e?([0-9]{1,3}))?"),
    ("1x01-03", r"(?i)(?<![0-9])(?<![0-9]\.)([0-9]{1,2})x(?!26[45])([0-9]{2,3})(?:[-_]([0-9]{2,3}))?(?![A-Za-z0-9_])"),
    ("Cap.101_103", r"(?i)(?<![A-Za-z0-9_])cap[\s._-]*([0-9]{1,2})([0-9]{2})(?:[\s._-]+[0-9]{1,2}([0-9]{2}))?(?![A-Za-z0-9_])"),
]
#: Notations of majors. Groups: first major, last major (may be missing).
MAJOR_NOTATIONS = [
    ("S01-S08", r"(?i)(?<![A-Za-z0-9_])s([0-9]{1,2})(?![\s._-]*e[0-9])(?:[\s._-]*-[\s._-]*s?([0-9]{1,2}))?(?![A-Za-z0-9_])"),
    ("Season 1-5", r"(?i)(?<![A-Za-z0-9_])(?:seasons?|temporadas?|temp|saisons?|stagion[ei]|staffel)[\s._:-]*([0-9]{1,2})(?:[\s._-]*(?:-|a|al|to|&|y)[\s._-]*([0-9]{1,2}))?(?![A-Za-z0-9_])"),
    ("T04", r"(?i)(?<![A-Za-z0-9_])t([0-9]{1,2})(?![A-Za-z0-9_])()"),
]
#: Fixed value: a range of members that is longer than this is a slip, and counts as its first member.
LONGEST = 50


def _groups(text: Column, pattern: str, names: list[str]) -> Column:
    """An array of structs of the groups of all matches, as numbers; a group that is missing is null."""
    each = [F.regexp_extract_all(text, F.lit(pattern), k + 1) for k in range(len(names))]
    zipped = F.arrays_zip(*(x.alias(n) for x, n in zip(each, names, strict=True)))
    return F.transform(zipped, lambda m: F.struct(*(m[n].try_cast("int").alias(n) for n in names)))


def member_ranges(text: Column, notations: list[tuple[str, str]] = MEMBER_NOTATIONS) -> Column:
    """array<struct<major, low, high>>: the members that a text names, in all notations. A last member before the first, or
    over LONGEST behind it, is ignored. Null for a null text."""
    found = F.concat(*(_groups(text, p, ["major", "low", "high"]) for _, p in notations))

    def bounded(m: Column) -> Column:
        return F.struct(m["major"].alias("major"), m["low"].alias("low"), F.when(m["high"].between(m["low"], m["low"] + LONGEST), m["high"]).otherwise(m["low"]).alias("high"))

    return F.transform(found, bounded)


def major_ranges(text: Column, notations: list[tuple[str, str]] = MAJOR_NOTATIONS) -> Column:
    """array<struct<low, high>>: the majors that a text names whole."""
    found = F.concat(*(_groups(text, p, ["low", "high"]) for _, p in notations))
    return F.transform(found, lambda m: F.struct(m["low"].alias("low"), F.coalesce(m["high"], m["low"]).alias("high")))


def member_evidence(major: Column, minor: Column, file: Column, title: Column) -> Column:
    """'match', 'mismatch' or 'unknown': whether a record is the member asked for.

    The first of file name and title that names members decides; where none does, the majors that the title names. A
    null coordinate, or texts that name nothing, are unknown.
    """
    return evidence_of(major, minor, member_ranges(file), member_ranges(title), major_ranges(title))


def evidence_of(major: Column, minor: Column, of_file: Column, of_title: Column, majors: Column) -> Column:
    """member_evidence from the members that file name and title name, and the majors that the title does (null: none)."""
    none = F.array().cast("array<struct<major:int,low:int,high:int>>")
    of_file, of_title = (F.coalesce(x, none) for x in (of_file, of_title))
    members = F.when(F.size(of_file) > 0, of_file).otherwise(of_title)
    majors = F.coalesce(majors, F.array().cast("array<struct<low:int,high:int>>"))
    hit = F.when(F.size(members) > 0, F.exists(members, lambda m: (m["major"] == major) & minor.between(m["low"], m["high"])))
    hit = hit.when(F.size(majors) > 0, F.exists(majors, lambda m: major.between(m["low"], m["high"])))
    return F.when(major.isNull() | minor.isNull() | hit.isNull(), "unknown").when(hit, "match").otherwise("mismatch")
