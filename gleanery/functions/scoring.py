"""Additive scores from tables of rules, with what each rule gave."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.languages import java
from gleanery.functions.rules import rounded


@dataclass
class Rule:
    """points (a number or a Column) where condition is true. Of the rules of one group only the first whose condition is true counts; a rule
    without a group always does. Null conditions and points give nothing."""

    name: str
    condition: Column
    points: float | Column
    group: str | None = None


def parts(rules: list[Rule]) -> Column:
    """A struct of what each rule gave, by its name."""
    taken: dict[str, Column] = {}
    out = []
    for rule in rules:
        holds = F.coalesce(rule.condition, F.lit(False))
        own = holds
        if rule.group is not None:
            before = taken.get(rule.group)
            own = holds if before is None else holds & ~before
            taken[rule.group] = holds if before is None else before | holds
        points = rule.points if isinstance(rule.points, Column) else F.lit(float(rule.points))
        out.append(F.when(own, F.coalesce(points, F.lit(0.0))).otherwise(F.lit(0.0)).alias(rule.name))
    return F.struct(*out)


def total(given: Column, rules: list[Rule], digits: int | None = 2) -> Column:
    """The sum of the parts, rounded half up."""
    out = F.lit(0.0)
    for rule in rules:
        out = out + given[rule.name]
    return out if digits is None else rounded(out, digits)


def measure_points(x: Column, cap: int = 100, factor: float = 1.5, none: float = -3.0) -> Column:
    """A capped logarithm: an unknown measure gives nothing, zero or less counts against the record."""
    return F.when(x.isNull(), 0.0).when(x <= 0, none).otherwise(factor * F.log10(F.least(x, F.lit(cap)) + 1))


#: Points of categories, of sources (the first that fits), of features, and penalties.
CATEGORY = {"4K": 3.25, "1080p": 3.0, "720p": 1.5, "480p": 0.5}
UNKNOWN_CATEGORY, UPSCALED = 1.0, 2.75
SOURCES = [("bluray", r"\b(?:bluray|blu-?ray)\b", 0.12), ("web_dl", r"\bweb-?dl\b", 0.10), ("remux", r"\bremux\b", 0.08), ("web", r"\bweb(?:rip)?\b", 0.06), ("rip", r"\b(?:brrip|bdrip)\b", 0.05), ("hdtv", r"\bhdtv\b", 0.03)]
FEATURES = [("audio", r"\b(?:truehd|atmos|dts-?hd|dts|ddp|eac3|ac3|aac|opus|flac)\b", 0.04), ("lossless", r"\b(?:truehd|dts-?hd|flac)\b", 0.03), ("deep", r"\b(?:10bit|10-bit)\b", 0.02), ("range", r"\b(?:hdr10\+?|dolby[ ._-]?vision|dv)\b", 0.03)]
PENALTIES = [("stereo", r"\b(?:3d|h-?sbs|h-?ou|half-?sbs|half-?ou)\b", -1.5), ("burnt_in", r"\b(?:hc|hardsubs?|hardcoded)\b", -1.0)]
UPSCALED_TEXT = r"(?:re-?escal|upscal|ai[\s._-]?enhanced)"
OFF_TOPIC, WRONG, HUGE, LARGE = -3.0, -5.0, -2.5, -1.0
GIB = 1024**3


#: What the rules look for in texts.
IN_TEXTS = {"upscaled": UPSCALED_TEXT, **{name: p for name, p, _ in (*SOURCES, *FEATURES, *PENALTIES)}}


def text_matches(text: Column) -> Column:
    """A struct of booleans: which of IN_TEXTS the text matches."""
    return F.struct(*(text.rlike(java(p)).alias(name) for name, p in IN_TEXTS.items()))


def record_rules(category: Column, measure: Column, size: Column, text: Column, off_topic: Column, wrong: Column, found: Column | None = None) -> list[Rule]:
    """The default table for records: category, measure, source, features, penalties for content and size. found: text_matches(text), where that is
    a column already."""
    fits = lambda name: text.rlike(java(IN_TEXTS[name])) if found is None else found[name]
    rules = [Rule("upscaled", (category == "4K") & fits("upscaled"), UPSCALED, "category")]
    rules += [Rule(f"is_{name.lower()}", category == name, points, "category") for name, points in CATEGORY.items()]
    rules += [Rule("other_category", F.lit(True), UNKNOWN_CATEGORY, "category"), Rule("measure", F.lit(True), measure_points(measure))]
    rules += [Rule(name, fits(name), points, "source") for name, _, points in SOURCES] + [Rule(name, fits(name), points) for name, _, points in FEATURES]
    rules += [Rule("off_topic", off_topic, OFF_TOPIC), Rule("wrong", wrong, WRONG)] + [Rule(name, fits(name), points) for name, _, points in PENALTIES]
    return rules + [Rule("huge", size > 40 * GIB, HUGE, "size"), Rule("large", size > 25 * GIB, LARGE, "size")]
