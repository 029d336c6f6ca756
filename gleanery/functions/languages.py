"""Languages of a record: declared ones, flags and names in its text, without those that tell of subtitles only; tiers and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions of flags and their languages.
REGIONS = {
    "ES": "es", "MX": "es", "AR": "es", "CL": "es", "CO": "es", "PE": "es", "VE": "es", "UY": "es", "GB": "en", "US": "en", "CA": "en", "AU": "en", "IE": "en", "NZ": "en",
    "BR": "pt", "PT": "pt", "FR": "fr", "DE": "de", "IT": "it", "JP": "ja", "RU": "ru", "KR": "ko", "CN": "zh", "TW": "zh", "HK": "zh", "IN": "hi", "PL": "pl", "CZ": "cs", "SK": "sk",
    "NL": "nl", "UA": "uk", "TR": "tr", "HU": "hu", "SE": "sv", "NO": "no", "DK": "da", "FI": "fi", "GR": "el", "SA": "ar", "IL": "he", "TH": "th", "VN": "vi", "ID": "id", "RO": "ro",
    "BG": "bg", "HR": "hr", "RS": "sr", "LT": "lt", "LV": "lv", "EE": "et", "IR": "fa", "MY": "ms",
}
#: What declared languages are called.
ALIASES = {
    "es": ["es", "spa", "esp", "castellano", "latino", "spanish", "español", "espanol"], "en": ["en", "eng", "english", "ingles", "inglés"],
    "pt": ["pt", "por", "portuguese", "português", "portugues", "portugués"], "fr": ["fr", "fra", "fre", "french", "français", "frances", "francés"],
    "de": ["de", "deu", "ger", "german", "aleman", "alemán"], "it": ["it", "ita", "italian", "italiano"], "ja": ["ja", "jpn", "japanese", "japones", "japonés"],
    "ru": ["ru", "rus", "russian"], "ko": ["ko", "kor", "korean"], "zh": ["zh", "chi", "zho", "chinese"],
}
#: Names of languages in texts.
NAMES = [
    ("es", r"\b(?:castellano|espa[ñn]ol|spanish|latino|latam|esp|spa|dual[\s._-]*lat)\b"), ("en", r"\b(?:english|ingl[ée]s|eng)\b"),
    ("fr", r"\b(?:french|fran[çc]ais|franc[ée]s|truefrench|vff|vfq)\b"), ("de", r"\b(?:german|deutsch|alem[áa]n)\b"), ("it", r"\b(?:italian[oa]?|ita)\b"),
    ("pt", r"\b(?:portuguese|portugu[êée]s|dublado)\b"), ("ja", r"\b(?:japanese|japon[ée]s)\b"), ("ru", r"\b(?:russian|rus)\b"), ("hi", r"\bhindi\b"),
]
#: Words for languages and for subtitles; one beside the other tells of subtitles.
WORDS = r"castellano|espa[ñn]ol|spanish|latino|latam|esp|spa|english|ingl[ée]s|eng|french|fran[çc]ais|franc[ée]s|fre|fra|italian[oa]?|ita|german|deutsch|alem[áa]n|ger|portuguese|portugu[êée]s|por|japanese|japon[ée]s|jpn|russian|rus|korean|kor|chinese|hindi"
SUBTITLES = r"subs?|subt[ií]tulos?|subtitulad[oa]s?|subtitles?|subbed|sous[\s.-]?titres?|legendas?|legendado|napisy"
SUBTITLES_FIRST = rf"\b(?:{SUBTITLES})\b[\s._:\-\[(]*(?:(?:en|in)[\s._-]+)?(?:{WORDS})(?:[\s._\-/,&+]+(?:{WORDS}))*\b"
LANGUAGE_FIRST = rf"\b(?:{WORDS})[\s._-]+(?:{SUBTITLES})\b"
#: Evidence for the slots es and en.
ES_AUDIO = NAMES[0][1]
ES_SUBTITLES = rf"\b(?:{SUBTITLES})\b[\s._:\-\[(]*(?:(?:en|in)[\s._-]+)?(?:castellano|espa[ñn]ol|spanish|esp|spa)\b|\b(?:castellano|espa[ñn]ol|spanish|esp|spa)[\s._-]+(?:{SUBTITLES})\b|\bvose\b"
ES_SURE = r"\b(?:castellano|espa[ñn]ol|spanish|latino|latam|es-?la|es-?mx|es-?es)\b"
EN_SURE, EN_SOME, MIXED = r"\b(?:english|eng|en-?us|en-?gb)\b", r"\b(?:eng|english|en)\b", r"\b(?:multi|dual)\b"
OTHER_SCRIPTS = "[\\x{0370}-\\x{03FF}\\x{0400}-\\x{04FF}\\x{0590}-\\x{05FF}\\x{0600}-\\x{06FF}\\x{0900}-\\x{0DFF}\\x{0E00}-\\x{0E7F}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]"
OTHERS = r"\b(?:ita|italian[oa]?|stagion[ei]|french|truefrench|vff|vfq|vf2|vostfr|vost|fr|german|deutsch|ger|hindi|tamil|telugu|malayalam|kannada|bengali|punjabi|urdu|korean|kor|japanese|jpn|chinese|chs|cht|mandarin|cantonese|russian|rus|ukr|ukrainian|polish|pol|pl|lektor|napisy|dubbing|cz|cze|czech|sk|slovak|hun|hungarian|magyar|turkish|tur|arabic|persian|farsi|dutch|nl|nordic|swedish|swe|danish|norwegian|finnish|portuguese|ptbr|pt-br|dublado|legendado|vietnamese|thai|indonesian|greek|hebrew|romanian|bulgarian|croatian|serbian|mvo|dvo|avo|temporada|cap[ií]tulo)\b"

_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_FLAG = "[\\x{1F1E6}-\\x{1F1FF}]"


def java(pattern: str) -> str:
    """The pattern without regard to case, and with \\b between ASCII word characters and others, as other engines read it."""
    return "(?iu)" + pattern.replace(r"\b", _EDGE)


def without_subtitles(text: Column) -> Column:
    """The text without mentions of languages that only tell of subtitles."""
    return F.regexp_replace(F.regexp_replace(text, java(SUBTITLES_FIRST), " "), java(LANGUAGE_FIRST), " ")


def _looked_up(table: dict[str, str], keys: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(keys, lambda k: F.try_element_at(known, k))


def language_set(declared: Column, text: Column) -> Column:
    """array<string>: declared languages (aliases, or codes of two or three letters), those of flags in the text or among the declared, and those
    that the text names other than for subtitles, each once, in this order. Nulls are empty."""
    declared, text = F.coalesce(declared, F.lit("")), F.coalesce(text, F.lit(""))
    aliases = {alias: code for code, names in ALIASES.items() for alias in names}
    tokens = F.filter(F.split(F.lower(declared), r"[,+\s/|]+"), lambda t: t != "")
    said = F.transform(F.arrays_zip(tokens.alias("t"), _looked_up(aliases, tokens).alias("c")), lambda p: F.coalesce(p["c"], F.when(p["t"].rlike("^[a-z]{2,3}$"), p["t"])))
    pairs = F.regexp_extract_all(F.concat_ws(" ", text, declared), F.lit(f"({_FLAG}{{2}})"), 1)
    letters = "".join(chr(0x1F1E6 + k) for k in range(26))
    flags = _looked_up(REGIONS, F.transform(pairs, lambda p: F.translate(p, letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    # array functions are interpreted and share nothing: the text without subtitles is bound to a name, or it would be made for each pattern
    named = F.transform(F.array(without_subtitles(text)), lambda spoken: F.array(*(F.when(spoken.rlike(java(p)), F.lit(code)) for code, p in NAMES)))[0]
    return F.array_distinct(F.array_compact(F.concat(said, flags, named)))


def _has(languages: Column, code: str) -> Column:
    return F.array_contains(languages, code)


def es_tier(languages: Column, text: Column, trusted: Column) -> Column:
    """3: the text, or a trusted source, says Spanish, alone or with English; 2: with others, or only declared; 1: declared among others;
    0: none, or only subtitles."""
    others = F.size(F.array_except(languages, F.array(F.lit("es"), F.lit("en"))))
    heard = F.coalesce(trusted, F.lit(False)) | without_subtitles(text).rlike(java(ES_AUDIO))
    ladder = F.when(~_has(languages, "es"), 0).when(heard, F.when(others == 0, 3).otherwise(2)).when(text.rlike(java(ES_SUBTITLES)), 0)
    return ladder.when(F.size(languages) == 1, 2).otherwise(1)


def en_tier(languages: Column, text: Column, es: Column) -> Column:
    """2: English alone, or no language and no mark of another; 1: English among others; 0: none. es is the record's es_tier."""
    others = F.size(F.array_except(languages, F.array(F.lit("es"), F.lit("en")))) > 0
    foreign = others | text.rlike(OTHER_SCRIPTS) | text.rlike(java(OTHERS))
    mixed = text.rlike(java(MIXED)) | _has(languages, "es")
    english = _has(languages, "en")
    ladder = F.when(es >= 2, english.cast("int")).when(english, F.when(foreign | mixed, 1).otherwise(2))
    return ladder.when((F.size(languages) == 0) & ~foreign, F.when(mixed, 1).otherwise(2)).otherwise(0)


def es_confidence(languages: Column, text: Column, trusted: Column, tier: Column) -> Column:
    ladder = F.when(text.rlike(java(ES_SUBTITLES)), 0.0).when(without_subtitles(text).rlike(java(ES_SURE)), 1.0)
    return ladder.when(_has(languages, "es"), F.when(tier >= 2, 0.9).otherwise(0.55)).when(F.coalesce(trusted, F.lit(False)), 0.8).otherwise(0.0)


def en_confidence(languages: Column, text: Column, tier: Column) -> Column:
    heard = without_subtitles(text)
    ladder = F.when(heard.rlike(java(OTHERS)) & ~heard.rlike(java(EN_SOME)), 0.1).when(heard.rlike(java(EN_SURE)), 1.0)
    return ladder.when(_has(languages, "en"), F.when(tier >= 2, 0.95).otherwise(0.75)).when((F.size(languages) == 0) & ~heard.rlike(OTHER_SCRIPTS), 0.55).otherwise(0.0)
