"""Title keys and words of texts in any script: compatibility forms folded, accents gone."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Years in brackets, and tags with all that follows them.
YEARS = r"\(\s*(?:19|20)[0-9]{2}(?:\s*[–-]\s*(?:19|20)?[0-9]{0,4})?\s*\)"
TAG = r"(?i)\b(?:s[0-9]{1,2}\s*e[0-9]{1,3}|s[0-9]{1,2}|temporada\s*[0-9]{1,2}|season\s*[0-9]{1,2}|[0-9]{1,2}x[0-9]{2,3})\b.*$"
_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def unaccented(text: Column) -> Column:
    """The text in compatibility form without accents. Texts that are ASCII do not go to Python: they are as they should be."""

    def decomposed(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKD").str.replace("[\u0300-\u036f]", "", regex=True)

    plain = F.octet_length(text) == F.char_length(text)
    return F.coalesce(F.pandas_udf(decomposed, StringType())(F.when(~plain, text)), text)


def title_key(text: Column) -> Column:
    """What titles have in common: no accents, years in brackets or tags ('S01E02', 'season 2', '1x02') and what follows one, lower case, words
    of letters and digits with single blanks. Null if nothing is left or if it looks like an id."""
    key = F.regexp_replace(F.regexp_replace(unaccented(text), YEARS, " "), TAG.replace(r"\b", _EDGE), " ")
    key = F.trim(F.regexp_replace(F.lower(key), "[^a-z0-9]+", " "))
    return F.when((key != "") & ~key.rlike("^tt[0-9]{7,10}$"), key)


def significant_words(text: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct words of ASCII letters alone, at least so long and not in the stop list, in order of first place, of the text without accents."""
    words = F.filter(F.split(F.lower(unaccented(text)), "[^a-z0-9]+"), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop)).cast("array<string>"))
