"""Title and language rules as columns.

Unicode composition and case folding have no built-in; they run in an Arrow UDF that receives only
the rows with a character they could change (the rest arrive as nulls and never leave the JVM's result).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronoweft import settings

_ODD_SPACE = r"\x{09}-\x{0D}\x{1C}-\x{1F}"
_WIDE_SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CASELESS = r"\x{3030}-\x{3098}\x{309B}-\x{33FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{1F300}-\x{1FAFF}"
# characters that are composed already and that nothing composes with
COMPOSED = r"\x{00}-\x{2FF}\x{388}-\x{482}\x{48A}-\x{52F}\x{2002}-\x{20CF}" + _CASELESS
# of those, the ones that fold to their lower case, and the sharp s
FOLDED = (r"\x{00}-\x{B4}\x{B6}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}\x{400}-\x{482}\x{48A}-\x{52F}"
          r"\x{2002}-\x{20CF}" + _CASELESS)


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.str.casefold()


@F.pandas_udf(StringType())
def _compose_fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v).casefold(), na_action="ignore")


def _wide(value: Column) -> Column:
    return F.octet_length(value) > F.length(value)


def _uncomposed(value: Column) -> Column:
    """True where a character is outside ``COMPOSED``; the cheap tests come first."""
    return _wide(value) & value.rlike(r"[\x{300}-\x{FFFF}]") & value.rlike(f"[^{COMPOSED}]")


def _unfolded(value: Column) -> Column:
    """True where a character is outside ``FOLDED``; the cheap tests come first."""
    return (_wide(value) & (value.contains("µ") | value.rlike(r"[\x{100}-\x{FFFF}]"))
            & value.rlike(f"[^{FOLDED}]"))


def _only(odd: Column, value: Column, fn, plain: Column) -> Column:
    return F.when(odd, fn(F.when(odd, value))).otherwise(plain)


def _lower(value: Column) -> Column:
    return F.lower(F.replace(value, F.lit("ß"), F.lit("ss")))


def compose(value: Column) -> Column:
    """Canonical composition (NFC)."""
    return _only(_uncomposed(value), value, _compose, value)


def casefold(value: Column) -> Column:
    """Full Unicode case folding (``ß`` becomes ``ss``), unlike SQL ``lower``."""
    return _only(_unfolded(value), value, _fold, _lower(value))


def normalize_title(value: Column) -> Column:
    """NFC, no NUL, every run of Unicode whitespace one space, trimmed."""
    text = F.replace(compose(value), F.lit("\x00"), F.lit(""))

    def join(spaced: Column) -> Column:
        return F.regexp_replace(spaced, " {2,}", " ")

    # composition makes no white space and takes none away, so the tests read the given text
    wide = _wide(value) & value.rlike(r"[\x{85}\x{A0}\x{1680}-\x{3000}]")
    return F.trim(
        F.when(wide, join(F.regexp_replace(text, f"[{_ODD_SPACE}{_WIDE_SPACE}]", " ")))
        .when(value.rlike(r"[\x{09}-\x{1F}]"), join(F.regexp_replace(text, f"[{_ODD_SPACE}]", " ")))
        .when(value.contains("  ") | value.contains("\x00"), join(text)).otherwise(text))


def language_code(value: Column, names: dict[str, str] | None = None) -> Column:
    """Provider language name to a code; null where the language is not supported."""
    known = {"english": "en"} if names is None else names
    # composition leaves white space alone; one function for both steps is one worker per task
    text = F.regexp_replace(value, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    name = _only(_unfolded(text), text, _compose_fold, _lower(text))
    out = F.lit(None).cast("string")
    for text, code in known.items():
        out = F.when(name == text, code).otherwise(out)
    return out


def selects_title(title: Column, include: str = settings.INCLUDE_TITLES,
                  exclude: str = settings.EXCLUDE_TITLES) -> Column:
    """Whole-word keyword match after known false positives are blanked out."""
    text = title
    if exclude:
        text = F.regexp_replace(text, rf"(?iU)(?<!\w)(?:{exclude})(?!\w)", " ")
    return text.rlike(rf"(?iU)(?<!\w)(?:{include})(?!\w)")


def is_sensitive_key(key: Column) -> Column:
    """True for parameter and header names that carry secrets."""
    decoded = F.coalesce(F.try_url_decode(F.replace(key, F.lit("+"), F.lit("%2B"))), key)
    return F.lower(F.trim(decoded)).isin(*settings.SENSITIVE_KEYS)


def redact_headers(headers: Column) -> Column:
    """Header map with the values of sensitive names replaced."""
    return F.transform_values(
        headers, lambda k, v: F.when(is_sensitive_key(k), F.lit("REDACTED")).otherwise(v)
    )


def redact_url(url: Column) -> Column:
    """Locator without credentials, fragment or secret query values; null when not absolute."""
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    authority = F.regexp_replace(F.regexp_extract(url, shape, 2), r"^.*@", "")
    query = F.regexp_extract(url, shape, 4)

    def hide(part: Column) -> Column:
        key = F.substring_index(part, "=", 1)
        return F.when(is_sensitive_key(key), F.concat(key, F.lit("=REDACTED"))).otherwise(part)

    parts = F.array_join(F.transform(F.split(query, "&"), hide), "&")
    return F.when(
        url.rlike(shape) & (F.regexp_replace(authority, r":[0-9]*$", "") != ""),
        F.concat(
            F.lower(F.regexp_extract(url, shape, 1)), F.lit("://"),
            F.lower(F.regexp_replace(authority, r":$", "")), F.regexp_extract(url, shape, 3),
            F.when(query != "", F.concat(F.lit("?"), parts)).otherwise(""),
        ),
    )
