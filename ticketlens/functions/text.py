"""Text helpers: trimming, line splitting, phrase tests and numeric tokens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, that is the Unicode space characters plus the four
# ASCII separators.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\R|[\x1c-\x1e]"

# Any Unicode decimal digit counts as a digit.
DIGIT = r"\p{Nd}"
NUMBER_TOKEN = rf"({DIGIT}[{DIGIT},]*(?:\.{DIGIT}+)?%?(?:/{DIGIT}+)?)"


def strip(x: Column) -> Column:
    """Trim all white space, not only blanks; only the ends of the text are read."""
    return F.btrim(x, F.lit(_SPACES))


def lines(x: Column) -> Column:
    return F.split(x, LINE_BREAK)


def has_digit(x: Column) -> Column:
    return x.rlike(DIGIT)


def number_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(NUMBER_TOKEN), F.lit(1))


def mentions_any(x: Column, phrases: Sequence[str]) -> Column:
    """True where the lower-cased text contains one of the phrases."""
    lowered = F.lower(x)
    return reduce(lambda a, b: a | b, (lowered.contains(phrase) for phrase in phrases))


def starts_with_any(x: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (x.startswith(p) for p in prefixes))


def title(x: Column) -> Column:
    """Capitalise every run of letters, also after a digit, hyphen or apostrophe."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")
