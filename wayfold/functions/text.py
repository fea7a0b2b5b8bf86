"""Column expressions that bring dirty text to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as a Java character class.
SPACE = r"[\s\x{85}\p{Z}]"


def padded(c: Column | str) -> Column:
    """Lower case without white space around it; null where nothing is left."""
    bare = F.lower(F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", ""))
    return F.when(bare != "", bare)


def day(c: Column | str) -> Column:
    """A date in one notation (yyyymmdd): year first, or day.month.year; anything else as :func:`padded` gives it."""
    bare = padded(c)
    year_first = F.regexp_replace(bare, r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})$", "$1$2$3")
    return F.regexp_replace(year_first, r"^(\d{2})[-/.](\d{2})[-/.](\d{4})$", "$3$2$1")


def digest16(c: Column | str) -> Column:
    """The first 16 hex digits of a digest, lower case; null for none, for all zeros and for fewer than 16."""
    bare = F.regexp_replace(F.regexp_replace(padded(c), r"^(sha-?256\W*)?(0x)?", ""), "[^0-9a-f]", "")
    return F.when((F.length(bare) >= 16) & ~bare.rlike("^0+$"), F.substring(bare, 1, 16))


def words(c: Column | str) -> Column:
    """The distinct runs of a-z and 0-9 after lower-casing, sorted; null for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))))
