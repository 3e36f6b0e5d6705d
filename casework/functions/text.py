"""String helpers whose results match Python's ``re`` and ``str`` methods.

Java's ``\\s`` and ``\\d`` are ASCII-only by default, so patterns carry ``(?U)``;
the separators ``\\x1c``-``\\x1f`` count as white space in Python but not in Java.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

WS = r"[\s\x1c-\x1f]"
# What ``str.strip`` takes off; U+3000 is the last of them.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """``str.strip()``."""
    return F.btrim(col(c), F.lit(BLANKS))


def is_filled(c: Column | str) -> Column:
    """Python truthiness of an optional string; never null."""
    return col(c).isNotNull() & (col(c) != "")


def text_or_empty(c: Column | str) -> Column:
    """The value as text, a missing one as the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null when nothing matches."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(col(c), F.lit(pattern)), F.lit(0)).cast("bigint")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
