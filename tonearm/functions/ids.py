"""Numbers in ids. Ids of one thing are spelled in several ways; the integer made of their digits identifies it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_number(c: Column | str) -> Column:
    """The integer made of all digits of a string; null for null, for no digits and beyond 64 bits."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")


def basename(c: Column | str) -> Column:
    """The part after the last slash."""
    return F.substring_index(c, "/", -1)


def first_number(c: Column | str) -> Column:
    """The first run of digits as an integer, or null."""
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("bigint")
