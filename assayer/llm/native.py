"""Small helpers over DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and \t to \r.
GAPS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often (and inside whatever lambda) body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; null for a null text."""
    return F.filter(F.split(text, GAPS), lambda w: w != "")


def long(n: int) -> Column:
    return F.lit(n).cast("long")
