"""Small building blocks for Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether one of `parts` occurs; a byte search, far cheaper than a regex."""
    tests = [F.contains(text, F.lit(part)) for part in parts]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def caseless(text: Column) -> Column:
    """Lower case, with the dotted and dotless i of Turkish read as a plain i."""
    plain = F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u0131"), F.lit("i"))
    return F.lower(plain)
