"""Text expressions whose results agree across engines; all are built-in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode classes, where a dot stops at line feeds only."""
    return f"(?Ud{'i' if ignore_case else ''})" + pattern


def first(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The first match or null."""
    got = F.regexp_extract(text, rx(pattern, ignore_case), group)
    return F.when(got != "", got)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rx(r"^\s+|\s+$"), "")


def slice_(text: Column, start: Column, end: Column) -> Column:
    """Characters start to end (from 0), clamped at the front."""
    start = F.greatest(start, F.lit(0))
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row; inside lambdas a plain column would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def filled(text: Column) -> Column:
    """The text, or null if it is empty; ``text`` must be cheap, it is looked at twice."""
    return F.when(text != "", text)


def exploded(df: DataFrame, items: Column, alias: str, *keep, pos: str | None = None) -> DataFrame:
    """``keep`` and one row an element that isn't null, as ``alias``, with its place if ``pos`` names it.

    An inner explode would make the optimizer compute the array a second time, in a filter on its size below.
    """
    each = F.posexplode_outer(items).alias(pos, alias) if pos else F.explode_outer(items).alias(alias)
    return df.select(*keep, each).where(F.col(alias).isNotNull())
