"""How complete an extraction is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _told(c: Column, word: str | None = None) -> Column:
    """Filled; with ``word``, anything but that word, null included."""
    return F.coalesce(c, F.lit("")) != "" if word is None else ~c.eqNullSafe(word)


def score(drugs: Column, reactions: Column, age: Column, sex: Column, causality: Column, severity: Column) -> Column:
    """Points out of 95 for what an extraction holds."""
    has = lambda items, test: F.coalesce(F.exists(items, test), F.lit(False))
    # fixed values: points for each thing told
    tests = (
        (F.coalesce(F.size(drugs), F.lit(0)) > 0, 15),
        (has(drugs, lambda d: _told(d["dose"])), 10),
        (F.coalesce(F.size(reactions), F.lit(0)) > 0, 15),
        (has(reactions, lambda r: _told(r["severity"])), 8),
        (has(reactions, lambda r: _told(r["onset"])), 4),
        (has(reactions, lambda r: _told(r["outcome"], "unknown")), 3),
        (_told(age), 10),
        (_told(sex), 10),
        (_told(causality, "unassessable"), 10),
        (_told(severity), 10),
    )
    total = F.lit(0)
    for test, points in tests:
        total = total + F.when(test, points).otherwise(0)
    return total.cast("long")


def verdict(points: Column) -> Column:
    # fixed values: borders of the verdicts
    return F.when(points >= 80, "HIGH").when(points >= 50, "MEDIUM").otherwise("LOW")
