"""Two extractions of the same narratives: what differs, and both as one.

``pairs`` has one row a narrative: rules and other, structs with drugs, reactions, age, sex, relevant_history, causality and
overall_severity. Everything here is a projection of that row. Where the other engine gave nothing, its struct is null and
there is no difference to tell; an engine that failed has a struct with empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def names(items: Column, field: str) -> Column:
    """Distinct lower-case names, sorted; null lists are empty."""
    got = F.transform(F.filter(items, lambda x: x[field].isNotNull()), lambda x: F.lower(x[field]))
    return F.array_sort(F.array_distinct(F.coalesce(got, F.array().cast("array<string>"))))


def only_in(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def detail_gaps(rules: Column, other: Column) -> Column:
    """(reaction, field, rules_value, other_value) where the rules lack what the other engine tells of a reaction."""
    lacking = lambda v: v.isNull() | (v == "unknown")

    def of(o: Column, r: Column) -> Column:
        each = F.array(
            *(
                F.when(
                    lacking(r[f]) & ~lacking(o[f]),
                    F.struct(o["reaction"].alias("reaction"), F.lit(f).alias("field"), r[f].alias("rules_value"), o[f].alias("other_value")),
                )
                for f in ("severity", "onset", "outcome")
            )
        )
        return F.array_compact(each)

    same = lambda o: F.filter(rules, lambda r: F.lower(r["reaction"]) == F.lower(o["reaction"]))
    per = F.flatten(F.transform(other, lambda o: F.transform(same(o), lambda r: of(o, r))))
    return F.filter(per, lambda g: F.size(g) > 0)


def field_gaps(rules: Column, other: Column, fields: tuple[str, ...]) -> Column:
    """(field, rules_value, other_value) of the fields that differ; null differs from every value but null."""
    each = F.array(
        *(
            F.when(~rules[f].eqNullSafe(other[f]), F.struct(F.lit(f).alias("field"), rules[f].alias("rules_value"), other[f].alias("other_value")))
            for f in fields
        )
    )
    return F.array_compact(each)


def merged(mine: Column, theirs: Column, field: str) -> Column:
    """Items of the rules, then those of the other engine whose name the rules don't have, its own repeats kept."""
    known = names(mine, field)
    return F.concat(mine, F.coalesce(F.filter(theirs, lambda x: x[field].isNotNull() & ~F.array_contains(known, F.lower(x[field]))), F.slice(mine, F.lit(1), F.lit(0))))
