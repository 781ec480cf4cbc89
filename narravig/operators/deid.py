"""Redaction by ordered rules, with the list of what was replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig.functions.text import rx
from narravig.lexicons import REDACTIONS


def redact(text: Column) -> Column:
    """The rules one after the other, each on what the one before left. Null stays null."""
    for _, pattern, label in REDACTIONS:
        text = F.regexp_replace(text, rx(pattern), label)
    return text


def findings(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``redacted``, ``changed`` and ``findings``: rule, original and label, by rule then place."""
    at, lists = F.col(text), []
    out = df
    for i, (name, pattern, label) in enumerate(REDACTIONS):
        hits = F.regexp_extract_all(at, F.lit(rx(pattern)), 0)
        lists.append(F.transform(hits, lambda h: F.struct(F.lit(i).alias("rule_no"), F.lit(name).alias("rule"), h.alias("original"), F.lit(label).alias("label"))))
        out = out.withColumn(f"_t{i}", F.regexp_replace(at, rx(pattern), label)).withColumn(f"_f{i}", lists[-1])
        at = F.col(f"_t{i}")
    n = len(REDACTIONS)
    made = F.flatten(F.array(*(F.col(f"_f{i}") for i in range(n))))
    out = out.withColumns({"redacted": at, "findings": made, "changed": ~at.eqNullSafe(F.col(text))})
    return out.drop(*(f"_{k}{i}" for k in "tf" for i in range(n)))
