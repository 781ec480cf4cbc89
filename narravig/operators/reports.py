"""Counts of reported reactions by drug."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(reports: DataFrame, limit: int | None = 500) -> DataFrame:
    """drug, term, cnt, rank: distinct reports by drug and exact term, the commonest first, ties by term.

    Rows of a report are unique by (report_id, line_no). Both aggregations combine before their shuffle; the ranking works
    on one row a term. ``limit`` terms a drug are kept; None keeps all. Null drugs or reactions aren't counted.
    """
    each = reports.where("drug IS NOT NULL AND reaction IS NOT NULL AND reaction <> ''").select("report_id", "line_no", F.upper("drug").alias("drug"), F.col("reaction").alias("term")).distinct()
    grouped = each.groupBy("drug", "term").agg(F.count("*").alias("cnt"))
    order = Window.partitionBy("drug").orderBy(F.col("cnt").desc(), F.col("term"))
    ranked = grouped.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def by_term(counted: DataFrame) -> DataFrame:
    """drug, term in lower case, cnt, rank: of terms that differ in case, the first's rank with the last's count."""
    return counted.groupBy("drug", F.lower("term").alias("term")).agg(F.min("rank").alias("rank"), F.max_by("cnt", "rank").alias("cnt"))


def top(folded: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` first terms of each drug after folding, ranked anew; a drug has at most as many rows as were counted."""
    order = Window.partitionBy("drug").orderBy("rank", "term")
    return folded.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
