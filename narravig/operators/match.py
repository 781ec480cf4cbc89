"""Narrative reactions against labels and report counts.

The rules differ in their keywords only: words longer than ``least`` letters, split at ``split``. A reaction with no such
word matches the first term (``vacuous``) or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig.functions.text import let


def keywords(term: Column, least: int, split: str = r"(?U)\s+") -> Column:
    return F.filter(F.split(F.lower(term), split), lambda w: F.length(w) > least)


def all_in(words: Column, blob: Column) -> Column:
    return F.forall(words, lambda w: F.contains(blob, w))


def any_in(words: Column, blob: Column) -> Column:
    return F.exists(words, lambda w: F.contains(blob, w))


def match_reports(reactions: DataFrame, terms: DataFrame, words: Column, exact: bool = True, vacuous: bool = True) -> DataFrame:
    """``reactions`` (with drug_key, reaction) plus matched_term and report_count.

    A term equal to the reaction wins; else the first by rank that holds all ``words``. The candidates come from an
    equality join on (drug, reaction): each distinct pair meets its drug's terms, collected as one sorted array a drug,
    which the limit of terms a drug bounds.
    """
    listed = terms.groupBy("drug").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "cnt"))).alias("_terms"))
    out = reactions.withColumn("_w", words).join(listed, reactions["drug_key"] == listed["drug"], "left").drop(listed["drug"])
    key = F.lower("reaction")
    like = F.get(F.filter("_terms", lambda t: all_in(F.col("_w"), t["term"])), 0)
    like = like if vacuous else F.when(F.size("_w") > 0, like)
    got = F.coalesce(F.get(F.filter("_terms", lambda t: t["term"] == key), 0), like) if exact else like
    out = out.withColumn("_m", got)
    return out.select(*reactions.columns, F.col("_m.term").alias("matched_term"), F.coalesce(F.col("_m.cnt"), F.lit(0)).cast("long").alias("report_count"))


def match_sections(reaction: Column, sections: Column, items: Column) -> tuple[Column, Column, Column]:
    """(headers, items, found): sections (header, body) and items that hold any word of the reaction."""
    words = F.split(F.lower(reaction), r"(?U)\s+")
    words = F.filter(words, lambda w: w != "")
    heads = F.transform(F.filter(sections, lambda s: any_in(words, F.lower(s["body"]))), lambda s: s["header"])
    hits = F.filter(items, lambda i: any_in(words, F.lower(i)))
    heads, hits = F.coalesce(heads, F.array().cast("array<string>")), F.coalesce(hits, F.array().cast("array<string>"))
    return heads, hits, (F.size(heads) > 0) | (F.size(hits) > 0)


def tags(reaction: Column, raw_reactions: Column, raw_warnings: Column, split: str = r"(?U)\W+") -> Column:
    """Which parts of a label (in small letters, null if missing) name the reaction: the whole term, or all its words over four letters."""
    term = F.lower(F.trim(reaction))

    def of(words: Column) -> Column:
        def named(blob: Column) -> Column:
            return F.contains(blob, term) | ((F.size(words) > 0) & all_in(words, blob))

        return F.array_compact(F.array(F.when(named(raw_reactions), "Adverse Reactions"), F.when(named(raw_warnings), "Warning")))

    made = let(keywords(term, 4, split), of)
    return F.when(F.coalesce(term, F.lit("")) == "", F.array().cast("array<string>")).otherwise(made)
