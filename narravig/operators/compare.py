"""One table of all reactions of a narrative, its label and the reports, merged by name.

Four sources are united with an ordinal (source, place): the narrative's reactions, the label's cleaned items, list terms in
warning sections, and the fifty commonest reported terms. One keyed aggregation then merges them in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig import lexicons as lex
from narravig.functions.text import exploded
from narravig.operators import match
from narravig.operators.extract import entries, literal, occurring_each

TOP = 50
HEADERS = tuple(h.lower() for h in lex.WARNING_HEADERS)
KIND = (
    "array<struct<key:string,reaction:string,src:int,ord:bigint,severity:string,onset:string,outcome:string,in_narrative:boolean,"
    "report_count:bigint,sections:array<string>,drug:string>>"
)


def _report(terms: Column, rule) -> Column:
    return F.get(F.filter(terms, rule), 0)


def _row(src: int, at: Column, name: Column, count: Column, sections: Column, told: Column | None = None) -> Column:
    value = lambda f, other: told[f] if told is not None else other
    none = F.lit(None).cast("string")
    return F.struct(
        F.lower(F.trim(name)).alias("key"),
        name.alias("reaction"),
        F.lit(src).alias("src"),
        at.cast("long").alias("ord"),
        value("severity", none).alias("severity"),
        value("onset", none).alias("onset"),
        value("outcome", F.lit("unknown")).alias("outcome"),
        F.lit(told is not None).alias("in_narrative"),
        F.coalesce(count, F.lit(0)).cast("long").alias("report_count"),
        sections.alias("sections"),
        value("drug", none).alias("drug"),
    )


def _tag(reaction: Column) -> Column:
    return match.tags(reaction, F.col("raw_reactions"), F.col("raw_warnings"))


def _together(*sources: Column) -> Column:
    """All sources in one array: what they are made of is computed once."""
    empty = F.array().cast(KIND)
    return F.concat(*(F.coalesce(x, empty) for x in sources))


def _with_terms(df: DataFrame) -> DataFrame:
    return df.withColumn("_terms", F.coalesce(F.col("terms"), F.array().cast("array<struct<rank:bigint,term:string,cnt:bigint>>")))


def listed(parts: DataFrame, reaction_lex: DataFrame) -> DataFrame:
    """``parts`` with array ``listed``: the rows of the sources that no narrative has a part in, label items, terms in warnings, and reports.

    ``parts`` has items, sections, raw_reactions, raw_warnings of a label and terms of a drug, as ``full`` says.
    """

    def item(x: Column, i: Column) -> Column:
        head = F.substring(x, F.lit(1), F.lit(60))
        kept = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
        name = F.when(F.length(x) > 60, F.when(F.contains(head, F.lit(" ")), kept).otherwise(head)).otherwise(x)
        words = match.keywords(name, 3)
        hit = F.when(F.size(words) > 0, _report(F.col("_terms"), lambda t: match.all_in(words, t["term"])))
        warned = F.exists(F.col("sections"), lambda s: match.any_in(words, F.lower(s["body"])))
        tagged = F.when(F.coalesce(warned, F.lit(False)), F.array(F.lit("Adverse Reactions"), F.lit("Warning"))).otherwise(F.array(F.lit("Adverse Reactions")))
        return _row(2, i, name, hit["cnt"], tagged)

    parts = _with_terms(parts)
    known = entries(reaction_lex, "term")
    skip = set(HEADERS) | set(lex.EXCLUDED_TERMS)
    if known is not None:
        known_terms = literal([(n, t) for n, t in known if t not in skip])
        size = max((n for n, _ in known), default=0) + 1
    else:
        # too many terms for literals: each section's are found beforehand
        size = reaction_lex.where("term <> ''").agg(F.max("ord")).first()[0] + 1
        bodies = F.transform("sections", lambda s: F.lower(s["body"]))
        parts = occurring_each(parts, bodies, reaction_lex.where(~F.lower("term").isin(*skip)), "term", "_listed")

    def warned(s: Column, i: Column) -> Column:
        hits = F.filter(known_terms, lambda x: F.contains(F.lower(s["body"]), x["name"])) if known is not None else F.get(F.col("_listed"), i)

        def one(x: Column) -> Column:
            both = lambda t: F.contains(t["term"], x["name"]) | F.contains(x["name"], t["term"])
            hit = F.coalesce(_report(F.col("_terms"), lambda t: t["term"] == x["name"]), _report(F.col("_terms"), both))
            return _row(3, i.cast("long") * size + x["ord"], x["name"], hit["cnt"], F.array(F.lit("Warning")))

        return F.transform(hits, one)

    keep = lambda t: ~t["term"].isin(*HEADERS) & ~t["term"].isin(*lex.EXCLUDED_TERMS)
    top = F.filter(F.slice("_terms", 1, TOP), keep)
    sources = (
        F.transform(F.filter("items", lambda x: ~F.lower(x).isin(*HEADERS)), item),
        F.flatten(F.transform("sections", warned)),
        F.transform(top, lambda t: _row(4, t["rank"], t["term"], t["cnt"], _tag(t["term"]))),
    )
    return parts.withColumn("listed", _together(*sources)).drop("_terms", "_listed")


def full(cases: DataFrame, reaction_lex: DataFrame) -> DataFrame:
    """id, reaction, severity, onset, outcome, in_narrative, found_in_label, report_count, label_sections, drug, ord.

    ``cases`` has one row an id: reactions (as extracted), items and sections of the label (arrays; null without a label),
    raw_reactions and raw_warnings, and terms (rank, term, cnt) of the drug in order (null without reports); or, in place of
    items and sections, ``listed`` as made once for each drug. All are bounded by one narrative, one label and the limit of
    terms a drug, so every step but the merge is a projection.
    """
    cases = _with_terms(cases if "listed" in cases.columns else listed(cases, reaction_lex))

    def told(r: Column) -> Column:
        key = F.lower(F.trim(r["reaction"]))
        words = match.keywords(key, 3)
        hit = F.coalesce(_report(F.col("_terms"), lambda t: t["term"] == key), _report(F.col("_terms"), lambda t: match.all_in(words, t["term"])))
        return _row(1, r["ord"], r["reaction"], hit["cnt"], _tag(r["reaction"]), r)

    own = F.transform(F.filter("reactions", lambda r: ~F.lower(F.trim(r["reaction"])).isin(*HEADERS)), told)
    rows = exploded(cases, _together(own, F.col("listed")), "r", "id").select("id", "r.*")
    # every source but a narrative's or a report's own term has sections, so having some is being in the label
    return merge(rows.withColumn("found_in_label", F.size("sections") > 0))


def merge(rows: DataFrame) -> DataFrame:
    """The rows of each (id, key) folded in order: see the column rules below; independent of partitioning."""
    o = F.struct("src", "ord")
    last = lambda c, where: F.max_by(c, F.when(where, o))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    told = ~F.col("outcome").eqNullSafe("unknown")
    # a null outcome counts as told and may win, so it travels in a struct
    out = rows.groupBy("id", "key").agg(
        F.min_by("reaction", o).alias("reaction"),
        last("severity", filled("severity")).alias("severity"),
        last("onset", filled("onset")).alias("onset"),
        F.max_by(F.struct("outcome"), F.when(told, o)).alias("_outcome"),
        F.bool_or("in_narrative").alias("in_narrative"),
        F.bool_or("found_in_label").alias("found_in_label"),
        F.coalesce(last("report_count", F.col("report_count") != 0), F.lit(0)).cast("long").alias("report_count"),
        F.min_by("drug", F.when(filled("drug"), o)).alias("drug"),
        F.array_sort(F.collect_list(F.struct("src", "ord", "sections"))).alias("_sections"),
        F.min(o).alias("_first"),
    )
    return out.select(
        "id",
        "reaction",
        "severity",
        "onset",
        F.when(F.col("_outcome").isNull(), "unknown").otherwise(F.col("_outcome.outcome")).alias("outcome"),
        "in_narrative",
        "found_in_label",
        "report_count",
        F.array_distinct(F.flatten(F.transform("_sections", lambda s: s["sections"]))).alias("label_sections"),
        "drug",
        F.col("_first.src").alias("src"),
        F.col("_first.ord").alias("ord"),
    )
