"""Whole pipelines over tables: narratives against labels and report counts, and two engines side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig.functions.text import exploded, strip
from narravig.operators import compare, enginediff, extract, labels, match, reports

EMPTY = "array<string>"


def narratives(raw: DataFrame) -> DataFrame:
    """narrative_id, drug_name, engine, t of the narratives with text."""
    return raw.where("narrative IS NOT NULL").select("narrative_id", "drug_name", "engine", F.col("narrative").alias("t"))


def validated(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Narratives to work on, and errors(narrative_id, code, message) for those without text."""
    blank = F.coalesce(F.col("narrative"), F.lit("")).rlike(r"(?U)^\s*$")
    bad = raw.where(blank).select("narrative_id", F.lit(400).cast("long").alias("code"), F.lit("No narrative provided").alias("message"))
    return raw.where(~blank), bad.distinct()


def label_parts(picked: DataFrame) -> DataFrame:
    """``drug``, label_id, items, sections, raw_reactions, raw_warnings: what comparisons need of each label, as one projection."""
    warnings, precautions = labels.element0("warnings"), labels.element0("warnings_and_precautions")
    filled = lambda c: F.when(c != "", c)
    found = labels.sections(warnings)
    return picked.select(
        "drug",
        "label_id",
        F.coalesce(labels.items(labels.element0("adverse_reactions")), F.array().cast(EMPTY)).alias("items"),
        F.coalesce(F.transform(found, lambda s: F.struct(s["header"].alias("header"), s["body"].alias("body"))), F.array().cast("array<struct<header:string,body:string>>")).alias("sections"),
        F.lower(F.coalesce(labels.element0("adverse_reactions"), F.lit(""))).alias("raw_reactions"),
        F.lower(F.coalesce(filled(warnings), filled(precautions), F.lit(""))).alias("raw_warnings"),
    )


def cases(told: DataFrame, raw_labels: DataFrame, counted: DataFrame, reaction_lex: DataFrame | None = None) -> DataFrame:
    """One row a narrative with a drug: its reactions, its label's parts and its drug's report terms.

    Narratives and labels that stand twice count once. The labels that are meant are found first, so only they are taken apart.
    With ``reaction_lex`` the label's items and sections give way to ``compare.listed``, worked out once for each drug.
    """
    asked = told.where("drug_name IS NOT NULL").select(F.col("narrative_id").alias("id"), F.lower(strip(F.col("drug_name"))).alias("drug_key"), "reactions").dropDuplicates(["id"])
    meant = label_parts(labels.for_drugs(asked, "drug_key", raw_labels)).withColumnRenamed("drug", "drug_key")
    terms = reports.by_term(counted).groupBy(F.lower("drug").alias("drug_key")).agg(F.array_sort(F.collect_list(F.struct("rank", "term", "cnt"))).alias("terms"))
    parts = meant.join(terms, "drug_key", "full")
    if reaction_lex is not None:
        parts = compare.listed(parts, reaction_lex).drop("items", "sections")
    return asked.join(parts, "drug_key", "left")


def analyze(raw: DataFrame, raw_labels: DataFrame, raw_reports: DataFrame, drug_lex: DataFrame, reaction_lex: DataFrame) -> DataFrame:
    """The full comparison of every narrative that names a drug."""
    told = extract.extract(narratives(raw), "t", drug_lex, reaction_lex, True)
    return compare.full(cases(told, raw_labels, reports.counts(raw_reports), reaction_lex), reaction_lex)


def pairs(told: DataFrame, ai: DataFrame) -> DataFrame:
    """id, rules, other for enginediff: an extraction beside the other engine's of the same narrative."""
    none = F.lit(None).cast("string")
    rules = F.struct("drugs", "reactions", "age", "sex", none.alias("relevant_history"), "causality", "overall_severity").alias("rules")
    e = F.col("extraction")
    lists = lambda f, kind: F.coalesce(e[f], F.array().cast(kind))
    other = F.struct(
        lists("drugs", "array<struct<name:string,dose:string,route:string,indication:string>>").alias("drugs"),
        lists("reactions", "array<struct<reaction:string,severity:string,onset:string,outcome:string,drug:string>>").alias("reactions"),
        e["patient"]["age"].alias("age"),
        e["patient"]["sex"].alias("sex"),
        e["patient"]["relevant_history"].alias("relevant_history"),
        e["causality"].alias("causality"),
        e["overall_severity"].alias("overall_severity"),
    ).alias("other")
    mine = told.select(F.col("narrative_id").alias("id"), rules)
    theirs = ai.select(F.col("narrative_id").alias("id"), other, F.col("error").isNotNull().alias("failed"))
    return mine.join(theirs, "id", "left")


def compare_engines(both: DataFrame) -> DataFrame:
    """The merged extraction: skipped, as rules alone, where the other engine is missing or failed."""
    fine = F.col("other").isNotNull() & ~F.coalesce(F.col("failed"), F.lit(False))
    r, o = F.col("rules"), F.col("other")
    slim = lambda items, fields: F.transform(items, lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    drug, reaction = ("name", "dose", "route", "indication"), ("reaction", "severity", "onset", "outcome", "drug")
    mine_d, mine_r = slim(r["drugs"], drug), slim(r["reactions"], reaction)
    filled = lambda f, empty=None: F.when(fine & (r[f].isNull() | (r[f] == (empty or ""))), F.coalesce(o[f], r[f])).otherwise(r[f])
    return both.select(
        "id",
        F.when(fine, enginediff.merged(mine_d, o["drugs"], "name")).otherwise(mine_d).alias("drugs"),
        F.when(fine, enginediff.merged(mine_r, o["reactions"], "reaction")).otherwise(mine_r).alias("reactions"),
        filled("causality", "unassessable").alias("causality"),
        filled("overall_severity").alias("overall_severity"),
        filled("relevant_history").alias("relevant_history"),
    )


def compared_engines(both: DataFrame, told: DataFrame, raw_labels: DataFrame, counted: DataFrame, reaction_lex: DataFrame | None = None) -> DataFrame:
    """One row a narrative with a drug, as ``cases``, of the reactions that both engines give together."""
    numbered = F.transform("reactions", lambda r, i: F.struct(i.alias("ord"), *(r[f].alias(f) for f in ("reaction", "severity", "onset", "outcome", "drug"))))
    merged = compare_engines(both).select(F.col("id").alias("narrative_id"), numbered.alias("reactions"))
    named = told.select("narrative_id", "drug_name").dropDuplicates(["narrative_id"])
    return cases(merged.join(named, "narrative_id"), raw_labels, counted, reaction_lex)


def document(aware: bool) -> Column:
    """An extraction as one nested record: drugs, reactions, patient, causality, overall_severity; the other engine's adds notes."""
    slim = lambda items, fields: F.transform(items, lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    drug, reaction = ("name", "dose"), ("reaction", "severity", "onset", "outcome", "drug")
    patient = [F.col("age"), F.col("sex")]
    note = []
    if not aware:
        drug = (*drug, "route", "indication")
        patient.append(F.lit(None).cast("string").alias("relevant_history"))
        note = [F.format_string("Extracted by rules. %d drug(s), %d reaction(s) found.", F.size("drugs"), F.size("reactions")).alias("notes")]
    return F.struct(slim(F.col("drugs"), drug).alias("drugs"), slim(F.col("reactions"), reaction).alias("reactions"), F.struct(*patient).alias("patient"), "causality", "overall_severity", *note)


def report_match(told: DataFrame, counted: DataFrame) -> DataFrame:
    """narrative_id, ord, reaction, matched_term, report_count for the reactions of narratives with a drug."""
    rows = exploded(told.where("drug_name IS NOT NULL"), F.col("reactions"), "r", "narrative_id", F.upper(strip(F.col("drug_name"))).alias("drug_key"))
    rows = rows.select("narrative_id", "drug_key", "r.ord", "r.reaction").distinct()
    words = match.keywords(F.replace(F.col("reaction"), F.lit("-"), F.lit(" ")), 3)
    return match.match_reports(rows, reports.by_term(counted), words)
