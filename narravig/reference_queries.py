"""Queries of the narrative, label, report and comparison operators over the tables as stored, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narravig import lexicons as lex
from narravig.functions.text import exploded, first, let, rx, strip
from narravig.operators import compare, deid, enginediff, extract, labels, match, reports, score
from narravig.plans import analysis
from narravig.sources import providers
from narravig.sources.tables import cut, read, spread

LINK = "https://labels.example.org"
TEXTS = tuple(f for f, _ in lex.SECTIONS)


def _told(s: SparkSession, sf: str) -> DataFrame:
    return analysis.narratives(spread(read(s, sf, "narratives", "narrative_id", "drug_name", "engine", "narrative")))


def _lexicons(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return read(s, sf, "drug_lex"), read(s, sf, "reaction_lex")


def _extracted(s: SparkSession, sf: str, aware: bool) -> DataFrame:
    return extract.extract(_told(s, sf), "t", *_lexicons(s, sf), aware)


def _labels(s: SparkSession, sf: str) -> DataFrame:
    return spread(read(s, sf, "drug_labels", "label_id", "set_id", "openfda", *TEXTS))


def _counted(s: SparkSession, sf: str) -> DataFrame:
    return reports.counts(read(s, sf, "reports", "report_id", "line_no", "drug", "reaction"))


def deid_redact(s, sf):
    # two projections, which aren't merged as the second names the first's column twice: the rules run once
    redacted = _told(s, sf).select("narrative_id", "t", deid.redact(F.col("t")).alias("redacted"))
    return redacted.select("narrative_id", "redacted", (F.col("redacted") != F.col("t")).alias("changed")).distinct()


def deid_findings(s, sf):
    found = exploded(deid.findings(_told(s, sf), "t"), F.col("findings"), "f", "narrative_id", pos="hit_no")
    return found.select("narrative_id", F.col("hit_no").cast("long"), "f.rule", "f.original", "f.label").distinct()


def deid_rule_counts(s, sf):
    return deid_findings(s, sf).groupBy("rule").agg(F.count("*").alias("hits"), F.countDistinct("narrative_id").alias("narratives"))


def redaction_marked(s, sf):
    marked = F.regexp_replace(deid.redact(F.col("t")), r"(\[[A-Z]+\])", "<mark>$1</mark>")
    return _told(s, sf).select("narrative_id", marked.alias("marked")).distinct()


def collapse_ws(s, sf):
    text = F.regexp_replace(strip(F.col("text")), rx(r"\s+"), " ")
    return read(s, sf, "documents", "doc_id", "text").select("doc_id", text.alias("text")).where(F.length("text") > 20)


def drug_mentions(s, sf):
    rows = exploded(_extracted(s, sf, False), F.col("drugs"), "d", "narrative_id")
    return rows.select("narrative_id", F.col("d.ord").cast("long").alias("ord"), "d.name", F.col("d.start").cast("long").alias("start"), "d.dose", "d.route", "d.indication").distinct()


def drug_doses_aware(s, sf):
    rows = exploded(_extracted(s, sf, True), F.col("drugs"), "d", "narrative_id")
    return rows.select("narrative_id", "d.name", "d.dose").distinct()


def _reactions(s, sf, aware):
    rows = exploded(_extracted(s, sf, aware), F.col("reactions"), "r", "narrative_id")
    cols = (F.col(f"r.{c}") for c in ("reaction", "severity", "onset", "outcome", "drug"))
    return rows.select("narrative_id", F.col("r.ord").cast("long").alias("ord"), F.col("r.start").cast("long").alias("start"), *cols).distinct()


def reactions_substring(s, sf):
    return _reactions(s, sf, False)


def reactions_aware(s, sf):
    return _reactions(s, sf, True)


def reactions_by_drug(s, sf):
    rows = _reactions(s, sf, True).withColumn("drug", F.coalesce("drug", F.lit("<none>")))
    return rows.groupBy("drug").agg(F.count("*").alias("reactions"), F.countDistinct("narrative_id").alias("narratives"))


def patient_facts(s, sf):
    t = F.col("t")
    facts = {
        "age": first(t, lex.AGE, 1),
        "sex": F.lower(first(t, lex.SEX)),
        "causality": F.coalesce(F.lower(first(t, lex.CAUSALITY)), F.lit("unassessable")),
        "overall_severity": F.lower(first(t, lex.SEVERITY)),
    }
    return _told(s, sf).select("narrative_id", *(c.alias(k) for k, c in facts.items())).distinct()


def extraction_notes(s, sf):
    d, r = F.size("drugs"), F.size("reactions")
    note = F.format_string("Extracted by rules. %d drug(s), %d reaction(s) found.", d, r)
    return _extracted(s, sf, False).select("narrative_id", d.cast("long").alias("drugs"), r.cast("long").alias("reactions"), note.alias("notes")).distinct()


def distinct_drugs(s, sf):
    rows = exploded(_extracted(s, sf, False), F.col("drugs"), "d", "narrative_id").select("narrative_id", F.lower("d.name").alias("name"), "d.ord")
    return rows.groupBy("narrative_id", "name").agg(F.min("ord").cast("long").alias("first_ord"))


def drug_headers(s, sf):
    """The first drug row of each narrative's reactions' drugs, with its dose and route."""
    x = _extracted(s, sf, False)
    rows = exploded(x, F.col("reactions"), "r", "narrative_id", "drugs").where("r.drug IS NOT NULL")
    d = F.filter("drugs", lambda d: F.lower(d["name"]) == F.lower(F.col("r.drug")))[0]
    return rows.select("narrative_id", F.col("r.drug").alias("drug"), d["dose"].alias("dose"), d["route"].alias("route")).distinct()


def evidence_sentence(s, sf):
    rows = exploded(_extracted(s, sf, False), F.col("reactions"), "r", "narrative_id", "t")
    parts = F.regexp_extract_all("t", F.lit(r"[^.!?]+[.!?]*"), 0)
    term = F.lower("r.reaction")
    hit = F.get(F.filter(parts, lambda p: F.contains(F.lower(p), term)), 0)
    marked = F.regexp_replace(strip(hit), F.concat(F.lit(r"(?i)(\Q"), term, F.lit(r"\E)")), F.lit("<mark>$1</mark>"))
    return rows.select("narrative_id", F.col("r.reaction").alias("reaction"), F.coalesce(marked, F.lit("")).alias("sentence")).distinct()


def report_counts_top(s, sf):
    return _counted(s, sf)


def report_top50(s, sf):
    top = reports.top(reports.by_term(_counted(s, sf)), compare.TOP)
    return top.where(~F.col("term").isin(*compare.HEADERS) & ~F.col("term").isin(*lex.EXCLUDED_TERMS)).select("drug", "term", "rank", "cnt")


def report_map(s, sf):
    rows = read(s, sf, "report_counts", "feed", "drug", "term", "cnt", "rank_no").where("term IS NOT NULL").distinct()
    rows = rows.select(F.concat_ws("|", "feed", "drug").alias("drug"), "term", "cnt", F.col("rank_no").cast("long").alias("rank"))
    return reports.by_term(rows).select("drug", "term", "rank", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def _asked(s, sf):
    return read(s, sf, "narratives", "drug_name").where("drug_name IS NOT NULL")


def label_resolve(s, sf):
    return labels.resolve(_asked(s, sf), "drug_name", _labels(s, sf)).withColumn("priority", F.col("priority").cast("long"))


def label_resolve_two_steps(s, sf):
    return labels.resolve(_asked(s, sf), "drug_name", _labels(s, sf), labels.TWO_STEPS).withColumn("priority", F.col("priority").cast("long"))


def label_warning_sections(s, sf):
    return labels.warning_sections(_labels(s, sf)).select("label_id", F.col("ord").cast("long"), "header", "body").distinct()


def label_ar_items(s, sf):
    rows = exploded(_labels(s, sf), labels.items(labels.element0("adverse_reactions")), "item", "label_id", pos="pos")
    return rows.select("label_id", F.col("pos").cast("long"), "item").distinct()


def label_side_effects(s, sf):
    return labels.side_effects(_labels(s, sf)).select("label_id", "section", F.col("ord").cast("long"), "label", "text").distinct()


def label_projection(s, sf):
    flat = labels.projection(_labels(s, sf))
    joined = {c: F.array_join(c, "|", "-") for c in ("brand_name", "generic_name", "manufacturer_name", "route", "product_type")}
    return flat.withColumns(joined).distinct()


def label_sections(s, sf):
    return labels.section_rows(_labels(s, sf)).select("label_id", F.col("ord").cast("long"), "section", "text").distinct()


def label_titles(s, sf):
    drug = F.lit("the drug")
    return _labels(s, sf).select("label_id", labels.title(drug).alias("title"), labels.link(F.col("set_id"), drug, LINK).alias("link")).distinct()


def keyword_context(s, sf):
    return labels.keyword_context(_labels(s, sf), "dose").select("label_id", F.col("hit_no").cast("long"), "context").distinct()


def report_match(s, sf):
    return analysis.report_match(_extracted(s, sf, True), _counted(s, sf)).withColumn("ord", F.col("ord").cast("long"))


def _cases(s, sf, reaction_lex=None):
    return analysis.cases(_extracted(s, sf, True), _labels(s, sf), _counted(s, sf), reaction_lex)


def _checked(cases):
    c = exploded(cases, F.col("reactions"), "r", "id", "sections", "items", "raw_reactions", "raw_warnings", "label_id")
    return c.withColumns({"ord": F.col("r.ord").cast("long"), "reaction": F.col("r.reaction")})


def _matched(checked):
    heads, hits, found = match.match_sections(F.col("reaction"), F.col("sections"), F.col("items"))
    return checked.select("id", "ord", "reaction", found.alias("found_in_label"), F.array_join(heads, "|").alias("headers"), F.size(hits).cast("long").alias("items"))


def label_match(s, sf):
    return _matched(_checked(_cases(s, sf)))


def label_gaps(s, sf):
    return label_match(s, sf).where("NOT found_in_label").select("id", "ord", "reaction")


def label_tags(s, sf):
    tagged = match.tags(F.col("reaction"), F.col("raw_reactions"), F.col("raw_warnings"))
    return _checked(_cases(s, sf)).select("id", "ord", "reaction", F.array_join(tagged, "|").alias("tags"))


def label_check_per_drug(s, sf):
    """Reactions against the label of the drug they are tied to; without a label they count as not found."""
    rows = _reactions(s, sf, False).select("narrative_id", "ord", "reaction", F.lower("drug").alias("drug"))
    meant = analysis.label_parts(labels.for_drugs(rows, "drug", _labels(s, sf))).select("drug", "raw_reactions", "raw_warnings")
    tagged = match.tags(F.col("reaction"), F.col("raw_reactions"), F.col("raw_warnings"), r"(?U)\s+")
    return rows.join(meant, "drug", "left").select("narrative_id", "ord", "reaction", "drug", (F.size(tagged) > 0).alias("found"))


def in_label_counts(s, sf):
    rows = label_check_per_drug(s, sf).withColumn("drug", F.coalesce("drug", F.lit("<none>")))
    return rows.groupBy("drug").agg(F.count_if("found").alias("in_label"), F.count_if(~F.col("found")).alias("not_in_label"))


def _rows(full):
    return full.select(
        "id", "reaction", "severity", "onset", "outcome", "in_narrative", "found_in_label", "report_count", "drug",
        F.array_join("label_sections", "|").alias("label_sections"), F.col("src").cast("long").alias("src"), "ord",
    )


def _full(s, sf):
    terms = _lexicons(s, sf)[1]
    return compare.full(_cases(s, sf, terms), terms)


def full_comparison(s, sf):
    return _rows(_full(s, sf))


def novel_reactions(s, sf):
    return _full(s, sf).where("NOT found_in_label").select("id", "reaction", "report_count")


def _scored(points):
    return points.withColumn("verdict", score.verdict(F.col("points"))).withColumn("needs_ai", F.col("points") < 80)


def _points():
    return score.score(*(F.col(c) for c in ("drugs", "reactions", "age", "sex", "causality", "overall_severity")))


def confidence(s, sf):
    return _scored(_extracted(s, sf, True).select("narrative_id", _points().alias("points")).distinct())


def _both(s, sf):
    ai = read(s, sf, "ai_extractions", "narrative_id", "extraction", "error").dropDuplicates(["narrative_id"])
    told = _extracted(s, sf, False).dropDuplicates(["narrative_id"])
    return analysis.pairs(told, ai)


def confidence_other_engine(s, sf):
    o = F.col("other")
    points = score.score(*(o[c] for c in ("drugs", "reactions", "age", "sex", "causality", "overall_severity")))
    return _scored(_both(s, sf).where("other IS NOT NULL").select(F.col("id").alias("narrative_id"), points.alias("points")))


def engine_setdiff(s, sf):
    b = _both(s, sf).where("other IS NOT NULL")
    r, o = F.col("rules"), F.col("other")
    join = lambda a, c, f: F.array_join(enginediff.only_in(enginediff.names(a, f), enginediff.names(c, f)), "|")
    return b.select(
        "id",
        join(o["drugs"], r["drugs"], "name").alias("drugs_only_other"),
        join(r["drugs"], o["drugs"], "name").alias("drugs_only_rules"),
        join(o["reactions"], r["reactions"], "reaction").alias("reactions_only_other"),
        join(r["reactions"], o["reactions"], "reaction").alias("reactions_only_rules"),
    )


def engine_detail_gaps(s, sf):
    b = _both(s, sf).where("other IS NOT NULL")
    gaps = F.flatten(enginediff.detail_gaps(F.col("rules.reactions"), F.col("other.reactions")))
    return exploded(b, gaps, "g", "id").select("id", "g.*")


def engine_field_gaps(s, sf):
    b = _both(s, sf).where("other IS NOT NULL")
    return exploded(b, enginediff.field_gaps(F.col("rules"), F.col("other"), ("causality", "overall_severity")), "g", "id").select("id", "g.*")


def engine_patient_gaps(s, sf):
    b = _both(s, sf).where("other IS NOT NULL")
    return exploded(b, enginediff.field_gaps(F.col("rules"), F.col("other"), ("age", "sex", "relevant_history")), "g", "id").select("id", "g.*")


def engine_diff_summary(s, sf):
    b = _both(s, sf).where("other IS NOT NULL")
    r, o = F.col("rules"), F.col("other")
    missed = lambda f, n: F.size(enginediff.only_in(enginediff.names(o[f], n), enginediff.names(r[f], n))).cast("long")
    gaps = F.size(enginediff.field_gaps(r, o, ("causality", "overall_severity"))) + F.size(enginediff.field_gaps(r, o, ("age", "sex", "relevant_history")))
    gaps = gaps + F.size(enginediff.detail_gaps(r["reactions"], o["reactions"]))
    return b.select("id", missed("drugs", "name").alias("drugs_missed"), missed("reactions", "reaction").alias("reactions_missed"), gaps.cast("long").alias("total_gaps"))


def engine_merge(s, sf):
    m = analysis.compare_engines(_both(s, sf))
    return m.select(
        "id", F.size("drugs").cast("long").alias("drugs"), F.size("reactions").cast("long").alias("reactions"),
        F.array_join(F.array_sort(F.transform("reactions", lambda r: F.lower(r["reaction"]))), "|").alias("names"),
        "causality", "overall_severity", "relevant_history",
    )


def _compared(s, sf, reaction_lex=None):
    return analysis.compared_engines(_both(s, sf), _told(s, sf), _labels(s, sf), _counted(s, sf), reaction_lex)


def _compared_full(s, sf):
    terms = _lexicons(s, sf)[1]
    return compare.full(_compared(s, sf, terms), terms)


def engines_full_comparison(s, sf):
    """What both engines give together, against label and reports."""
    return _rows(_compared_full(s, sf))


def engines_novel_reactions(s, sf):
    return _compared_full(s, sf).where("NOT found_in_label").select("id", "reaction", "report_count")


def engines_label_match(s, sf):
    return _matched(_checked(_compared(s, sf)))


def engines_label_gaps(s, sf):
    return engines_label_match(s, sf).where("NOT found_in_label").select("id", "ord", "reaction")


def _entities(s, sf):
    """Entities as a model would give them: list entries in text order, every third with marks before it."""
    told = _told(s, sf).dropDuplicates(["narrative_id"])
    drugs, reactions = _lexicons(s, sf)
    x = extract.occurring(extract.occurring(told, "t", drugs, "name", "d"), "t", reactions, "term", "r")
    made = lambda low, items, kind: F.transform(items, lambda e: F.struct(F.position(e["name"], low).alias("at"), e["name"].alias("word"), F.lit(kind).alias("entity_group")))
    both = let(F.lower("t"), lambda low: F.concat(made(low, F.col("d"), "Drug"), made(low, F.col("r"), "Disease")))
    rows = x.select("narrative_id", "t", F.array_sort(F.array_distinct(both)).alias("e"))
    marked = F.transform("e", lambda e, i: F.struct(i.alias("seq"), F.when(i % 3 == 2, F.concat(F.lit("##"), e["word"])).otherwise(e["word"]).alias("word"), e["entity_group"].alias("entity_group")))
    return rows.select("narrative_id", "t", marked.alias("entities"))


def ner_extract(s, sf):
    x = exploded(extract.ner_extract(_entities(s, sf), "t", "entities"), F.col("reactions"), "r", "narrative_id")
    return x.select("narrative_id", "r.reaction", "r.severity", "r.onset", "r.outcome", "r.drug")


def extraction_documents(s, sf):
    """Each narrative's extraction by both rule engines, as nested records in JSON."""
    out = []
    for aware in (True, False):
        made = F.to_json(analysis.document(aware), {"ignoreNullFields": "false"}).alias("document")
        out.append(_extracted(s, sf, aware).select("narrative_id", F.lit("aware" if aware else "substring").alias("engine"), made).distinct())
    return out[0].unionByName(out[1])


def analysis_documents(s, sf):
    """The answer to a whole request as one record in JSON: points, verdict, novel reactions and label gaps of each narrative with a drug."""
    terms = _lexicons(s, sf)[1]
    # the extraction is read by three branches
    told = cut(_extracted(s, sf, True).drop("t").dropDuplicates(["narrative_id"]))
    scored = _scored(told.select(F.col("narrative_id").alias("id"), "drug_name", _points().alias("points"))).where("drug_name IS NOT NULL").select("id", "points", "verdict")
    full = compare.full(analysis.cases(told, _labels(s, sf), _counted(s, sf), terms), terms)
    rows = full.groupBy("id").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.when(~F.col("found_in_label"), F.col("reaction")))).alias("novel_reactions"))
    gaps = _matched(_checked(analysis.cases(told, _labels(s, sf), _counted(s, sf)))).where("NOT found_in_label")
    gaps = gaps.groupBy("id").agg(F.array_sort(F.collect_list("reaction")).alias("label_gaps"))
    none = F.array().cast("array<string>")
    out = scored.join(rows, "id", "left").join(gaps, "id", "left")
    made = F.struct("points", "verdict", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce("novel_reactions", none).alias("novel_reactions"), F.coalesce("label_gaps", none).alias("label_gaps"))
    return out.select("id", F.to_json(made).alias("document"))


def drug_labels_asked(s, sf):
    """The parsed label of every asked drug, or the error that there is none."""
    asked = _asked(s, sf)
    found = labels.for_drugs(asked, "drug_name", _labels(s, sf))
    flat = labels.projection(found, "drug").withColumns({c: F.array_join(c, "|", "-") for c in labels.LISTED})
    heads = labels.sections(labels.element0("warnings"))
    parsed = found.select("drug", F.coalesce(F.size(heads), F.lit(0)).cast("long").alias("sections"), F.coalesce(F.size(labels.items(labels.element0("adverse_reactions"))), F.lit(0)).cast("long").alias("items"))
    every = asked.select(F.lower(strip(F.col("drug_name"))).alias("drug")).where("drug <> ''").distinct()
    error = F.when(F.col("label_id").isNull(), F.concat(F.lit("No label found for '"), "drug", F.lit("'"))).alias("error")
    return every.join(flat, "drug", "left").join(parsed, "drug", "left").select("drug", "label_id", *labels.LISTED, "adverse_reactions_raw", "warnings_raw", "sections", "items", error)


def drug_sections_asked(s, sf):
    """The sections of the label of every asked drug with its title and link."""
    found = labels.for_drugs(_asked(s, sf), "drug_name", _labels(s, sf))
    head = found.select("drug", labels.title(F.col("drug")).alias("title"), labels.link(F.col("set_id"), F.col("drug"), LINK).alias("link"))
    return labels.section_rows(found, "drug").join(head, "drug").select("drug", "label_id", F.col("ord").cast("long").alias("ord"), "section", "text", "title", "link")


def keyword_found(s, sf):
    return labels.keyword_found(_labels(s, sf), ("nausea and vomiting", "vomiting", "dose")).distinct()


def summary_cards(s, sf):
    """Drugs, reactions, and reactions in and not in their drug's label, of each narrative."""
    counted = label_check_per_drug(s, sf).groupBy("narrative_id").agg(F.count_if("found").alias("in_label"), F.count_if(~F.col("found")).alias("not_in_label"))
    told = extraction_notes(s, sf).drop("notes")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.join(counted, "narrative_id", "left").select("narrative_id", "drugs", "reactions", zero("in_label"), zero("not_in_label"))


def engine_routes(s, sf):
    """The provider that each request goes to, and its error; without a client in the session's settings none is available."""
    rows = read(s, sf, "narratives", "narrative_id", "engine", "narrative").distinct()
    routed = providers.route(analysis.validated(rows)[0], "engine")
    known = providers.configured(s)
    parts = [run(known[name], routed.where(F.col("provider") == name), "narrative_id", "narrative").select("narrative_id", F.lit(name).alias("provider"), "error") for name, run in providers.ROUTES.items()]
    return parts[0].unionByName(parts[1])


def request_errors(s, sf):
    return analysis.validated(read(s, sf, "narratives", "narrative_id", "narrative"))[1]


def json_sink(s, sf):
    """Requests as JSON text, and read back: strings stripped, an engine that isn't named is the default one."""
    raw = read(s, sf, "narratives", "narrative_id", "drug_name", "engine", "narrative").distinct()
    text = F.to_json(F.struct("narrative_id", "drug_name", "engine", "narrative"))
    back = F.from_json(text, "narrative_id long, drug_name string, engine string, narrative string")
    told = lambda c: F.coalesce(strip(F.col(f"b.{c}")), F.lit("")).alias(c)
    return raw.select(back.alias("b")).select("b.narrative_id", told("drug_name"), told("narrative"), F.coalesce("b.engine", F.lit("openai")).alias("engine"))


QUERIES = {
    f.__name__: f
    for f in (
        deid_redact, deid_findings, deid_rule_counts, redaction_marked, collapse_ws, drug_mentions, drug_doses_aware, reactions_substring,
        reactions_aware, reactions_by_drug, patient_facts, extraction_notes, distinct_drugs, drug_headers, evidence_sentence, report_counts_top,
        report_top50, report_map, label_resolve, label_resolve_two_steps, label_warning_sections, label_ar_items, label_side_effects,
        label_projection, label_sections, label_titles, keyword_context, report_match, label_match, label_gaps, label_tags, label_check_per_drug,
        in_label_counts, full_comparison, novel_reactions, confidence, confidence_other_engine, engine_setdiff, engine_detail_gaps,
        engine_field_gaps, engine_patient_gaps, engine_diff_summary, engine_merge, ner_extract, request_errors, json_sink,
        engines_full_comparison, engines_novel_reactions, engines_label_match, engines_label_gaps, extraction_documents, analysis_documents,
        drug_labels_asked, drug_sections_asked, keyword_found, summary_cards, engine_routes,
    )
}

