"""Queries against their SQL on the smallest tables, the smoke query, providers and the stream."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from narravig import lexicons as lex
from narravig.sources import providers
from narravig.streaming import narratives

DATA = Path("/root/testdata/sf0.001")
SOME = ("deid_redact", "report_top50", "p2_extracted", "drug_labels_asked", "engines_label_match", "deid_findings", "reactions_aware", "report_counts_top", "label_warning_sections", "label_resolve", "report_match", "full_comparison", "engine_diff_summary", "ner_extract")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    got = __spark_entry__.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, rows))
    assert rows


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_smoke(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_and_sql_belong_together():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_providers_see_redacted_text_only(spark):
    def answer(text):
        if "fail" in text:
            raise RuntimeError("down")
        return "no json" if "odd" in text else json.dumps({"drugs": [{"name": "d"}], "reactions": [], "notes": text})

    df = spark.createDataFrame([(1, "SSN 123-45-6789"), (2, "fail"), (3, "odd"), (4, None)], "id long, t string")
    got = {r.id: r for r in providers.extractions(providers.Provider(answer), df, "id", "t").collect()}
    assert got[1].extraction.notes == "SSN [SSN]" and got[1].error is None
    assert got[2].error == "down" and got[3].error == "malformed answer" and 4 not in got
    closed = providers.Provider(None)
    assert not closed.available() and {r.error for r in providers.extractions(closed, df, "id", "t").collect()} == {"not available"}
    ner = providers.Provider(lambda t: [{"word": t[:3], "entity": "Drug"}], providers.NER_CHARS)
    assert providers.entities(ner, df, "id", "t").where("id = 1").first().entities[0].entity_group == "Drug"
    routed = spark.createDataFrame([("huggingface",), (None,)], "engine string")
    assert [r.provider for r in providers.route(routed, "engine").collect()] == ["entities", "extractions"]


def test_clients_come_from_the_settings(spark):
    assert not any(p.available() for p in providers.configured(spark).values())
    spark.conf.set(f"{providers.CLIENT_CONF}extractions", "builtins:str")
    try:
        known = providers.configured(spark)
        assert known["extractions"].available() and not known["entities"].available()
        df = spark.createDataFrame([(1, "no json")], "id long, t string")
        assert providers.extractions(known["extractions"], df, "id", "t").first().error == "malformed answer"
    finally:
        spark.conf.unset(f"{providers.CLIENT_CONF}extractions")


def test_stream_counts_reactions_once(spark, tmp_path):
    rows = [(1, "Aspirin gave him a rash.", "2024-01-02"), (1, "Aspirin gave him a rash.", "2024-01-02"), (2, None, "2024-01-03")]
    df = spark.createDataFrame(rows, "narrative_id long, narrative string, at string")
    df.select("narrative_id", "narrative", F.to_timestamp("at").alias("received_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("narrative_id long, narrative string, received_at timestamp").parquet(str(tmp_path / "in"))
    drugs = spark.createDataFrame([(0, "aspirin")], "ord int, name string")
    reactions = spark.createDataFrame([(0, "rash")], "ord int, term string")
    counted = narratives.reaction_counts(stream, drugs, reactions)
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.drug, r.reaction, r.n) for r in spark.table("counted").collect()] == [("aspirin", "rash", 1)]


def _label_table(spark, at, *rows):
    """drug_labels of (label_id, lists by field); other fields are null."""
    openfda = "struct<" + ",".join(f"{k}:array<string>" for k in ("brand_name", "generic_name", "substance_name", "manufacturer_name", "route", "product_type")) + ">"
    schema = f"label_id long, set_id string, openfda {openfda}, " + ", ".join(f"{f} array<string>" for f, _ in lex.SECTIONS)
    made = [(i, None, None, *(fields.get(f) for f, _ in lex.SECTIONS)) for i, fields in rows]
    spark.createDataFrame(made, schema).write.parquet(f"{at}/drug_labels.parquet")
    return str(at)


def test_labels_as_stored(spark, tmp_path):
    known = __spark_entry__.queries()
    sf = _label_table(
        spark,
        tmp_path,
        (1, {"warnings": ["Allergy alert may redden. Liver warning see a doctor.", "second text"], "adverse_reactions": ["Severe migraine."]}),
        (2, {"warnings_and_precautions": ["Use with care."], "contraindications": ["Known porphyria."]}),
    )
    sections = {(r.label_id, r.header, r.body) for r in known["label_warning_sections"](spark, sf).collect()}
    assert sections == {(1, "Allergy alert", "may redden."), (1, "Liver warning", "see a doctor.")}
    flat = {r.label_id: r.warnings_raw for r in known["label_projection"](spark, sf).collect()}
    assert flat == {1: "Allergy alert may redden. Liver warning see a doctor.", 2: "Use with care."}


def test_nested_tables_hold_every_scalar(spark, tmp_path):
    known = __spark_entry__.queries()
    drug = {"name": "a", "dose": "5 mg", "reactions": [{"reaction": "ache", "onset": "2 days"}]}
    reaction = {"reaction": "rash", "severity": "mild", "outcome": "resolved"}
    payloads = [
        (1, json.dumps({"results": [{"setId": "S", "patient": {"age": 58, "sex": None}, "drugs": drug, "reactions": [None, reaction]}, {"set_id": "T", "drugs": [drug]}]})),
        (2, json.dumps({"set_id": "U", "patient": json.dumps({"Age": "7", "sex": "male"})})),
        (3, "{cut"),
        (4, None),
    ]
    spark.createDataFrame(payloads + payloads[:1], "record_id long, payload string").write.parquet(f"{tmp_path}/raw_records.parquet")
    got = lambda name, *c: sorted(tuple(r[x] for x in c) for r in known[name](spark, str(tmp_path)).collect())
    assert got("p2_records", "key", "dewey", "node_path", "set_id", "age") == [(1, "0", "$", "S", "58"), (1, "1.0.1", "results[1]", "T", None), (2, "0", "$", "U", "7")]
    assert got("p2_reactions", "key", "parent_dewey", "pos", "reaction", "severity", "outcome") == [(1, "0", 1, "rash", "mild", "resolved")]
    assert {d for _, d in got("p2_drugs", "key", "parent_dewey")} == {"0", "1.0.1"}
    nodes = {r.node_path: r.fields for r in known["p2_nodes"](spark, str(tmp_path)).collect()}
    assert json.loads(nodes["reactions[1]"]) == reaction and nodes["reactions[0]"] is None

    schema = (
        "narrative_id long, extraction struct<drugs:array<struct<name:string,dose:string,route:string,indication:string>>,"
        "reactions:array<struct<reaction:string,severity:string,onset:string,outcome:string,drug:string>>,"
        "patient:struct<age:string,sex:string,relevant_history:string>,causality:string,overall_severity:string,notes:string>, error string"
    )
    extraction = ([("a", "5 mg", "oral", None)], [("rash", "mild", None, "resolved", "a")], ("58", "male", None), "possible", None, "n")
    spark.createDataFrame([(1, extraction, None), (2, None, "down")], schema).write.parquet(f"{tmp_path}/ai_extractions.parquet")
    assert got("p2_extracted_drugs", "key", "pos", "name", "dose", "route", "indication") == [(1, 0, "a", "5 mg", "oral", None)]
    assert got("p2_extracted_reactions", "key", "pos", "reaction", "severity", "onset", "outcome", "drug") == [(1, 0, "rash", "mild", None, "resolved", "a")]
    assert got("p2_extracted_records", "key", "age", "sex", "causality", "notes") == [(1, "58", "male", "possible", "n")]
    assert [json.loads(f)["outcome"] for p, f in got("p2_extracted", "node_path", "fields") if p == "reactions[0]"] == ["resolved"]


def test_of_several_units_in_notes_the_classifier_chooses(spark, tmp_path):
    kind = "narrative_id long, extraction struct<drugs:array<struct<name:string,dose:string,route:string,indication:string>>,notes:string>"
    stated = [(i, ([("d", f"{100 + i % 50} mg", None, None), ("e", f"{1 + i % 3} g", None, None)], None)) for i in range(200)]
    several = "Doses in mg, for some drugs in g"
    asked = [
        (900, ([("d", "125", None, None), ("e", "2 BID", None, None)], several)),  # chosen
        (901, ([("d", "125", None, None)], "Doses in ng or kg")),  # units that no labelled dose has
        (902, ([("d", "125", None, None)], None)),  # no unit is written down
        (903, ([("e", "2", None, None)], "Dose unit: mg")),  # one unit: not the classifier's affair
        (904, ([("d", "1e350", None, None)], several)),  # no magnitude of a dose
        (905, ([("d", "125", None, None)], "Doses in ㎎ (or grams)")),
    ]
    spark.createDataFrame(stated + asked + asked, kind).write.parquet(f"{tmp_path}/ai_extractions.parquet")
    spark.createDataFrame([(i, "x") for i in range(200)], "narrative_id long, engine string").write.parquet(f"{tmp_path}/narratives.parquet")
    known = __spark_entry__.queries()
    found = known["p6_found"](spark, str(tmp_path)).where("narrative_id >= 900").collect()
    assert sorted(map(tuple, found)) == [(900, 0, 125_000), (900, 1, 2_000_000), (903, 0, 2000), (905, 0, 125_000)]
    doses = {(r.narrative_id, r.drug_pos): r.unit_source for r in known["p6_doses"](spark, str(tmp_path)).where("narrative_id >= 900").collect()}
    assert [doses[900, 0], doses[900, 1], doses[901, 0], doses[903, 0], doses[904, 0], doses[905, 0]] == ["chosen", "chosen", "review", "notes", "review", "chosen"]


def test_texts_as_stored(spark, tmp_path):
    known = __spark_entry__.queries()
    thai, hindi = "ยานี้อาจทำให้เกิดอาการปวดศีรษะได้", "यह दवा  सिरदर्द का कारण बन सकती है"
    spark.createDataFrame([(1, thai), (2, f"\u3000{hindi}\u00a0"), (3, "短い")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in known["collapse_ws"](spark, str(tmp_path)).collect()} == {(1, thai), (2, " ".join(hindi.split()))}

    told = [(1, "Dolor", None, "Mrs. Müller, née Ångström: após aspirin, rash. Zoë"), (2, None, None, "Überrash nach aspirin")]
    spark.createDataFrame(told, "narrative_id long, drug_name string, engine string, narrative string").write.parquet(f"{tmp_path}/narratives.parquet")
    spark.createDataFrame([(0, "aspirin")], "ord int, name string").write.parquet(f"{tmp_path}/drug_lex.parquet")
    spark.createDataFrame([(0, "rash")], "ord int, term string").write.parquet(f"{tmp_path}/reaction_lex.parquet")
    redacted = {r.narrative_id: r.redacted for r in known["deid_redact"](spark, str(tmp_path)).collect()}
    assert redacted == {i: t for i, *_, t in told}
    # a letter with an accent is part of the word: no whole word in the second
    assert [(r.narrative_id, r.reaction) for r in known["reactions_aware"](spark, str(tmp_path)).collect()] == [(1, "rash")]

    items = "Vómitos intensos\u00a0graves;\u3000Éruption étendue.\u2003Then more headache"
    sf = _label_table(spark, tmp_path, (1, {"adverse_reactions": [items], "warnings": [thai]}))
    assert {r.item for r in known["label_ar_items"](spark, sf).collect()} == {"Vómitos intensos\u00a0graves", "Éruption étendue"}
    assert {(r.section, r.text) for r in known["label_sections"](spark, sf).collect()} >= {("Warnings", thai)}


@pytest.fixture()
def asked_labels(spark, tmp_path):
    rows = [
        (1, ["Alpha"], ["alphine"], {"indications_and_usage": ["For pain."]}),
        (2, None, ["beta hydrochloride salt of long name"], {}),
        (3, None, None, {"nursing_mothers": ["x"], "drug_interactions": ["none", "Avoid with Gamma-2 Delta epsilon zeta eta at night."]}),
        (1, ["Alpha"], ["alphine"], {"indications_and_usage": ["For pain."]}),
    ]
    openfda = "struct<" + ",".join(f"{k}:array<string>" for k in ("brand_name", "generic_name", "substance_name", "manufacturer_name", "route", "product_type")) + ">"
    schema = f"label_id long, set_id string, openfda {openfda}, " + ", ".join(f"{f} array<string>" for f, _ in lex.SECTIONS)
    made = [(i, None, (brand, generic, None, None, None, None), *(fields.get(f) for f, _ in lex.SECTIONS)) for i, brand, generic, fields in rows]
    return spark.createDataFrame(made, schema)


def test_loose_steps_take_names_of_any_length_and_all_texts(spark, asked_labels, monkeypatch):
    from narravig.operators import labels

    asked = spark.createDataFrame([(" ALPHA ",), ("hydrochloride salt of long",), ("gamma-2 delta epsilon zeta eta",), ("gamma",), ("",), (None,), ("!!",)], "d string")
    want = {("alpha", 1, 0), ("hydrochloride salt of long", 2, 3), ("gamma-2 delta epsilon zeta eta", 3, 5)}
    assert {tuple(r) for r in labels.resolve(asked, "d", asked_labels).collect()} == want
    monkeypatch.setattr(labels, "ASKED", 0)
    assert {tuple(r) for r in labels.resolve(asked, "d", asked_labels).collect()} == want
    # a label that stands twice counts once
    assert [(r.drug, r.label_id) for r in labels.for_drugs(asked.where("d = ' ALPHA '"), "d", asked_labels).collect()] == [("alpha", 1)]
    assert labels.resolve(asked.limit(0), "d", asked_labels).count() == 0


def test_top_terms_are_taken_after_folding(spark):
    from narravig.operators import reports

    rows = [(i, 1, "D", t) for i, t in enumerate(["Rash"] * 4 + ["rash"] * 3 + ["ache"] * 2 + ["fever"])]
    counted = reports.counts(spark.createDataFrame(rows, "report_id long, line_no int, drug string, reaction string"))
    assert sorted((r.term, r["rank"], r.cnt) for r in reports.top(reports.by_term(counted), 2).collect()) == [("ache", 2, 2), ("rash", 1, 3)]


def test_sections_under_headers_of_a_fixture(spark, tmp_path):
    text = "Intro. Liver warning one. Do not use with x. Liver warning two."
    sf = _label_table(spark, tmp_path, (1, {"warnings": [text], "adverse_reactions": ["Severe migraine attack; Nausea 10%"]}), (2, {"warnings": [None]}), (3, {}))
    known = __spark_entry__.queries()
    assert {tuple(r) for r in known["label_warning_sections"](spark, sf).select("label_id", "ord", "header", "body").collect()} == {(1, 1, "Liver warning", "two."), (1, 2, "Do not use", "with x.")}
    assert {(r.section, r.label, r.text) for r in known["label_side_effects"](spark, sf).collect()} == {
        ("Adverse Reactions", None, "Severe migraine attack"), ("Warnings", "Liver warning", "two."), ("Warnings", "Do not use", "with x."),
    }


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_the_comparison_reads_labels_little(spark):
    plan = __spark_entry__.queries()["full_comparison"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    # one of narratives, labels and reports each; what a label is found by is cut off before
    assert plan.count("FileScan parquet") <= 5 and not [line for line in plan.splitlines() if "FileScan" in line and "clinical_pharmacology" in line]
