"""Small fixtures for the core operators, with their defined results for awkward input."""

import json

import pytest
from pyspark.sql import functions as F

from narravig import lexicons as lex
from narravig.functions.trees import BaggedClassifier, BoostedRegressor
from narravig.operators import compare, deid, enginediff, extract, labels, match, nested, packed, reports, score, units

LEX = "ord int, name string"


@pytest.fixture(scope="module")
def lists(spark):
    drugs = spark.createDataFrame(list(enumerate(lex.DRUGS)), LEX)
    reactions = spark.createDataFrame(list(enumerate(lex.REACTIONS)), "ord int, term string")
    return drugs, reactions


def told(spark, lists, text, aware=True):
    df = spark.createDataFrame([(1, text)], "narrative_id long, t string")
    return extract.extract(df, "t", *lists, aware).first()


def test_sample_narrative(spark, lists):
    row = told(spark, lists, "A 45-year-old male was prescribed ibuprofen 400mg and lisinopril 10mg. He developed nausea, headache, and elevated liver enzymes after 2 weeks.")
    assert [(d.name, d.dose) for d in row.drugs] == [("ibuprofen", "400mg"), ("lisinopril", "400mg")]
    assert [(r.reaction, r.severity, r.onset, r.outcome, r.drug) for r in row.reactions] == [
        (r, None, "2 weeks", "unknown", "lisinopril") for r in ("nausea", "headache", "elevated liver enzymes")
    ]
    assert (row.age, row.sex, row.causality, row.overall_severity) == ("45", "male", "unassessable", None)


@pytest.mark.parametrize(
    ("text", "aware", "loose"),
    [
        ("Patient denies nausea. Later nausea occurred.", [], ["nausea"]),
        ("No fever. Rash appeared.", [], ["rash", "fever"]),
        ("She had liver damage.", ["liver damage"] * 2, ["liver damage"] * 2),
        ("He had angioedema.", ["angioedema"], ["angioedema", "edema"]),
        ("", [], []),
        (None, [], []),
    ],
)
def test_negation_bounds_and_repeats(spark, lists, text, aware, loose):
    assert [r.reaction for r in told(spark, lists, text).reactions] == aware
    assert [r.reaction for r in told(spark, lists, text, False).reactions] == loose


def test_long_lists_go_through_the_automaton(spark, lists, monkeypatch):
    df = spark.createDataFrame([(1, "Aspirin, then a RASH and fever."), (2, None)], "narrative_id long, t string")
    literal = extract.occurring(df, "t", lists[1], "term", "o").collect()
    monkeypatch.setattr(extract, "LITERAL_ENTRIES", 3)
    assert extract.occurring(df, "t", lists[1], "term", "o").collect() == literal


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SSN 123-45-6789", "SSN [SSN]"),
        ("DOB: 01/15/1980", "DOB: [DATE]"),
        ("2024-01-15", "2024-[DATE]"),
        ("BP 98/60", "BP [DATE]"),
        ("BP 120/80", "BP 120/80"),
        ("(555) 123-4567", "([PHONE]"),
        ("+1 (743) 555-3824", "+[PHONE]"),
        ("He went to Mercy Hospital", "[FACILITY]"),
        ("Seen by Dr. Jane Smith", "Seen by [NAME]"),
        ("visited 12 Oak Street", "visited [ADDRESS]"),
        ("took 40 mg on the way", "took [ADDRESS]"),
        (None, None),
    ],
)
def test_redaction(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    row = deid.findings(df, "t").first()
    assert row.redacted == expected
    assert row.changed == (text != expected)


def test_label_sections_and_items(spark):
    text = "Intro text Liver warning: severe damage. Do not use with alcohol Liver warning second"
    fields = "label_id long, warnings array<string>, adverse_reactions array<string>"
    df = spark.createDataFrame([(1, [text], ["Unstable angina; Discontinue at onset of jaundice; Rash; Nausea 10%"]), (2, [], None), (3, [None], [""])], fields)
    got = sorted((r.ord, r.header, r.body) for r in labels.warning_sections(df).collect())
    assert [g[1:] for g in got] == [("Liver warning", "second"), ("Do not use", "with alcohol")]
    items = {r.label_id: r.i for r in df.select("label_id", labels.items(labels.element0("adverse_reactions")).alias("i")).collect()}
    assert items == {1: ["Discontinue at onset of jaundice"], 2: None, 3: []}


def test_match_rules(spark):
    df = spark.createDataFrame([("back pain", "pain relief"), ("", "x"), (None, "x")], "r string, blob string")
    rows = df.select(match.tags(F.col("r"), F.col("blob"), F.lit("")).alias("t")).collect()
    assert [r.t for r in rows] == [[], [], []]
    terms = spark.createDataFrame([("D", 1, "blood pressure elevated", 9), ("D", 2, "alt elevated", 5)], "drug string, rank long, term string, cnt long")
    asked = spark.createDataFrame([("D", "elevated alt"), ("D", "flu"), ("E", "flu")], "drug_key string, reaction string")
    got = {(r.drug_key, r.reaction): (r.matched_term, r.report_count) for r in match.match_reports(asked, terms, match.keywords(F.col("reaction"), 3)).collect()}
    assert got == {("D", "elevated alt"): ("blood pressure elevated", 9), ("D", "flu"): ("blood pressure elevated", 9), ("E", "flu"): (None, 0)}


def test_report_counts_ties_and_repeats(spark):
    rows = [(1, 1, "A", "x"), (1, 1, "A", "x"), (2, 1, "a", "y"), (3, 1, None, "y"), (4, 1, "A", None), (5, 1, "A", "")]
    df = spark.createDataFrame(rows, "report_id long, line_no int, drug string, reaction string")
    assert sorted(map(tuple, reports.counts(df, 1).collect())) == [("A", "x", 1, 1)]
    assert reports.counts(df.limit(0)).count() == 0


def test_merge_is_independent_of_partitions_and_null_outcome_wins(spark):
    fields = "id long, key string, reaction string, src int, ord long, severity string, onset string, outcome string, in_narrative boolean, found_in_label boolean, report_count long, sections array<string>, drug string"
    rows = [
        (1, "a", "A", 1, 0, "mild", None, "died", True, False, 0, [], None),
        (1, "a", "a", 1, 1, None, "2 days", None, True, True, 3, ["Warning"], "x"),
        (1, "a", "a", 4, 0, "", None, "unknown", False, False, 0, ["Adverse Reactions", "Warning"], "y"),
    ]
    df = spark.createDataFrame(rows, fields)
    got = {tuple(map(str, compare.merge(df.repartition(n)).first())) for n in (1, 3)}
    assert got == {("1", "A", "mild", "2 days", "None", "True", "True", "3", "['Warning', 'Adverse Reactions']", "x", "1", "0")}


def test_score_and_gaps(spark):
    kinds = "drugs array<struct<name:string,dose:string>>, reactions array<struct<reaction:string,severity:string,onset:string,outcome:string>>, age string, sex string, causality string, overall_severity string"
    full = ([("d", "1 mg")], [("r", "mild", "1 day", "died")], "4", "male", "possible", "mild")
    df = spark.createDataFrame([full, ([], [], None, None, None, None)], kinds)
    points = df.select(score.score(*(F.col(c) for c in df.columns)).alias("p"))
    assert [(r.p, r.v) for r in points.select("p", score.verdict(F.col("p")).alias("v")).collect()] == [(95, "HIGH"), (10, "LOW")]
    both = df.select(F.struct("causality").alias("a"), F.struct(F.lit(None).cast("string").alias("causality")).alias("b"))
    gaps = both.select(enginediff.field_gaps(F.col("a"), F.col("b"), ("causality",)).alias("g")).collect()
    assert [len(r.g) for r in gaps] == [1, 0]


# nested records

RECORD = {
    "meta": {},
    "results": [
        {
            "openFda": {"brandName": ["A", None], "route": "ORAL"},
            "adverseReactions": '[{"section": "S", "items": {"label": "l", "text": "t"}}, null]',
            "drugs": [{"name": "x", "dose": 5, "reactions": '[{"reaction": "r"}]', "openFda": {"route": ["R"]}}, None],
            "reactions": [],
        }
    ],
}


def test_nested_links(spark):
    rows = [(1, json.dumps(RECORD)), (1, json.dumps(RECORD)), (2, None), (3, ""), (4, "{"), (5, "[1]"), (6, "{}"), (7, "[" * 100_000)]
    df = spark.createDataFrame(rows, "record_id long, payload string").withColumns({"key": F.lit("clash"), "value": F.lit(1)})
    got = nested.nodes(df, "record_id", "payload")
    assert sorted((r.parent_path, r.node_path) for r in nested.found(got).collect()) == [
        ("$", "adverse_reactions[0]"),
        ("$", "drugs[0]"),
        ("$", "openfda.brand_name[0]"),
        ("$", "openfda.route[0]"),
        ("adverse_reactions[0]", "adverse_reactions[0].items[0]"),
        ("drugs[0]", "drugs[0].openfda.route[0]"),
        ("drugs[0]", "drugs[0].reactions[0]"),
    ]
    broken = {r.key: r.broken for r in got.where("broken IS NOT NULL").collect()}
    assert broken == {2: "empty", 3: "empty", 4: "malformed", 5: "no object", 7: broken[7]}
    drugs = nested.table(got, "drugs[]", ["name", "dose"]).collect()
    reactions = nested.table(got, "drugs[].reactions[]", ["reaction"]).collect()
    assert [(d.name, d.dose) for d in drugs] == [("x", "5")]
    assert [r.parent_dewey for r in reactions] == [drugs[0].dewey]
    assert nested.nodes(df.limit(0), "record_id", "payload").count() == 0


def test_nothing_is_lost_where_names_coincide_or_objects_repeat(spark):
    record = {
        "Drugs": [{"name": "a"}], "drugs": [{"name": "b", "Name": "c"}, None],
        "openfda": [{"brand_name": ["X"]}, {"brand_name": ["Y", "Z"], "route": "R"}],
    }
    got = nested.nodes(spark.createDataFrame([(1, json.dumps(record))], "record_id long, payload string"), "record_id", "payload").collect()
    paths = {r.node_path: (r.value, r.fields, r.parent_path) for r in got}
    assert set(paths) == {"drugs[0]", "drugs[1]", "drugs[2]", "openfda.brand_name[0]", "openfda#1.brand_name[0]", "openfda#1.brand_name[1]", "openfda#1.route[0]"}
    assert paths["drugs[1]"][1] == {"name": "b", "name#2": "c"} and paths["openfda#1.brand_name[1]"][0] == "Z"
    assert {p for _, _, p in paths.values()} == {"$"} and len({r.dewey for r in got}) == len(got)
    assert {r.value for r in got if r.schema_path == "openfda.brand_name[]"} == {"X", "Y", "Z"}


# packed fields


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []),
        (" \n ", []),
        ("a, b (c, d),, e", ["a", "b (c, d)", "e"]),
        ("a, b; c", ["a, b", "c"]),
        ("1) x (1 in 500)\n2) y, z", ["x (1 in 500)", "y, z"]),
        ("(1) a (2) b (1 in 6)", ["a", "b (1 in 6)"]),
        ('"so-called ""p, q""", r', ['so-called "p, q"', "r"]),
        ('x | "so-called \\"y\\""', ["x", 'so-called "y"']),
        ("• a • b", ["a", "b"]),
        ("a and/or b / c", ["a and/or b", "c"]),
        ('"open, a, b', ['"open', "a", "b"]),
        ("a (open, b", ["a (open", "b"]),
        ("same, same", ["same", "same"]),
    ],
)
def test_packed(text, expected):
    assert [v for v, _ in packed.parse(text)] == expected


def test_packed_flags_and_length(spark):
    assert [f for _, f in packed.parse('"open, b')] == ["open_quote", None]
    assert len(packed.parse(", ".join('"x' for _ in range(50_000)))) == 50_000
    df = spark.createDataFrame([(1, "a;b"), (1, "a;b"), (2, None)], "label_id long, f string").withColumns({"item": F.lit(1), "pos": F.lit(1)})
    assert sorted((r.key, r.pos, r.item) for r in packed.unpack(df, "label_id", {"f": F.col("f")}).collect()) == [(1, 0, "a"), (1, 1, "b")]
    assert packed.unpack(df.limit(0), "label_id", {"f": F.col("f")}).count() == 0


# doses


@pytest.mark.parametrize(
    ("text", "micrograms"),
    [
        ("¼ g", 250_000), ("1½ g", 1_500_000), ("2 ½ mg", 2500), ("1'000 MG", 1_000_000), ("12 000 mg", 12_000_000), ("0,5 mg", 500), ("1,500 mg", 1_500_000),
        ("1.5 x 10^3 mg q8h", 1_500_000), ("5e1 mg", 50_000), ("15 mL of 20 mg/mL", 300_000), ("5 mg/mL, 2 mL", 10_000), ("4 ml (50 mg/5 ml)", 40_000),
        ("2 × 50 mg", 100_000), ("50 mg x 3 tabs", 150_000), ("3 tabs (5 mg each)", 15_000), ("7.5 mg (2 tablets)", 7500), ("2 g + 500 mg", 2_500_000),
        ("twenty-five milligrams BID", 25_000), ("a quarter gram per dose", 250_000), ("50000 ng", 50), ("tab 20 mg", 20_000), ("500 mg 3 times daily", 500_000),
        ("5-10 mg", None), ("29 mg/m²", None), ("5 mg/kg/day", None), ("58 IU", None), ("5%", None), ("2 puffs BID", None), ("one tablet", None), ("as directed", None), ("", None),
    ],
)
def test_quantities(text, micrograms):
    value, _, reason = units.quantity(text)
    assert (value if reason == "stated" else None) == micrograms


def test_units_from_notes_and_prediction(spark):
    kind = "narrative_id long, extraction struct<drugs:array<struct<name:string,dose:string,route:string,indication:string>>,notes:string>"
    known = [(i, ([("d", f"{100 + i % 50} mg", None, None), ("e", f"{1 + i % 3} g", None, None)], None)) for i in range(200)]
    asked = [(900, ([("d", "125", None, None)], None)), (901, ([("d", "2 BID", None, None)], "Dose unit: g")), (902, None), (903, (None, None)), (904, ([("d", None, None, None)], None))]
    out = {(r.narrative_id, r.drug_pos): r for r in units.convert(spark.createDataFrame(known + asked + asked, kind)).where("narrative_id >= 900").collect()}
    assert set(out) == {(900, 0), (901, 0)}
    assert out[901, 0].amount_ug == 2_000_000 and out[901, 0].unit_source == "notes"
    assert out[900, 0].unit == "mg" and out[900, 0].unit_source in ("predicted", "review")
    alone = units.convert(spark.createDataFrame(asked[:1], kind)).first()
    assert (alone.unit_source, alone.amount_ug) == ("review", None)
    assert units.convert(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize(("text", "value", "reason"), [("1e3 mg", 10**6, "stated"), ("1 x 10^-40 mg", 0, "stated"), ("5e20 g", None, "stated"), ("1e99999999 mg", None, "several numbers")])
def test_powers_are_exact_or_given_up(text, value, reason):
    got, _, why = units.quantity(text)
    assert why == reason or got is None
    assert (units._whole(got) if got is not None else None) == value


def test_doses_too_large_have_a_reason_and_the_model_sees_bare_ones_only(spark):
    kind = "narrative_id long, extraction struct<drugs:array<struct<name:string,dose:string,route:string,indication:string>>,notes:string>"
    df = spark.createDataFrame([(1, ([("d", "5e20 g", None, None)], None)), (2, ([("d", "7", None, None)], "Dose unit: mg"))] * 2, kind)
    assert {(r.narrative_id, r.amount_ug, r.reason) for r in units.parse(df).collect()} == {(1, None, "too large"), (2, 7000, None)}
    assert "MapInArrow" in (plan := units.found(units.parse(df))._jdf.queryExecution().executedPlan().toString()) and plan.count("MapInArrow") == 1


def test_the_classifier_is_right_where_it_is_sure(spark):
    kind = "narrative_id long, extraction struct<drugs:array<struct<name:string,dose:string,route:string,indication:string>>,notes:string>, source string"
    rows = [(i, ([("d", f"{100 + i % 50} mg", None, None), ("e", f"{1 + i % 3} g", None, None)], None), "x") for i in range(150)]
    rows += [(1000 + i, ([("d", f"{100 + i % 50}", None, None)], "Dose unit: mg"), "y") for i in range(40)]
    got = {r.unit_source: r for r in units.accuracy(spark.createDataFrame(rows, kind)).collect()}
    assert got["stated"].doses == 300 and got["notes"].doses == 40
    assert all(r.sure_right >= 0.9 * r.sure and r.right >= 0.9 * r.doses for r in got.values()) and got["stated"].sure > 0


def test_trees_learn():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 0] > 0.5) + 2.0 * (x[:, 1] > 0.3)
    assert np.abs(BoostedRegressor().fit(x[:300], y[:300]).predict(x[300:]) - y[300:]).mean() < 0.2
    model = BaggedClassifier().fit(x[:300], np.where(y[:300] > 1, "b", "a"))
    guess, chance = model.predict(x[300:])
    assert (guess == np.where(y[300:] > 1, "b", "a")).mean() > 0.9 and model.accuracy > 0.9 and (chance <= 1).all()


def test_full_comparison_is_equal_for_long_lists(spark, monkeypatch):
    terms = "array<struct<rank:bigint,term:string,cnt:bigint>>"
    reactions = "array<struct<ord:int,reaction:string,severity:string,onset:string,outcome:string,drug:string>>"
    schema = f"id long, reactions {reactions}, items array<string>, sections array<struct<header:string,body:string>>, raw_reactions string, raw_warnings string, terms {terms}"
    rows = [(1, [], ["Sore gums"], [("Do not use", "with a Rash"), ("Liver warning", "jaundice, rash or ache; death")], "", "", [(1, "rash", 4)]), (2, [], None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    lexicon = spark.createDataFrame([(0, "Rash"), (1, "ache"), (2, "jaundice"), (3, "death"), (4, "fever")], "ord int, term string")
    short = sorted(map(str, compare.full(df, lexicon).collect()))
    monkeypatch.setattr(extract, "LITERAL_ENTRIES", 3)
    assert sorted(map(str, compare.full(df, lexicon).collect())) == short
    assert sum("src=3" in r for r in short) == 3
