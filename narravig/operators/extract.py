"""Drugs, reactions and patient facts of narratives, by word lists and windows around each mention.

The lists are small and become literal arrays, so a narrative is scanned where it lies: one projection, no join, no
shuffle. A list beyond LITERAL_ENTRIES goes through an Aho-Corasick automaton in Arrow batches instead.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig import lexicons as lex
from narravig.functions.arrowmap import flat_map
from narravig.functions.text import filled, first, let, rx, slice_, strip

LITERAL_ENTRIES = 2000
#: A longer list is broadcast to the automatons up to so many entries (some 100 bytes each); beyond that it is an error.
BROADCAST_ENTRIES = 2_000_000


def entries(lexicon: DataFrame, name: str) -> list[tuple[int, str]] | None:
    """(ord, lower-case entry) in order, or None if the list is too long for literals."""
    rows = lexicon.select("ord", F.lower(F.col(name)).alias("name")).where("name <> ''").limit(LITERAL_ENTRIES + 1).collect()
    return None if len(rows) > LITERAL_ENTRIES else sorted((r.ord, r.name) for r in rows)


def literal(own: list[tuple[int, str]]) -> Column:
    """The entries as one array; the optimizer folds the text into a constant, and building it is one call."""
    return F.from_json(F.lit(json.dumps([{"ord": o, "name": n} for o, n in own])), "array<struct<ord:int,name:string>>")


def occurring(df: DataFrame, text: str, lexicon: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with array ``out`` of (ord, name) of the entries that the text holds, in list order."""
    own = entries(lexicon, name)
    kind = "array<struct<ord:int,name:string>>"
    if own is not None:
        if not own:
            return df.withColumn(out, F.array().cast(kind))
        listed = literal(own)
        held = let(F.lower(F.col(text)), lambda low: F.filter(listed, lambda x: F.contains(low, x["name"])))
        return df.withColumn(out, F.coalesce(held, F.array().cast(kind)))
    make = _scanner(lexicon, name)
    at = df.columns.index(text)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def rows():
        held = make()
        return lambda *row: [(*row, held(row[at].lower() if row[at] else None))]

    return flat_map(df, df.columns, rows, f"{schema}, `{out}` {kind}")


def _scanner(lexicon: DataFrame, name: str):
    """Makes, in a worker, the function that lists a small-letter text's entries in list order."""
    if lexicon.count() > BROADCAST_ENTRIES:
        raise ValueError(f"a word list may have at most {BROADCAST_ENTRIES} entries")
    rows = [(r.ord, r.name) for r in lexicon.select("ord", F.lower(F.col(name)).alias("name")).where("name <> ''").toLocalIterator()]
    shared = lexicon.sparkSession.sparkContext.broadcast(rows)

    def make():
        import ahocorasick

        tree = ahocorasick.Automaton()
        for o, n in shared.value:
            tree.add_word(n, tree.get(n, []) + [(o, n)])
        tree.make_automaton()
        return lambda low: [{"ord": o, "name": n} for o, n in sorted({e for _, es in tree.iter(low) for e in es})] if low else []

    return make


def occurring_each(df: DataFrame, texts: Column, lexicon: DataFrame, name: str, out: str) -> DataFrame:
    """``df`` with array ``out``: for each of the small-letter ``texts`` the (ord, name) of its entries, by automaton."""
    make = _scanner(lexicon, name)

    def rows():
        held = make()
        return lambda *row: [(*row[:-1], [held(t) for t in row[-1] or ()])]

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return flat_map(df, [*df.columns, texts.alias("_texts")], rows, f"{schema}, `{out}` array<array<struct<ord:int,name:string>>>")


def _window(text: Column, low: Column, found: Column, place, lead: int, tail: int) -> Column:
    """(ord, name, start, ctx) of the entries, with the text around each one's place; none for a negative place."""
    at = F.transform(found, lambda x: F.struct(x["ord"].alias("ord"), x["name"].alias("name"), place(low, x["name"]).alias("start")))
    around = lambda x: F.when(x["start"] >= 0, slice_(text, x["start"] - lead, x["start"] + F.length(x["name"]) + tail))
    return F.transform(at, lambda x: F.struct(x["ord"].alias("ord"), x["name"].alias("name"), x["start"].alias("start"), around(x).alias("ctx")))


def _first_place(low: Column, name: Column) -> Column:
    return F.position(name, low) - 1


def _raw(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(x["ctx"], rx(pattern, True), group)


def drug_details(text: Column, found: Column, tail: int) -> Column:
    """Array of (ord, name, start, dose, route, indication) at each drug's first place."""
    near = let(F.lower(text), lambda low: _window(text, low, found, _first_place, 10, tail))
    raw = F.transform(
        near,
        lambda x: F.struct(
            x["ord"].alias("ord"), x["name"].alias("name"), x["start"].alias("start"),
            _raw(x, lex.DOSE).alias("dose"), F.lower(_raw(x, lex.ROUTE)).alias("route"), _raw(x, lex.INDICATION, 1).alias("indication"),
        ),
    )
    return F.transform(
        raw,
        lambda x: F.struct(
            x["ord"].alias("ord"), x["name"].alias("name"), x["start"].alias("start"),
            filled(x["dose"]).alias("dose"), filled(x["route"]).alias("route"), strip(filled(x["indication"])).alias("indication"),
        ),
    )


def nearest(drugs: Column, start: Column) -> Column:
    """The drug with the last place at or before ``start``; of several there the first of the list."""
    before = F.filter(drugs, lambda d: d["start"] <= start)
    ranked = F.transform(before, lambda d: F.struct(d["start"].alias("start"), (-d["ord"]).alias("o"), d["name"].alias("name")))
    return F.array_max(ranked)["name"]


def _bounded(name: Column) -> Column:
    return F.concat(F.lit(r"(?U)(?<!\w)\Q"), name, F.lit(r"\E(?!\w)"))


def _reaction_fields(near: Column, drugs: Column, of_drugs=None, outcome: bool = True) -> Column:
    """Severity, onset, outcome and nearest drug from each window; ``of_drugs`` narrows the drugs for a reaction."""
    raw = F.transform(
        near,
        lambda x: F.struct(
            x["ord"].alias("ord"), x["name"].alias("name"), x["start"].alias("start"), F.lower(_raw(x, lex.SEVERITY)).alias("severity"),
            _raw(x, lex.ONSET, 1).alias("onset"), (F.lower(_raw(x, lex.OUTCOME)) if outcome else F.lit("")).alias("outcome"),
        ),
    )
    return let(
        drugs,
        lambda known: F.transform(
            raw,
            lambda x: F.struct(
                x["ord"].alias("ord"), x["name"].alias("reaction"), x["start"].alias("start"), filled(x["severity"]).alias("severity"),
                strip(filled(x["onset"])).alias("onset"), F.coalesce(filled(x["outcome"]), F.lit("unknown")).alias("outcome"),
                nearest(of_drugs(known, x) if of_drugs else known, x["start"]).alias("drug"),
            ),
        ),
    )


def reaction_details(text: Column, found: Column, drugs: Column, bounded: bool) -> Column:
    """Array of (ord, reaction, start, severity, onset, outcome, drug) at each reaction's first place.

    ``bounded`` asks for whole words and drops mentions after a negation or right behind an amount.
    """
    if not bounded:
        return _reaction_fields(let(F.lower(text), lambda low: _window(text, low, found, _first_place, 30, 80)), drugs)
    cue = F.lit(rx(rf"\b({lex.NEGATIONS})\b", True))
    amount = lambda x: F.concat(F.lit(rx(lex.DOSE_BEFORE + r"\Q", True)), x["name"], F.lit(r"\E"))
    place = lambda low, name: F.length(F.split(low, _bounded(name))[0])

    def windows(low: Column) -> Column:
        whole = F.filter(found, lambda x: F.regexp_like(low, _bounded(x["name"])))
        near = _window(text, low, whole, place, 30, 80)
        near = F.filter(near, lambda x: ~F.regexp_like(slice_(text, x["start"] - 60, x["start"]), cue))
        return F.filter(near, lambda x: ~F.regexp_like(slice_(text, x["start"] - 40, x["start"] + F.length(x["name"]) + 40), amount(x)))

    return _reaction_fields(let(F.lower(text), windows), drugs)


def extract(df: DataFrame, text: str, drugs: DataFrame, reactions: DataFrame, negation_aware: bool) -> DataFrame:
    """``df`` with drugs, reactions, age, sex, causality, overall_severity. Null text gives empty arrays.

    ``negation_aware`` is the engine with whole words, negation and amount guards and a 60-character dose window; the other
    one matches substrings, looks 80 characters ahead, and adds route and indication.
    """
    out = occurring(df, text, drugs, "name", "_drugs")
    out = occurring(out, text, reactions, "term", "_reactions")
    t = F.col(text)
    out = out.withColumn("drugs", drug_details(t, F.col("_drugs"), 60 if negation_aware else 80))
    if negation_aware:
        none = F.lit(None).cast("string")
        out = out.withColumn("drugs", F.transform("drugs", lambda d: d.withField("route", none).withField("indication", none)))
    out = out.withColumn("reactions", reaction_details(t, F.col("_reactions"), F.col("drugs"), negation_aware))
    return out.withColumns(
        {
            "age": first(t, lex.AGE, 1),
            "sex": F.lower(first(t, lex.SEX)),
            "causality": F.coalesce(F.lower(first(t, lex.CAUSALITY)), F.lit("unassessable")),
            "overall_severity": F.lower(first(t, lex.SEVERITY)),
        }
    ).drop("_drugs", "_reactions")


def ner_extract(df: DataFrame, text: str, entities: str) -> DataFrame:
    """Drugs and reactions from array ``entities`` of (seq, word, entity_group), in its order.

    Marks at a word's front are stripped, words under two letters dropped, repeats dropped; a reaction is tied to the
    nearest preceding drug among those that came before it in the list.
    """
    t = F.col(text)
    word = lambda e: F.lower(F.trim(F.regexp_replace(e["word"], "^#+", "")))
    kind = lambda e: (
        F.when(F.regexp_like(e["kind"], F.lit("Chemical|Drug|DRUG|Medication")), "drug").when(
            F.regexp_like(e["kind"], F.lit("Disease|disorder|DISEASE|Symptom|Sign|ADR|Adverse")), "reaction"
        )
    )
    read = F.transform(F.col(entities), lambda e: F.struct(e["seq"].alias("ord"), word(e).alias("name"), e["entity_group"].alias("kind")))
    read = F.transform(F.array_sort(read), lambda e: F.struct(e["ord"].alias("ord"), e["name"].alias("name"), kind(e).alias("kind")))
    kept = F.filter(read, lambda e: (F.length(e["name"]) >= 2) & e["kind"].isNotNull())
    # the first of each (kind, name): a repeat is one that such an element precedes
    once = let(kept, lambda all_: F.filter(all_, lambda e: ~F.exists(all_, lambda f: (f["name"] == e["name"]) & (f["kind"] == e["kind"]) & (f["ord"] < e["ord"]))))
    own = lambda items, k: F.transform(F.filter(items, lambda e: e["kind"] == k), lambda e: F.struct(e["ord"].alias("ord"), e["name"].alias("name")))
    out = df.withColumn("_e", once)
    drugs = let(F.col("_e"), lambda e: drug_details(t, own(e, "drug"), 80))
    out = out.withColumn("drugs", F.transform(drugs, lambda d: d.withField("indication", F.lit(None).cast("string"))))
    near = let(F.lower(t), lambda low: _window(t, low, own(F.col("_e"), "reaction"), _first_place, 30, 80))
    seen = lambda known, x: F.filter(known, lambda d: (d["ord"] < x["ord"]) & (d["start"] >= 0))
    return out.withColumn("reactions", _reaction_fields(near, F.col("drugs"), seen, outcome=False)).drop("_e")
