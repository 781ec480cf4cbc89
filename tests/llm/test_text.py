"""The text operators against brute force, round trips and their defined results for awkward input."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from narravig.llm import canon, chunking, packing, pii, readability, sentences, tokens

RANKS = os.path.join(tokens.FOLDER, tokens.FILE)
LONG = "word " * 40_000

# pieces


@pytest.mark.parametrize("text", ["a" * 5000, "日本語" * 2000, "one two. " * 600, "x\r\n" * 2000, "👩‍⚕️" * 900, LONG])
def test_pieces_cover_the_text_within_the_limit(text):
    got = chunking.cuts(text, 700, 90)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= 700 for a, b in got)
    assert all(a < c <= b < d for (a, b), (c, d) in zip(got, got[1:]))
    assert all(40 <= b - c <= 140 for (_, b), (c, _) in zip(got, got[1:]))


def test_pieces_cut_at_sentences_and_cheapest():
    text = "".join(f"Sentence number {i} is here. " for i in range(60))
    at, penalty = chunking.boundaries(text, 6)
    inner = [b for _, b in chunking.cuts(text, 300, 30)][:-1]
    assert all(text[b - 2 : b] == ". " for b in inner)
    assert set(inner) <= set(at.tolist()) and penalty[0] == 0


@pytest.mark.parametrize("overlap", [0, 20, 45])
def test_pieces_are_the_cheapest_over_all_boundaries(overlap):
    rng = random.Random(overlap)
    for _ in range(6):
        text = "".join(rng.choice(["ab ", "cdef ", "gh, ", "ij. ", "k\n", "lm\n\n", "n" * 30]) for _ in range(70))
        most = 100
        at, penalty = chunking.boundaries(text, most // 50)

        def start(j):
            near = [(penalty[i] + 20 * abs(at[i] - (at[j] - overlap)) / overlap, i) for i in range(j) if at[j] - overlap * 1.25 <= at[i] <= at[j] - overlap * 0.75] if overlap and j else []
            return at[min(near)[1]] if near else at[j] if not overlap or not j else max(0, at[j] - overlap)

        starts = [start(j) for j in range(len(at))]
        pieces = max(2, -(-(len(text) - overlap) // (most - overlap)))
        target = overlap + (len(text) - overlap) / pieces
        cost = [0.0] + [np.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                size = at[j] - starts[i]
                if size <= most and at[j] - at[i] >= most // 8:
                    cost[j] = min(cost[j], cost[i] + chunking.IMBALANCE * ((size - target) / target) ** 2 + penalty[j])
        place = {int(p): k for k, p in enumerate(at)}
        got = chunking.cuts(text, most, overlap)
        spent = sum(chunking.IMBALANCE * ((b - a - target) / target) ** 2 + penalty[place[b]] for a, b in got)
        assert spent == pytest.approx(cost[-1])


def test_pieces_query_shape(spark):
    rows = [("n", 1, 0, "a b " * 20), ("n", 1, 0, "a b " * 20), ("n", 2, 0, None), ("n", 3, 0, ""), ("n", 4, 0, "x" * 50), ("other", 5, 0, "x" * 99)]
    df = spark.createDataFrame(rows, "field string, item_id long, pos int, text string").withColumns({"piece": F.lit(1), "start_at": F.lit(2)})
    got = chunking.split(df, {"n": (50, 5)}).distinct().collect()
    assert {r.item_id for r in got} == {1}
    assert chunking.split(df.limit(0), {"n": (50, 5)}).count() == 0


# tokens


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return tokens.Encoder(f.read())


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_rank_rule_and_decode(encoder, reference):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabbe  tinoh\n!.—é日本ß😀​<|>") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    for text in [*texts, "<|endoftext|>", " ", "ab" * 5000, LONG]:
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text


def test_the_automaton_finds_the_longest_token_at_each_place(encoder):
    text = "".join(random.Random(1).choice(["the", " the", "ing", "zq", "aaaa", "\xc3", "\xa9", "  "]) for _ in range(60))
    want = [max((k for k in range(1, encoder_longest(encoder) + 1) if text[i : i + k] in encoder.ids and i + k <= len(text)), default=0) for i in range(len(text))]
    assert [encoder.length[n] for n in encoder.longest(text)] == want


def encoder_longest(encoder):
    return max(encoder.length)


def test_ids_of_rows(spark):
    df = spark.createDataFrame([(1, "hi there"), (2, ""), (3, None), (4, "hi there")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] != []
    assert {r.doc_id: r.n_tokens for r in tokens.encode(df, "doc_id", "text", lengths_only=True).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


# containers


def optimum(sizes, capacity):
    def place(left, bins):
        if not left:
            return len(bins)
        best = len(bins) + len(left)
        for i in range(len(bins)):
            if bins[i] + left[0] <= capacity:
                bins[i] += left[0]
                best = min(best, place(left[1:], bins))
                bins[i] -= left[0]
        return min(best, place(left[1:], [*bins, left[0]]))

    return place(sorted(sizes, reverse=True), [])


def test_packing_is_optimal_on_small_sets():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(5, 60) for _ in range(9)]
        bins = [b for b, _ in packing.pack(sizes, 100)[0]]
        assert sorted(i for b in bins for i in b) == list(range(9))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) == optimum(sizes, 100) >= packing.lower_bound(sizes, 100)


def test_fillings_come_from_the_search_and_beat_best_fit():
    rng, better = random.Random(6), 0
    for _ in range(40):
        sizes = [rng.randint(20, 45) for _ in range(24)]
        bins, steps = packing.pack(sizes, 100)
        fitted = packing.best_fit(sizes, 100)
        assert len(bins) <= len(fitted) and steps > 0
        better += len(bins) < len(fitted)
    assert better
    large = [rng.randint(1, 400) for _ in range(5000)]
    bins, _ = packing.pack(large, 1000)
    assert len(bins) == packing.lower_bound(large, 1000) and all(n > 0 for _, n in bins)
    # a filling is left out if its items fit into those of another
    assert packing.fits_inside((3, 2, 2), (5, 4)) and not packing.fits_inside((5, 4), (3, 3, 3))
    kept, _ = packing.fillings([2, 3, 5], [2, 1, 1], 5, 5)
    assert kept == [(5,)]


def test_containers_of_rows(spark):
    rows = [(i, i % 37 + 1) for i in range(500)] + [(900, 250), (900, 250), (901, 0), (902, None), (903, -4), (904, 100)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumns({"id": F.lit("clash"), "size": F.lit("clash")})
    got = packing.containers(df, "doc_id", "n", 100, group_items=120).collect()
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.size
    assert max(fill.values()) <= 100
    assert sorted(r.size for r in got if r.id == 900) == [50, 100, 100]
    assert {r.id for r in got} == {r[0] for r in rows if r[1] and r[1] > 0} and len({(r.id, r.piece) for r in got}) == len(got)
    assert len(fill) <= -(-sum(r.size for r in got) // 100) + 3
    assert packing.containers(df.limit(0), "doc_id", "n", 100).count() == 0


# typed values


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pigeonhole_join_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(5, 13))) for _ in range(25)]
    typed = set()
    for w in words:
        for _ in range(12):
            t = list(w)
            for _ in range(rng.randint(1, 5)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "e"])
            typed.add("".join(t) or "a")
    refs = canon.references(spark.createDataFrame([("l", w) for w in words], "list string, canonical string"))
    near = canon._near(spark.createDataFrame([("l", t) for t in sorted(typed)], "list string, typed string"), refs).collect()
    got = {t: {r.canonical: r.edits for r in near if r.typed == t} for t in typed}
    bound = lambda n: 1 if n <= 5 else 2 if n <= 7 else 3 if n <= 10 else 4
    for t in typed:
        assert got[t] == {w: levenshtein(t, w) for w in words if levenshtein(t, w) <= bound(len(w))}


def test_every_value_goes_through_the_join(spark):
    entries = spark.createDataFrame([("reaction", "dry mouth"), ("reaction", "mouth dry skin"), ("reaction", "x")], "list string, canonical string")
    values = spark.createDataFrame([("reaction", t) for t in ("mouth dry", "dry mouht", "mouth dry s", "x", "qqqqqq")], "list string, value string")
    got = {r.value: r.canonical for r in canon.known_values(values, entries).collect()}
    assert got == {"mouth dry": "dry mouth", "dry mouht": "dry mouth", "mouth dry s": "mouth dry skin", "x": "x"}


def test_typed_values(spark):
    entries = [("reaction", "dry mouth"), ("reaction", "restless legs"), ("reaction", "dry mouth"), ("drug", "cardexal"), ("drug", "cardexal plus"), ("drug", None)]
    entries = spark.createDataFrame(entries, "list string, canonical string")
    want = {
        "Dry  MOUTH": None, "mouth, dry": "dry mouth", "drymouth": "dry mouth", "? dry mouths": "dry mouth", "severe dry muoth!!": "dry mouth",
        "restless l": "restless legs", "dry mouth x 2 days": "dry mouth", "hip scar": "", "-": "", "drý m0uth": "dry mouth", "x" * 20_000: "", "  ": None, None: None,
    }
    rows = [("reaction", "reaction", i, 0, v) for i, v in enumerate(want)] + [("name", "drug", 50 + i, 1, v) for i, v in enumerate(("cardexal p", "cardexalx", "Cardexal hcl"))]
    rows = spark.createDataFrame(rows * 2, "field string, list string, row_id long, pos long, value string").withColumn("canonical", F.lit("clash"))
    got = {(r.field, r.row_id): r.canonical for r in canon.resolve(rows, entries).collect()}
    assert got == {("reaction", i): c for i, c in enumerate(want.values()) if c is not None} | {("name", 50): "cardexal plus", ("name", 51): "cardexal", ("name", 52): "cardexal"}
    assert canon.resolve(rows.limit(0), entries).count() == 0
    assert {r.canonical for r in canon.resolve(rows, entries.limit(0)).collect()} == {""}


# personal information


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Contact: Ann B. Lee, ann+x@mail.example.org", [("NAME", "Ann B. Lee"), ("EMAIL", "ann+x@mail.example.org")]),
        ("Mail from kwame at home dot example dot net received.", [("EMAIL", "kwame at home dot example dot net")]),
        ("Took 500 mg @ 8 pm. Barcode 420313540 scanned.", []),
        ("Seen by Dr. KOST, YASMIN on the ward of Mount Alder Clinic.", [("NAME", "KOST, YASMIN")]),
        ("Known Bell palsy; Raynaud phenomenon; a Foley catheter.", []),
        ("Lives at 12B St. Brannoc Lane, Apt 3; MRN: 737 848 829.", [("ADDRESS", "12B St. Brannoc Lane, Apt 3"), ("ID", "737 848 829")]),
        ("M. van Oskel habite 19 rue du Weir, tel (808) 555-0150.", [("NAME", "van Oskel"), ("ADDRESS", "19 rue du Weir"), ("PHONE", "(808) 555-0150")]),
        ("SSN 000-31-3644; +49 (0)30 23125 189; PO Box 77", [("ID", "000-31-3644"), ("PHONE", "+49 (0)30 23125 189"), ("ADDRESS", "PO Box 77")]),
        ("attn łucja velorska Room 3", [("NAME", "łucja velorska")]),
        ("", []),
    ],
)
def test_mentions(text, expected):
    assert [(k, text[a:b]) for a, b, k in pii.mentions(text)] == expected


def test_pseudonyms_are_permutations_that_keep_the_format():
    key = b"k" * 32
    seen = {pii.permute_digits(f"{i:03d}", key, "ID") for i in range(1000)}
    assert len(seen) == 1000
    for text, kind in (("737 848 829", "ID"), ("+1 808 555 0162", "PHONE"), ("80-1621-Y", "ID"), ("943 476 5919", "ID"), ("12345678Z", "ID"), ("666-31-3644", "ID")):
        new = pii.permute_number(text, key, kind)
        assert [c if not c.isdigit() else "9" for c in new] == [c if not c.isdigit() else "9" for c in text]
        assert pii.permute_number(new, key, kind, back=True) == text
        assert pii.checked(new, kind) == pii.checked(text, kind)
    checks = [pii.checked(t, k) for t, k in (("943 476 5919", "ID"), ("943 476 5918", "ID"), ("12345678Z", "ID"), ("666-31-3644", "ID"), ("665-31-3644", "ID"), ("(808) 555-0150", "PHONE"))]
    assert checks == ["mod11", None, "mod23", None, "ssn", "dialled"]
    days = [dt.date(1999, 12, 31) + dt.timedelta(days=i) for i in range(300)]
    new = [pii.permute_date(d, key) for d in days]
    assert len(set(new)) == 300 and [pii.permute_date(d, key, back=True) for d in new] == days


DATES = (
    "01/31/2024", "31/01/2024", "01-31-2024", "31.01.2024", "2024-01-31", "January 31, 2024", "Jan 31 2024", "31 January 2024", "31. Januar 2024", "le 31 janvier 2024",
    "31 de enero de 2024", "11/12/80", "January 2024", "01/2024", "born in 1980", "29/02/2023",
)


@pytest.mark.parametrize("text", DATES)
def test_no_form_of_a_date_stays(text):
    key = b"k" * 32
    new = pii.redact(f"Seen {text}.", key)
    assert "[DATE " in new and text.split()[-1] not in new
    if text != "29/02/2023":
        # a month may come back in another language that spells the new one alike
        assert pii.restore(new, key).replace("January", "Januar") == f"Seen {text}.".replace("January", "Januar")


def test_dates_keep_days_apart_and_other_numbers_stay():
    key = b"k" * 32
    for form in ("%d/%m/%Y", "%d.%m.%y", "%B %d, %Y"):
        days = [(dt.date(1990, 1, 1) + dt.timedelta(days=31 * i)).strftime(form) for i in range(200)]
        new = [pii.redact(d, key) for d in days]
        assert len(set(new)) == len(set(days)) and [pii.restore(n, key) for n in new] == days
    for text in ("BP 98/60", "pump 2.6.11.8", "dose log 48-39-14", "ref 55597-0932-29"):
        assert pii.redact(text, key) == text


def test_redaction_links_equal_values(spark):
    rows = [(1, "MRN: 737848829 on 2020-02-03."), (2, "Chart No 737 848 829, born 03.02.2020"), (3, None), (4, ""), (1, "MRN: 737848829 on 2020-02-03.")]
    df = spark.createDataFrame(rows, "narrative_id long, narrative string").withColumn("kind", F.lit(1))
    got = {r.narrative_id: r.narrative for r in pii.redacted(df, "narrative_id", "narrative", "s").collect()}
    assert got[3] is None and got[4] == "" and "[DATE " in got[1] and "737848829" not in got[1]
    new = [got[k].split("]")[0].split("[ID ")[1] for k in (1, 2)]
    assert new[0] == new[1].replace(" ", "") and new[1].count(" ") == 2
    key = pii._key("s")
    assert {k: pii.restore(t, key) if t else t for k, t in got.items()} == {r[0]: r[1] for r in rows}
    links = pii.found(df, "narrative_id", "narrative", "s").collect()
    assert sorted((r.narrative_id, r.kind, r.checked, r.pseudonym) for r in links) == [(1, "ID", "ssn", new[0]), (2, "ID", "ssn", new[1])]
    assert pii.found(df.limit(0), "narrative_id", "narrative", "s").count() == 0
    assert len(pii.mentions("Dr. Ann Lee called. " * 5000)) == 5000
    with pytest.raises(ValueError):
        pii.redacted(df, "narrative_id", "narrative", "")
    assert len(pii.tag("Ann Lee", key)) == 20


# sentences

CORPUS = [
    ("en", "Dr. Orvik saw it. Take 5 mg p.o. daily. Give 50 mg p.o.\n\nThe dose fell. Patients of Dr. Lunde rested. The patients slept."),
    ("en", "Watch the dose. Take approx. 5 mg. Watch for signs. He asked Dr. Orvik. Give 9 mg p.o.\n\nWatch it. He did watch it."),
    ("de", "Der 3. Fall trat am 13. Juni auf. Die Haut war normal. Er lag auf dem Bett.\n\nDie Haut fiel auf."),
]


@pytest.fixture(scope="module")
def learned(spark):
    return sentences.learn(spark.createDataFrame(CORPUS * 12 + [(None, "x. y"), ("en", None), ("en", "")], "lang string, text string"))()


@pytest.mark.parametrize(
    ("lang", "text", "expected"),
    [
        ("en", "Dr. Orvik slept. He woke.", ["Dr. Orvik slept.", "He woke."]),
        ("en", "Give 5 mg p.o. Watch the skin.", ["Give 5 mg p.o.", "Watch the skin."]),
        ("en", 'The box says "Keep cool. Keep dry." in red. (See 3.) Done.', ['The box says "Keep cool. Keep dry." in red.', "(See 3.)", "Done."]),
        ("en", "It cleared.Watch it. 2.5 mg is low.", ["It cleared.", "Watch it.", "2.5 mg is low."]),
        ("en", "Skin effects\n\n7.2 Other data\n\nRash came\nback.\n• one\n- two", ["Skin effects", "7.2 Other data", "Rash came\nback.", "one", "two"]),
        ("de", "Der 3. Fall trat am 13. Juni auf. Die Haut war normal.", ["Der 3. Fall trat am 13. Juni auf.", "Die Haut war normal."]),
        ("zh", "有人说：“好。走了。”随后停药。第7天好了！", ["有人说：“好。走了。”随后停药。", "第7天好了！"]),
        ("th", "ห้ามขับรถหลังใช้ยา ควรดื่มน้ำมากๆ", ["ห้ามขับรถหลังใช้ยา", "ควรดื่มน้ำมากๆ"]),
        (None, "Plain text. No language!", ["Plain text.", "No language!"]),
    ],
)
def test_sentences(learned, lang, text, expected):
    at = sentences.starts(text, learned.of(lang), lang)
    got = [text[a:b].strip().rstrip("•-").strip() for a, b in zip(at, [*at[1:], len(text)])]
    assert got == expected


def test_collocations_alone_decide():
    before = {"": (1000, 5000, 100, 0), "suppl": (20, 12, 0, 0)}
    after = {"": (300, 5000, 0, 0), "tabelle": (0, 20, 0, 0)}
    text = "Siehe Suppl. Tabelle dort."
    assert sentences.starts(text, sentences.Language(before, after), "de") == [0, 13]
    assert sentences.starts(text, sentences.Language(before, after, {"suppl tabelle": (15, 0, 0, 0)}), "de") == [0]
    # by chance, or with a word that starts sentences, they don't
    assert sentences.starts(text, sentences.Language(before, after | {"tabelle": (0, 3000, 0, 0)}, {"suppl tabelle": (9, 0, 0, 0)}), "de") == [0, 13]
    assert sentences.starts(text, sentences.Language(before, after | {"tabelle": (90, 20, 0, 0)}, {"suppl tabelle": (15, 0, 0, 0)}), "de") == [0, 13]


def test_pairs_are_counted_and_words_may_be_long(spark):
    texts = [("en", "See vol. Orvik now. He left now it is.")] * 4
    got = {r.word: r.a for r in sentences.counts(spark.createDataFrame(texts, "lang string, text string")).where("kind = 'c' AND lang = 'en' AND word <> ''").collect()}
    # "now" stands without a period as often
    assert got == {"vol orvik": 4}
    long = "Q" + "x" * 90
    assert sentences.starts(f"Seen {long}. Ends.", sentences.Language({"": (9, 9, 9, 0), long.lower(): (5, 0, 0, 5)}, {}), "en") == [0]
    assert len(sentences.starts("a.a" * 30_000, sentences.NOTHING, "en")) == 1


def test_sentence_rows(spark, learned):
    rows = [(1, "f", "en", "One. Two."), (1, "f", "en", "One. Two."), (2, "f", "en", None), (3, "f", None, "  "), (4, "f", "en", "x" * 200_000)]
    df = spark.createDataFrame(rows, "item_id long, field string, lang string, text string").withColumn("start_at", F.lit("clash"))
    rows, path = learned.rows, learned.path
    known = lambda: sentences.Learned(rows, path)
    got = sentences.split(df, known).distinct().collect()
    assert sorted((r.item_id, r.start_at) for r in got) == [(1, 0), (1, 5), (4, 0)]
    assert sentences.split(df.limit(0), known).count() == 0


def test_counts_beyond_the_broadcast_are_read_for_each_batch(spark, learned, monkeypatch):
    monkeypatch.setattr(sentences, "BROADCAST_WORDS", 0)
    known = sentences.learn(spark.createDataFrame(CORPUS * 12, "lang string, text string"))()
    assert known.rows is None
    # what a batch needs is read for it, and decides alike
    text = "Dr. Orvik slept. He took approx. 5 mg (p.o.) daily. Watch it."
    known.ahead([("en", text), ("de", "Der 3. Fall."), (None, None)])
    assert known.of("en").abbreviation("dr") and not known.of("de").before.get("orvik")
    assert sentences.starts(text, known.of("en"), "en") == sentences.starts(text, learned.of("en"), "en")
    assert sum(map(len, (known.of("en").before, known.of("en").after))) < sum(map(len, (learned.of("en").before, learned.of("en").after)))


# reading level


def test_levels(spark):
    plain = [f"I took the pill at noon. My {w} was sore. You can rest now. She felt fine in bed." for w in ("arm", "leg", "knee", "back", "foot", "hand")]
    hard = [f"Pharmacokinetic modelling demonstrated disproportionate {w} elevation. Histopathological examination corroborated hypersensitivity." for w in ("renal", "hepatic", "biliary", "cardiac", "gastric", "pancreatic")]
    samples = [(i, t, 1) for i, t in enumerate(plain)] + [(10 + i, t, 3) for i, t in enumerate(hard)] + [(90, None, 1), (91, "x", None)]
    model = readability.fit(spark.createDataFrame(samples, "sample_id long, text string, band int"))
    assert model.accuracy >= 0.9
    docs = [(1, plain[0]), (2, hard[0]), (3, None), (4, ""), (5, "123 !!"), (6, LONG), (7, plain[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "band": F.lit("clash")})
    got = {r.doc_id: r.band for r in readability.levels(df, "doc_id", "text", model).collect()}
    assert got[1] == got[7] == 1 and got[2] == 3 and got[3] is got[4] is got[5] is None and got[6] in (1, 3)
    assert readability.levels(df.limit(0), "doc_id", "text", model).count() == 0
    with pytest.raises(ValueError):
        readability.Model([("One band.", 1)])
    assert np.isnan(model.score([None])[0])


def test_a_text_is_scored_once(spark):
    samples = [(i, "The cat sat down. You can rest." if b == 1 else "Pharmacokinetic investigations demonstrated considerable hepatotoxicity.", b) for i, b in enumerate([1, 3] * 6)]
    model = readability.fit(spark.createDataFrame(samples, "sample_id long, text string, band int"))
    df = spark.createDataFrame([(1, "The cat sat.")], "doc_id long, text string")
    plan = readability.levels(df, "doc_id", "text", model).where("band IS NOT NULL").distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1


def test_every_script_has_a_level(spark, tmp_path):
    from narravig.llm import queries

    texts = ["这种药可能引起头痛。请咨询医生。", "यह दवा सिरदर्द का कारण बन सकती है। डॉक्टर से पूछें।", "ยานี้อาจทำให้ปวดศีรษะ ควรปรึกษาแพทย์", "Die Tablette hilft gut. Fragen Sie den Arzt.", "Take it. Rest.", "1 2 3", None]
    assert [len(readability.sentences(t)) for t in texts[:5]] == [2, 2, 1, 2, 2]
    assert readability.words_of("यह दवा") == ["यह", "दवा"] and readability.words_of("naïve rash") == readability.WORD.findall("naïve rash")
    # a few foreign letters in an English text are still left out
    assert readability.sentences("Take it with water 水 daily.") == ["Take it with water daily."]
    langs = ["zh", "hi", "th", "de", None, "en", "en"]
    docs = [(i, t, lang, "s") for i, (t, lang) in enumerate(zip(texts, langs))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    samples = [(i, "The cat sat down. You can rest." if b == 1 else "Pharmacokinetic investigations demonstrated considerable hepatotoxicity.", b) for i, b in enumerate([1, 3] * 6)]
    spark.createDataFrame(samples, "sample_id long, text string, band int").write.parquet(f"{tmp_path}/level_samples.parquet")
    assert {r.doc_id for r in queries.p10_scores(spark, str(tmp_path)).collect()} == {0, 1, 2, 3, 4}
    assert queries.p10_profile(spark, str(tmp_path)).first().docs == 5


def test_sentences_without_a_language_use_all_counts(spark, learned):
    text = "Dr. Orvik slept. He woke."
    assert sentences.starts(text, learned.of(None), None) == [0, 17]
    # texts without a language are counted too
    alone = sentences.learn(spark.createDataFrame([(None, t) for lang, t in CORPUS * 12 if lang == "en"], "lang string, text string"))()
    assert sentences.starts(text, alone.of(None), None) == [0, 17]
