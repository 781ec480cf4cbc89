"""Reading level of texts by boosted regression trees fitted on English passages.

Features are distributions of length, vocabulary, syntax and cohesion, taken over the whole text and, so that a few
foreign sentences don't sway them, as quantiles over its sentences. The trees are fitted on the labelled passages and on
resamples of their sentences; out-of-fold predictions, with a passage's resamples held out together, calibrate the
score (monotone, by pooling adjacent violators) and place the borders between bands.

Texts mostly in another script are read in it; for languages other than English the score is a transfer of what English
passages taught and was not validated.

Defined results: null, empty and wordless texts have no score (null band); texts of any length are read whole; equal
texts get equal bands; without labelled passages of two bands the fit fails with a message; extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from narravig.functions.trees import BoostedRegressor

#: Labelled passages used, at most, and resamples of each.
PASSAGES, RESAMPLES, FOLDS = 2000, 8, 5
#: Words kept with what they add, per process.
CACHED = 200_000
TOGETHER = 256
STRAY = re.compile(r"<[^<>]{0,20}>|[​-‏⁠﻿­]|[^\x00-ɏ‐-…]")
WORD = re.compile(r"[A-Za-z][A-Za-z'’-]*")
GAP = re.compile(r"[^\S\n]+")
SENTENCE = re.compile(r"(?<=[.!?])[\s\"'”)]+|\n+")
#: Letters of other scripts, with the vowel signs of Indic ones and Thai; and what such texts are read by.
OTHER = re.compile(r"[\u0370-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufaff]")
LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
MARKS = re.compile(r"<[^<>]{0,20}>|[\u200b-\u200f\u2060\ufeff\u00ad]")
ANY = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]{1,2}|[\u0e01-\u0e4e]{1,4}|(?:(?![\u0e00-\u0e7f\u0964\u0965\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\d_])[\w\u0900-\u0dff])+")
SENTENCE_OF_ANY = re.compile(r"(?<=[.!?])[\s\"'”)]+|(?<=[。！？।॥؟])[\s」』）”]*|\n+")
PERSON = frozenset("i me my mine you your yours he him his she her we us our they them their it".split())
GLUE = frozenset("and but so then or because if when after before until".split())
COMPLEX = frozenset("although whereas which whether notwithstanding thereby while despite whom whose unless however therefore".split())
PLAIN = frozenset("the a an to of in on at is are was were be have had do did not no can will this that with for it as by".split())
LEARNED = re.compile(r"(?:tion|sion|ity|osis|emia|aemia|itis|ology|ally|ical|ive|ous|ance|ence|ment|pathy|genic)s?$")
VOWELS = re.compile(r"[aeiouy]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text; one with more letters of other scripts than Latin ones keeps them."""
    other = 0 if text.isascii() else len(OTHER.findall(text))
    if other and other > len(LATIN.findall(text)):
        text = GAP.sub(" ", MARKS.sub("", text))
        return [s for s in SENTENCE_OF_ANY.split(text) if ANY.search(s)]
    # most texts have nothing to be taken out, which is seen faster than looked for
    if "<" in text or not text.isascii():
        text = STRAY.sub("", text)
    if "  " in text or not text.isascii() or any(c in text for c in "\t\r\v\f\x1c\x1d\x1e\x1f"):
        text = GAP.sub(" ", text)
    return [s for s in SENTENCE.split(text) if WORD.search(s)]


def words_of(sentence: str) -> list[str]:
    """Words; beside other scripts' letters all count, an ideograph pair or four Thai letters as a word, for want of spaces."""
    return WORD.findall(sentence) if sentence.isascii() or not OTHER.search(sentence) else ANY.findall(sentence)


def _word(word: str) -> tuple[float, ...]:
    """What one word adds to the shares of its sentence."""
    low, size = word.lower(), len(word)
    syllables = max(1, len(VOWELS.findall(word[:-1].lower() if word.endswith("e") else low)))
    return (
        size,
        size >= 7,
        size >= 10,
        size >= 13,
        syllables,
        syllables >= 3,
        low in PERSON,
        low in GLUE,
        low in COMPLEX,
        low in PLAIN,
        bool(LEARNED.search(low)),
        size > 1 and word.isupper(),
    )


class Words:
    """What words add, as rows of one array, and the numbers of their small-letter forms; each word is looked at once."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.small: dict[str, int] = {}
        self.low: list[int] = []
        self.rows = np.zeros((1024, len(_word("a"))))

    def numbers(self, words: list[str]) -> list[int]:
        return [n if (n := self.number.get(w)) is not None else self._new(w) for w in words]

    def _new(self, word: str) -> int:
        n = self.number[word] = len(self.number)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = _word(word)
        low = word.lower()
        # function words count for no cohesion
        self.low.append(-1 if low in PLAIN else self.small.setdefault(low, len(self.small)))
        return n


_WORDS = Words()


def tables(texts: list[list[str]]) -> list[tuple[np.ndarray, list[set[int]]]]:
    """For each text, given as its sentences: a row of shares, size and commas for each sentence, and its words' numbers.

    Words are kept from call to call in a process, until there are CACHED of them; then they are looked at anew.
    """
    global _WORDS
    if len(_WORDS.number) > CACHED:
        _WORDS = Words()
    words = _WORDS
    numbers = [words.numbers(words_of(s)) for parts in texts for s in parts]
    if not numbers:
        return []
    sizes = np.array([len(n) for n in numbers])
    flat = np.fromiter(chain.from_iterable(numbers), dtype=np.int64, count=int(sizes.sum()))
    sums = np.add.reduceat(words.rows[flat], np.cumsum([0, *sizes[:-1]]), axis=0)
    extra = np.array([(s.count(","), sum(map(s.count, "0123456789"))) for parts in texts for s in parts])
    table = np.concatenate([sums / sizes[:, None], sizes[:, None], extra / sizes[:, None]], axis=1)
    low, out, at = words.low, [], 0
    for parts in texts:
        end = at + len(parts)
        out.append((table[at:end], [{low[n] for n in own} - NO_WORD for own in numbers[at:end]]))
        at = end
    return out


NO_WORD = frozenset([-1])


def _quantiles(x: np.ndarray, q: list[float]) -> np.ndarray:
    """Quantiles by linear interpolation along the first axis."""
    x = np.sort(x, axis=0)
    at = np.array(q) * (len(x) - 1)
    low = at.astype(int)
    part = (at - low).reshape(-1, *(1,) * (x.ndim - 1))
    return x[low] * (1 - part) + x[np.minimum(low + 1, len(x) - 1)] * part


def features(parts: list[str], table: np.ndarray, bags: list[set[int]], scores: np.ndarray) -> list[float]:
    """The features of a text given as its sentences with their tables and single scores."""
    sizes = table[:, 12]
    n = sizes.sum()
    whole = (table * (sizes / n)[:, None]).sum(0)
    text = " ".join(parts)
    types = len(set().union(*bags))
    overlap = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(bags, bags[1:])] or [0.0]
    marks = [text.count(c) / n for c in ",;:()%/<>"] + [sum(map(text.count, "0123456789")) / n]
    return [
        *_quantiles(scores, [0.25, 0.4, 0.5, 0.6, 0.75]),
        scores.mean(),
        (scores * sizes).sum() / n,
        (scores < 1.5).mean(),
        (scores > 2.5).mean(),
        *whole,
        *_quantiles(table[:, [0, 1, 4, 6, 9]], [0.25, 0.5, 0.75]).ravel(),
        *_quantiles(sizes, [0.2, 0.5, 0.8]),
        types / n**0.5,
        float(np.mean(overlap)),
        *marks,
    ]


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone step from scores to mean labels."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x, y)):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            q, p = blocks.pop(), blocks.pop()
            blocks.append([(p[0] * p[1] + q[0] * q[1]) / (p[1] + q[1]), p[1] + q[1], (p[2] * p[1] + q[2] * q[1]) / (p[1] + q[1])])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    """Boosted trees with their calibration; accuracy is that of the held-out passages."""

    def __init__(self, passages: list[tuple[str, int]]):
        passages = [(parts, int(b)) for t, b in passages if t and (parts := sentences(t))]
        self.bands = np.array(sorted({b for _, b in passages}))
        if len(self.bands) < 2:
            raise ValueError("labelled passages of at least two bands are needed")
        rng = np.random.default_rng(11)
        fold = rng.permutation(len(passages)) % FOLDS
        cut = tables([parts for parts, _ in passages])
        rows = np.concatenate([t for t, _ in cut])
        owner = np.repeat(np.arange(len(cut)), [len(t) for t, _ in cut])
        label = np.array([b for _, b in passages], dtype=float)
        # single sentences first; each passage is scored by trees that didn't see it
        single = np.zeros(len(rows))
        for k in range(FOLDS):
            test = fold[owner] == k
            if test.any() and not test.all():
                single[test] = self._trees(rows[~test], label[owner[~test]]).predict(rows[test])
        self.sentence_trees = self._trees(rows, label[owner])
        x, y, group, whole = [], [], [], []
        for g, (parts, band) in enumerate(passages):
            mine = np.flatnonzero(owner == g)
            for k in range(RESAMPLES + 1):
                at = np.arange(len(parts)) if not k else rng.integers(0, len(parts), max(3, int(len(parts) * rng.uniform(0.3, 1.2))))
                x.append(features([parts[i] for i in at], rows[mine[at]], [cut[g][1][i] for i in at], single[mine[at]]))
                y.append(band)
                group.append(g)
                whole.append(not k)
        x, y, group, whole = np.array(x), np.array(y, dtype=float), np.array(group), np.array(whole)
        held = np.zeros(len(y))
        for k in range(FOLDS):
            test = fold[group] == k
            if test.any() and not test.all():
                held[test] = self._trees(x[~test], y[~test]).predict(x[test])
        self.trees = self._trees(x, y)
        self.knots, self.levels = _monotone(held, y)
        self.borders = (self.bands[1:] + self.bands[:-1]) / 2
        calibrated = np.interp(held[whole], self.knots, self.levels)
        self.accuracy = float((self.band(calibrated) == y[whole]).mean())

    @staticmethod
    def _trees(x: np.ndarray, y: np.ndarray) -> BoostedRegressor:
        return BoostedRegressor(trees=80, rate=0.1, columns=0.4).fit(x, y)

    def band(self, score: np.ndarray) -> np.ndarray:
        return self.bands[np.searchsorted(self.borders, score, side="right")]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores; nan where a text has no words. TOGETHER texts at a time are held as tables."""
        return np.concatenate([self._score(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)] or [np.zeros(0)])

    def _score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), np.nan)
        split = [sentences(t) if t else [] for t in texts]
        at = [i for i, parts in enumerate(split) if parts]
        if not at:
            return out
        cut = [(split[i], *made) for i, made in zip(at, tables([split[i] for i in at]))]
        single = self.sentence_trees.predict(np.concatenate([t for _, t, _ in cut]))
        ends = np.cumsum([len(t) for _, t, _ in cut])
        x = [features(p, t, b, single[e - len(t) : e]) for (p, t, b), e in zip(cut, ends)]
        out[at] = np.interp(self.trees.predict(np.array(x)), self.knots, self.levels)
        return out


def fit(samples: DataFrame) -> Model:
    """The model of level_samples(sample_id, text, band), at most PASSAGES of them."""
    rows = samples.select("sample_id", "text", "band").where("text IS NOT NULL AND band IS NOT NULL").distinct()
    return Model([(r.text, r.band) for r in rows.orderBy("sample_id", "text").limit(PASSAGES).collect()])


def levels(df: DataFrame, key: str, text: str, model: Model, *keep: str) -> DataFrame:
    """key, the columns ``keep``, and score and band of each text, looked at once."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in (key, *keep)]
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds) + ", score double, band long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    # a map over batches, not a function in a column: a filter on the band would have the optimizer call that twice
    def rate(batches):
        for b in batches:
            score = shared.value.score(b.column(b.num_columns - 1).to_pylist())
            none = np.isnan(score)
            band = pa.array(shared.value.band(score), pa.int64(), mask=none)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, mask=none), band], schema=arrow)

    return df.select(key, *keep, F.col(text).alias("_text")).mapInArrow(rate, schema)
