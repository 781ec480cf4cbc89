"""Sentence boundaries in many languages, with abbreviations learned from the corpus itself.

Counts over every text, by language: how often a word stands with and without a period, with a period at the end of a
paragraph, and before a small letter; how often a word opens a sentence for certain or stands inside one; and how often
two words stand on either side of a period. From these come, by log-likelihood ratios, the abbreviations, those of them
that never end a sentence (they shun the ends of paragraphs), the words that start sentences, and the collocations: pairs
that belong together across the period. Each period is then judged by the word before and the word after it.
Quotations and brackets that are closed again hold no boundary inside; paragraphs, bulleted lines and numbered
headings bound sentences; ideographic and danda stops always end one; in Thai, spaces between longer phrases do.

A text without a language counts for, and is cut by, the statistics of all languages pooled.

Defined results: null and blank texts give no row; every other text gives at least one; a text in a language
that the counts don't hold is split by the rules alone; equal texts are split equally; repeated rows are
reported once; texts of any length are read whole in one pass; extra columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable
from functools import lru_cache
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig.functions.arrowmap import flat_map
from narravig.sources.tables import remove, shared_dir

#: Up to so many counted words travel by broadcast (some 60 bytes each); beyond, workers read those that a batch of texts holds.
BROADCAST_WORDS = 300_000
#: A word or pair is judged from so many sightings; rarer ones go by the rules for unknown words.
SEEN = 3
#: Significance of a log-likelihood ratio (0.5 %), and the bound of the abbreviation score.
RATIO, ABBREVIATION = 7.88, 0.3

#: The statistics of all texts together, for those without a language.
POOLED = "*"
NUMBER = "##"
OPEN = "\"'“„‘«‹「『(（[【〈《¿¡"
CLOSE = "\"'”“’»›」』)）]】〉》"
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "«": "»", "‹": "›", "「": "」", "『": "』", "〈": "〉", "《": "》", "“": "”", "„": "“", "‘": "’"}
STOPS = ".!?…。！？｡।॥؟։"
WIDE = "。！？｡।॥"
BULLET = re.compile(r"[^\S\n]*(?:[•‣▪●○◦■□*·–—-][^\S\n]+)")
HEADING = re.compile(r"[^\S\n]*\d+(?:\.\d+)*(?P<stop>\.?)[^\S\n]+[^\W\d_a-z][^.!?\n]*$", re.M)
THAI = re.compile(r"[฀-๿]")


def counts(texts: DataFrame) -> DataFrame:
    """lang, kind, word and counts a to e of texts(lang, text).

    kind ``p``: words before periods: a with a period, b without, c at a paragraph's end, d before a small letter.
    kind ``s``: words after something: a opening a sentence for certain, b inside one, c inside one with a small letter.
    kind ``c``: pairs of words, parted by a space, with a period between: a how often.
    """
    spaced = texts.where("lang IS NULL OR lang NOT IN ('zh', 'ja', 'th')")
    block = spaced.select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), F.explode(F.split("text", r"\n\s*\n")).alias("block"))
    words = F.filter(F.split("block", r"[\s\u00a0\u202f\u3000]+"), lambda w: w != "")
    block = block.select("lang", words.alias("w")).where(F.size("w") > 0)
    none = F.array(F.lit(None).cast("string"))
    before, after = F.concat(none, "w"), F.concat(F.slice("w", F.lit(2), F.size("w")), none)
    each = block.select("lang", F.explode(F.arrays_zip(before.alias("before"), F.col("w").alias("word"), after.alias("after"))).alias("t"))
    each = each.where("t.word IS NOT NULL").select("lang", "t.before", "t.word", "t.after")
    # per word of the corpus only what its neighbours say, by cheap tests; words themselves are looked at after counting
    last = F.substring("before", -1, 1)
    cut_off = F.when(last.isin(*CLOSE), F.substring(F.rtrim(F.col("before"), F.lit(CLOSE)), -1, 1)).otherwise(last)
    word_stop = (last == ".") & (F.length("before") > 4) & (F.locate(".", F.col("before")) == F.length("before")) & ~F.substring("before", 1, 1).between("0", "9")
    place = F.when(F.col("before").isNull() | cut_off.isin("!", "?") | word_stop, 1).when(last.isin(*(STOPS + ":;" + OPEN + CLOSE)), 0).otherwise(2)
    is_small = lambda c: (F.lower(c) == c) & (F.upper(c) != c)
    is_large = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    first = F.substring("after", 1, 1)
    small = first.between("a", "z") | ~first.between("A", "Z") & ~first.between("0", "9") & is_small(first)
    follow = F.when(F.col("after").isNull(), 1).when(small & ~is_large(F.substring("after", 2, 1)), 2).otherwise(0)
    # a stop before a closing sign tells nothing about the word
    full = F.col("word").endswith(".") & ~F.col("word").endswith("..")
    kinds = each.select("lang", "word", place.alias("place"), follow.alias("follow"), F.when(full, F.col("after")).alias("next"))
    kinds = kinds.groupBy("lang", "word", "place", "follow", "next").agg(F.count("*").alias("n"))
    core = F.trim(F.col("word"), F.lit(OPEN + CLOSE + ",;:"))

    def based(c: Column) -> Column:
        low = F.lower(F.rtrim(F.trim(c, F.lit(OPEN + CLOSE + ",;:")), F.lit(".!?…")))
        return F.when(F.translate(low, "0123456789.,:", "") == "", NUMBER).otherwise(low)

    base = based(F.col("word"))
    n = F.col("n")
    if_ = lambda c: F.when(c, n).otherwise(0)
    as_before = F.struct(
        F.lit("p").alias("kind"),
        base.alias("word"),
        if_(full).alias("a"),
        if_(~full & ~F.substring("word", -1, 1).isin(*(STOPS + CLOSE))).alias("b"),
        if_(full & (F.col("follow") == 1)).alias("c"),
        if_(full & (F.col("follow") == 2)).alias("d"),
    )
    as_after = F.struct(
        F.lit("s").alias("kind"),
        base.alias("word"),
        if_(F.col("place") == 1).alias("a"),
        if_(F.col("place") == 2).alias("b"),
        if_((F.col("place") == 2) & is_small(F.substring(core, 1, 1))).alias("c"),
        F.lit(0).cast("long").alias("d"),
    )
    none = (F.lit(0).cast("long").alias(c) for c in "bcd")
    as_pair = F.struct(F.lit("c").alias("kind"), F.concat(base, F.lit(" "), based(F.col("next"))).alias("word"), n.alias("a"), *none)
    rows = kinds.select("lang", F.explode(F.array(as_before, as_after, as_pair)).alias("r")).select("lang", "r.*").where("word <> ''")
    sums = rows.groupBy("lang", "kind", "word").agg(*(F.sum(c).alias(c) for c in "abcd"))
    both = F.explode(F.array_distinct(F.array("lang", F.lit(POOLED)))).alias("lang")
    sums = sums.select(both, "kind", "word", *"abcd").groupBy("lang", "kind", "word").agg(*(F.sum(c).alias(c) for c in "abcd"))
    # totals of each language as word '' (the sums of all words, rare ones too)
    totals = sums.groupBy("lang", "kind").agg(*(F.sum(c).alias(c) for c in "abcd")).withColumn("word", F.lit(""))
    # a pair counts only where its first word stands with a period more often than without
    abbreviated = sums.where((F.col("kind") == "p") & (F.col("a") >= SEEN) & (F.col("a") > F.col("b"))).select("lang", F.col("word").alias("first"))
    pairs = sums.where((F.col("kind") == "c") & (F.col("a") >= SEEN)).withColumn("first", F.substring_index("word", " ", 1))
    pairs = pairs.join(abbreviated, ["lang", "first"], "left_semi").drop("first")
    kept = sums.where((F.col("kind") == "p") & (F.col("a") >= SEEN) | (F.col("kind") == "s") & (F.col("a") + F.col("b") >= SEEN))
    return kept.unionByName(pairs).unionByName(totals)


def _ratio(k1: float, n1: float, k2: float, n2: float) -> float:
    """The log-likelihood ratio of two shares, signed: positive if the first is larger."""

    def ll(k: float, n: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * log(p) + (n - k) * log(1 - p)

    if not n1 or not n2:
        return 0.0
    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    value = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
    return value if p1 >= p2 else -value


class Language:
    """What the counts of one language say about words."""

    def __init__(self, before: dict[str, tuple], after: dict[str, tuple], pairs: dict[str, tuple] | None = None):
        self.before, self.after, self.pairs = before, after, pairs or {}
        self.total, self.opening = before.get("", (0, 0, 0, 0)), after.get("", (0, 0, 0, 0))
        self.never_final = lru_cache(100_000)(self._never_final)
        self.abbreviation = lru_cache(100_000)(self._abbreviation)
        self.starter = lru_cache(100_000)(self._starter)

    def collocation(self, word: str, following: str) -> bool:
        """Whether the two belong together across a period: the first hardly stands without one and hardly ends paragraphs,
        the second follows it more often than chance would have it, and isn't known to start sentences."""
        together = self.pairs.get(f"{word} {following}")
        if together is None:
            return False
        a, b, _, _ = self.before.get(word, (0, 0, 0, 0))
        if a <= b or self.often_final(word) or self.starter(following):
            return False
        n, (opens, inside, _, _) = sum(self.opening[:2]), self.after.get(following, (0, 0, 0, 0))
        return _ratio(together[0], a, max(opens + inside - together[0], 0), max(n - a, 1)) >= RATIO

    def _never_final(self, word: str) -> bool:
        a, _, c, d = self.before.get(word, (0, 0, 0, 0))
        if a < SEEN:
            return False
        ends = self.total[2]
        if not c and ends * 50 < self.total[0]:
            return True  # periods hardly ever end paragraphs here
        return c * 8 <= a * ends / max(self.total[0], 1) and (_ratio(c, a, ends - c, self.total[0] - a) <= -RATIO or d * 2 > a)

    def often_final(self, word: str) -> bool:
        """Whether a word's period ends paragraphs at a quarter of the usual rate or more."""
        a, _, c, _ = self.before.get(word, (0, 0, 0, 0))
        return c > 0 and 4 * c * self.total[0] >= a * self.total[2]

    def _abbreviation(self, word: str) -> bool:
        if re.fullmatch(r"[^\W\d_]", word) or re.fullmatch(r"(?:[^\W\d_]{1,4}\.)+[^\W\d_]{1,4}", word):
            return True
        a, b, _, d = self.before.get(word, (0, 0, 0, 0))
        if a < SEEN:
            return False
        n, periods = self.total[0] + self.total[1], self.total[0]
        p = periods / max(n, 1)
        value = -2 * (a * log(max(p, 1e-12)) + b * log(max(1 - p, 1e-12)) - a * log(0.99) - b * log(0.01))
        letters, inner = len(word.replace(".", "")) or 1, word.count(".") + 1
        score = value * exp(-letters) * inner * letters ** -min(b, 300)
        return score >= ABBREVIATION and (d * 30 > a or self.never_final(word) or inner > 1) or self.never_final(word)

    def _starter(self, word: str) -> bool | None:
        """Whether a word with a capital starts sentences; None if it was hardly ever seen."""
        a, b, c, _ = self.after.get(word, (0, 0, 0, 0))
        if a + b < SEEN:
            return None
        if c >= SEEN and c * 2 > b:
            return True
        return a > 0 and _ratio(a, a + b, self.opening[0] - a, self.opening[0] + self.opening[1] - a - b) >= RATIO


NOTHING = Language({}, {})


def spans(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets that are closed, as (first, last) places, in order."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    closers: dict[str, int] = {}

    def close(sign: str, i: int) -> bool:
        if not closers.get(sign):
            return False
        while stack:
            want, start = stack.pop()
            closers[want] -= 1
            if want == sign:
                found.append((start, i))
                return True
        return False

    def push(want: str, i: int) -> None:
        stack.append((want, i))
        closers[want] = closers.get(want, 0) + 1

    for m in re.finditer(r"[\"'“„‘«‹「『(（\[【〈《”’»›」』)）\]】〉》]", text):
        c, i = m[0], m.start()
        left, right = text[i - 1 : i], text[i + 1 : i + 2]
        if c == '"':
            if not close('"', i):
                push('"', i)
        elif c == "'":
            if left.isalnum() and right.isalnum():
                continue
            if not (closers.get("'") and not left.isspace() and close("'", i)) and (not left or left.isspace() or left in "([") and right.isalnum():
                push("'", i)
        elif c == "“" and closers.get("“"):
            close("“", i)
        elif c in PAIRS:
            push(PAIRS[c], i)
        else:
            close(c, i)
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


OPENED = re.compile(rf"([{re.escape(OPEN)}]*)([^\s]*)")


def _first(text: str, i: int, end: int) -> tuple[str, str]:
    """Opening signs and the word that begin at i."""
    m = OPENED.match(text, i, end)
    return m[1], m[2]


STOP = re.compile(rf"[{STOPS}]+")
CLOSERS = re.compile(rf"(?:[^\S\n]?[»›]|[{re.escape(CLOSE)}])*")
SPACE = re.compile(r"\s*")
BETWEEN = re.compile(r"[\s\"'“„‘«‹「『(（\[【〈《¿¡/]")


def block_starts(text: str, a: int, b: int, lang: Language, unknown_opens: bool) -> list[int]:
    """Places in text[a:b] where sentences start, the first included."""
    starts = [a]
    part = text[a:b]
    inner = spans(part)
    #: where the words before stops may begin
    edges = [0, *(m.end() for m in BETWEEN.finditer(part))]
    k = 0
    i = 0
    while m := STOP.search(part, i):
        i = m.end()
        while k < len(inner) and inner[k][1] < m.start():
            k += 1
        end = m.end()
        opened_first = False
        inside = k < len(inner) and inner[k][0] < m.start() < inner[k][1]
        # closing signs right behind the stop, with spaces before » as in French
        tail = CLOSERS.match(part, end).end()
        if inside:
            last = inner[k][1]
            if last >= tail or not part[end : last + 1].strip():
                tail = max(tail, last + 1) if not part[end:last].strip() else tail
            if last + 1 > tail or part[end:last].strip(CLOSE + " "):
                continue
            opened_first = not part[starts[-1] - a : inner[k][0]].strip()
            tail = last + 1
        elif tail > end and k < len(inner) and end <= inner[k][0] < tail:
            tail = end
        if tail >= len(part):
            break
        wide = any(c in WIDE for c in m[0])
        gap = SPACE.match(part, tail).end()
        if gap >= len(part):
            break
        if wide:
            if inside and gap == tail:
                continue
            if not inside or gap > tail:
                starts.append(a + gap)
            i = max(i, gap)
            continue
        opens, word = _first(part, gap, len(part))
        head = word[:1]
        camel = bool(re.match(r"[^\W\d_]{1,2}[A-Z]", word))
        upper = head.isupper() or head.istitle() or camel and head.islower() or bool(opens.strip("\"'([（【「『“„‘«‹")) and not head.islower()
        before = part[max(starts[-1] - a, edges[bisect_right(edges, m.start()) - 1]) : m.start()]
        plain = m[0] == "."
        if gap == tail:
            # no space: only a word of some letters before a capital counts
            fine = tail == end and head.isupper() and word[1:2].islower() and re.search(r"[^\W\d_A-Z]{2}$|[)\]%\d]$", before[-2:])
            if not fine or plain and ("." in before or lang.never_final(before.lower())):
                continue
        if head.islower() and not camel:
            continue
        if plain and not inside:
            base = before.lower()
            number = bool(re.fullmatch(r"[\d.,:]+", before))
            following = re.sub(r"[^\w]+$", "", word.lower())
            following = NUMBER if re.fullmatch(r"[\d.,:%]+", word) else following
            if number:
                starts_here = lang.starter(following)
                if not (starts_here or starts_here is None and unknown_opens or bool(opens) or not head.isalpha()):
                    continue
            elif lang.never_final(base):
                continue
            elif lang.abbreviation(base):
                if not (lang.starter(following) or opens and not head.islower() or following == NUMBER and lang.often_final(base)):
                    continue
            elif lang.collocation(base, following):
                continue
            elif head.isalpha() and not upper and head.lower() == head.upper() and re.fullmatch(r"[^\W\d_]\.?|", before):
                continue
        starts.append(a + gap)
        i = max(i, gap)
    return starts


def starts(text: str, lang: Language = NOTHING, name: str | None = None) -> list[int]:
    """Where the sentences of a text start: first signs that are neither space nor bullet."""
    cuts: list[tuple[int, int]] = []
    at, n = 0, len(text)
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n\r]+", text)]
    for j, (a, b) in enumerate(lines):
        line = text[a:b]
        if not line.strip():
            continue
        gap = text[lines[j - 1][1] : a] if j else ""
        blank = not j or not text[lines[j - 1][0] : lines[j - 1][1]].strip() or len(gap.replace("\r\n", "\n").replace("\r", "\n")) > 1
        bullet = bool(BULLET.match(line))
        after_bullet = bool(cuts) and bool(BULLET.match(text[cuts[-1][0] : cuts[-1][1]])) and not blank
        ended = bool(cuts) and text[cuts[-1][0] : cuts[-1][1]].rstrip(CLOSE + " \t")[-1:] in STOPS + ":"
        if ended and not blank and (last := re.search(r"(\S+)\.\s*$", text[cuts[-1][0] : cuts[-1][1]])):
            ended = not lang.never_final(last[1].lower()) and not lang.abbreviation(last[1].lower())
        title = HEADING.match(line)
        heading = bool(title) and (blank or ended and not title["stop"])
        was_heading = bool(cuts) and not blank and len(cuts[-1]) == 2 and heading_at == cuts[-1][0]
        if cuts and not (blank or bullet or after_bullet or heading or was_heading):
            cuts[-1] = (cuts[-1][0], b)
        else:
            cuts.append((a, b))
            heading_at = a if heading else -1
    out: list[int] = []
    for a, b in cuts:
        m = BULLET.match(text, a, b)
        a = m.end() if m else a
        if THAI.search(text, a, b) or name == "th":
            out += thai(text, a, b)
        else:
            out += block_starts(text, a, b, lang, name != "de")
    clean = []
    for s in out:
        while s < n and (text[s].isspace() or text[s] in "•‣▪●○◦■□·​﻿"):
            s += 1
        if s < n:
            clean.append(s)
    return sorted(set(clean))


def thai(text: str, a: int, b: int) -> list[int]:
    """Spaces between phrases of at least four Thai letters each start sentences, as do other scripts' stops."""
    out, last = [a], a
    for m in re.finditer(r"\s+", text[a:b]):
        left, right = text[last : a + m.start()], text[a + m.end() : b].split(maxsplit=1)
        if right and len(THAI.findall(left)) >= 4 and THAI.match(right[0]) and len(THAI.findall(right[0])) >= 4:
            last = a + m.end()
            out.append(last)
    return out


def asked(text: str) -> set[str]:
    """The words and pairs of a text that a decision may ask for."""
    edges = [0, *(m.end() for m in BETWEEN.finditer(text))]
    out: set[str] = set()
    for m in STOP.finditer(text):
        tail = CLOSERS.match(text, m.end()).end()
        gap = SPACE.match(text, tail).end()
        _, word = _first(text, gap, len(text))
        if gap == tail and not word[:1].isupper():
            continue
        base = text[edges[bisect_right(edges, m.start()) - 1] : m.start()].lower()
        following = NUMBER if re.fullmatch(r"[\d.,:%]+", word) else re.sub(r"[^\w]+$", "", word.lower())
        out |= {base, following, f"{base} {following}"}
    out |= {m[1].lower() for m in re.finditer(r"(\S+)\.\s*$", text, re.M)}
    return out


class Learned:
    """The counts of all languages, from a broadcast list, or as read for the words at hand from the shared folder."""

    def __init__(self, rows: list[tuple] | None, path: str):
        self.rows, self.path = rows, path
        self.languages: dict[str, Language] = {}

    def of(self, name: str | None) -> Language:
        name = POOLED if name is None else name
        if name not in self.languages:
            self._keep(name, [r[1:] for r in self.rows or () if r[0] == name])
        return self.languages[name]

    def _keep(self, name: str, mine: list[tuple]) -> None:
        sides = {k: {w: tuple(v) for kind, w, *v in mine if kind == k} for k in "psc"}
        self.languages[name] = Language(sides["p"], sides["s"], sides["c"])

    def ahead(self, texts: Iterable[tuple[str | None, str | None]]) -> None:
        """Gets what a batch of (lang, text) needs, in place of what the last one needed."""
        if self.rows is not None:
            return
        import pyarrow.dataset as ds
        from pyarrow import fs

        needed: dict[str, set[str]] = {}
        for name, text in texts:
            if text:
                needed.setdefault(POOLED if name is None else name, {""}).update(asked(text))
        system, at = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        table = ds.dataset(at, filesystem=system)
        self.languages = {}
        for name, words in needed.items():
            got = table.to_table(filter=(ds.field("lang") == name) & ds.field("word").isin(sorted(words)))
            self._keep(name, list(zip(*(got.column(c).to_pylist() for c in ("kind", "word", "a", "b", "c", "d")))))


def learn(texts: DataFrame) -> Callable[[], Learned]:
    """Counts over texts(lang, text); a function that gives a worker its copy.

    They go through the shared folder. Where they are few they are broadcast and the folder is removed; else they stay
    there, sorted by word, for the workers to read from, as long as the result is in use.
    """
    spark = texts.sparkSession
    path = f"{shared_dir(spark)}/sentence-counts-{uuid.uuid4().hex}"
    counts(texts).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    rows = None
    if table.count() <= BROADCAST_WORDS:
        rows = [tuple(r) for r in table.select("lang", "kind", "word", "a", "b", "c", "d").collect()]
    else:
        table.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").write.parquet(f"{path}-sorted")
    remove(spark, path)
    shared = spark.sparkContext.broadcast((rows, f"{path}-sorted"))
    return lambda: Learned(*shared.value)


SCHEMA = "item_id long, field string, lang string, start_at long, end_at long"


def split(texts: DataFrame, learned: Callable[[], Learned]) -> DataFrame:
    """item_id, field, lang, start_at, end_at of every sentence of texts(item_id, field, lang, text)."""

    def make():
        known = learned()

        def rows(key, field, name, text):
            if not text or not text.strip():
                return
            at = starts(text, known.of(name), name)
            for a, b in zip(at, [*at[1:], len(text)]):
                yield key, field, name, a, a + len(re.sub(r"\s*(?:\n\s*[•‣▪●○◦■□*·–—-]\s*)?$", "", text[a:b]))

        rows.ahead = lambda given: known.ahead((name, text) for _, _, name, text in given)
        return rows

    return flat_map(texts, [F.col("item_id").cast("long"), "field", "lang", "text"], make, SCHEMA)
