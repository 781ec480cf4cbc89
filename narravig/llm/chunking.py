"""Cutting oversized texts into overlapping pieces at natural boundaries.

Boundaries are graded: paragraph, line, sentence, clause, word, and, where none of these occurs for long, any place
that isn't inside a character cluster. Dynamic programming over all of them finds the cuts with the least sum of cut
penalties and squared deviation of the pieces' sizes from their common target, subject to the limit. The overlap before a
cut starts at the best boundary near the wanted distance.

Defined results: texts that are null or within the limit give no row; pieces in order cover the text without gaps, and
without their overlaps give it back exactly; an overlap of half the limit or more is reduced to just under half; equal
texts are cut equally; repeated rows are reported once; sizes are code points; other columns aren't looked at.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravig.functions.arrowmap import flat_map

CLOSERS = "\"'”’»）)\\]」』】"
GRADES = (
    (0.0, re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*")),
    (1.0, re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*")),
    (2.0, re.compile(rf"[.!?…।॥]+[{CLOSERS}]*\s+|[。！？]+[{CLOSERS}]*\s*")),
    (6.0, re.compile(rf"[;:,—–][{CLOSERS}]*\s+|[，、；：]\s*")),
    (12.0, re.compile(r"\s+")),
    (12.0, re.compile(r"-(?<=[^\W\d_]-)(?=[^\W\d_])")),
)
HARD = 60.0
IMBALANCE = 40.0
#: Boundaries whose overlaps are looked for together.
ROWS = 4096


def inside_cluster(text: str, i: int) -> bool:
    """Whether a cut at i would part a base from its marks, a joined sequence or a line end."""
    c, before = text[i], text[i - 1]
    return (
        unicodedata.category(c) in ("Mn", "Me", "Mc")
        or "‍" in (c, before)
        or "︀" <= c <= "️"
        or "\U0001f3fb" <= c <= "\U0001f3ff"
        or before == "\r" and c == "\n"
    )


def boundaries(text: str, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may start, in order from 0 to the text's length, with their penalties.

    All natural boundaries of every grade are places, each with the least of its penalties. In a stretch without any
    that is longer than ``grid``, every ``grid``-th code point is one too, moved back out of a character cluster.
    """
    ends = [[0, len(text)]] + [[m.end() for m in pattern.finditer(text)] for _, pattern in GRADES]
    grades = np.repeat([0.0, *(penalty for penalty, _ in GRADES)], [len(e) for e in ends])
    # of a place that several grades name, the first stands
    at, which = np.unique(np.array(sum(ends, [])), return_index=True)
    hard = []
    for k in np.flatnonzero(np.diff(at) > grid):
        a, b = int(at[k]), int(at[k + 1])
        for i in range(a + grid, b, grid):
            j = i
            while j > a + 1 and i - j < grid - 1 and inside_cluster(text, j):
                j -= 1
            hard.append(j)
    places = np.concatenate([at, np.array(hard, dtype=at.dtype)])
    order = np.argsort(places, kind="stable")
    return places[order], np.concatenate([grades[which], np.full(len(hard), HARD)])[order]


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text longer than ``most``.

    The cheapest row of cuts over all boundaries, where each piece adds between ``most // 8`` and ``most`` code points. As
    no piece ends within ``most // 8`` of where it begins, the boundaries of such a stretch are worked out together.
    """
    n = len(text)
    least = max(1, most // 8)
    overlap = max(0, min(overlap, (most - 1) // 2))
    at, penalty = boundaries(text, max(1, most // 50))
    # where the piece that follows a cut starts: the best boundary near the wanted overlap
    starts = at.copy()
    if overlap:
        low = np.searchsorted(at, at - overlap * 1.25)
        high = np.minimum(np.searchsorted(at, at - overlap * 0.75, side="right"), np.arange(len(at)))
        for a in range(1, len(at), ROWS):
            rows = np.arange(a, min(a + ROWS, len(at)))
            near = low[rows, None] + np.arange(max(1, int((high - low)[rows].max())))
            far = near >= high[rows, None]
            near = np.minimum(near, len(at) - 1)
            cost = np.where(far, np.inf, penalty[near] + 20 * np.abs(at[near] - (at[rows, None] - overlap)) / overlap)
            starts[rows] = at[near[np.arange(len(rows)), cost.argmin(1)]]
        for j in np.flatnonzero(high[1:] <= low[1:]) + 1:
            i = max(0, int(at[j]) - overlap)
            while i > max(0, int(at[j]) - overlap * 5 // 4) + 1 and inside_cluster(text, i):
                i -= 1
            starts[j] = i
    pieces = max(2, -(-(n - overlap) // (most - overlap)))
    target = overlap + (n - overlap) / pieces
    cost, back = np.full(len(at), np.inf), np.zeros(len(at), dtype=int)
    cost[0] = 0.0
    first = np.searchsorted(at, at - most)
    last = np.searchsorted(at, at - least, side="right")
    j = 1
    while j < len(at):
        # a block of ends whose last possible beginnings all lie before it; rows are ends, columns beginnings
        end = max(j + 1, int(np.searchsorted(at, at[j] + least - 1, side="right")))
        a, b = int(first[j]), int(last[end - 1])
        if b > a:
            size = at[j:end, None] - starts[None, a:b]
            total = cost[None, a:b] + IMBALANCE * ((size - target) / target) ** 2
            total[(size > most) | (at[j:end, None] - at[None, a:b] < least)] = np.inf
            best = total.argmin(1)
            cost[j:end] = total[np.arange(end - j), best] + penalty[j:end]
            back[j:end] = a + best
        j = end
    assert np.isfinite(cost[-1]), "no cuts keep the limit"
    out, j = [], len(at) - 1
    while j:
        i = int(back[j])
        out.append((int(starts[i]), int(at[j])))
        j = i
    return out[::-1]


SCHEMA = "field string, item_id long, pos long, piece long, start_at long, end_at long, text string"


def split(texts: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Pieces of texts(field, item_id, pos, text) that are longer than ``limits[field]``: (max_size, overlap_size)."""
    over = F.lit(False)
    for field, (most, _) in limits.items():
        over = over | ((F.col("field") == field) & (F.length("text") > most))

    def make():
        def rows(field, key, pos, text):
            for k, (a, b) in enumerate(cuts(text, *limits[field])):
                yield field, key, pos, k, a, b, text[a:b]

        return rows

    cols = ["field", F.col("item_id").cast("long"), F.col("pos").cast("long"), "text"]
    return flat_map(texts.where(over), cols, make, SCHEMA)
