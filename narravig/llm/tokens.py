"""Token ids of whole texts by a public byte-level BPE vocabulary, exact and in linear time.

A piece is encoded by walking over it with the longest token that matches at each place. An Aho-Corasick automaton over
all tokens, spelled backwards, finds these for all places in one run over the piece, read backwards; each token also knows
the longest token that is its own prefix. A token may only follow another if merging would keep the two apart, which a table of pairs decides; where it may not, the encoder goes back to a shorter token.
Places found to be dead ends are marked, so no place is tried twice. Merges made this way equal those of the
rank-by-rank rule. Decoding cuts the tokens out of one byte string by a table of offsets.

Defined results: null and empty texts give an empty list; other texts, blank ones too, give the ids of all their bytes;
strings of special tokens are ordinary text; equal rows are equal; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import os

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files lie, unless the session names another folder.
FOLDER, CONF = "/opt/tokenizers", "spark.narravig.tokenizers"
FILE = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids are kept, per worker; a piece is at most CACHED_BYTES long.
CACHE, CACHED_BYTES = 200_000, 64


class Encoder:
    """Tables of one vocabulary, given as the bytes of its rank file."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        by_id = {int(n): base64.b64decode(token) for token, n in pairs}
        assert sorted(by_id) == list(range(len(by_id)))
        tokens = [by_id[n] for n in range(len(by_id))]
        self.offsets, at = [0], 0
        for token in tokens:
            at += len(token)
            self.offsets.append(at)
        self.bytes = b"".join(tokens)
        #: Keys are latin-1 strings: one character a byte.
        self.ids = {token.decode("latin-1"): n for n, token in enumerate(tokens)}
        self.length = [len(token) for token in tokens]
        self.shorter = [self._prefix(token.decode("latin-1")) for token in tokens]
        self.automaton = ahocorasick.Automaton()
        for token, n in self.ids.items():
            self.automaton.add_word(token[::-1], n)
        self.automaton.make_automaton()
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for n, token in enumerate(tokens):
            text, a = token.decode("latin-1"), self.shorter[n]
            while a >= 0:
                b = self.ids.get(text[self.length[a] :], -1)
                if 0 <= b < n and a < n and self.stay_apart(a, b):
                    self.merged[a, b] = n
                    self.left[n], self.right[n] = a, b
                    break
                a = self.shorter[a]
        self.cache: dict[str, list[int]] = {}
        self.pattern = regex.compile(PATTERN)

    def _prefix(self, token: str) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        return next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)

    def longest(self, text: str) -> list[int]:
        """For each place of a piece the longest token that starts there."""
        out, last = [-1] * len(text), len(text) - 1
        # of the tokens that end at a place the automaton gives the longest first
        for end, n in self.automaton.iter(text[::-1]):
            if out[last - end] < 0:
                out[last - end] = n
        return out

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between tokens a and b: no merge across it comes before theirs."""
        limit = 1 << 62
        merged, left, right = self.merged, self.left, self.right
        while True:
            joint = merged.get((a, b))
            if joint is not None and joint < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def piece(self, text: str) -> list[int]:
        """The ids of one piece, given as latin-1 characters."""
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n, at = len(text), 0
        dead = bytearray(n + 1)
        out: list[int] = []
        at_place = self.longest(text)
        token = at_place[0]
        length, shorter, apart = self.length, self.shorter, self.stay_apart
        while True:
            end = at + length[token]
            if not dead[end] and (not out or apart(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = at_place[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.pattern.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece.encode().decode("latin-1"))
                if len(piece) <= CACHED_BYTES and len(cache) < CACHE:
                    cache[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[self.offsets[n] : self.offsets[n + 1]] for n in ids).decode(errors="replace")


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(ranks: bytes) -> Encoder:
    """The encoder of this process, built once."""
    key = hash(ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def rank_file(spark: SparkSession, file: str = FILE, folder: str | None = None) -> bytes:
    """The vocabulary's bytes (under 1 MB, fixed by the vocabulary), read on the driver and broadcast."""
    folder = folder or spark.conf.get(CONF, FOLDER)
    with open(os.path.join(folder, file), "rb") as f:
        return f.read()


def encode(df: DataFrame, key: str, text: str, folder: str | None = None, lengths_only: bool = False) -> DataFrame:
    """key and ids (array of int) of each text; with ``lengths_only`` key and n_tokens instead."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(df.sparkSession, folder=folder))
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ("n_tokens long" if lengths_only else "ids array<int>")

    def run(batches):
        encoder = worker_encoder(ranks.value)
        for b in batches:
            # a few texts at a time, so that a batch of long ones doesn't pile up
            step = max(1, int(b.num_rows * 4_000_000 / max(b.nbytes, 1)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                values = pa.array([len(x) for x in ids], pa.int64()) if lengths_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=[key, "n_tokens" if lengths_only else "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
