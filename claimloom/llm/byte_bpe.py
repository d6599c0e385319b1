"""Byte-level BPE encoding of a whole corpus with a public tokenizer.

The bytes of a piece become Latin-1 characters; one Aho-Corasick automaton over all tokens lists the tokens that start
at each place. The encoder takes the longest, keeps it while it is compatible with the token before it, and otherwise
tries shorter ones or steps back over a place now known to be dead, so each place is given up once: linear time. Two
adjacent tokens are compatible when merging their bytes by rank leaves the border between them; that answer is kept.
The result is exactly that of applying the merges by rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files are; never copied into this repository.
FOLDER = "/opt/tokenizers"
# Fixed value: how the public 50k byte-level vocabularies part a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept of each memo of a worker; a full memo is emptied.
MEMO = 400_000


class Encoder:
    """Encodes texts by the ranks of a vocabulary file with lines `base64 rank`."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import ahocorasick
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                a, b = self._halves(token, rank, ranks)
                self.split[rank] = a, b
                self.merged[a, b] = rank
        auto = ahocorasick.Automaton()
        for token, rank in ranks.items():
            auto.add_word(token.decode("latin-1"), (rank, len(token)))
        auto.make_automaton()
        self.auto, self.find = auto, regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens whose merge makes `token`."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether `a` and `b` can stand side by side in an encoding: no earlier merge crosses their border.

        The merges that made both tokens are undone, latest first; a merge across the border that would have come
        before the one just undone forbids the pair.
        """
        key = a, b
        known = self.pairs.get(key)
        if known is not None:
            return known
        before = len(self.bytes_of) + 1
        answer = True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                answer = False
                break
            left, right = self.split.get(a), self.split.get(b)
            if left is None and right is None:
                break
            # the token made last is taken apart; of two equal ones the right one, since merging goes from the left
            if right is None or left is not None and a > b:
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def piece(self, text: str) -> list[int]:
        """The tokens of one piece."""
        raw = text.encode("utf-8").decode("latin-1")
        n = len(raw)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (rank, size) in self.auto.iter(raw):
            starts[end + 1 - size].append((rank, size))  # by growing size: pop() takes the longest left
        out: list[tuple[int, int]] = []
        dead = bytearray(n + 1)
        tried: list[int] = []  # how many of a start's tokens are still open, for each token of `out`
        at, left = 0, len(starts[0]) if n else 0
        while at < n:
            options = starts[at]
            while left:
                left -= 1
                rank, size = options[left]
                if not dead[at + size] and (not out or self.compatible(out[-1][0], rank)):
                    out.append((rank, size))
                    tried.append(left)
                    at += size
                    left = len(starts[at]) if at < n else 0
                    break
            else:
                dead[at] = 1
                at -= out.pop()[1]
                left = tried.pop()
        return [rank for rank, _ in out]

    def text(self, text: str, out: list[int]) -> None:
        """Appends the tokens of a text to `out`."""
        known = self.pieces
        for p in self.find(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(known) >= MEMO:
                        known.clear()
                    known[p] = ids
            out += ids


class _Held:
    """A vocabulary in a broadcast; a worker builds its encoder once and keeps it."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.vocabulary, self.pattern, self.built = vocabulary, pattern, None

    def encoder(self) -> Encoder:
        if self.built is None:
            self.built = Encoder(self.vocabulary, self.pattern)
        return self.built


def encode(df: DataFrame, identifier: str, text: str, path: str = f"{FOLDER}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """(identifier, ids): the token ids of every row's text, without special tokens.

    An empty or null text has the empty list. Strings of special tokens in a text are ordinary text. Repeated rows come
    out repeated; other columns take no part. The vocabulary file is read by the driver and broadcast: a megabyte or so.
    """
    held = df.sparkSession.sparkContext.broadcast(_Held(Path(path).read_bytes(), pattern))
    got = df.select(identifier, text)
    kind = dict(got.dtypes)[identifier]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held.value.encoder()
        for b in batches:
            step = 512
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                flat: list[int] = []
                ends = [0]
                for t in part.column(1).to_pylist():
                    if t:
                        enc.text(t, flat)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [identifier, "ids"])

    return got.mapInArrow(run, f"`{identifier}` {kind}, ids array<int>")
