"""Passages of held-out test items inside a training corpus.

One Aho-Corasick automaton holds every run of twelve words of the normalised test questions and answers. To keep it
small, a word is one character: test words get private-use characters, any other word a character that no pattern has.
A document is read once; each hit is mapped back to its place in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Consecutive words that make a leak.
RUN = 12
#: Words of the test items in one automaton, about. More are handled in further blocks, each over the whole corpus, so that the
#: memory of workers and driver is bounded; the driver holds one block at a time.
BLOCK_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")
_FIRST, _OTHER = 0x10000, "\x01"
_ROOM = 0x110000 - _FIRST - 2  # characters there are for words


class Passages:
    """The automaton over (item, part, text) rows."""

    def __init__(self, items: list[tuple[int, str, str | None]], run: int = RUN):
        import ahocorasick

        self.code: dict[str, str] = {}
        owners: dict[str, set[tuple[int, str]]] = {}
        for item, part, text in items:
            chars = []
            for w in _WORD.findall((text or "").lower()):
                if w not in self.code:
                    if len(self.code) >= _ROOM:  # a million different words in one block
                        raise ValueError("too many words for one automaton; use a smaller block_words")
                    self.code[w] = chr(_FIRST + len(self.code))
                chars.append(self.code[w])
            for k in range(len(chars) - run + 1):
                owners.setdefault("".join(chars[k:k + run]), set()).add((item, part))
        self.run, self.size = run, len(owners)
        self.auto = ahocorasick.Automaton()
        for p, who in owners.items():
            self.auto.add_word(p, tuple(sorted(who)))
        if owners:
            self.auto.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, str, int, int]]:
        """(item, part, start, end): each longest passage of the text, in characters of the original text."""
        if not text or not self.size:
            return []
        get, places, chars = self.code.get, [], []
        low = text.lower()
        at = None if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]  # a letter may become two
        for m in _WORD.finditer(low):
            a, b = m.span()
            places.append((a, b) if at is None else (at[a], at[b - 1] + 1))
            chars.append(get(m.group(), _OTHER))
        if len(chars) < self.run:
            return []
        open_: dict[tuple[int, str], list[int]] = {}
        out = []
        for end, who in self.auto.iter("".join(chars)):
            start = end - self.run + 1
            for w in who:
                had = open_.get(w)
                if had is not None and start <= had[1] + 1:
                    had[1] = end
                else:
                    if had is not None:
                        out.append((*w, places[had[0]][0], places[had[1]][1]))
                    open_[w] = [start, end]
        out += [(*w, places[a][0], places[b][1]) for w, (a, b) in open_.items()]
        return sorted(out)

    def items(self, text: str | None, part: str = "text") -> set[int]:
        """The items of which the text holds a passage; places are not kept."""
        if not text or not self.size:
            return set()
        get = self.code.get
        chars = "".join([get(w, _OTHER) for w in _WORD.findall(text.lower())])
        return {i for _, who in self.auto.iter(chars) for i, p in who if p == part}


class _Held:
    """Rows of items in a broadcast; a worker builds their automaton once and keeps it."""

    def __init__(self, rows: list[tuple[int, str, str | None]], run: int):
        self.rows, self.run, self.built = rows, run, None

    def passages(self) -> Passages:
        if self.built is None:
            self.built = Passages(self.rows, self.run)
        return self.built


def _scan(documents: DataFrame, items: DataFrame, run: int, block_words: int, hits, schema: str) -> DataFrame:
    """(doc_id, ...) of `hits` (automaton, text) over all documents and all blocks of items; null texts and items without an id are left out."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = items.select(F.col("item_id").cast("long").alias("i"), F.explode(F.array(
        F.struct(F.lit("text").alias("p"), F.col("text").alias("t")), F.struct(F.lit("answer").alias("p"), F.col("answer").alias("t")))).alias("s"))
    rows = rows.select("i", "s.p", "s.t").where("i is not null and t is not null and trim(t) != ''")
    words = rows.agg(F.sum(F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    parts = max(1, -(-words // block_words))
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() if x.split()[1] == "long" else pa.int32() for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]
    out = None
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64("i", "p"), F.lit(parts)) == k) if parts > 1 else rows
        held = docs.sparkSession.sparkContext.broadcast(_Held([(r.i, r.p, r.t) for r in block.collect()], run))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            auto = held.value.passages()
            for b in batches:
                got = [(d, *h) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for h in hits(auto, t)]
                cols = list(zip(*got, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        part = docs.mapInArrow(scan, schema)
        part = part if parts == 1 else cut(part)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id): each document that holds at least `run` consecutive words of the item's text.

    Words are runs of letters and digits; case, punctuation and white space do not matter. Null and empty texts and
    items of fewer words match nothing. A repeated document comes out once for each row.
    """
    return _scan(documents, items, run, block_words, lambda auto, t: [(i,) for i in sorted(auto.items(t))], "doc_id long, item_id long")


def leak_spans(documents: DataFrame, items: DataFrame, run: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, part, start, end): every leaked passage with its place in the original text, answers included."""
    return _scan(documents, items, run, block_words, lambda auto, t: auto.spans(t), "doc_id long, item_id long, part string, start int, end int")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, benchmark, documents): every test item with the number of documents that leak it; 0 where none does."""
    hits = leaked_items(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
    return items.select(F.col("item_id").cast("long").alias("item_id"), "benchmark").join(hits, "item_id", "left").na.fill({"documents": 0})
