"""Same and nearly same texts across data splits: a weighted cosine join between two sides.

Texts are compared as vectors of weighted terms, a term being a word and the number of its occurrence, its squared weight
between 1 and 2, growing with rarity. Two texts are linked when the words to insert, delete or replace are at most an
eighth of the longer one's words. So at most k = floor(n / 8) of a text's n terms may be missing in its partner, and the
dot product is at least `need`: the squared norm less the k heaviest squared weights.

* Terms stand by falling weight. What is left of a vector after its first k terms, its residual norm, is below `need`, so
  partners share one of the first k + 1 terms, two of the first k + 2, four of the first k + 4: only these enter the
  inverted lists. A list is keyed by two of them, or by four where the first one is in many texts, so that no list of a
  frequent term is walked.
* An entry of a list holds the text's number and length, its `need`, and the most that its dot product with any text can
  be whose first common terms are those of the list: the norm without the terms passed over. Two entries make a candidate
  only if both of these bounds reach the larger of both needs (maximum weights: of each term no partner holds more).
* Candidates are pairs of numbers; texts are fetched once for each, dot products are then exact, and last comes the word
  edit distance.

Nothing is lost by the pruning. Equal texts meet once, as one class: only distinct texts enter the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: A pair counts when edits * PART <= words of the longer text.
PART = 8
#: Term frequencies are kept by hash bucket: a table of fixed size at any corpus size. It orders terms and weighs them;
#: a collision makes a term look more frequent and never loses a pair.
BUCKETS = 1 << 18
#: Up to so many words the lists are keyed by several terms, from LONG - LONG / 8 on by one term as well (the zone between has both).
LONG = 64
#: Terms of a list's key, and where its first term is in more than HOT texts.
KEY, HOT_KEY, HOT = 2, 4, 2_000

_WORD = r"[\p{L}\p{M}]+|\p{Nd}+(?:[^\p{L}\p{M}\p{Nd}\s\p{Z}]\p{Nd}+)*"


def words(c: Column) -> Column:
    """Runs of letters, or numbers with the marks between their digits; without case and apostrophes."""
    bare = F.regexp_replace(F.lower(c), "['‘’ʼ‛`´＇]", "")
    return F.regexp_extract_all(bare, F.lit(_WORD), F.lit(0))


def text_rows(df: DataFrame, name: str, identifier: str, text: str, side: str, *more: str) -> DataFrame:
    """(side, tbl, id, text, k1, k2, more...): `text` is the words parted by blanks, k1 and k2 its 128-bit key.

    Rows without any word, null and blank ones among them, are left out.
    """
    got = df.select(F.lit(side).alias("side"), F.lit(name).alias("tbl"), F.col(identifier).cast("string").alias("id"), F.array_join(words(F.col(text)), " ").alias("text"), *more)
    return got.where("text != ''").withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _hashes(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many distinct texts hold a word of each hash bucket; BUCKETS numbers, whatever the corpus."""
    b = texts.select(F.explode(F.array_distinct(F.transform(F.split("text", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))).alias("b"))
    got = b.groupBy("b").count().toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["b"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    return out


def _squared(counts: np.ndarray, total: int) -> np.ndarray:
    """The squared weight of a term by its bucket, 1 to 2."""
    return 1.0 + np.log(max(total, 2) / np.clip(counts, 1, None)).clip(0) / np.log(max(total, 2))


def _terms(flat: np.ndarray, row: np.ndarray) -> np.ndarray:
    """64-bit terms: the hash of a word mixed with the number of its occurrence in the text."""
    order = np.lexsort((flat, row))
    f, r = flat[order], row[order]
    new = np.r_[True, (f[1:] != f[:-1]) | (r[1:] != r[:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))
    occ = np.empty(len(f), np.uint64)
    occ[order] = (np.arange(len(f)) - start).astype(np.uint64)
    return (flat.view(np.uint64) ^ (occ * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + b.view(np.uint64)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, row of each value) of a list column."""
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(np.int64)
    off = off - off[0]
    return flat, off, np.repeat(np.arange(len(off) - 1), np.diff(off))


def _postings(counts: np.ndarray, total: int, hot_df: int = HOT):
    """For mapInArrow over (no, hashes): an entry for each list that a text stands in."""
    squared = _squared(counts, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off, row = _flat(batch.column("hashes"))
            if not len(flat):
                continue
            n = np.diff(off)
            term, bucket = _terms(flat, row), np.mod(flat, BUCKETS)
            order = np.lexsort((term, counts[bucket], row))
            term, df, w = term[order], counts[bucket][order], squared[bucket][order]
            before = np.r_[0.0, np.cumsum(w)]  # weight of all terms before a place
            start = off[:-1]
            norm = before[off[1:]] - before[start]
            k = n // PART
            need = norm - (before[start + k] - before[start])
            feature, rows, bound = [], [], []

            def lists(ok: np.ndarray, places: tuple[int, ...]) -> None:
                at = start[ok]
                key = np.full(len(ok), len(places), np.int64)
                for p in places:
                    key = _mix(key, term[at + p])
                feature.append(key)
                rows.append(ok)
                shared = sum(w[at + p] for p in places[:-1]) if len(places) > 1 else 0.0
                bound.append(norm[ok] - (before[at + places[-1]] - before[at] - shared))

            some, hot = n < LONG, df > hot_df
            most = int(k[some].max()) if some.any() else -1
            for i in range(most + 1):
                ok = np.nonzero(some & (k >= i))[0]
                first = hot[start[ok] + i]
                for size, part in ((KEY, ok[~first]), (HOT_KEY, ok[first])):
                    # the r-th common term, counted from 0, stands at place k + r at the most
                    for rest in combinations(range(i + 1, (int(k[part].max()) if len(part) else -1) + size), size - 1):
                        if all(p <= most + r for r, p in enumerate(rest, 1)):
                            lists(part[np.all([k[part] + r >= p for r, p in enumerate(rest, 1)], 0)], (i, *rest))
            one = np.nonzero(n >= LONG - LONG // PART)[0]
            for i in range(int(k[one].max()) + 1 if len(one) else 0):
                lists(one[k[one] >= i], (i,))
            r = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(feature)), batch.column("no").take(pa.array(r)), pa.array(n[r].astype(np.int32)), pa.array(need[r].astype(np.float32)), pa.array(np.concatenate(bound).astype(np.float32))],
                ["feature", "no", "n", "need", "bound"])

    return run


def edits_within(a: list[str], b: list[str], most: int) -> bool:
    """Whether `most` insertions, deletions and replacements of words turn `a` into `b`."""
    if abs(len(a) - len(b)) > most:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b)) <= most
    far = most + 1
    old = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = i if i <= most else far
        best = new[0]
        for j in range(lo, hi + 1):
            c = old[j - 1] if x == b[j - 1] else 1 + min(old[j - 1], old[j], new[j - 1])
            new[j] = c
            best = min(best, c)
        if best > most:
            return False
        old = new
    return old[-1] <= most


def _verify(counts: np.ndarray, total: int):
    """For mapInArrow over the columns of PAIR, texts and their hashes: the pairs that hold, with their cosine."""
    squared = _squared(counts, total)

    def vectors(col: pa.ListArray):
        flat, off, row = _flat(col)
        w = squared[np.mod(flat, BUCKETS)]
        order = np.lexsort((-w, row))
        pos = np.arange(len(w)) - off[:-1][row]
        norm = np.bincount(row, w, len(off) - 1)
        heavy = np.where(pos < (np.diff(off) // PART)[row], w[order], 0.0)
        return _terms(flat, row), row, w, norm, norm - np.bincount(row, heavy, len(norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            te, re_, we, norm_e, need_e = vectors(batch.column("e_hashes"))
            tt, rt, wt, norm_t, need_t = vectors(batch.column("t_hashes"))
            term, row, w = np.r_[te, tt], np.r_[re_, rt], np.r_[we, wt]
            order = np.lexsort((term, row))
            s, r = term[order], row[order]
            same = np.nonzero((s[1:] == s[:-1]) & (r[1:] == r[:-1]))[0]
            dot = np.bincount(r[same], w[order][same], batch.num_rows)
            ok = np.nonzero(dot >= np.maximum(need_e, need_t) - 1e-9)[0]
            e, t = batch.column("e_text").take(pa.array(ok)).to_pylist(), batch.column("t_text").take(pa.array(ok)).to_pylist()
            good = []
            for i, a, b in zip(ok.tolist(), e, t, strict=True):
                x, y = a.split(" "), b.split(" ")
                if edits_within(x, y, max(len(x), len(y)) // PART):
                    good.append(i)
            i = np.array(good, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(i)) for c in PAIR], pa.array(dot[i] / np.sqrt(norm_e[i] * norm_t[i]))], [*PAIR, "cosine"])

    return run


PAIR = ("e_k1", "e_k2", "t_k1", "t_k2")


def links(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(e_k1, e_k2, t_k1, t_k2, cosine): every linked pair of distinct texts of side 'e' and side 't', by their keys, equal texts included.

    `rows` is made of `text_rows` of both sides and should be materialised (`cut`), since it is read several times.
    """
    is_ = lambda side: F.max((F.col("side") == side).cast("int"))
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), is_("e").alias("e"), is_("t").alias("t"))
    texts = cut(texts.withColumn("no", F.monotonically_increasing_id()))
    counts, total = bucket_counts(texts), texts.count()

    def entries(p: str) -> DataFrame:
        own = texts.where(F.col(p) == 1).select("no", _hashes(F.col("text")).alias("hashes")).where(F.size("hashes") >= PART - 1)
        got = spread(own).mapInArrow(_postings(counts, total, hot), "feature long, no long, n int, need float, bound float")
        return got.select("feature", *[F.col(c).alias(f"{p}_{c}") for c in ("no", "n", "need", "bound")])

    both = entries("e").join(entries("t"), "feature")
    near = both.where(f"""e_no != t_no and abs(e_n - t_n) <= greatest(e_n, t_n) div {PART}
        and least(e_bound, t_bound) >= greatest(e_need, t_need) - 0.0001D""").select("e_no", "t_no").distinct()  # a pair meets in several lists
    full = lambda p: texts.where(F.col(p) == 1).select(*[F.col(c).alias(f"{p}_{c}") for c in ("no", "k1", "k2", "text")])
    met = near.join(full("e"), "e_no").join(full("t"), "t_no").select(*PAIR, "e_text", "t_text", _hashes(F.col("e_text")).alias("e_hashes"), _hashes(F.col("t_text")).alias("t_hashes"))
    near = met.mapInArrow(_verify(counts, total), ", ".join(f"{c} long" for c in PAIR) + ", cosine double")
    equal = texts.where("e = 1 and t = 1").select(*[F.col(c[2:]).alias(c) for c in PAIR], F.lit(1.0).alias("cosine"))
    return near.unionByName(equal)


def split_rows(claims: DataFrame, candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """The texts of both sides: evaluation ('e') and training ('t'), each with its split and source."""
    src = lambda df, split: df.withColumn("split", split).withColumn("source", F.coalesce("source", F.lit("")))
    held = src(claims.where("split in ('validation', 'test')"), F.col("split"))
    train = src(claims.where("split = 'train'"), F.col("split"))
    golden, fact = src(candidates, F.lit("golden")), src(facts, F.lit("facts"))
    parts = [
        text_rows(golden, "golden_candidates_v0", "id", "original_text", "e", "split", "source"),
        text_rows(held, "final_health_claims", "claim_id", "claim", "e", "split", "source"),
        text_rows(train, "final_health_claims", "claim_id", "claim", "t", "split", "source"),
        text_rows(fact, "verified_facts", "fact_id", "scientific_truth", "t", "split", "source"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlap_pairs(claims: DataFrame, candidates: DataFrame, facts: DataFrame, hot: int = HOT) -> DataFrame:
    """(eval_table, eval_id, train_table, train_id): every pair of an evaluation and a training record that overlap.

    Null splits, null and blank texts take no part; an empty side gives no rows; repeated texts pair row by row.
    """
    rows = cut(split_rows(claims, candidates, facts))
    e = rows.where("side = 'e'").select(F.col("k1").alias("e_k1"), F.col("k2").alias("e_k2"), F.col("tbl").alias("eval_table"), F.col("id").alias("eval_id"))
    t = rows.where("side = 't'").select(F.col("k1").alias("t_k1"), F.col("k2").alias("t_k2"), F.col("tbl").alias("train_table"), F.col("id").alias("train_id"))
    return links(rows, hot).join(e, ["e_k1", "e_k2"]).join(t, ["t_k1", "t_k2"]).select("eval_table", "eval_id", "train_table", "train_id")


def overlap_counts(claims: DataFrame, candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Overlaps per evaluation split and source and per training table: evaluation records touched, and record pairs.

    Counted by classes of equal texts: no pair is expanded.
    """
    rows = cut(split_rows(claims, candidates, facts))
    e = rows.where("side = 'e'").groupBy(F.col("k1").alias("e_k1"), F.col("k2").alias("e_k2"), "tbl", "split", "source").agg(F.count(F.lit(1)).alias("e_rows"))
    t = rows.where("side = 't'").groupBy(F.col("k1").alias("t_k1"), F.col("k2").alias("t_k2"), F.col("tbl").alias("train_table")).agg(F.count(F.lit(1)).alias("t_rows"))
    per = links(rows).join(t, ["t_k1", "t_k2"]).groupBy("e_k1", "e_k2", "train_table").agg(F.sum("t_rows").alias("partners"))
    got = e.join(per, ["e_k1", "e_k2"]).groupBy(F.col("tbl").alias("eval_table"), "split", "source", "train_table")
    return got.agg(F.sum("e_rows").alias("eval_records"), F.sum(F.col("e_rows") * F.col("partners")).alias("pairs"))
