"""Retrieval: BM25 and nearest neighbours of blocks of queries, rank fusion, reranking.

Both searches compare every query with every row, as their exact results need. The rows stay where they are. Queries
come in blocks whose bytes are bounded: a block is broadcast, each task keeps a running list of its k best rows of each
query, and only those leave Python and are shuffled. The driver holds one block at a time; further blocks are searched
after the results of the last one are written to the shared folder.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import words
from ..session import cut, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Bytes of a block of queries: what is broadcast for one pass over the rows.
BLOCK_BYTES = 32 << 20
#: Queries and rows of one score matrix.
_Q, _R = 2048, 512


class Best:
    """The k best rows so far of each of n queries: larger scores first, of equal ones the larger number."""

    def __init__(self, n: int, k: int):
        self.score, self.row = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).min)

    def take(self, at: int, score: np.ndarray, rows: np.ndarray) -> None:
        """Scores (queries from `at` on x rows) of further rows, which must come by falling number in each call."""
        k = self.score.shape[1]
        old, tie = self.score[at:at + len(score), -1, None], self.row[at:at + len(score), -1, None]
        better = ((score > old) | (score == old) & (rows > tie)) & (score > -np.inf)
        q = np.nonzero(better.any(1))[0]
        if not len(q):
            return
        s, r = np.where(better[q], score[q], -np.inf), np.broadcast_to(rows, (len(q), len(rows)))
        if s.shape[1] > k:  # of the new rows only the k best of a query can stay
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            s, r = np.take_along_axis(s, top, 1), rows[top]
        s, r = np.concatenate([self.score[at + q], s], 1), np.concatenate([self.row[at + q], r], 1)
        order = np.lexsort((~r, -s), axis=1)[:, :k]
        self.score[at + q], self.row[at + q] = np.take_along_axis(s, order, 1), np.take_along_axis(r, order, 1)

    def batches(self, ids: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
        q, j = np.nonzero(self.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(self.row[q, j]), pa.array(self.score[q, j])], ["qid", name, "score"])


def _blocks(queries: DataFrame, size: int, search: Callable[[pa.Table], DataFrame], empty: str) -> DataFrame:
    """Results of `search` over all queries, a block of at most about BLOCK_BYTES at a time; `size` is the bytes of a query."""
    n = queries.count()
    parts = max(1, -(-n * max(size, 8) // BLOCK_BYTES))
    out = None
    for p in range(parts if n else 0):
        block = (queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p) if parts > 1 else queries).toArrow()
        if block.num_rows:
            got = search(block)
            got = got if parts == 1 else cut(got)  # so that the driver can let go of the block
            out = got if out is None else out.unionByName(got)
    return queries.sparkSession.createDataFrame([], empty) if out is None else out


def term_weights(texts: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) over all n passages (pid, w) (A25): a term in more than half of them weighs EPSILON of the mean."""
    w = texts.select("pid", F.explode(F.array_distinct("w")).alias("term"))
    df = w.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = df.agg((F.avg("raw") * EPSILON).alias("floor"))
    return df.crossJoin(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))  # one row broadcast


class _Lists:
    """The terms of a block of queries, each with the queries that have it and their weights."""

    def __init__(self, block: pa.Table):
        self.ids = block.column("qid").to_numpy()
        terms = block.column("terms").combine_chunks()
        off = np.r_[0, np.cumsum(terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
        flat = terms.flatten()
        q = np.repeat(np.arange(len(self.ids)), np.diff(off))
        codes = flat.field("term").dictionary_encode()
        t, w = codes.indices.to_numpy(zero_copy_only=False), flat.field("weight").to_numpy(zero_copy_only=False)
        order = np.lexsort((q, t))
        self.q, self.w = q[order], w[order]
        self.at = np.searchsorted(t[order], np.arange(len(codes.dictionary) + 1))
        self.number = {x: k for k, x in enumerate(codes.dictionary.to_pylist())}


def _score(lists, avgdl: float, k: int):
    """For mapInArrow over (pid, words): the k best passages of the task for each query of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: _Lists = lists.value
        n, number, best = len(x.ids), x.number, Best(len(x.ids), k)
        cuts = [np.searchsorted(x.q[a:b], np.arange(0, n + _Q, _Q)) + a for a, b in zip(x.at, x.at[1:], strict=False)]  # a term's queries by matrix
        for batch in batches:
            for start in range(0, batch.num_rows, _R):
                part = batch.slice(start, _R)
                pids = part.column(0).to_numpy().astype(np.int64)
                order = np.argsort(-pids, kind="stable")
                texts = part.column(1).to_pylist()
                by: dict[int, tuple[list[int], list[float]]] = {}
                for row, source in enumerate(order.tolist()):
                    ws = texts[source] or []
                    norm = K1 * (1 - B + B * len(ws) / avgdl)
                    for t, tf in Counter(ws).items():
                        j = number.get(t)
                        if j is not None:
                            r, v = by.setdefault(j, ([], []))
                            r.append(row)
                            v.append(tf * (K1 + 1) / (tf + norm))
                found = [(j, np.array(r), np.array(v)) for j, (r, v) in by.items()]
                for m, q0 in enumerate(range(0, n, _Q)):
                    score = np.zeros((min(_Q, n - q0), len(pids)))
                    for j, r, v in found:
                        a, b = cuts[j][m], cuts[j][m + 1]
                        if a < b:
                            score[(x.q[a:b] - q0)[:, None], r] += x.w[a:b, None] * v
                    best.take(q0, np.round(score, 9), pids[order])
        yield from best.batches(x.ids, "pid")

    return run


def bm25(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(qid, pid, score, rank): the k best passages of each query (J5, W1), passages of score 0 among them (Q8).

    Ties go to the higher pid. Repeated query terms count as often as they occur; queries without words have no rows,
    null texts and identifiers take no part.
    """
    texts = cut(spread(passages.where("pid is not null").select(F.col("pid").cast("long").alias("pid"), "text")).select("pid", words(F.col("text")).alias("w")))
    n, length = texts.agg(F.count(F.lit(1)), F.sum(F.greatest(F.coalesce(F.size("w"), F.lit(0)), F.lit(0)))).first()
    empty = "qid long, pid long, score double"
    asked = queries.where("qid is not null").select(F.col("qid").cast("long").alias("qid"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    if not length:
        return texts.sparkSession.createDataFrame([], empty + ", rank int")
    q = asked.select("qid", F.explode("w").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qn")).join(term_weights(texts, n), "term", "left")
    terms = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", (F.col("qn") * F.col("idf")).alias("weight"))))  # the words of one query
    block = cut(q.groupBy("qid").agg(terms.alias("terms")))
    size = int(block.agg(F.avg(F.size("terms") * 24 + 24 * k)).first()[0] or 0)
    sc, texts = texts.sparkSession.sparkContext, spread(texts)
    out = _blocks(block, size, lambda rows: texts.mapInArrow(_score(sc.broadcast(_Lists(rows)), length / n, k), empty), empty)
    top = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("pid"))
    return out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def _near(block, k: int, metric: str):
    """For mapInArrow over (id, vec): the k nearest rows of the task to each query of the broadcast block.

    A matrix product bounds the distances; those that may be among the best are then computed exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, a = block.value
        n, best = len(ids), Best(len(ids), k)
        length = (a * a).sum(1)
        for batch in batches:
            for start in range(0, batch.num_rows, _R):
                part = batch.slice(start, _R)
                key = part.column(0).to_numpy().astype(np.int64)
                order = np.argsort(key, kind="stable")  # ids count down in `Best`: of ties the smaller id comes first
                key = key[order]
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(key), -1)[order]
                if metric == "cosine":
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                if metric == "damped":
                    exact = np.round(a @ v.T / (np.sqrt(length)[:, None] * np.sqrt((v * v).sum(1)) + 1e-9), 9)
                    best.take(0, exact, ~key)
                    continue
                norm = (v * v).sum(1)
                for q0 in range(0, n, _Q):
                    x = a[q0:q0 + _Q]
                    dot = x @ v.T
                    score = dot if metric == "cosine" else 2 * dot - length[q0:q0 + _Q, None] - norm
                    room = 1e-9 * (1 + length[q0:q0 + _Q, None] + norm)
                    least = best.score[q0:q0 + len(x), -1, None]
                    if len(key) > k:  # what these rows alone leave out
                        least = np.maximum(least, np.partition(score, len(key) - k, axis=1)[:, len(key) - k, None] - room)
                    i, j = np.nonzero(score >= least - room)
                    exact = np.full(score.shape, -np.inf)
                    for c in range(0, len(i), 1 << 16):
                        ii, jj = i[c:c + (1 << 16)], j[c:c + (1 << 16)]
                        exact[ii, jj] = np.round((x[ii] * v[jj]).sum(1) if metric == "cosine" else -((x[ii] - v[jj]) ** 2).sum(1), 9)
                    best.take(q0, exact, ~key)
        best.row = ~best.row
        yield from best.batches(ids, "id")

    return run


def neighbours(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(qid, id, score, rank): the k nearest rows of base (id, vec) to each query (qid, vec); J1 to J4.

    'l2' is the squared distance, smallest first; 'cosine' the similarity, largest first, a zero vector counting as far;
    'damped' the similarity with 1e-9 added to the product of the lengths.
    Both are rounded to nine digits; ties go to the smaller id. Null vectors take no part; all vectors have one length.
    """
    base = base.where("vec is not null and id is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    queries = cut(queries.where("vec is not null and qid is not null").select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec")))
    dim = queries.agg(F.max(F.size("vec"))).first()[0] or 0
    sc = queries.sparkSession.sparkContext

    def search(rows: pa.Table) -> DataFrame:
        a = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        if metric == "cosine":
            a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        return base.mapInArrow(_near(sc.broadcast((rows.column("qid").to_numpy(), a)), k, metric), "qid long, id long, score double")

    out = _blocks(queries, 8 * dim + 16 * k, search, "qid long, id long, score double")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select("qid", "id", (F.lit(0.0) + F.col("score") if metric != "l2" else F.lit(0.0) - F.col("score")).alias("score"), "rank")


def lanes(claims: DataFrame) -> DataFrame:
    """(qid, lane_no, lane, text): the five searches of each claim (qid, claim, subject, outcome); P7."""
    claim = F.trim("claim")
    s = F.when(F.coalesce("subject", F.lit("")) != "", F.col("subject")).otherwise(claim)
    o = F.when(F.coalesce("outcome", F.lit("")) != "", F.col("outcome")).otherwise(lx.DEFAULT_OUTCOME)

    def filled(t: str):
        parts, out = t.replace("{c}", "\0c\0").replace("{s}", "\0s\0").replace("{o}", "\0o\0").split("\0"), []
        for x in parts:
            out.append({"c": claim, "s": s, "o": o}.get(x, F.lit(x)))
        return F.concat(*out)

    rows = F.array(*[F.struct(F.lit(k).alias("lane_no"), F.lit(n).alias("lane"), filled(t).alias("text")) for k, (n, t) in enumerate(lx.LANES)])
    return claims.where("claim is not null").select("qid", F.explode(rows).alias("x")).select("qid", "x.*")


def string_hits(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, lane, seen, rank, pid): hits given by their text (qid, lane, seen, rank, passage) as numbers of passages.

    A text that several passages have stands for the first of them; one that none has is dropped.
    """
    first = passages.where("text is not null").groupBy(F.col("text").alias("passage")).agg(F.min("pid").alias("pid"))
    return hits.join(first, "passage").select("qid", "lane", "seen", "rank", "pid")


def fuse(hits: DataFrame, k: int = 60) -> DataFrame:
    """(qid, pid, rrf, lanes, rank) from hits (qid, pid, lane, seen, rank): reciprocal rank fusion.

    `seen` orders the lists; of equal scores the passage met first comes first.
    """
    got = hits.groupBy("qid", "pid").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"), F.min(F.col("seen") * 1_000_000 + F.col("rank")).alias("first"))
    got = got.withColumn("rrf", F.round("rrf", 9))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "first", "pid"))).drop("first")


def numbered(claims: DataFrame, passages: DataFrame, long: int) -> tuple[DataFrame, DataFrame]:
    """(qid, cw, cn) and (pid, pw): the distinct words that claims (qid, text) and passages (pid, text) share, as numbers, and how many words a claim has.

    The numbers of words of `long` letters and more are odd. A claim or passage without such words has an empty list.
    """
    own = lambda df, key: cut(spread(df.select(key, "text")).select(key, F.array_distinct(words(F.col("text"))).alias("w")))
    c, p = own(claims, "qid"), own(passages, "pid")
    terms = lambda df: df.select(F.explode("w").alias("term")).distinct()
    number = 2 * F.monotonically_increasing_id() + (F.length("term") >= long).cast("long")
    known = cut(terms(c).join(terms(p), "term").select("term", number.alias("number")))  # a number of its own for each word, fixed by the cut
    lists = lambda df, key: df.select(key, F.explode("w").alias("term")).join(known, "term").groupBy(key).agg(F.collect_list("number").alias("x"))
    none = F.array().cast("array<long>")
    c = c.select("qid", F.greatest(F.coalesce(F.size("w"), F.lit(0)), F.lit(0)).alias("cn")).join(lists(c, "qid"), "qid", "left").select("qid", F.coalesce("x", none).alias("cw"), "cn")
    return cut(c), cut(p.select("pid").join(lists(p, "pid"), "pid", "left").select("pid", F.coalesce("x", none).alias("pw")))


def rerank(candidates: DataFrame, k: int, score: Callable | None = None) -> DataFrame:
    """(qid, pid, rerank_score, rank): candidates (qid, claim, pid, passage, rrf_rank) by shared words (X7, W4), or by the
    hook `score` of claim and passage, a cross-encoder say; where the hook gives null, by shared words (D4)."""
    c, p = F.array_distinct(words(F.col("claim"))), F.array_distinct(words(F.col("passage")))
    shared = F.size(F.array_intersect(c, p)) / (F.size(c) + 1.0)
    got = candidates.withColumn("rerank_score", shared if score is None else F.coalesce(score(F.col("claim"), F.col("passage")), shared))
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rrf_rank")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
