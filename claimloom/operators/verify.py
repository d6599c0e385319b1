"""Checking claims against a base of verified facts: nearest fact, gates, model answers; and the hooks for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from . import evidence, retrieval
from .evidence import lexical_nli

#: Squared distance up to which a fact is a strong match; least confidences of a reading and of a model's answer.
STRONG, NLI_FLOOR, ANSWER_FLOOR = 0.82, 0.65, 0.6
DIM = 64
# Words that make no topic.
STOP = "the a an and or of to in on for with is are was were be been not no it this that these those from by as at can may will do does did has have had if than then there their they you your our his her its about into over after before".split()


def _hashed(c: Column, dim: int, unit: bool) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib

        known: dict[str, tuple[int, float]] = {}
        for s in batches:
            out = []
            for ws in s:
                v = np.zeros(dim)
                for w in ws if ws is not None else ():
                    at = known.get(w)
                    if at is None:
                        if len(known) > 200_000:
                            known.clear()
                        h = hashlib.md5(w.encode()).digest()
                        at = known[w] = h[0] % dim, 1.0 if h[1] >= 128 else -1.0
                    v[at[0]] += at[1]
                n = unit and np.sqrt((v * v).sum())
                out.append(v / n if n else v)
            yield pd.Series(out)

    return run(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def embed(c: Column, dim: int = DIM) -> Column:
    """The default embedder (D2): words hashed into a unit vector, the zero vector for a text without any. A neural one takes its place as an Arrow function."""
    return _hashed(c, dim, True)


def sums(c: Column, dim: int = DIM) -> Column:
    """What `embed` brings to unit length: the vector of a text is the sum of its words'."""
    return _hashed(c, dim, False)


def topics(c: Column) -> Column:
    """The words that may be a text's topic: longer than two characters, no stop word."""
    return F.array_except(F.array_distinct(F.filter(tx.words(c), lambda x: (F.length(x) > 2) & x.rlike(r"^\p{L}+$"))), F.array(*[F.lit(w) for w in STOP]))


def same_topic(a: Column, b: Column) -> Column:
    """Whether two texts share a topic word (F8)."""
    return F.arrays_overlap(topics(a), topics(b))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def nearest_fact(claims: DataFrame, facts: DataFrame, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """(qid, claim, fact_id, distance, claim_subject, ...): the nearest fact of each claim by squared distance."""
    base = cut(facts.where("scientific_truth is not null").withColumn("vec", embedder(F.concat_ws(" ", "claim_subject", "scientific_truth"))))
    asked = cut(claims.where("claim is not null").withColumn("vec", embedder(F.col("claim"))))
    hits = retrieval.neighbours(asked.select("qid", "vec"), base.select(F.col("fact_id").alias("id"), "vec"), 1)
    return asked.select("qid", "claim").join(hits.select("qid", F.col("id").alias("fact_id"), F.col("score").alias("distance")), "qid", "left").join(base.drop("vec"), "fact_id", "left")


def tier_one(claims: DataFrame, facts: DataFrame, embedder: Callable[[Column], Column] = embed, nli: Callable[[Column, Column], Column] = lexical_nli) -> DataFrame:
    """One result per claim (qid, claim): what the fact base says.

    STRONG within the distance and on topic, WEAK on topic beyond it with a sure reading, else NONE and UNVERIFIED. A
    claim always has a row. Facts may name their source.
    """
    facts = facts if "source" in facts.columns else facts.withColumn("source", F.lit(None).cast("string"))
    m = nearest_fact(claims, facts, embedder).withColumn("n", nli(F.col("claim"), F.col("scientific_truth")))
    topic = F.coalesce(same_topic(F.col("claim"), F.concat_ws(" ", "claim_subject", "scientific_truth")), F.lit(False))
    sure = F.col("n.probability") >= NLI_FLOOR
    kind = F.when(topic & (F.col("distance") <= STRONG), "STRONG").when(topic & sure, "WEAK").otherwise("NONE")
    found = F.col("match_type") != "NONE"
    m = m.withColumn("match_type", kind)
    v = evidence.table_verdict(tx.normalize_verdict(F.col("verdict")), F.col("n.verdict"))
    got = lambda c: F.when(found, F.col(c))
    return m.select("qid", "match_type", found.alias("match_found"), F.round("distance", 6).alias("match_score"), F.when(found, v).otherwise("UNVERIFIED").alias("verdict"), got("fact_id").alias("fact_id"),
                    got("scientific_truth").alias("truth"), got("risk_level").alias("risk_level"), got("source").alias("source"), got("n.verdict").alias("nli_verdict"), got("n.probability").alias("nli_confidence"))


def with_answers(tier: DataFrame, answers: DataFrame) -> DataFrame:
    """Claims that the fact base left open take a model's answer (qid, answer) if it is sure enough."""
    a = answers.select("qid", tx.parse_answer(tx.strip_fences(F.col("answer"))).alias("a"))
    take = (F.col("match_type") == "NONE") & (F.coalesce(F.col("a.confidence"), F.lit(0.0)) >= ANSWER_FLOOR)
    got = tier.join(a, "qid", "left")
    return got.withColumn("verdict", F.when(take, F.col("a.verdict")).otherwise(F.col("verdict"))).withColumn("truth", F.when(take, F.col("a.reason")).otherwise(F.col("truth"))).withColumn(
        "match_type", F.when(take, "LLM").otherwise(F.col("match_type"))).drop("a")


class VectorIndex:
    """A table of vectors with their passages: add, search, save, load."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("id", "vec", "passage", "source_file")

    def add(self, rows: DataFrame) -> VectorIndex:
        return VectorIndex(self.rows.unionByName(rows.select("id", "vec", "passage", "source_file")))

    def search(self, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
        """(qid, id, score, rank, passage, source_file)."""
        return retrieval.neighbours(queries, self.rows, k, metric).join(self.rows.drop("vec"), "id", "left")

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> VectorIndex:
        return VectorIndex(spark.read.parquet(path))
