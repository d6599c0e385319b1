"""Evidence per claim, verdict tables, votes and decisions over sets of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx


def lexical_nli(claim: Column, passage: Column) -> Column:
    """The default reading of a passage: enough shared words support, or refute where only one of both negates (D3)."""
    c, p = F.array_distinct(tx.words(claim)), F.array_distinct(tx.words(passage))
    share = F.size(F.array_intersect(c, p)) / (F.size(c) + 1.0)
    no = lambda x: F.arrays_overlap(x, F.array(*[F.lit(w) for w in ("not", "no", "isn", "doesn", "nahi", "never")]))
    return F.struct(F.when(share < 0.4, "NEI").when(no(c) != no(p), "REFUTES").otherwise("SUPPORTS").alias("verdict"), F.round(share, 6).alias("probability"))


def summarize(claims: DataFrame, scored: DataFrame, *more: Column) -> DataFrame:
    """One row per claim (qid) from scored passages (qid, source_tier, nli_verdict, quality); claims without any stay (A1).

    `more` are further aggregates of the passages.
    """
    s, r = F.count_if(F.col("nli_verdict") == "SUPPORTS"), F.count_if(F.col("nli_verdict") == "REFUTES")
    got = scored.groupBy("qid").agg(
        s.alias("support_count"), r.alias("contradiction_count"), F.avg(F.coalesce("quality", F.lit(0.5))).alias("mean_quality"),
        F.max(F.col("source_tier").isin(*lx.GUIDELINE_TIERS)).alias("g"), F.max(F.col("source_tier") == "pubmed").alias("p"),
        F.array_join(F.array_sort(F.collect_set("source_tier")), ",").alias("tiers"), *more)
    total = F.col("support_count") + F.col("contradiction_count")
    got = got.withColumn("agreement", F.when(total > 0, F.greatest("support_count", "contradiction_count") / total).otherwise(0.5))
    got = got.withColumn("best_tier", F.when(F.col("g"), "guideline").when(F.col("p"), "study").otherwise("journalism")).drop("g", "p")
    out = claims.select("qid").join(got, "qid", "left")
    return out.na.fill({"support_count": 0, "contradiction_count": 0, "mean_quality": 0.0, "agreement": 0.0, "best_tier": "none", "tiers": ""})


def table_verdict(kb: Column, nli: Column) -> Column:
    """Verdict of a fact and a model's reading of it; UNVERIFIED where the table has none.

    The fact's verdict is looked up in its normalised form, under which MIXED has no entry (Q1).
    """
    m = F.create_map(*[F.lit(x) for (a, b), v in lx.VERDICT_TABLE.items() for x in (f"{a}|{b}", v)])
    return F.coalesce(F.try_element_at(m, F.concat_ws("|", kb, nli)), F.lit("UNVERIFIED"))


def mode(match_type: Column, found: Column, nli: Column, floor: float = 0.65) -> Column:
    """'fast' for a strong match with a sure model, else 'standard'; a missing confidence is not sure."""
    return F.when((match_type == "STRONG") & F.coalesce(found, F.lit(False)) & (F.coalesce(nli, F.lit(0.0)) >= floor), "fast").otherwise("standard")


def escalate(harm_signal: Column, supports: Column, refutes: Column, agreement: Column, floor: float = 0.70) -> Column:
    """Whether a claim needs the deep mode."""
    return harm_signal | (refutes > 0) | ((supports + refutes > 0) & (agreement < floor))


def escalation(harm_signal: Column, supports: Column, refutes: Column, agreement: Column, floor: float = 0.70) -> Column:
    """Why a claim needs the deep mode, null if it does not."""
    why = F.when(harm_signal, "harm_signal").when(refutes > 0, F.concat(F.lit("contradiction_count="), refutes.cast("string"))).otherwise(F.format_string("agreement_ratio=%.2f", agreement))
    return F.when(escalate(harm_signal, supports, refutes, agreement, floor), why)


def majority(votes: DataFrame, verbal: float = 0.5) -> DataFrame:
    """(qid, votes..., verdict, share, hybrid) from votes (qid, verdict): self-consistency.

    Ties go to TRUE, then FALSE, then UNVERIFIED; any other vote counts as UNVERIFIED.
    """
    v = F.when(F.col("verdict").isin("TRUE", "FALSE"), F.col("verdict")).otherwise("UNVERIFIED")
    got = votes.groupBy("qid").agg(F.count_if(v == "TRUE").alias("n_true"), F.count_if(v == "FALSE").alias("n_false"), F.count_if(v == "UNVERIFIED").alias("n_unverified"))
    top = F.greatest("n_true", "n_false", "n_unverified")
    got = got.withColumn("majority", F.when(F.col("n_true") == top, "TRUE").when(F.col("n_false") == top, "FALSE").otherwise("UNVERIFIED"))
    got = got.withColumn("share", top / (F.col("n_true") + F.col("n_false") + F.col("n_unverified")))
    return got.withColumn("hybrid", 0.3 * F.lit(verbal) + 0.7 * F.col("share"))


def binary(reports: DataFrame, limit: float = 0.5) -> DataFrame:
    """(qid, prediction) from reports (qid, idx, verdict, risk): 1 for misinformation.

    The first report with a decisive verdict decides; without one the highest risk does (Q17, Q18).
    """
    d = F.when(F.col("verdict").isin(*lx.FAKE_VERDICTS), 1).when(F.col("verdict").isin(*lx.REAL_VERDICTS), 0)
    got = reports.withColumn("d", d).groupBy("qid").agg(F.min_by("d", F.when(F.col("d").isNotNull(), F.col("idx"))).alias("d"), F.max("risk").alias("r"))
    return got.select("qid", F.coalesce("d", F.when(F.coalesce("r", F.lit(0.0)) > limit, 1).otherwise(0)).alias("prediction"))


def fast_summary(facts: DataFrame) -> DataFrame:
    """(qid, support_count, contradiction_count, mean_quality, agreement, best_tier, tiers, probability) of claims that a fact decides.

    `facts` has (qid, claim, truth, nli_confidence). The fact's truth stands for the evidence, the claim where it is
    blank; a missing confidence is 0.5.
    """
    from ..functions import scoring as sc

    empty = F.lit(None).cast("string")
    truth = F.coalesce(F.when(F.trim("truth") != "", F.col("truth")), F.col("claim"))
    return facts.select("qid", F.lit(1).alias("support_count"), F.lit(0).alias("contradiction_count"), sc.passage_quality(truth, empty, empty, empty).alias("mean_quality"), F.lit(1.0).alias("agreement"),
                        F.lit("guideline").alias("best_tier"), F.lit("guideline").alias("tiers"), F.coalesce("nli_confidence", F.lit(0.5)).alias("probability"))
