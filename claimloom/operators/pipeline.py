"""Claims to reports in one plan: cleaning, routing, retrieval, evidence, verdict, risk.

Model hooks are functions of columns with deterministic defaults: `nli` gives struct(verdict, probability) of a claim
and a passage, `rerank_score` is lexical. A neural model takes a hook's place as an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import lexicons as lx
from ..functions import scoring as sc
from ..functions import text as tx
from ..session import cut, spread
from . import evidence, lanes, retrieval, verify
from .evidence import lexical_nli

def lane_hits(claims: DataFrame, passages: DataFrame, per_lane: int = 15, embedder: Callable[[Column], Column] | None = verify.embed) -> DataFrame:
    """(qid, pid, lane, seen, rank): the best passages of each lane of each claim (qid, claim), by BM25 and by vectors.

    Vectors are compared by squared distance. Without an embedder only BM25 searches. The default embedder's vectors add
    up over the words of a search, as BM25 does; those of another are compared lane by lane.
    """
    asked = cut(claims.where("claim is not null and qid is not null").select(F.col("qid").cast("long").alias("qid"), "claim"))
    found = lanes.by_words(asked, passages, per_lane)
    hits = [] if found is None else [lanes.ranked(found, per_lane).withColumn("dense", F.lit(0))]
    if embedder is verify.embed:
        hits.append(lanes.ranked(lanes.by_vectors(asked, passages, per_lane, verify.sums), per_lane).withColumn("dense", F.lit(1)))
    elif embedder is not None:
        texts = retrieval.lanes(asked.select("qid", "claim", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("outcome")))
        base = cut(spread(passages.where("text is not null").select(F.col("pid").cast("long").alias("id"), "text")).select("id", embedder(F.col("text")).alias("vec")))
        near = retrieval.neighbours(texts.select((F.col("qid") * 8 + F.col("lane_no")).alias("qid"), embedder(F.col("text")).alias("vec")), base, per_lane)
        hits.append(near.select(F.floor(F.col("qid") / 8).alias("qid"), F.pmod("qid", F.lit(8)).cast("int").alias("lane"), F.col("id").alias("pid"), "rank", F.lit(1).alias("dense")))
    if not hits:
        return claims.sparkSession.createDataFrame([], "qid long, pid long, lane string, seen int, rank int")
    got = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    names = F.element_at(F.array(*[F.lit(n) for n, _ in lx.LANES]), F.col("lane") + 1)
    return got.select("qid", "pid", names.alias("lane"), (2 * F.col("lane") + F.col("dense")).alias("seen"), "rank")


def fused(hits: DataFrame, claims: DataFrame, passages: DataFrame, fusion_k: int = 60) -> DataFrame:
    """Candidates of each claim from the hits of its lanes."""
    got = retrieval.fuse(hits, fusion_k).join(claims.select("qid", "claim"), "qid").join(passages.select("pid", F.col("text").alias("passage")), "pid")
    return got.select("qid", "claim", "pid", "passage", F.col("rank").alias("rrf_rank"), "rrf", "lanes")


def candidates(claims: DataFrame, passages: DataFrame, per_lane: int = 15, embedder: Callable[[Column], Column] | None = verify.embed) -> DataFrame:
    """(qid, claim, pid, passage, rrf_rank, lanes): the fused candidates of each claim (qid, claim) over all lanes and both retrievers."""
    return fused(lane_hits(claims, passages, per_lane, embedder), claims, passages)


def read(candidates: DataFrame, k: int = 5, nli: Callable[[Column, Column], Column] = lexical_nli, rerank_score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The k reranked candidates of each claim with tier, reading and quality."""
    got = retrieval.rerank(candidates, k, rerank_score)
    empty = F.lit(None).cast("string")
    return got.withColumn("n", nli(F.col("claim"), F.col("passage"))).select(
        "qid", "pid", "rank", F.round("rerank_score", 6).alias("rerank_score"), sc.text_tier(F.col("passage")).alias("source_tier"), F.col("n.verdict").alias("nli_verdict"),
        F.col("n.probability").alias("probability"), sc.passage_quality(F.col("passage"), empty, empty, empty).alias("quality"))


def scored(claims: DataFrame, passages: DataFrame, k: int = 5, nli: Callable[[Column, Column], Column] = lexical_nli, embedder: Callable[[Column], Column] | None = verify.embed) -> DataFrame:
    """The k reranked passages of each claim with tier, reading and quality."""
    return read(candidates(claims, passages, embedder=embedder), k, nli)


def verdicts(claims: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """The evidence summary, confidence and verdict of each claim (A1, A3, X45, X46); a claim without passages is insufficient."""
    got = evidence.summarize(claims, evidence_rows, F.stddev_pop("probability").alias("sd"))
    conf = F.when(F.col("sd").isNull(), F.lit(0.20)).otherwise(sc.calibrated_confidence(F.col("mean_quality"), F.col("agreement"), F.col("sd"), F.lit(0.75)))
    got = got.withColumn("confidence", F.round(conf, 4))
    v = F.when(F.col("sd").isNull(), "INSUFFICIENT_EVIDENCE").otherwise(
        sc.verdict(F.col("confidence"), F.col("mean_quality"), F.col("support_count"), F.col("contradiction_count"), F.col("agreement"), F.lit(False)))
    return got.withColumn("verdict", v)


def checked_facts(claims: DataFrame, facts: DataFrame | None, nli: Callable[[Column, Column], Column] = lexical_nli, embedder: Callable[[Column], Column] = verify.embed,
                  answers: Callable[[Column], Column] | None = None) -> DataFrame:
    """(qid, operating mode, truth and sureness of the tier-one match, verification_text, fact_*): what the fact base says of claims (qid, claim).

    The mode comes from the claim itself, the fact result from the verification text: the claim's first triple, or the
    claim where it has none (P10). There only a strong match counts, else a sure answer of the hook `answers` (D5, F10),
    else it is UNVERIFIED at medium risk (D7, F5, F7). Without facts every claim is open.
    """
    t = tx.triple(F.col("claim"))
    texts = F.array(F.col("claim"), F.concat_ws(" ", t["subject"], t["relation"], t["object"]))
    claims = claims.select("qid", "claim", F.when(t.isNull(), F.slice(texts, 1, 1)).otherwise(texts).alias("texts"))
    if facts is None:
        facts = claims.sparkSession.createDataFrame([], "fact_id long, claim_subject string, verdict string, scientific_truth string, risk_level string, source string")
    asked = claims.select("qid", F.posexplode("texts").alias("which", "claim"))
    numbered = asked.select((F.col("qid") * 2 + F.col("which")).alias("qid"), "claim")
    tier = verify.tier_one(numbered, facts, embedder, nli)
    got = cut(tier)
    which, qid = F.pmod("qid", F.lit(2)), F.floor(F.col("qid") / 2).alias("qid")
    first = got.where(which == 0).select(qid, evidence.mode(F.col("match_type"), F.col("match_found"), F.col("nli_confidence")).alias("mode"), "truth", F.col("nli_confidence").alias("sure"))
    last = got.groupBy(qid).agg(F.max_by(F.struct("match_type", "verdict", "nli_verdict", "nli_confidence", "risk_level", "source"), which).alias("f"))
    if answers is None:
        last = last.withColumn("a", F.lit(None).cast("struct<verdict:string,confidence:double>"))
    else:
        said = claims.select("qid", tx.parse_answer(tx.strip_fences(answers(F.element_at("texts", -1)))).alias("said"))
        sure = F.col("said.confidence") >= verify.ANSWER_FLOOR
        last = last.join(said, "qid").withColumn("a", F.when(sure, F.struct("said.verdict", "said.confidence"))).drop("said")
    when = lambda c, otherwise: F.when(F.col("f.match_type") == "STRONG", F.col(f"f.{c}")).otherwise(otherwise)
    last = last.select(
        "qid", when("match_type", F.when(F.col("a").isNotNull(), "LLM").otherwise("NONE")).alias("fact_match"), when("verdict", F.coalesce("a.verdict", F.lit("UNVERIFIED"))).alias("fact_verdict"),
        when("nli_verdict", F.lit("NEI")).alias("fact_reading"), when("nli_confidence", F.col("a.confidence")).alias("fact_nli"), when("risk_level", F.lit("Medium")).alias("fact_risk"), when("source", F.lit(None)).alias("fact_source"))
    return claims.select("qid", F.element_at("texts", -1).alias("verification_text")).join(first, "qid").join(last, "qid")


def analyze(claims: DataFrame, passages: DataFrame, facts: DataFrame | None = None, nli: Callable[[Column, Column], Column] = lexical_nli, gloss: Callable[[Column], Column] | None = None,
            embedder: Callable[[Column], Column] = verify.embed, rerank_score: Callable[[Column, Column], Column] | None = None, answers: Callable[[Column], Column] | None = None,
            explain: Callable[[Column, Column], Column] | None = None, settings: Settings | None = None) -> DataFrame:
    """One report row per part of a claim (qid, text), numbered by idx: route, mode, verdict, confidence, style, harm, risk, review.

    Personal questions are answered with the safety notice and never reach retrieval (F2). The rest is cleaned, or
    replaced by what the hook `gloss` gives (an accepted English gloss of the text, else null), and parted. A part that
    the facts (fact_id, claim_subject, verdict, scientific_truth, risk_level, source) match strongly and surely is judged by
    its fact alone (fast); any other by the 5 best passages of 5 per lane (standard), or, where these conflict or the
    text may do harm, by the 15 best of 15 per lane instead (deep). Null claims have no report. The other hooks stand for
    a reranker (D4), a model's answers to open claims (D5) and its wording of the explanation (D6).
    """
    at = settings or Settings.read(claims.sparkSession)
    clean = tx.clean_claim(F.col("text")) if gloss is None else F.coalesce(gloss(F.col("text")), tx.clean_claim(F.col("text")))
    source = F.lit("original") if gloss is None else F.when(gloss(F.col("text")).isNotNull(), "gloss").otherwise("original")
    base = cut(claims.where("text is not null").select("qid", "text", clean.alias("claim"), tx.route(F.col("text")).alias("route"), source.alias("text_source")))
    parts = base.where("route = 'fact_check'").select(F.col("qid").alias("of"), "text", "route", "text_source", F.posexplode(tx.sub_claims(F.col("claim"))).alias("idx", "claim"))
    parts = cut(parts.withColumn("idx", F.col("idx") + 1).withColumn("qid", F.monotonically_increasing_id()))  # a number of its own for each part, fixed by the cut
    known = cut(parts.join(checked_facts(parts.select("qid", "claim"), facts, nli, embedder, answers), "qid"))
    empty = F.lit(None).cast("string")
    fast = known.where("mode = 'fast'")
    truth = F.coalesce(F.when(F.trim("truth") != "", F.col("truth")), F.col("claim"))
    fast = fast.select("qid", F.lit("guideline").alias("source_tier"), F.lit("SUPPORTS").alias("nli_verdict"), F.col("sure").alias("probability"), sc.passage_quality(truth, empty, empty, empty).alias("quality"))
    asked = cut(known.where("mode <> 'fast'").select("qid", "claim", "text"))
    hits = cut(lane_hits(asked, passages, at.deep, embedder))
    standard = cut(read(fused(hits.where(F.col("rank") <= at.standard), asked, passages, at.fusion_k), at.standard, nli, rerank_score))
    signal = tx.any_contained(F.col("text"), lx.HARM_SIGNALS)
    s = evidence.summarize(asked, standard).join(asked.select("qid", signal.alias("signal")), "qid")
    reason = evidence.escalation(F.col("signal"), F.col("support_count"), F.col("contradiction_count"), F.col("agreement"))
    deep = cut(s.select("qid", reason.alias("escalation")).where("escalation is not null"))
    more = read(fused(hits.join(deep, "qid", "left_semi"), asked, passages, at.fusion_k), at.deep, nli, rerank_score)
    ev = cut(standard.join(deep, "qid", "left_anti").unionByName(more).select(*fast.columns).unionByName(fast))
    got = known.join(verdicts(known.select("qid"), ev), "qid").join(deep, "qid", "left").withColumn("style", sc.style_score(F.col("claim")))
    harm = sc.harm(F.col("text"), F.col("confidence"), confidence_floor=at.review_confidence, harm_limit=at.review_harm)
    fact = sc.fact_score(F.col("fact_verdict"), F.col("fact_match"), F.col("fact_nli"), F.col("fact_risk"))
    risk = sc.combined_risk(F.col("fact_verdict"), fact["fact_score"], fact["reliability"], F.col("style"))
    said = sc.explanation(F.col("verdict"), F.col("confidence"), F.col("best_tier"), F.col("agreement"))
    reports = got.select(
        F.col("of").alias("qid"), "idx", "claim", "verification_text", "route", F.when(F.col("escalation").isNotNull(), "deep").otherwise(F.col("mode")).alias("mode"), F.col("escalation").isNotNull().alias("escalated"), "escalation",
        "verdict", "confidence", "best_tier", F.col("fact_verdict").alias("kb_verdict"), F.col("fact_reading").alias("nli_verdict"), (said if explain is None else F.coalesce(explain(F.col("claim"), said), said)).alias("explanation"),
        F.coalesce("fact_source", F.lit("evidence")).alias("source"), "text_source", "style", harm["harm_axis"].alias("harm"), F.round(risk["risk"], 4).alias("risk"), risk["risk_label"].alias("risk_level"),
        (harm["needs_review"] | F.col("verdict").isin("INSUFFICIENT_EVIDENCE", "MIXED_EVIDENCE")).alias("needs_review"), F.lit(None).cast("string").alias("notice"))
    none = lambda n: F.lit("none").alias(n)
    advice = base.where("route = 'medical_advice'").select(
        "qid", F.lit(1).alias("idx"), "claim", F.col("claim").alias("verification_text"), "route", none("mode"), F.lit(False).alias("escalated"), empty.alias("escalation"), F.lit("NOT_A_FACT_CHECK").alias("verdict"), F.lit(0.0).alias("confidence"),
        none("best_tier"), F.lit("UNVERIFIED").alias("kb_verdict"), F.lit("NEI").alias("nli_verdict"), F.lit(lx.SAFETY_RESPONSE).alias("explanation"), none("source"), "text_source", F.lit(0.0).alias("style"), F.lit(0.0).alias("harm"),
        F.lit(0.0).alias("risk"), F.lit("safe").alias("risk_level"), F.lit(False).alias("needs_review"), F.lit(lx.SAFETY_RESPONSE).alias("notice"))
    return reports.unionByName(advice)
