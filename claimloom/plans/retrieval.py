"""Queries of retrieval, evidence and reports: claims whose id is divisible by 50 against all facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import words
from ..operators import lanes, metrics, pipeline, retrieval
from ..session import cut
from ..sources.tables import table
from . import sql as S

QUERIES, ORACLE = {}, {}


def queries(s, d):
    return table(s, d, "final_health_claims").where("claim_id % 50 = 0 and claim is not null").select(F.col("claim_id").alias("qid"), F.col("claim").alias("text"))


def facts(s, d):
    return table(s, d, "verified_facts").where("scientific_truth is not null").select(F.col("fact_id").alias("pid"), F.col("scientific_truth").alias("text"))


BASE = """WITH q AS (SELECT claim_id AS qid, claim AS text FROM final_health_claims WHERE claim_id % 50 = 0 AND claim IS NOT NULL),
p AS (SELECT fact_id AS pid, scientific_truth AS text FROM verified_facts WHERE scientific_truth IS NOT NULL)"""


def bm25_sql(name: str, q: str, k: int) -> str:
    """CTEs that end in `name`(qid, pid, score, rank): BM25 of the texts of `q` over `p`, filled up to k."""
    n = name
    return f"""{n}w AS (SELECT pid, {S.words('text')} AS w FROM p), {n}i AS (SELECT pid, len(w) AS dl, t AS term, count(*) AS tf FROM (SELECT pid, w, unnest(w) AS t FROM {n}w) GROUP BY pid, w, t),
{n}n AS (SELECT (SELECT count(*) FROM p) AS n, sum(len(w))::DOUBLE / (SELECT count(*) FROM p) AS avgdl FROM {n}w),
{n}d AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {n}i, {n}n GROUP BY term, n), {n}f AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {n}d) ELSE raw END AS idf FROM {n}d),
{n}q AS (SELECT qid, t AS term, count(*) AS qn FROM (SELECT qid, unnest({S.words('text')}) AS t FROM {q}) GROUP BY 1, 2),
{n}s AS (SELECT qid, pid, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM {n}i JOIN {n}q USING (term) JOIN {n}f USING (term), {n}n GROUP BY 1, 2),
{n}a AS (SELECT x.qid, p.pid, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT qid FROM {n}q) x CROSS JOIN p LEFT JOIN {n}s s ON s.qid = x.qid AND s.pid = p.pid),
{n} AS (SELECT * FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid DESC)::INT AS rank FROM {n}a) WHERE rank <= {k})"""


QUERIES["bm25_topk"] = lambda s, d: retrieval.bm25(queries(s, d), facts(s, d), 5).select("qid", "pid", F.round("score", 6).alias("score"), "rank")
ORACLE["bm25_topk"] = f"{BASE}, {bm25_sql('b', 'q', 5)} SELECT qid, pid, round(score, 6) AS score, rank FROM b"


def _knn(metric):
    def run(s, d):
        e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        got = retrieval.neighbours(e.where("id % 50 = 0").withColumnRenamed("id", "qid"), e, 5, metric)
        return got.select("qid", "id", F.round("score", 6).alias("score"), "rank")

    return run


for _m, _e, _o in (("l2", "pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)", "ASC"), ("cosine", "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "DESC")):
    QUERIES[f"knn_{_m}"] = _knn(_m)
    ORACLE[f"knn_{_m}"] = (f"WITH x AS (SELECT a.vec_id AS qid, b.vec_id AS id, {_e} AS v FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) SELECT qid, id, round(v, 6) + 0.0 AS score, rank FROM "
                           f"(SELECT qid, id, v, row_number() OVER (PARTITION BY qid ORDER BY round(v, 9) {_o}, id)::INT AS rank FROM x) WHERE rank <= 5")

_lane_sql = " UNION ALL ".join(
    f"SELECT qid, {k} AS lane_no, {S.q(n)} AS lane, {S.q(t).replace('{c}', chr(39) + ' || c || ' + chr(39)).replace('{s}', chr(39) + ' || s || ' + chr(39)).replace('{o}', chr(39) + ' || o || ' + chr(39))} AS text FROM l0" for k, (n, t) in enumerate(lx.LANES))
QUERIES["query_lanes"] = lambda s, d: retrieval.lanes(table(s, d, "verified_facts").select(F.col("fact_id").alias("qid"), F.col("scientific_truth").alias("claim"), F.col("claim_subject").alias("subject"), F.when(F.col("fact_id") % 2 == 0, F.col("risk_level")).alias("outcome")))
ORACLE["query_lanes"] = (f"WITH l0 AS (SELECT fact_id AS qid, trim(scientific_truth) AS c, coalesce(nullif(claim_subject, ''), trim(scientific_truth)) AS s, coalesce(nullif(CASE WHEN fact_id % 2 = 0 THEN risk_level END, ''), {S.q(lx.DEFAULT_OUTCOME)}) AS o "
                         f"FROM verified_facts WHERE scientific_truth IS NOT NULL) {_lane_sql}")


def _claims(s, d):
    return queries(s, d).select("qid", F.col("text").alias("claim"))


def lanes_sql(q: str, k: int) -> str:
    """CTEs that end in lq (searches) and hits: the k best passages of `p` of each lane of the claims of `q` (qid, text), by BM25 and by vectors."""
    return (f"l0 AS (SELECT qid, trim(text) AS c, trim(text) AS s, {S.q(lx.DEFAULT_OUTCOME)} AS o FROM {q}), lanes AS ({_lane_sql}), lq AS (SELECT qid * 8 + lane_no AS qid, text FROM lanes), {bm25_sql('b', 'lq', k)}, "
            f"{S.embedded('lq', 'lq', 'qid', 'text')}, {S.embedded('p', 'p', 'pid', 'text')}, {S.distances('near', 'lq', 'p')}, "
            f"lane_hits AS (SELECT qid, pid, rank, 0 AS dense FROM b UNION ALL SELECT qid, pid, rank, 1 AS dense FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score, pid)::INT AS rank FROM near) WHERE rank <= {k}), "
            f"hits AS (SELECT qid // 8 AS qid, pid, 2 * (qid % 8) + dense AS seen, rank, [{', '.join(S.q(n) for n, _ in lx.LANES)}][(qid % 8)::INT + 1] AS lane FROM lane_hits)")


def quality_sql(c: str) -> str:
    """The quality of a passage `c` of unknown subject, outcome and population."""
    year = rf"coalesce(try_cast(nullif(regexp_extract({c}, '(?:^|[^\p{{L}}\p{{N}}_])((?:19|20)[0-9][0-9])(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS INT), 2020)"
    age = f"greatest(0, 2026 - {year})"
    return f"round(0.35 * {S.case(c, lx.SOURCE_WEIGHTS, 0.5)} + 0.2 * CASE WHEN {S.has(c, lx.FAST_MOVING)} THEN greatest(0.2, 1 - {age} * 0.15) ELSE greatest(0.5, 1 - {age} * 0.03) END + 0.25 * 0.7 + 0.2 * 0.75, 4)::DOUBLE"


NEGATIONS = "['not', 'no', 'isn', 'doesn', 'nahi', 'never']"


def read_sql(x: str, hits: str, q: str, k: int) -> str:
    """CTEs {x}cand, {x}rk and {x}scored: fused, reranked and read passages of the claims of `q` (qid, text) from `hits`."""
    return (f"{x}fused AS (SELECT qid, pid, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, array_to_string(list_sort(list(DISTINCT lane)), ',') AS lanes, min(seen * 1000000 + rank) AS first FROM {hits} GROUP BY 1, 2), "
            f"{x}cand AS (SELECT qid, pid, rrf, lanes, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first, pid)::INT AS rrf_rank FROM {x}fused), "
            f"{x}cw AS (SELECT c.*, list_distinct({S.words('q.text')}) AS c, list_distinct({S.words('p.text')}) AS w, p.text AS passage FROM {x}cand c JOIN {q} q USING (qid) JOIN p USING (pid)), "
            f"{x}rr AS (SELECT *, len(list_intersect(c, w)) / (len(c) + 1.0::DOUBLE) AS rs FROM {x}cw), {x}rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rs DESC, rrf_rank)::INT AS rank FROM {x}rr), "
            f"{x}scored AS (SELECT qid, pid, rank, round(rs, 6) AS rerank_score, {S.case('passage', {k: k for k in lx.SOURCE_WEIGHTS}, 'journalism')} AS source_tier, "
            f"CASE WHEN rs < 0.4 THEN 'NEI' WHEN list_has_any(c, {NEGATIONS}) <> list_has_any(w, {NEGATIONS}) THEN 'REFUTES' ELSE 'SUPPORTS' END AS nli_verdict, round(rs, 6) AS probability, {quality_sql('passage')} AS quality FROM {x}rk WHERE rank <= {k})")


def verdict_sql(x: str, q: str, scored: str) -> str:
    """CTEs {x}ev and {x}vd: evidence summary, confidence and verdict of the claims of `q` from `scored` passages."""
    return (f"{x}summary AS (SELECT qid, count(*) FILTER (WHERE nli_verdict = 'SUPPORTS') AS support_count, count(*) FILTER (WHERE nli_verdict = 'REFUTES') AS contradiction_count, avg(quality) AS mean_quality, stddev_pop(probability) AS sd, "
            f"bool_or(source_tier IN ('who', 'icmr', 'nih', 'guideline')) AS g, bool_or(source_tier = 'pubmed') AS pm, array_to_string(list_sort(list(DISTINCT source_tier)), ',') AS tiers FROM {scored} GROUP BY qid), "
            f"{x}ev AS (SELECT q.qid, coalesce(support_count, 0) AS support_count, coalesce(contradiction_count, 0) AS contradiction_count, coalesce(mean_quality, 0) AS mean_quality, sd, coalesce(tiers, '') AS tiers, "
            "CASE WHEN g IS NULL THEN 'none' WHEN g THEN 'guideline' WHEN pm THEN 'study' ELSE 'journalism' END AS best_tier, CASE WHEN g IS NULL THEN 0.0 WHEN support_count + contradiction_count > 0 "
            f"THEN greatest(support_count, contradiction_count)::DOUBLE / (support_count + contradiction_count) ELSE 0.5 END::DOUBLE AS agreement FROM {q} q LEFT JOIN {x}summary USING (qid)), "
            f"{x}cv AS (SELECT *, CASE WHEN sd IS NULL THEN 0.2 ELSE round(1 / (1 + exp(-(2.5 * mean_quality + 2.0 * agreement - 1.5 * sd + 1.2 * 0.75 - 1.8))), 4) END::DOUBLE AS confidence FROM {x}ev), "
            f"{x}vd AS (SELECT *, CASE WHEN sd IS NULL OR confidence < 0.45 OR mean_quality < 0.35 THEN 'INSUFFICIENT_EVIDENCE' WHEN support_count > 0 AND contradiction_count > 0 AND agreement < 0.7 THEN 'MIXED_EVIDENCE' WHEN contradiction_count > support_count AND confidence >= 0.65 THEN 'FALSE' "
            "WHEN contradiction_count > support_count THEN 'MOSTLY_FALSE' WHEN support_count > contradiction_count AND confidence >= 0.75 THEN 'SUPPORTED' WHEN support_count > contradiction_count THEN 'MOSTLY_SUPPORTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict "
            f"FROM {x}cv)")


CHAIN = f"{BASE}, {lanes_sql('q', 15)}, {read_sql('', 'hits', 'q', 5)}, {verdict_sql('', 'q', 'scored')}"

QUERIES["rrf_fusion"] = lambda s, d: pipeline.candidates(_claims(s, d), facts(s, d)).select("qid", "pid", F.round("rrf", 6).alias("rrf"), "lanes", "rrf_rank")
ORACLE["rrf_fusion"] = f"{CHAIN} SELECT qid, pid, round(rrf, 6) AS rrf, lanes, rrf_rank FROM cand"
QUERIES["rerank_scored"] = lambda s, d: pipeline.scored(_claims(s, d), facts(s, d))
ORACLE["rerank_scored"] = f"{CHAIN} SELECT * FROM scored"


def _verdicts(s, d):
    ev = pipeline.scored(_claims(s, d), facts(s, d))
    return pipeline.verdicts(_claims(s, d), ev)


QUERIES["evidence_summary"] = lambda s, d: _verdicts(s, d).select("qid", "support_count", "contradiction_count", F.round("mean_quality", 6).alias("mean_quality"), F.round("agreement", 6).alias("agreement"), "best_tier", "tiers")
ORACLE["evidence_summary"] = f"{CHAIN} SELECT qid, support_count, contradiction_count, round(mean_quality, 6) AS mean_quality, round(agreement, 6) AS agreement, best_tier, tiers FROM ev"
QUERIES["calibrated_verdict"] = lambda s, d: _verdicts(s, d).select("qid", F.round(F.col("confidence") + 1e-7, 3).alias("confidence"), "verdict")
ORACLE["calibrated_verdict"] = f"{CHAIN} SELECT qid, round(confidence + 1e-7, 3) AS confidence, verdict FROM vd"


def gold(s, d):
    """(qid, pid): facts that share two words of eight letters or more with a claim."""
    long = lambda df, k: df.select(k, F.explode(F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) >= 8))).alias("w"))
    return long(queries(s, d), "qid").join(long(facts(s, d), "pid"), "w").groupBy("qid", "pid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("qid", "pid")


def gold_ranks(s, d):
    """(qid, golds) and (qid, lexical, fused, reranked): how many gold facts each claim has that has any, and the ranks at which they are found.

    Ranks are those of the claim's own words (the best 15, which the first lane searches), of `pipeline.candidates`, and of
    `retrieval.rerank` of these. What is gold is told from the words of both sides, as in `gold`, without a table of all
    pairs; claims without gold count in no metric and are not searched.
    """
    q, f = queries(s, d), facts(s, d)
    cw, pw = retrieval.numbered(q, f, 8)
    long = lambda df, key, w: df.select(key, F.filter(w, lambda x: x % 2 == 1).alias("w"))
    size = cut(lanes.in_common(long(cw, "qid", "cw"), long(pw, "pid", "pw"), 2).withColumnRenamed("n", "golds"))
    asked = _claims(s, d).join(size.select("qid"), "qid", "left_semi")
    hits = cut(pipeline.lane_hits(asked, f))
    first = hits.where("seen = 0").select("qid", "pid", F.col("rank").alias("lexical"))
    got = retrieval.fuse(hits.repartition("qid")).select("qid", "pid", F.col("rank").alias("fused")).join(cw, "qid").join(pw, "pid")
    both = F.array_intersect("cw", "pw")
    got = got.select("qid", "pid", "fused", (F.size(both) / (F.col("cn") + 1.0)).alias("score"), (F.size(F.filter(both, lambda x: x % 2 == 1)) >= 2).alias("gold"))
    got = got.withColumn("reranked", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "fused"))).where("gold")
    return size, cut(got.join(first, ["qid", "pid"], "left").select("qid", "lexical", "fused", "reranked"))


GOLD = (f"gw AS (SELECT DISTINCT qid, w FROM (SELECT qid, unnest({S.words('text')}) AS w FROM q) WHERE len(w) >= 8), gf AS (SELECT DISTINCT pid, w FROM (SELECT pid, unnest({S.words('text')}) AS w FROM p) WHERE len(w) >= 8), "
        "gold AS (SELECT qid, pid FROM gw JOIN gf USING (w) GROUP BY 1, 2 HAVING count(*) >= 2), gn AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid)")


def _metrics(s, d):
    q, f = queries(s, d), facts(s, d)
    m = metrics.ranking(q, retrieval.bm25(q, f, 20), gold(s, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns if c != "queries"], "queries")


QUERIES["retrieval_metrics"] = _metrics
ORACLE["retrieval_metrics"] = (f"{BASE}, {bm25_sql('b', 'q', 20)}, {GOLD}, "
                               "h AS (SELECT qid, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, count(*) AS h20, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM b JOIN gold USING (qid, pid) GROUP BY qid), "
                               "r AS (SELECT n, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(h20, 0) AS h20, first, coalesce(dcg, 0) AS dcg, list_sum(list_transform(range(1, least(n, 10) + 1), x -> 1 / log2(x + 1))) AS ideal FROM gn LEFT JOIN h USING (qid)) "
                               "SELECT round(avg(h5 / n), 6) AS recall_at_5, round(avg(h10 / n), 6) AS recall_at_10, round(avg(h20 / n), 6) AS recall_at_20, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg_at_10, count(*) AS queries FROM r")


ORACLE = {k: S.lambdas(v) for k, v in ORACLE.items()}
