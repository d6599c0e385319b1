"""Queries of set operations, ordered picks, event logs and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..operators import evidence, metrics, records
from ..sources.tables import table
from . import sql as S
from .claims import CLAIMS, STYLE_SQL, claims

QUERIES, ORACLE = {}, {}
QUERIES["new_documents"] = lambda s, d: records.not_in(table(s, d, "documents").select("doc_id", "source"), table(s, d, "subject_labels"), "doc_id")
ORACLE["new_documents"] = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM subject_labels)"


def _overlap(s, d):
    a = table(s, d, "golden_candidates_v0").select(F.col("original_text").alias("t0"))
    b = table(s, d, "final_health_claims").select(F.col("claim").alias("t0"))
    got = records.overlap(a, b, "t0")
    return got.select("left_texts", "right_texts", "shared", F.round("percent", 6).alias("percent"))


QUERIES["leakage_overlap"] = _overlap
ORACLE["leakage_overlap"] = """WITH a AS (SELECT DISTINCT lower(trim(original_text)) AS t FROM golden_candidates_v0 WHERE original_text IS NOT NULL), b AS (SELECT DISTINCT lower(trim(claim)) AS t FROM final_health_claims WHERE claim IS NOT NULL)
SELECT (SELECT count(*) FROM a) AS left_texts, (SELECT count(*) FROM b) AS right_texts, count(*) AS shared, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM a), 6) AS percent FROM a JOIN b USING (t)"""

QUERIES["dedupe_first"] = lambda s, d: records.first_of(table(s, d, "verified_facts").select("fact_id", "claim_subject", "verdict", "source"), [F.lower("claim_subject"), F.col("verdict")], "fact_id")
ORACLE["dedupe_first"] = "SELECT fact_id, claim_subject, verdict, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(claim_subject), verdict ORDER BY fact_id) AS r FROM verified_facts) WHERE r = 1"

QUERIES["stride_sample"] = lambda s, d: records.stride(table(s, d, "final_health_claims").select("claim_id", "label"), "label", "claim_id", 125)
ORACLE["stride_sample"] = """SELECT claim_id, label FROM (SELECT claim_id, label, row_number() OVER (PARTITION BY label ORDER BY claim_id) - 1 AS p, greatest(1, count(*) OVER (PARTITION BY label) // 125) AS step FROM final_health_claims WHERE label IS NOT NULL)
WHERE p % step = 0 AND p // step < 125"""

_VOTE = "CASE WHEN value < 100 THEN 'TRUE' WHEN value < 250 THEN 'FALSE' ELSE 'UNVERIFIED' END"
QUERIES["vote_majority"] = lambda s, d: evidence.majority(table(s, d, "events").select(F.col("user_id").alias("qid"), F.expr(_VOTE).alias("verdict"))).select("qid", "n_true", "n_false", "n_unverified", F.col("majority").alias("verdict"), F.round("share", 6).alias("share"), F.round("hybrid", 6).alias("hybrid"))
ORACLE["vote_majority"] = f"""WITH v AS (SELECT user_id AS qid, {_VOTE} AS v FROM events), c AS (SELECT qid, count(*) FILTER (WHERE v = 'TRUE') AS n_true, count(*) FILTER (WHERE v = 'FALSE') AS n_false, count(*) FILTER (WHERE v = 'UNVERIFIED') AS n_unverified FROM v GROUP BY qid)
SELECT qid, n_true, n_false, n_unverified, CASE WHEN n_true = greatest(n_true, n_false, n_unverified) THEN 'TRUE' WHEN n_false = greatest(n_true, n_false, n_unverified) THEN 'FALSE' ELSE 'UNVERIFIED' END AS verdict,
round(greatest(n_true, n_false, n_unverified)::DOUBLE / (n_true + n_false + n_unverified), 6) AS share, round(0.3 * 0.5 + 0.7::DOUBLE * greatest(n_true, n_false, n_unverified) / (n_true + n_false + n_unverified), 6) AS hybrid FROM c"""

_DEC = "['INSUFFICIENT_EVIDENCE', 'MIXED_EVIDENCE', 'FALSE', 'SUPPORTED', 'SUPPORTED_WITH_CAVEATS', 'MOSTLY_FALSE']"
QUERIES["binary_prediction"] = lambda s, d: evidence.binary(
    table(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("idx"), F.expr(f"element_at(array{_DEC.replace('[', '(').replace(']', ')')}, cast(least(floor(value / 10), 5) as int) + 1)").alias("verdict"), (F.col("value") / 500).alias("risk")))
ORACLE["binary_prediction"] = f"""WITH r AS (SELECT user_id AS qid, event_id AS idx, {_DEC}[least(floor(value / 10), 5)::INT + 1] AS v, value / 500 AS risk FROM events), x AS (SELECT *, CASE WHEN v IN ('FALSE', 'MOSTLY_FALSE', 'MISLEADING') THEN 1 WHEN v IN ('TRUE', 'SUPPORTED', 'MOSTLY_SUPPORTED') THEN 0 END AS d FROM r)
SELECT qid, coalesce(min_by(d, idx) FILTER (WHERE d IS NOT NULL), CASE WHEN max(risk) > 0.5 THEN 1 ELSE 0 END)::INT AS prediction FROM x GROUP BY qid"""

QUERIES["review_latest"] = lambda s, d: records.latest(table(s, d, "events"), "user_id", "ts", "event_id", "event_id", "event_type")
ORACLE["review_latest"] = "SELECT user_id, event_id, event_type, events FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS events FROM events) WHERE r = 1"
QUERIES["pending_reviews"] = lambda s, d: records.latest(table(s, d, "events"), "user_id", "ts", "event_id", "event_id", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))
ORACLE["pending_reviews"] = "SELECT event_type, count(*) AS users FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY event_type"

QUERIES["islands"] = lambda s, d: records.runs(table(s, d, "events"), "user_id", "ts", "event_id", "event_type", F.date_trunc("day", "ts"))
ORACLE["islands"] = """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS length, min(ts) AS first, max(ts) AS last FROM b GROUP BY user_id, run"""


def _intervals(s, d):
    e = table(s, d, "events")
    sec = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    spans = e.where("event_type = 'view'").select("user_id", sec.alias("start"), (sec + 3600 * 24).alias("end")).distinct()
    labels = e.where("event_type != 'view'").select("user_id", sec.alias("left"), (sec + 1800 * 24).alias("right"), F.col("event_type").alias("label"), F.round("value", 2).alias("confidence"))
    return records.best_overlap(spans, labels, "user_id")


QUERIES["interval_overlap"] = _intervals
ORACLE["interval_overlap"] = """WITH sp AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 86400 AS e FROM events WHERE event_type = 'view'), lb AS (SELECT user_id, floor(epoch(ts))::BIGINT AS l, floor(epoch(ts))::BIGINT + 43200 AS r, event_type AS label, round(value, 2) AS c FROM events WHERE event_type <> 'view')
SELECT sp.user_id, s AS start, e AS "end", arg_min(label, (-c, label)) AS label, max(c) AS confidence, count(c) AS candidates FROM sp LEFT JOIN lb ON sp.user_id = lb.user_id AND l < e AND r > s GROUP BY 1, 2, 3"""

_T = [0.40, 0.50, 0.60, 0.65, 0.70, 0.80]
QUERIES["threshold_sweep"] = lambda s, d: records.sweep(table(s, d, "image_ingestion"), "ocr_confidence", _T).withColumn("rate", F.round("rate", 6))
ORACLE["threshold_sweep"] = f"SELECT t::DOUBLE AS threshold, count(*) AS n, count(*) FILTER (WHERE coalesce(ocr_confidence, 0) < t) AS below, round(count(*) FILTER (WHERE coalesce(ocr_confidence, 0) < t)::DOUBLE / count(*), 6) AS rate FROM image_ingestion, (SELECT unnest({_T}::DOUBLE[]) AS t) GROUP BY t"


def scored(s, d):
    """(qid, y, prob, p): label, style as probability and its class, of claims with a label; one scan."""
    c = claims(s, d, "label").select("qid", "text", F.regexp_extract("label", "([01])", 1).try_cast("int").alias("y")).where("y is not null")
    c = c.select("qid", "y", sc.style_score(F.col("text")).alias("prob"))
    return c.select("qid", "y", "prob", (F.col("prob") > 0.3).cast("int").alias("p"))


_SC = CLAIMS + "," + STYLE_SQL + ", sc AS (SELECT s.qid, y, style AS prob, (style > 0.3)::INT AS p FROM style s JOIN (SELECT claim_id AS qid, try_cast(nullif(regexp_extract(label, '([01])', 1), '') AS INT) AS y FROM final_health_claims) USING (qid) WHERE y IS NOT NULL)"
QUERIES["brier_ece"] = lambda s, d: metrics.brier_ece(scored(s, d)).select(F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"), "n")
_BINS = ", bins AS (SELECT least(floor(prob * 10), 9)::INT AS bin, count(*) AS n, avg(prob) AS mean_prob, avg(y) AS accuracy FROM sc GROUP BY 1)"
ORACLE["brier_ece"] = _SC + _BINS + " SELECT round((SELECT avg(pow(prob - y, 2)) FROM sc), 6) AS brier, round(sum(n * abs(accuracy - mean_prob)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM bins"
QUERIES["reliability_bins"] = lambda s, d: metrics.reliability(scored(s, d)).select("bin", "n", F.round("mean_prob", 6).alias("mean_prob"), F.round("accuracy", 6).alias("accuracy"))
ORACLE["reliability_bins"] = _SC + _BINS + " SELECT i::INT AS bin, coalesce(n, 0) AS n, round(coalesce(mean_prob, 0), 6) AS mean_prob, round(coalesce(accuracy, 0), 6) AS accuracy FROM range(10) t(i) LEFT JOIN bins ON bin = i"
QUERIES["confidence_buckets"] = lambda s, d: metrics.confidence_buckets(scored(s, d)).withColumn("accuracy", F.round("accuracy", 6))
ORACLE["confidence_buckets"] = _SC + """ SELECT t.b AS bucket, count(prob) AS n, round(coalesce(avg(y), 0), 6) AS accuracy FROM (VALUES ('>=0.90'), ('0.80-0.90'), ('0.70-0.80'), ('<0.70')) t(b)
LEFT JOIN sc ON t.b = CASE WHEN prob >= 0.9 THEN '>=0.90' WHEN prob >= 0.8 THEN '0.80-0.90' WHEN prob >= 0.7 THEN '0.70-0.80' ELSE '<0.70' END GROUP BY 1"""
_REP = ", rep AS (SELECT l AS label, sum((y = l AND p = l)::INT)::DOUBLE AS tp, sum((p = l)::INT) AS pp, sum((y = l)::INT)::BIGINT AS support FROM sc, (SELECT DISTINCT l FROM (SELECT unnest([y, p]) AS l FROM sc)) GROUP BY l), r2 AS (SELECT label, support, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM rep), r3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r2)"
QUERIES["class_report"] = lambda s, d: metrics.class_report(scored(s, d)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
ORACLE["class_report"] = _SC + _REP + " SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r3"
QUERIES["weighted_metrics"] = lambda s, d: metrics.weighted(scored(s, d)).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
ORACLE["weighted_metrics"] = _SC + _REP + " SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM r3"
QUERIES["confusion_matrix"] = lambda s, d: metrics.confusion(scored(s, d))
ORACLE["confusion_matrix"] = _SC + " SELECT y, count(*) FILTER (WHERE p = 0) AS p0, count(*) FILTER (WHERE p = 1) AS p1 FROM sc GROUP BY y"
QUERIES["matthews"] = lambda s, d: metrics.matthews(scored(s, d)).select(F.round("mcc", 6).alias("mcc"))
ORACLE["matthews"] = _SC + ", c AS (SELECT sum(y * p)::DOUBLE AS tp, sum((1 - y) * (1 - p))::DOUBLE AS tn, sum((1 - y) * p)::DOUBLE AS fp, sum(y * (1 - p))::DOUBLE AS fn FROM sc) SELECT round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c"
QUERIES["pr_curve"] = lambda s, d: metrics.pr_curve(scored(s, d).withColumnRenamed("prob", "score")).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
ORACLE["pr_curve"] = _SC + ", b AS (SELECT prob AS threshold, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1) SELECT threshold, round(sum(pos) OVER w / sum(n) OVER w, 6)::DOUBLE AS precision, round(sum(pos) OVER w / (SELECT sum(pos) FROM b), 6)::DOUBLE AS recall FROM b WINDOW w AS (ORDER BY threshold DESC)"
QUERIES["safety_audit"] = lambda s, d: metrics.safety(scored(s, d).select((F.col("y") == 1).alias("dangerous"), (F.col("p") == 1).alias("flagged"))).select("tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "fn_rate", "fp_rate")])
ORACLE["safety_audit"] = _SC + ", c AS (SELECT sum(y * p)::BIGINT AS tp, sum(y * (1 - p))::BIGINT AS fn, sum((1 - y) * p)::BIGINT AS fp, sum((1 - y) * (1 - p))::BIGINT AS tn FROM sc) SELECT *, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(fn::DOUBLE / (tp + fn), 6) AS fn_rate, round(fp::DOUBLE / (fp + tn), 6) AS fp_rate FROM c"
QUERIES["class_weights"] = lambda s, d: metrics.class_weights(table(s, d, "verified_facts"), "verdict").withColumn("weight", F.round("weight", 6))
ORACLE["class_weights"] = "WITH n AS (SELECT verdict AS label, count(*) AS n FROM verified_facts GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n"
QUERIES["label_counts"] = lambda s, d: table(s, d, "final_health_claims").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
ORACLE["label_counts"] = "SELECT label, count(*) AS n FROM final_health_claims GROUP BY 1"
QUERIES["verdict_coverage"] = lambda s, d: table(s, d, "verified_facts").groupBy("verdict", "risk_level").agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg(F.col("scientific_truth").isNotNull().cast("double")), 6).alias("coverage"))
ORACLE["verdict_coverage"] = "SELECT verdict, risk_level, count(*) AS facts, round(avg((scientific_truth IS NOT NULL)::INT), 6) AS coverage FROM verified_facts GROUP BY 1, 2"


def _modes(s, d):
    m = F.element_at(F.array(F.lit("fast"), F.lit("standard")), (F.col("qid") % 2).cast("int") + 1)
    got = metrics.modes(scored(s, d).select(m.alias("mode"), "y", "p", ((F.col("qid") % 7) / 10.0).alias("latency")))
    return got.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("percent", "accuracy", "latency")])


QUERIES["mode_summary"] = _modes
ORACLE["mode_summary"] = _SC + ", g AS (SELECT ['fast', 'standard'][(qid % 2)::INT + 1] AS mode, count(*) AS n, avg((y = p)::INT) AS accuracy, avg((qid % 7) / 10.0::DOUBLE) AS latency FROM sc GROUP BY 1) SELECT t.mode, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT sum(n) FROM g), 6) AS percent, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(latency, 0), 6) AS latency FROM (VALUES ('fast'), ('standard'), ('deep')) t(mode) LEFT JOIN g USING (mode)"


def _failures(s, d):
    k = F.col("claim_ref")
    pick = lambda m, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % m).cast("int") + 1)
    stage = sc.stage_of_failure(pick(5, *_P), pick(4, *_E), F.col("route"), (k % 6).cast("int"), (k % 7).cast("int"), (k % 11).cast("int"), (k % 10) / 20.0)
    return table(s, d, "canonical_claims").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("claims"))


_P, _E = ("SUPPORTED", "FALSE", "INSUFFICIENT_EVIDENCE", "MIXED_EVIDENCE", "MOSTLY_FALSE"), ("SUPPORTED", "FALSE", "NOT_A_FACT_CHECK", "MOSTLY_SUPPORTED")
QUERIES["failure_attribution"] = _failures
ORACLE["failure_attribution"] = f"""WITH x AS (SELECT claim_ref % 6 AS lanes, claim_ref % 7 AS cand, claim_ref % 11 AS rer, (claim_ref % 10) / 20.0 AS q, route, {list(_P)}[(claim_ref % 5)::INT + 1] AS p, {list(_E)}[(claim_ref % 4)::INT + 1] AS e FROM canonical_claims)
SELECT CASE WHEN p = e THEN 'SUCCESS' WHEN e = 'NOT_A_FACT_CHECK' AND route <> 'medical_advice' THEN 'ROUTING_FAILURE' WHEN lanes < 3 THEN 'QUERY_PLANNING_FAILURE' WHEN cand = 0 THEN 'RETRIEVAL_FAILURE' WHEN rer = 0 THEN 'RERANKING_FAILURE'
WHEN q < 0.2 AND e IN ('SUPPORTED', 'FALSE') THEN 'EVIDENCE_QUALITY_FAILURE' WHEN p IN ('INSUFFICIENT_EVIDENCE', 'MIXED_EVIDENCE') AND e IN ('SUPPORTED', 'FALSE') THEN 'CALIBRATION_FAILURE' ELSE 'NLI_FAILURE' END AS stage, count(*) AS claims FROM x GROUP BY 1"""
ORACLE = {k: S.lambdas(v) for k, v in ORACLE.items()}
