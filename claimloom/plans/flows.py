"""Queries of sources, streams and training, run over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..operators import learning
from ..session import place
from ..sources import readers, sinks
from ..sources.tables import table
from ..streaming import flows
from . import claims as C
from . import sql as S

QUERIES, ORACLE = {}, {}


def _csv(s, d):
    at = place(s)
    sinks.predictions(table(s, d, "final_health_claims").select("claim", F.regexp_extract("label", "([01])", 1).alias("label")), at)
    return readers.labelled_claims(s, at).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("claim")).alias("characters"))


QUERIES["csv_round_trip"] = _csv
ORACLE["csv_round_trip"] = "SELECT regexp_extract(label, '([01])', 1)::INT AS label, count(*) AS n, sum(length(claim))::BIGINT AS characters FROM final_health_claims WHERE claim IS NOT NULL AND claim <> '' AND regexp_extract(label, '([01])', 1) <> '' GROUP BY 1"


def _json(s, d):
    at = place(s)
    sinks.json_lines(table(s, d, "golden_candidates_v0"), at)
    return readers.json_lines(s, at).groupBy("expected_class", "review_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("evidence_urls")).alias("urls"), F.count("reviewer").alias("reviewed"))


QUERIES["json_round_trip"] = _json
ORACLE["json_round_trip"] = "SELECT expected_class, review_status, count(*) AS n, sum(len(evidence_urls))::BIGINT AS urls, count(reviewer) AS reviewed FROM golden_candidates_v0 GROUP BY 1, 2"


def _stream(s, d):
    at = place(s)
    docs = table(s, d, "documents").where("text is not null")
    docs.select("text").write.option("lineSep", "\n").mode("overwrite").format("parquet").save(f"{at}/src")
    q = flows.assess(s.readStream.schema("text string").parquet(f"{at}/src")).select("route", "needs_review")
    run = q.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema("route string, needs_review boolean").parquet(f"{at}/out").groupBy("route", "needs_review").agg(F.count(F.lit(1)).alias("documents"))


QUERIES["stream_claims"] = _stream
_harm = C.HARM_SQL.replace("(qid % 100) / 100.0::DOUBLE AS conf", "0.5::DOUBLE AS conf")
ORACLE["stream_claims"] = (f"WITH claims AS (SELECT row_number() OVER () AS qid, text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''), {_harm} "
                           f"SELECT CASE WHEN {S.word('text', lx.ADVICE)} THEN 'medical_advice' ELSE 'fact_check' END AS route, needs_review, count(*) AS documents FROM claims JOIN harm USING (qid) GROUP BY 1, 2")


def _windows(s, d):
    at = place(s)
    table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(f"{at}/src")
    ev = s.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{at}/src")
    # complete mode: in append mode the last windows wait for a watermark that a finite table never brings
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")
    run = flows.windowed(ev, window="1 day").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{at}/out").select("start", "event_type", "n", F.round("total", 2).alias("total"))


QUERIES["stream_windows"] = _windows
ORACLE["stream_windows"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"
QUERIES["tfidf_lr"] = lambda s, d: learning.train_and_test(
    table(s, d, "golden_candidates_v0").select("id", F.col("original_text").alias("text"), F.col("source_label").alias("label")), "id")
