"""Structured Streaming forms: incremental articles, claims as they arrive, review state, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import scoring as sc
from ..functions import text as tx
from ..sources.readers import NOT_ARTICLES, REQUEST


def ingest_articles(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """New text files of `folder` become passages in `table`, each file once, and only what is there now.

    The checkpoint remembers the files; a batch counts as done after its rows are durable.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").schema("value string").load(folder)
    x = files.select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split("value", r"\r\n|\r|\n")))
    x = x.where(~F.col("file_name").rlike(NOT_ARTICLES)).select("file_name", (F.col("pos") + 1).alias("line_no"), tx.strip(F.col("col")).alias("passage")).where(tx.is_passage(F.col("passage")))
    return x.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assess(claims: DataFrame) -> DataFrame:
    """Route, style and harm of claims (text); the same columns for a batch and for a stream (T4)."""
    h = sc.harm(F.col("text"), F.lit(0.5))
    got = claims.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    return got.select("*", tx.route(F.col("text")).alias("route"), tx.any_contained(F.col("text"), lx.HARM_SIGNALS).alias("harm_signal"), sc.style_score(F.col("text")).alias("style"), h["harm_axis"].alias("harm"), h["needs_review"].alias("needs_review"))


def claim_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Requests in JSON files of `folder`, assessed as they arrive."""
    return assess(spark.readStream.schema(REQUEST).json(folder))


def windowed(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) per window and type; later rows than `late` are dropped."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total"))


def review_state(decisions: DataFrame) -> DataFrame:
    """decisions (request_id, status, ts) -> (request_id, status, decided_at, decisions): the current state of each review.

    An aggregate with partial results: of equal times the larger status holds. In a stream its state is kept in the
    checkpoint, and each batch sends the reviews that changed.
    """
    return decisions.groupBy("request_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("decided_at"), F.count(F.lit(1)).alias("decisions"))
