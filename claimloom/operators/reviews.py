"""The review queue as an event log: submit, decide, pending, one by its number; and the graph's review step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "request_id string, event string, claim_text string, verdict string, note string, at timestamp"


def needs_review(confidence: Column, verdict: Column) -> Column:
    """The graph's predicate (F11): little confidence, or a verdict that decides nothing."""
    return (F.coalesce(confidence, F.lit(0.0)) < 0.5) | F.coalesce(verdict, F.lit("INSUFFICIENT_EVIDENCE")).isin("INSUFFICIENT_EVIDENCE", "MIXED_EVIDENCE")


def stamped(df: DataFrame) -> DataFrame:
    """`df` with a request_id and the time of submission (X74); both differ in each run."""
    return df.withColumns({"request_id": F.expr("uuid()"), "submitted_at": F.current_timestamp()})


def submit(reports: DataFrame) -> DataFrame:
    """Events of the log (T3, K12) for reports (request_id, claim_text, verdict, at)."""
    return reports.select("request_id", F.lit("pending").alias("event"), "claim_text", "verdict", F.lit(None).cast("string").alias("note"), "at")


def decide(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events for decisions (request_id, action, verdict, note, at); a decision on an unknown request makes none."""
    known = log.where("event = 'pending'").select("request_id").distinct()
    return decisions.join(known, "request_id", "left_semi").select("request_id", F.col("action").alias("event"), F.lit(None).cast("string").alias("claim_text"), "verdict", "note", "at")


def state(log: DataFrame) -> DataFrame:
    """(request_id, status, claim_text, verdict, note, at): each submitted request with its last decision, else pending.

    An aggregate with partial results. Of decisions at one time the larger action holds; submitting again changes the
    text, not the decision.
    """
    made = F.col("event") != "pending"
    last = F.max_by(F.struct("event", "verdict", "note", "at"), F.when(made, F.struct("at", "event")))
    first = F.max_by(F.struct("claim_text", "verdict", "at"), F.when(~made, F.struct("at", F.coalesce("claim_text", F.lit("")))))
    got = log.groupBy("request_id").agg(last.alias("d"), first.alias("s"), F.max(made.cast("int")).alias("decided")).where("s is not null")
    pick = lambda c, other: F.when(F.col("decided") == 1, F.col(f"d.{c}")).otherwise(other)
    return got.select("request_id", pick("event", F.lit("pending")).alias("status"), F.col("s.claim_text").alias("claim_text"), pick("verdict", F.col("s.verdict")).alias("verdict"), pick("note", F.lit(None)).alias("note"), pick("at", F.col("s.at")).alias("at"))


def pending(log: DataFrame) -> DataFrame:
    """The requests without a decision."""
    return state(log).where("status = 'pending'")


def one(log: DataFrame, request_id: str) -> DataFrame:
    """The state of one request; no row for an unknown one (J19). The filter reaches the log's scan."""
    return state(log.where(F.col("request_id") == request_id))


def reviewed(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """reports (qid, verdict, confidence) with action, adjusted verdict and note of their decisions (qid, action, verdict, note).

    A report that needs review and has no decision is approved with its own verdict, as the graph does by itself.
    """
    d = decisions.select("qid", F.col("action").alias("a"), F.col("verdict").alias("v"), F.col("note").alias("n"))
    got = reports.join(d, "qid", "left")
    wants = needs_review(F.col("confidence"), F.col("verdict"))
    return got.select(*reports.columns, wants.alias("reviewed"), F.when(wants, F.coalesce("a", F.lit("override_approved"))).alias("action"), F.when(wants, F.coalesce("v", "verdict")).otherwise(F.col("verdict")).alias("final_verdict"),
                      F.when(wants & F.col("a").isNull(), "Human reviewer confirmed verdict").when(wants, F.col("n")).alias("note"))
