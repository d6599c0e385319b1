"""Evaluation: classification, calibration, retrieval and safety metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each class of pairs (y, p); a division by zero gives 0.

    Each pair counts once for its true and once for its predicted class, summed before the shuffle: one pass over `pairs`,
    no join, and as many rows as classes per task.
    """
    cells = pairs.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    hit, none = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), none.alias("pp"), F.col("n").alias("support")),
        F.struct(F.col("p").alias("label"), none.alias("tp"), F.col("n").alias("pp"), none.alias("support")))
    got = cells.select(F.explode(sides).alias("s")).groupBy("s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "pp", "support")])
    prec, rec = _div(F.col("tp"), F.col("pp")), _div(F.col("tp"), F.col("support"))
    return got.select("label", prec.alias("precision"), rec.alias("recall"), _div(2 * prec * rec, prec + rec).alias("f1"), "support")


def weighted(pairs: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1 of pairs (y, p)."""
    n = F.sum("support")
    got = class_report(pairs).agg(*[_div(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in ("precision", "recall", "f1")])
    return got.withColumn("accuracy", F.col("recall"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(y, p0, p1): counts of predictions 0 and 1 for each true 0 and 1."""
    return pairs.where("y in (0, 1)").groupBy("y").agg(F.count_if(F.col("p") == 0).alias("p0"), F.count_if(F.col("p") == 1).alias("p1"))


def matthews(pairs: DataFrame) -> DataFrame:
    """One row: Matthews correlation of pairs (y, p) in 0 and 1, 0 where undefined (A10)."""
    c = {k: F.count_if((F.col("y") == a) & (F.col("p") == b)).cast("double") for k, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))}
    n = pairs.agg(*[v.alias(k) for k, v in c.items()])
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return n.select(_div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def pr_curve(scored: DataFrame, ranges: int = 64) -> DataFrame:
    """(threshold, precision, recall) of (y, score) at every distinct score.

    Counts are aggregated by score first. The running sums are taken range by range of scores, on top of the sums of all
    higher ranges, so that no task holds all thresholds. A null score ranks below all and has no row; null labels do
    not count.
    """
    by = scored.groupBy(F.col("score").alias("threshold")).agg(F.sum("y").alias("pos"), F.count("y").alias("n"))
    by = by.withColumn("part", F.least(F.greatest(F.floor(F.col("threshold") * ranges), F.lit(0)), F.lit(ranges - 1)).cast("int"))  # scores outside 0 to 1 join the outer ranges
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    sums = by.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    total = F.sum("p").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = sums.select("part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("m"), total.alias("all"))
    w = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    pos, n = F.col("p") + F.sum("pos").over(w), F.col("m") + F.sum("n").over(w)
    return by.join(F.broadcast(sums), "part").select("threshold", _div(pos, n).alias("precision"), _div(pos, F.col("all")).alias("recall")).where("threshold is not null")  # at most `ranges` rows broadcast


def _binned(scored: DataFrame, bins: int) -> DataFrame:
    """(bin, n, mean_prob, accuracy, squares) of (y, prob); every bin has a row, empty ones of zeros."""
    b = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)).cast("int")
    got = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"), F.avg(F.col("y").cast("double")).alias("accuracy"), F.sum((F.col("prob") - F.col("y")) ** 2).alias("squares"))
    return scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").na.fill(0)


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_prob, accuracy) of (y, prob); every bin has a row, empty ones of zeros (A5)."""
    return _binned(scored, bins).drop("squares")


def brier_ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: Brier score and expected calibration error of (y, prob), from one pass (A4, A5)."""
    n = F.sum("n")
    return _binned(scored, bins).agg(_div(F.sum("squares"), n).alias("brier"), _div(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_prob"))), n).alias("ece"), n.alias("n"))


def confidence_buckets(scored: DataFrame) -> DataFrame:
    """(bucket, n, accuracy) of (y, prob) in four fixed buckets, empty ones of zeros."""
    b = F.when(F.col("prob") >= 0.90, ">=0.90").when(F.col("prob") >= 0.80, "0.80-0.90").when(F.col("prob") >= 0.70, "0.70-0.80").otherwise("<0.70")
    got = scored.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("accuracy"))
    names = scored.sparkSession.createDataFrame([(x,) for x in (">=0.90", "0.80-0.90", "0.70-0.80", "<0.70")], "bucket string")
    return names.join(got, "bucket", "left").na.fill(0)


def ranking(queries: DataFrame, hits: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row: mean recall at each cut, reciprocal rank and NDCG at 10 over queries (qid) that have gold (qid, pid)."""
    g = gold.select("qid", "pid").distinct()
    size = g.groupBy("qid").agg(F.count(F.lit(1)).alias("golds"))
    return means(queries.select("qid").join(size, "qid"), hits.join(g, ["qid", "pid"], "left_semi"), cuts)


def means(size: DataFrame, found: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """`ranking` of queries whose number of gold passages is known (qid, golds), from their hits that are gold (qid, rank)."""
    h = found.groupBy("qid").agg(
        *[F.count_if(F.col("rank") <= c).alias(f"h{c}") for c in cuts], F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("golds").cast("int"), F.lit(10))), F.lit(0.0), lambda a, x: a + 1.0 / F.log2(x + 1.0))
    per = size.join(h, "qid", "left").withColumn("ideal", ideal)
    return per.agg(*[F.avg(F.coalesce(F.col(f"h{c}"), F.lit(0)) / F.col("golds")).alias(f"recall_at_{c}") for c in cuts],
                   F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg_at_10"), F.count(F.lit(1)).alias("queries"))


def safety(pairs: DataFrame) -> DataFrame:
    """One row from (dangerous, flagged): counts, recall, precision and both error rates."""
    c = {k: F.count_if((F.col("dangerous") == a) & (F.col("flagged") == b)) for k, a, b in (("tp", True, True), ("fn", True, False), ("fp", False, True), ("tn", False, False))}
    got = pairs.agg(*[v.alias(k) for k, v in c.items()])
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return got.select("tp", "fn", "fp", "tn", _div(tp, tp + fn).alias("recall"), _div(tp, tp + fp).alias("precision"), _div(fn, tp + fn).alias("fn_rate"), _div(fp, fp + tn).alias("fp_rate"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): balanced weights n / (classes x n of the class)."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return n.crossJoin(F.broadcast(t)).select("label", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))  # one row broadcast


def lane_report(queries: DataFrame, hits: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(lane, recall_at_..., mrr, ndcg_at_10, queries): `ranking` of each lane's hits (qid, lane, pid, rank) over all queries with gold."""
    g = gold.select("qid", "pid").distinct().join(queries.select("qid").distinct(), "qid", "left_semi")
    size = g.groupBy("qid").agg(F.count(F.lit(1)).alias("golds"))
    n = size.agg(F.count(F.lit(1)).alias("queries"))
    per = hits.join(g, ["qid", "pid"], "left_semi").groupBy("lane", "qid").agg(
        *[F.count_if(F.col("rank") <= c).alias(f"h{c}") for c in cuts], F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("golds").cast("int"), F.lit(10))), F.lit(0.0), lambda a, x: a + 1.0 / F.log2(x + 1.0))
    got = per.join(size, "qid").withColumn("ideal", ideal).groupBy("lane").agg(
        *[F.sum(F.col(f"h{c}") / F.col("golds")).alias(f"recall_at_{c}") for c in cuts], F.sum(1.0 / F.col("first")).alias("mrr"), F.sum(F.col("dcg") / F.col("ideal")).alias("ndcg_at_10"))
    got = hits.select("lane").distinct().join(got, "lane", "left").na.fill(0.0).crossJoin(F.broadcast(n))  # one row broadcast
    return got.select("lane", *[_div(F.col(c), F.col("queries")).alias(c) for c in (*[f"recall_at_{c}" for c in cuts], "mrr", "ndcg_at_10")], "queries")


def lift(before: DataFrame, after: DataFrame, value: str = "ndcg_at_10") -> DataFrame:
    """One row: a metric before and after, and the gain in percent; 0 where there was nothing before."""
    got = before.select(F.col(value).alias("before")).crossJoin(F.broadcast(after.select(F.col(value).alias("after"))))  # one row each
    return got.withColumn("lift_percent", F.coalesce(F.try_divide(100.0 * (F.col("after") - F.col("before")), "before"), F.lit(0.0)))


def modes(reports: DataFrame) -> DataFrame:
    """(mode, n, percent, accuracy, latency) of reports (mode, y, p, latency); all three modes have a row."""
    got = reports.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), F.avg("latency").alias("latency"))
    names = reports.sparkSession.createDataFrame([("fast",), ("standard",), ("deep",)], "mode string")
    total = got.agg(F.sum("n").alias("t"))
    return names.join(got, "mode", "left").na.fill(0).crossJoin(F.broadcast(total)).select("mode", "n", _div(F.col("n") * 100.0, F.col("t")).alias("percent"), "accuracy", "latency")  # one row broadcast
