"""Operators over record tables: set operations, ordered picks, event logs, runs, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose key is not in `known`; null keys stay."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """One row: distinct texts of a and b apart from blanks at the ends and case, shared ones, and their percentage of a."""
    norm = lambda df: df.where(F.col(text).isNotNull()).select(F.lower(F.trim(text)).alias("t")).distinct()
    x, y = norm(a).withColumn("a", F.lit(1)), norm(b).withColumn("b", F.lit(1))
    got = x.join(y, "t", "full").agg(F.count("a").alias("left_texts"), F.count("b").alias("right_texts"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))
    return got.withColumn("percent", F.coalesce(F.try_divide(F.col("shared") * 100.0, F.col("left_texts")), F.lit(0.0)))


def first_of(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The row of least `order` of each key, as an aggregate with partial results (U7): no group is collected."""
    cols = df.columns
    got = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*cols), F.col(order)).alias("__r"))
    return got.select("__r.*")


def ranked(df: DataFrame, label: str, order: str, *ties: str) -> DataFrame:
    """`df` with __p, the place of each row in its class by `order` (a number), from 0, and __n, the size of the class.

    A class of any size is never sorted in one task: rows are counted per range of `order` (spread about evenly; some
    million rows a range), the counts are summed up, and only a range is sorted at a time.
    """
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    ranges = F.greatest(F.lit(64), F.ceil(F.col("__n") / 1_000_000))
    b = F.floor((F.col(order) - F.col("__lo")) * ranges / (F.col("__hi") - F.col("__lo") + 1)).cast("long")
    part = df.join(n, label).withColumn("__b", b)  # labels may be many: Spark broadcasts the sizes only if they are small
    before = part.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = before.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = part.join(before.select(label, "__b", "__before"), [label, "__b"])
    pos = F.col("__before") + F.row_number().over(Window.partitionBy(label, "__b").orderBy(order, *ties)) - 1
    return got.withColumn("__p", pos).select(*df.columns, "__p", "__n")


def stride(df: DataFrame, label: str, order: str, per_class: int) -> DataFrame:
    """At most `per_class` rows of each class, every step-th in order, step = max(1, n of class / per_class)."""
    step = F.greatest(F.floor(F.col("__n") / per_class), F.lit(1))
    got = ranked(df.where(F.col(label).isNotNull()), label, order)
    return got.where((F.col("__p") % step == 0) & (F.col("__p") / step < per_class)).select(*df.columns)


def latest(events: DataFrame, key: str, time: str, tie: str, *columns: str) -> DataFrame:
    """The newest event of each key as current state (W10); ties by the larger `tie`. An aggregate, not a sorted group."""
    got = events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time, tie)).alias("r"), F.count(F.lit(1)).alias("events"))
    return got.select(key, "r.*", "events")


def runs(events: DataFrame, key: str, time: str, tie: str, value: str, bucket: Column) -> DataFrame:
    """(key, run, value, length, first, last): stretches of equal values in time order (W8, gaps and islands).

    `bucket` grows with time (a day, say). Only a bucket of a key is sorted at a time; a summary row of each bucket tells
    whether its first stretch continues the last one of the bucket before, and how many stretches precede it. Null
    values make stretches of their own.
    """
    x = events.withColumn("__b", bucket)
    w = Window.partitionBy(key, "__b").orderBy(time, tie)
    opens = (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    x = x.withColumn("__s", opens.cast("long")).withColumn("__r", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = x.groupBy(key, "__b", "__r").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"), F.min(time).alias("first"), F.max(time).alias("last"))
    ends = part.groupBy(key, "__b").agg(F.min_by(F.struct(value), "__r").alias("__head"), F.max_by(F.struct(value), "__r").alias("__tail"), F.max("__r").alias("__n"))
    v = Window.partitionBy(key).orderBy("__b")
    ends = ends.withColumn("__joined", F.coalesce(F.lag("__tail").over(v).eqNullSafe(F.col("__head")) & F.lag("__n").over(v).isNotNull(), F.lit(False)).cast("long"))
    ends = ends.withColumn("__before", F.coalesce(F.sum(F.col("__n") - F.col("__joined")).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = part.join(ends.select(key, "__b", "__before", "__joined"), [key, "__b"]).withColumn("run", F.col("__before") + F.col("__r") - F.col("__joined"))
    return got.groupBy(key, "run").agg(F.first(value).alias(value), F.sum("length").alias("length"), F.min("first").alias("first"), F.max("last").alias("last"))


def best_overlap(spans: DataFrame, labels: DataFrame, key: str, width: int = 86400) -> DataFrame:
    """Spans (key, start, end) with the overlapping label (key, left, right, label, confidence) of highest confidence.

    Both sides are dealt into buckets of `width` and joined on key and bucket, so a key with many rows is never compared
    as a whole; a pair counts in the bucket where its overlap begins. Ties go to the smaller label; a span without any
    keeps null. `width` should be near the usual length of a span.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    each = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(bucket(F.col(a)), F.greatest(bucket(F.col(b)), bucket(F.col(a))))))
    j = each(spans, "start", "end").join(each(labels, "left", "right"), [key, "bucket"])
    j = j.where((F.col("left") < F.col("end")) & (F.col("right") > F.col("start")) & (F.col("bucket") == bucket(F.greatest("start", "left"))))
    best = j.groupBy(key, "start", "end").agg(F.max("confidence").alias("c"), F.min_by("label", F.struct(-F.col("confidence"), "label")).alias("label"), F.count(F.lit(1)).alias("candidates"))
    return spans.join(best, [key, "start", "end"], "left").select(key, "start", "end", "label", F.col("c").alias("confidence"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def sweep(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, below, rate): how many values fall below each of a few thresholds, in one pass."""
    aggs = [F.count_if(F.coalesce(value, F.lit(0.0)) < t).alias(f"b{k}") for k, t in enumerate(thresholds)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"b{k}").alias("below")) for k, t in enumerate(thresholds)])
    got = one.select("n", F.explode(rows).alias("r")).select("r.threshold", "n", "r.below")
    return got.withColumn("rate", F.coalesce(F.try_divide("below", "n"), F.lit(0.0)))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order fixed by key and seed, whatever the partitions (O1)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """`df` with `part`, train or test: of every class the first floor(n x share) rows in an order fixed by key and seed (M1).

    Rows without a label are left out; repeated keys stand beside each other.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    got = ranked(df.where(F.col(label).isNotNull()).withColumn("__h", h), label, "__h", key)
    return got.select(*df.columns, F.when(F.col("__p") < F.floor(F.col("__n") * share), "train").otherwise("test").alias("part"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order: the sample size that a caller asks for."""
    return df.orderBy(*order).limit(n)
