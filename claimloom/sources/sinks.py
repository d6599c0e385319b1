"""Sinks: tables, JSON, CSV, articles, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors with their passages as one table (K2, K3)."""
    df.withColumn("passage", F.regexp_replace("passage", "[\r\n]+", " ")).write.mode(mode).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """An object a line (K7, K8)."""
    df.write.mode("overwrite").json(path)


def predictions(df: DataFrame, path: str) -> None:
    """CSV with a header, every value as it is (K9)."""
    w = df.write.mode("overwrite").options(quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", lineSep="\n")
    w.csv(path, header=True)


def article_rows(df: DataFrame) -> DataFrame:
    """(file_name, content): articles (source, slug, title, url, body) as they are kept, header first (K6)."""
    head = F.format_string("SOURCE: %s\nTITLE: %s\nURL: %s\n%s\n", "source", "title", "url", F.lit("─" * 30))
    return df.select(F.concat_ws("__", "source", F.concat("slug", F.lit(".txt"))).alias("file_name"), F.concat(head, "body").alias("content"))


def manifest(df: DataFrame, path: str) -> None:
    """Names of processed files, written after what they stand for is durable (K4)."""
    df.select("file_name").distinct().write.mode("append").parquet(path)


def cache_state(df: DataFrame) -> DataFrame:
    """One row that tells whether a cache still holds: rows and newest change."""
    return df.agg(F.count(F.lit(1)).alias("entries"), F.max("_metadata.file_modification_time").alias("changed"))


def invalidate(spark: SparkSession, path: str) -> bool:
    """Removes a cached table; False if there was none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.delete(p, True))


def markdown(report: DataFrame, title: str) -> str:
    """All rows of a report as a Markdown table, taken to the driver a partition at a time; meant for aggregates."""
    head = report.columns
    rows = ("| " + " | ".join(str(x) for x in r) + " |" for r in report.toLocalIterator())
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *rows, ""])


def json_array(df: DataFrame, path: str) -> None:
    """One file with one array of objects, a line each, nulls kept (K7); rows stream through the driver a partition at a time, for reports."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = spark._jvm.java.io.OutputStreamWriter(p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True), "UTF-8")
    try:
        text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        before = "[\n"
        for r in df.select(text.alias("t")).toLocalIterator():
            out.write(before + r.t)
            before = ",\n"
        out.write("\n]\n" if before != "[\n" else "[]\n")
    finally:
        out.close()


def log(df: DataFrame, path: str, append: bool = True) -> None:
    """Lines (line) of a log, added to what is there or in its place (K1)."""
    df.select("line").write.mode("append" if append else "overwrite").text(path)


def sidecars(df: DataFrame, path: str) -> None:
    """Passages and their sources (id, passage, source_file) as two text files with a line each, in order of id.

    The old form of an index, one sorted file; `vectors` is the table that scales.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " ")
    rows = df.orderBy("id").select(flat("passage").alias("p"), flat("source_file").alias("s")).coalesce(1)
    rows.select("p").write.mode("overwrite").text(f"{path}/passages")
    rows.select("s").write.mode("overwrite").text(f"{path}/passage_sources")


def cache_valid(state: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: whether a kept state (entries, changed) is that of the source now (F23, K5); a missing one is not."""
    now = state.select(F.col("entries").alias("e"), F.col("changed").alias("c"))
    same = F.col("e").eqNullSafe(F.col("entries")) & F.col("c").eqNullSafe(F.col("changed"))
    return now.crossJoin(kept.select("entries", "changed")).agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("valid"))  # one row each
