"""Session defaults, reliable lineage cuts and scan helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Applied by `build` only; a session handed in by a cluster keeps its own settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    b = SparkSession.builder.master(master).config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, where all executors can write and read.

    Without one, a local session, as in tests, takes a temporary folder; a cluster is refused, since a machine's own
    folder would be lost with the machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="claimloom-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/claimloom-{sc.applicationId}"


def place(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` written once, as a compressed table in the shared folder, and read from there: its lineage is cut.

    What is read later prunes columns and pushes filters down as on any table. The files survive the loss of an
    executor; `release` removes them.
    """
    at = place(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> bool:
    """Removes every table that `cut` wrote in this session; False if there was none. Results that read them end here."""
    p = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.delete(p, True))


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as the session has cores.

    A scan of few small files yields fewer tasks than cores; text work is CPU bound, so those rows are dealt out.
    A scan that has splits enough is left alone and costs no shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
