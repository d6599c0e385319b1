"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of `folder`; columns and filters chosen later reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Only `columns` of the table, dealt over all cores (see `spread`)."""
    return spread(table(spark, folder, name).select(*columns))
