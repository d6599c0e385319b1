"""Training: weighted words and word pairs, logistic regression, on splits that stay the same."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from . import metrics
from .records import stratified_split


def train_and_test(rows: DataFrame, key: str, size: int = 12_000, iterations: int = 1_500) -> DataFrame:
    """One row of weighted metrics on the held-out fifth of every class of rows (key, text, label in 0 and 1)."""
    rows = cut(stratified_split(rows.where("text is not null and label is not null").select(F.col(key).alias("key"), "text", "label"), "key", "label"))
    return train_across(rows.where("part = 'train'"), rows.where("part = 'test'"), size, iterations)


def vocabulary(rows: DataFrame, size: int = 12_000, least: int = 2) -> DataFrame:
    """(term, df, idf, number): the `size` most frequent words and word pairs of rows (key, text) in at least `least` texts (M2).

    idf = ln((1 + n) / (1 + df)) + 1. Of equally frequent terms the alphabetically first are kept; `size` bounds the table.
    """
    n = rows.where("text is not null").agg(F.count(F.lit(1)).alias("texts"))
    t = _grams(rows).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least).orderBy(F.desc("total"), "term").limit(size)
    w = Window.orderBy(F.desc("total"), "term")  # at most `size` rows
    return t.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1.0 + F.col("texts")) / (1.0 + F.col("df"))) + 1.0).alias("idf"), (F.row_number().over(w) - 1).alias("number"))  # one row broadcast


def _grams(rows: DataFrame) -> DataFrame:
    """(key, term, tf): words of two characters or more, and pairs of them."""
    w = rows.where("text is not null").select("key", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).otherwise(F.array().cast("array<string>"))
    return w.select("key", F.explode(F.concat("w", pairs)).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term, number, weight): sublinear TF-IDF of rows (key, text) over a vocabulary, each text at length 1 (M2)."""
    got = _grams(rows).join(F.broadcast(terms), "term")  # the vocabulary's size is a parameter
    got = got.withColumn("x", (1.0 + F.log("tf")) * F.col("idf"))
    norm = got.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return got.join(norm, "key").select("key", "term", "number", (F.col("x") / F.col("norm")).alias("weight"))


def features(rows: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """rows (key, text, label) with their TF-IDF as a sparse vector `features`; texts without any term have the zero vector."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    vector = F.udf(lambda x: Vectors.sparse(size, [(e.number, e.weight) for e in x or ()]), VectorUDT())
    got = tfidf(rows, terms).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("x"))  # the terms of one text
    return rows.join(got, "key", "left").withColumn("features", vector("x")).drop("x")


def train_across(train: DataFrame, test: DataFrame, size: int = 5_000, iterations: int = 100, path: str | None = None) -> DataFrame:
    """One row of weighted metrics on `test` of a balanced regression trained on `train`, both (key, text, label) of any domains (M3, M4).

    The model is saved at `path` with its vocabulary (K10).
    """
    clean = lambda df: df.where("text is not null and label is not null")
    train, test = clean(train), clean(test)
    terms = cut(vocabulary(train, size))
    w = metrics.class_weights(train, "label").select("label", "weight")
    model = LogisticRegression(labelCol="label", weightCol="weight", maxIter=iterations).fit(features(train, terms, size).join(F.broadcast(w), "label"))  # one row per class
    if path:
        model.write().overwrite().save(f"{path}/model")
        terms.write.mode("overwrite").parquet(f"{path}/vocabulary")
    got = model.transform(features(test, terms, size))
    return metrics.weighted(got.select(F.col("label").alias("y"), F.col("prediction").cast("int").alias("p")))


def predict(spark: SparkSession, path: str, rows: DataFrame, size: int = 5_000) -> DataFrame:
    """rows (key, text) with the prediction and probability of a saved model, a batch per Arrow slice."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.functions import vector_to_array

    model = LogisticRegressionModel.load(f"{path}/model")
    got = model.transform(features(rows, spark.read.parquet(f"{path}/vocabulary"), size))
    return got.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability"))
