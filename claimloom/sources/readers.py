"""Sources: CSV, JSON, JSONL, text folders, binary media, pages; each with its schema, none inferred."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as lx
from ..functions import text as tx

CLAIMS = "claim string, label string"
FACTS = "claim_subject string, verdict string, scientific_truth string, risk_level string, source string"
UNREVIEWED = "claim string, explanation string"
GOLDEN = "id string, original_text string, expected_class string, language string, source string, source_label int, review_status string, reviewer string, evidence_urls array<string>, notes string"
REQUEST = "text string, input_type string, language string, mode string"
#: Rows of a lexicon file at most; a larger one is refused, not cut.
LEXICON_ROWS = 100_000
#: Files beside the articles that hold no article.
NOT_ARTICLES = r"^(passages|passage_sources|processed_files)"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, quoted fields over several lines allowed."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', lineSep="\n")


def labelled_claims(spark: SparkSession, path: str) -> DataFrame:
    """(claim, label int): rows with both; a label that is no number is dropped."""
    return csv(spark, path, CLAIMS).select("claim", F.col("label").try_cast("int").alias("label")).na.drop()


def training_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text, label): the label is risk_label, else label; KeyError where neither or no text column is there."""
    cols = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    if "text" not in cols or not {"risk_label", "label"} & set(cols):
        raise KeyError("columns text and risk_label or label are needed")
    name = "risk_label" if "risk_label" in cols else "label"
    return csv(spark, path, ", ".join(f"`{c}` string" for c in cols)).select(tx.normalize(F.col("text")).alias("text"), F.col(name).alias("label"))


def two_files(spark: SparkSession, fake: str, true: str, schema: str) -> DataFrame:
    """Rows of a file of false and a file of true news, labelled 1 and 0."""
    return csv(spark, fake, schema).withColumn("label", F.lit(1)).unionByName(csv(spark, true, schema).withColumn("label", F.lit(0)))


def named_labels(spark: SparkSession, path: str) -> DataFrame:
    """(text, label): Fake is 0 and Real is 1, the reverse of `labelled_claims`."""
    d = csv(spark, path, "text string, label string")
    v = F.when(F.lower("label") == "fake", 0).when(F.lower("label") == "real", 1).otherwise(F.col("label").try_cast("int"))
    return d.select("text", v.alias("label")).na.drop()


def lexicon(spark: SparkSession, path: str | None = None) -> list[tuple[str, str]]:
    """Phrases of a lexicon file over the built-in ones, longest first; the last row of a phrase holds.

    A lexicon is a small file made by hand; it is read to the driver, up to LEXICON_ROWS.
    """
    got = dict(lx.PHRASES_BUILT_IN)
    if path:
        rows = csv(spark, path, "hinglish string, english string, category string").limit(LEXICON_ROWS + 1).collect()
        if len(rows) > LEXICON_ROWS:
            raise ValueError(f"a lexicon has at most {LEXICON_ROWS} rows")
        for r in rows:
            a, b = (r.hinglish or "").strip().lower(), (r.english or "").strip().lower()
            if a and b:
                got[a] = b
    return sorted(got.items(), key=lambda x: -len(x[0]))


def json_array(spark: SparkSession, path: str, schema: str = FACTS) -> DataFrame:
    """A file with one array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str = GOLDEN) -> DataFrame:
    """A file with an object on each line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, line_no, passage): passages of the text files of a folder.

    Line numbers follow the file. A file that can't be read is skipped.
    """
    lines = spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    x = lines.select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split("value", r"\r\n|\r|\n")))
    x = x.where(~F.col("file_name").rlike(NOT_ARTICLES)).select("file_name", (F.col("pos") + 1).alias("line_no"), tx.strip(F.col("col")).alias("passage"))
    return x.where(tx.is_passage(F.col("passage")))


def media(spark: SparkSession, folder: str, read: Callable[[pd.Series], pd.DataFrame]) -> DataFrame:
    """(path, text, confidence) of images or sounds: `read` turns a series of bytes into a frame text, confidence."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])
    run = F.pandas_udf(lambda content: read(content), schema)
    return spark.read.format("binaryFile").load(folder).select("path", run("content").alias("r")).select("path", "r.*")


def requests(df: DataFrame) -> DataFrame:
    """Requests with a text; blank ones are refused."""
    return df.where(F.col("text").isNotNull() & (F.trim("text") != ""))


class _Main(HTMLParser):
    SKIP = {"script", "style", "nav", "aside", "figure", "button", "head"}
    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.head, self.title, self.parts = 0, 0, "", []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag == "h1" and not self.title:
            self.head = 1
        if tag in ("p", "div", "br", "li", "h1", "h2", "h3"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag == "h1":
            self.head = 0

    def handle_data(self, data):
        if self.head:
            self.title += data
        if not self.skip:
            self.parts.append(data)


def page_text(html: str | None) -> tuple[str | None, str]:
    """(title, text) of a page: first h1, text without scripts, styles, navigation."""
    if not html:
        return None, ""
    m = _Main()
    m.feed(html)
    body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(m.parts)))
    return (m.title.strip() or None), body.strip()


def pages(df: DataFrame, least_words: int = 150) -> DataFrame:
    """(url, slug, title, body) of pages (url, html) with at least `least_words` words."""
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])

    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_text(x) for x in html], columns=["title", "body"])

    x = df.where(tx.slug(F.col("url")) != "").select("url", tx.slug(F.col("url")).alias("slug"), F.pandas_udf(run, schema)("html").alias("p")).select("url", "slug", "p.*")
    named = F.coalesce("title", F.initcap(F.regexp_replace("slug", "[-_]+", " ")))
    return x.where(F.size(F.split(F.trim("body"), r"\s+")) >= least_words).select("url", "slug", named.alias("title"), tx.article_text(F.col("body")).alias("body"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(passage_index, passage, source_file): the two text files of an index, joined by the number of the line.

    A passage beyond the last source has none.
    """
    def lines(name: str, column: str) -> DataFrame:
        x = spark.read.text(f"{path}/{name}", wholetext=True).where("value != ''")
        return x.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("passage_index", column))

    return lines("passages", "passage").join(lines("passage_sources", "source_file"), "passage_index", "left")


#: Last parts of addresses that name no article (F16).
NOT_SLUGS = ("#", "health", "")


def addresses(spark: SparkSession, urls: list[str] | DataFrame) -> DataFrame:
    """(url): addresses of articles from a list or a table (url); those whose last part names none are left out."""
    df = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")
    last = F.element_at(F.split(F.rtrim(F.col("url"), F.lit("/")), "/"), -1)
    return df.where(F.col("url").isNotNull() & ~last.isin(*NOT_SLUGS))
