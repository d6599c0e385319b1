"""Records that are the same apart from formatting, collapsed with a count of copies.

Hot canonical keys are found exactly by partial counts, salted and aggregated in two levels; all other keys take one
shuffle. The representative of a group is its smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: A key is hot when it holds more than this share of all rows, so there are at most 1 / HOT_SHARE = 200,000 hot keys: a
#: few megabytes, whatever the table. No other key gives a task more rows than that share or HOT_ROWS.
HOT_SHARE = 1 / 200_000
#: Below so many rows a key is never hot: one task holds them easily.
HOT_ROWS = 20_000
SALTS = 64

#: Everything but letters, marks and digits goes; one mark directly between two digits stays (2.5 is not 25).
_LEFT_OUT = r"(?U)(?<!\p{Nd})[^\p{L}\p{M}\p{N}]|[^\p{L}\p{M}\p{N}](?!\p{Nd})|[\s\p{C}]"

FIELDS = ("claim", "label", "source", "language", "shares", "likes")
_ANY = "(?:" + "|".join(FIELDS) + ")"


def bare(c: Column) -> Column:
    """The letters and digits of a value in order, lower case; null becomes ''."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), _LEFT_OUT, "")


def record_fields(record: Column) -> dict[str, Column]:
    """The six fields of a raw record, whether JSON, `key: value | ...` or `key=value; ...`, in any key case and order.

    A field that the record lacks is null; a record in no known layout has only nulls.
    """
    pairs = F.from_json(F.when(F.ltrim(record).startswith("{"), record), "map<string,string>")
    pairs = F.transform_keys(pairs, lambda k, _: F.lower(F.trim(k)))

    def plain(name: str) -> Column:
        got = F.regexp_extract(record, rf"(?is)(?:^|[|;])\s*{name}\s*[:=]\s*(.*?)\s*(?=[|;]\s*{_ANY}\s*[:=]|[|;]?\s*$)", 1)
        return F.when(~F.ltrim(record).startswith("{") & (got != ""), got)

    return {name: F.coalesce(F.try_element_at(pairs, F.lit(name)), plain(name)) for name in FIELDS}


def digest(*parts: Column) -> Column:
    """A 128-bit key of several canonical values."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *parts)))


def keyed_claims(claims: DataFrame) -> DataFrame:
    """(id, key) of labelled claims; null and blank claims are left out, a null label equals another null label."""
    c = claims.where("claim is not null").where(F.regexp_replace("claim", r"(?U)[\s\p{C}]", "") != "")
    return c.select(F.col("claim_id").cast("long").alias("id"), digest(bare(F.col("claim")), bare(F.col("label"))).alias("key"))


def keyed_records(records: DataFrame) -> DataFrame:
    """(id, key) of raw records over their six fields; records with a null or blank claim are left out."""
    f = record_fields(F.col("record"))
    r = records.where("record is not null").select(F.col("record_id").cast("long").alias("id"), *[v.alias(k) for k, v in f.items()])
    r = r.where(F.regexp_replace(F.coalesce("claim", F.lit("")), r"(?U)[\s\p{C}]", "") != "")
    return r.select("id", digest(*[bare(F.col(k)) for k in FIELDS]).alias("key"))


def hot_keys(keyed: DataFrame, by: list[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """The keys with more than `share` of all rows and more than `least` rows, exactly.

    Counts are combined before the shuffle, so a hot key sends one row per task. At most 1 / share keys come out.
    """
    counts = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    total = keyed.agg((F.count(F.lit(1)) * share).alias("floor"))
    return counts.join(F.broadcast(total), F.col("n") > F.col("floor")).select(*by)


def split_hot(keyed: DataFrame, by: list[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(hot rows, other rows); the list of hot keys is bounded by 1 / share and broadcast."""
    hot = F.broadcast(hot_keys(keyed, by, share, least).select(*by))
    return keyed.join(hot, by, "left_semi"), keyed.join(hot, by, "left_anti")


def _two_level(hot: DataFrame, by: list[str]) -> DataFrame:
    salted = hot.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = salted.groupBy(*by, "salt").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return first.groupBy(*by).agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))


def collapse(keyed: DataFrame, by: list[str] | None = None, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """One row per key: `by`, keep_id (smallest id), copies (rows of the key). An empty input gives no rows."""
    by = by or ["key"]
    hot, rest = split_hot(keyed, by, share, least)
    one = rest.groupBy(*by).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return _two_level(hot, by).unionByName(one)


def copies_of(keyed: DataFrame, by: list[str] | None = None, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """One row for each record that is not the smallest id of its key: `by`, keep_id, copy_id.

    Hot keys are resolved by the salted aggregate and a broadcast of its few rows; the rest by one shuffle and a
    window. Rows with a repeated id and key count once.
    """
    by = by or ["key"]
    hot, rest = split_hot(keyed, by, share, least)
    few = _two_level(hot, by).select(*by, "keep_id")
    a = hot.join(F.broadcast(few), by)
    b = rest.withColumn("keep_id", F.min("id").over(Window.partitionBy(*by)))
    return a.unionByName(b, allowMissingColumns=True).where("id > keep_id").select(*by, "keep_id", F.col("id").alias("copy_id"))


def table_copies(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(tbl, keep_id, copy_id) over both tables; groups lie within one table."""
    both = keyed_claims(claims).withColumn("tbl", F.lit("final_health_claims")).unionByName(
        keyed_records(records).withColumn("tbl", F.lit("claim_records")))
    return copies_of(cut(both), ["tbl", "key"]).select("tbl", "keep_id", "copy_id")


def table_groups(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(tbl, keep_id, copies): every distinct record of both tables with its number of copies."""
    both = keyed_claims(claims).withColumn("tbl", F.lit("final_health_claims")).unionByName(
        keyed_records(records).withColumn("tbl", F.lit("claim_records")))
    return collapse(cut(both), ["tbl", "key"]).select("tbl", "keep_id", "copies")
