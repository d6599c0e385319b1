import random

from claimloom.llm import copies as c
from pyspark.sql import functions as F

CLAIMS = "claim_id long, claim string, label string"
RECORDS = "record_id long, record string"


def test_bare_keeps_letters_digits_and_marks_between_digits(spark, rows):
    got = spark.createDataFrame([("Take 2.5 g, NOW!",), ("take 25 g now",), ("«É» x",), (None,), ("...",)], "t string").select(c.bare(F.col("t")))
    assert [r[0] for r in got.collect()] == ["take2.5gnow", "take25gnow", "éx", "", ""]


def test_layouts_give_the_same_fields(spark):
    texts = [
        '{"CLAIM" : "Tea, heals; all" , "label":"1","Source":"a","language":"EN","shares":3,"likes":"4"}',
        "label: 1 | claim: Tea, heals; all | source : A | language:en | shares:3 | likes : 4",
        'shares=3;\nlikes="4";claim="TEA, heals; all";label=1;source=a;language=en',
    ]
    f = c.keyed_records(spark.createDataFrame(list(enumerate(texts, 1)), RECORDS))
    assert f.count() == 3 and f.select("key").distinct().count() == 1


def test_found_with_nulls_blanks_ties_and_extra_columns(spark, rows):
    data = [(5, "A b.", "1"), (3, "a  B", " 1"), (9, "A-B", "(1)"), (4, "a b", "0"), (6, None, "1"), (7, "  ", "1"), (8, "A b", None), (2, "a B!", None), (3, "a  B", " 1")]
    df = spark.createDataFrame([(*x, "k", 1) for x in data], CLAIMS + ", key string, keep_id int")
    got = rows(c.table_copies(df, spark.createDataFrame([], RECORDS)))
    assert got == [("final_health_claims", 2, 8), ("final_health_claims", 3, 5), ("final_health_claims", 3, 9)]
    assert rows(c.table_copies(spark.createDataFrame([], CLAIMS), spark.createDataFrame([], RECORDS))) == []
    assert rows(c.table_groups(spark.createDataFrame([], CLAIMS), spark.createDataFrame([(1, None), (2, "nonsense"), (3, "")], RECORDS))) == []


def test_hot_keys_take_the_salted_way_and_agree_with_brute_force(spark, rows):
    rng = random.Random(3)
    data = [(i, "hot" if rng.random() < 0.35 else f"k{rng.randrange(400)}") for i in range(4000)]
    df = spark.createDataFrame(data, "id long, key string")
    hot = [r[0] for r in c.hot_keys(df, ["key"], 0.01, 100).collect()]
    assert hot == ["hot"]
    least, count = {}, {}
    for i, k in data:
        least[k], count[k] = min(least.get(k, i), i), count.get(k, 0) + 1
    assert rows(c.collapse(df, share=0.01, least=100)) == sorted(((k, least[k], count[k]) for k in least), key=repr)
    assert rows(c.copies_of(df, share=0.01, least=100)) == sorted(((k, least[k], i) for i, k in data if i != least[k]), key=repr)


def test_long_texts(spark, rows):
    long = "word, " * 50_000
    df = spark.createDataFrame([(1, long, "1"), (2, long.upper(), "1"), (3, long + "x", "1")], CLAIMS)
    assert rows(c.table_copies(df, spark.createDataFrame([], RECORDS))) == [("final_health_claims", 1, 2)]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"p{k}_found" for k in (1, 2, 3, 4, 5, 7, 8)} | {"p6_ids"} <= set(names) and set(e.oracle_sql()) <= set(names)
