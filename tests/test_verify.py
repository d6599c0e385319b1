from claimloom.config import Settings
from claimloom.operators import multilingual, verify
from pyspark.sql import functions as F

FACTS = [(1, "warm water", "TRUE", "Warm water aids digestion", "Low"), (2, "vaccines", "FALSE", "Vaccines do not cause autism", "High"), (3, "nothing", "TRUE", None, None)]
SCHEMA = "fact_id long, claim_subject string, verdict string, scientific_truth string, risk_level string"


def test_tier_one_and_answers(spark):
    facts = spark.createDataFrame(FACTS, SCHEMA)
    claims = spark.createDataFrame([(1, "warm water aids digestion"), (2, "zebra crossing paint"), (3, None), (4, "vaccines cause autism")], "qid long, claim string")
    got = {r.qid: r for r in verify.tier_one(claims, facts).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].match_type == "STRONG" and got[1].verdict == "TRUE" and got[1].fact_id == 1
    assert got[2].match_type == "NONE" and not got[2].match_found and got[2].verdict == "UNVERIFIED" and got[2].truth is None
    assert got[4].fact_id == 2 and got[4].verdict == "FALSE"
    a = spark.createDataFrame([(2, "```\nVerdict: FALSE\nConfidence: 0.9\nReason: paint\n```"), (1, "Verdict: FALSE\nConfidence: 1.0")], "qid long, answer string")
    w = {r.qid: r for r in verify.with_answers(verify.tier_one(claims, facts), a).collect()}
    assert (w[2].match_type, w[2].verdict) == ("LLM", "FALSE") and w[1].match_type == "STRONG" and w[1].verdict == "TRUE"
    assert verify.tier_one(claims, facts.where("false")).where("match_found").count() == 0


def test_index(spark, tmp_path):
    x = verify.VectorIndex(spark.createDataFrame([(1, [1.0, 0.0], "p1", "a.txt")], "id long, vec array<float>, passage string, source_file string"))
    x = x.add(spark.createDataFrame([(2, [0.0, 1.0], "p2", "b.txt")], "id long, vec array<float>, passage string, source_file string"))
    x.save(str(tmp_path / "ix"))
    r = verify.VectorIndex.load(spark, str(tmp_path / "ix")).search(spark.createDataFrame([(9, [0.1, 0.9])], "qid long, vec array<float>"), 1).first()
    assert (r.id, r.passage, r.source_file) == (2, "p2", "b.txt")


def test_softmax_and_gloss(spark):
    p = spark.createDataFrame([([1.0, 2.0, 1000.0],)], "x array<double>").select(verify.softmax(F.col("x"))).first()[0]
    assert abs(sum(p) - 1) < 1e-9 and p[2] > 0.99
    df = spark.createDataFrame([("2 cups of chai", "two cups", 0.9), ("500 mg roz", "500 mg daily", 0.8), ("x", None, 0.9), ("x", "हल", None)], "s string, g string, sim double")
    got = [r.r for r in df.select(multilingual.gloss_check(F.col("s"), F.col("g"), F.col("sim")).alias("r")).collect()]
    assert [r.accepted for r in got] == [False, True, False, False] and got[0].confidence == 0.7 and got[2].warnings == ["no text"]
    t = spark.createDataFrame([("Take Paracetamol 500mg roz",)], "s string").select(multilingual.transform_unprotected(F.col("s"), F.array(F.lit("Paracetamol")), F.upper)).first()[0]
    assert t == "TAKE Paracetamol 500mg ROZ"


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("CLAIMLOOM_STANDARD", "7")
    spark.conf.set("spark.claimloom.review_harm", "0.8")
    s = Settings.read(spark)
    assert s.standard == 7 and s.review_harm == 0.8 and s.deep == 15
    spark.conf.unset("spark.claimloom.review_harm")
