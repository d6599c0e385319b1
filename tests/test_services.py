import datetime as dt
import json

from claimloom import session
from claimloom.operators import contracts, evidence, learning, metrics, records, reviews
from claimloom.functions import text as tx
from claimloom.sources import readers, sinks
from pyspark.sql import functions as F

T = [dt.datetime(2026, 1, 1, 0, k) for k in range(9)]


def test_review_queue(spark, rows):
    log = spark.createDataFrame([("a", "pending", "x", "FALSE", None, T[0]), ("b", "pending", None, None, None, T[1]), ("a", "pending", "y", "TRUE", None, T[2])], reviews.LOG)
    made = spark.createDataFrame([("a", "approved", "TRUE", "ok", T[3]), ("a", "rejected", "FALSE", "no", T[3]), ("zzz", "approved", None, None, T[4])], "request_id string, action string, verdict string, note string, at timestamp")
    log = log.unionByName(reviews.decide(log, made))
    assert rows(reviews.state(log).select("request_id", "status", "claim_text", "verdict", "note")) == [("a", "rejected", "y", "FALSE", "no"), ("b", "pending", None, None, None)]
    assert [r.request_id for r in reviews.pending(log).collect()] == ["b"]
    assert reviews.one(log, "zzz").count() == 0 and reviews.one(log, "a").count() == 1 and reviews.state(log.where("false")).count() == 0
    reps = spark.createDataFrame([(1, "FALSE", 0.9), (2, "FALSE", 0.4), (3, None, None), (4, "MIXED_EVIDENCE", 0.9)], "qid long, verdict string, confidence double")
    got = {r.qid: r for r in reviews.reviewed(reps, spark.createDataFrame([(4, "override_rejected", "TRUE", "n")], "qid long, action string, verdict string, note string")).collect()}
    assert [got[k].reviewed for k in (1, 2, 3, 4)] == [False, True, True, True] and got[1].action is None and got[2].action == "override_approved" and got[4].final_verdict == "TRUE"
    assert reviews.stamped(reps).select("request_id").distinct().count() == 4


def test_contracts_with_and_without_models(spark):
    df = spark.createDataFrame([(1, "Take Metformin 500 mg roz, blood test", 0.9), (2, None, None), (3, "", 0.1)], "key long, text string, similarity double")
    plain = {r.key: r for r in contracts.multilingual(df).collect()}
    assert plain[1].accepted is False and "no text" in plain[1].warnings and plain[1].canonical.startswith("Take") and plain[2].canonical is None
    m = contracts.Models(transliterate=F.upper, translate=lambda t: F.concat(F.lit("daily "), F.lower(t)), style=lambda t: F.lit(0.3), tokens=lambda t: F.struct(F.lit("English").alias("label"), F.lit(0.97).alias("confidence")))
    r = {x.key: x for x in contracts.multilingual(df, m).collect()}[1]
    assert r.accepted and r.style == 0.3 and not r.warnings and "Metformin 500" in r.canonical
    bad = contracts.Models(translate=F.lower, tokens=lambda t: F.struct(F.lit("klingon").alias("label"), F.lit(1.0).alias("confidence")))
    assert "gloss not in English" in {x.key: x for x in contracts.multilingual(df, bad).collect()}[1].warnings  # fails closed
    e = df.select(contracts.guarded(F.col("text"), contracts.tagged(F.col("text"))).alias("e")).first().e
    assert e == ["500", "500 mg", "Metformin", "Take", "blood", "mg"]
    img = spark.createDataFrame([("a", "t", 0.7), ("b", "t", 0.2), ("c", "t", None)], "id string, text string, confidence double")
    got = {x.id: (x.text, x.confidence, x.method) for x in contracts.image(img, lambda i: F.struct(F.when(i == "b", "better").alias("text"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("double").alias("confidence"))).collect()}
    assert got == {"a": ("t", 0.7, "first_pass"), "b": ("better", 0.85, "fallback"), "c": ("t", 0.85, "fallback")}
    assert contracts.image(img).where("method = 'first_pass'").count() == 3 and [x.needs_review for x in contracts.audio(img).orderBy("id").collect()] == [False, True, True]
    f = contracts.suggested_facts(spark.createDataFrame([(None, None), ("c", "e")], "claim string, explanation string")).collect()
    assert {(x.claim_subject, x.verdict, x.risk_level) for x in f} == {("", "UNVERIFIED", "Medium"), ("c", "UNVERIFIED", "Medium")}
    lang = [x.l.label for x in spark.createDataFrame([("yeh hai",), ("plain words",), ("नमस्ते",), ("123",)], "t string").select(contracts.language(F.col("t")).alias("l")).collect()]
    assert lang == ["hinglish", "en", "hin_Deva", "unknown"]


def test_text_forms(spark):
    df = spark.createDataFrame([("Straße ΣΑΣ", "BAAI/bge-M3 ", ' say "Hi"  there ')], "a string, b string, c string")
    r = df.select(tx.casefold(F.col("a")).alias("a"), tx.cache_key(F.col("b")).alias("b"), tx.token_pattern(F.lit("L"), F.col("c")).alias("c")).first()
    assert r.a == "Straße ΣΑΣ".casefold() and r.b == "baai_bge_m3" and json.loads(r.c) == {"label": "L", "pattern": [{"LOWER": "say"}, {"LOWER": '"hi"'}, {"LOWER": "there"}]}


def test_split_is_stratified_and_exact(spark):
    df = spark.createDataFrame([(k, "a" if k % 10 else "b") for k in range(1000)] + [(5, "a"), (1001, None)], "id long, label string")
    got = {(r.label, r.part): r.n for r in records.stratified_split(df, "id", "label").groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("a", "train"): 720, ("a", "test"): 181, ("b", "train"): 80, ("b", "test"): 20}
    assert records.stratified_split(df.where("false"), "id", "label").count() == 0 and records.head(df, 3, "id").count() == 3


def test_training_generalises_and_is_kept(spark, tmp_path):
    rows_ = [(str(k), ("garlic cures flu %d" if k % 2 else "doctors advise rest %d") % k, k % 2) for k in range(200)] + [("n", None, 1), ("m", "x", None)]
    df = spark.createDataFrame(rows_, "key string, text string, label int")
    assert learning.train_and_test(df, "key").first().accuracy > 0.95
    other = spark.createDataFrame([("1", "garlic cures all", 1), ("2", "doctors advise calm", 0), ("3", "", 0)], "key string, text string, label int")
    assert learning.train_across(df, other, path=str(tmp_path / "m")).first().accuracy >= 0.66
    got = {r.key: r.prediction for r in learning.predict(spark, str(tmp_path / "m"), other).collect()}
    assert got["1"] == 1 and got["2"] == 0 and len(got) == 3


def test_lane_metrics_lift_and_modes(spark, rows):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "qid long, pid long")
    hits = spark.createDataFrame([(1, 10, "a", 1), (1, 99, "a", 2), (2, 98, "a", 1), (2, 20, "b", 2)], "qid long, pid long, lane string, rank int")
    got = {r.lane: (r.recall_at_5, r.mrr, r.queries) for r in metrics.lane_report(q, hits, gold).collect()}
    assert got == {"a": (0.25, 0.5, 2), "b": (0.5, 0.25, 2)}
    one = lambda v: spark.createDataFrame([(v,)], "ndcg_at_10 double")
    assert metrics.lift(one(0.5), one(0.6)).first().lift_percent > 19.9 and metrics.lift(one(0.0), one(0.6)).first().lift_percent == 0.0
    m = {r.mode: (r.n, r.percent, r.latency) for r in metrics.modes(spark.createDataFrame([("fast", 1, 1, 0.5), ("deep", 1, 0, 1.5)], "mode string, y int, p int, latency double")).collect()}
    assert m == {"fast": (1, 50.0, 0.5), "standard": (0, 0.0, 0.0), "deep": (1, 50.0, 1.5)}


def test_files(spark, tmp_path, rows):
    df = spark.createDataFrame([("a\"b\n", None), (None, 1)], "t string, n int")
    sinks.json_array(df, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) in ([{"t": "a\"b\n", "n": None}, {"t": None, "n": 1}], [{"t": None, "n": 1}, {"t": "a\"b\n", "n": None}])
    sinks.json_array(df.where("false"), str(tmp_path / "y.json"))
    assert json.loads((tmp_path / "y.json").read_text()) == []
    sinks.sidecars(spark.createDataFrame([(2, "p\n2", "f2"), (1, "", None), (3, "p3", "f3")], "id long, passage string, source_file string"), str(tmp_path / "s"))
    assert rows(readers.sidecars(spark, str(tmp_path / "s"))) == [(0, "", ""), (1, "p 2", "f2"), (2, "p3", "f3")]
    assert rows(readers.addresses(spark, ["https://a.example/", "https://a.example/x/#", "https://b.example/t/", None])) == [("https://a.example/",), ("https://b.example/t/",)]


def test_tables_cut_are_removed(spark):
    import os

    d = session.cut(spark.range(3))
    assert d.count() == 3
    at = session.shared_folder(spark).removeprefix("file:")
    assert os.path.isdir(at)
    assert evidence.fast_summary(spark.createDataFrame([(1, "c", " ", None)], "qid long, claim string, truth string, nli_confidence double")).first().probability == 0.5
