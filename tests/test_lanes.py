import numpy as np
import pyarrow as pa
import pytest
from claimloom.operators import lanes, metrics, pipeline, retrieval, verify
from claimloom.plans import retrieval as R
from pyspark.sql import functions as F

WORDS = "garlic water evidence not safe tea children pregnant advice health cures lowers pressure milk rice oil patients turmeric".split()


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(1, 9))) + f" n{rng.integers(0, 40)}" for _ in range(n)]


def _old(claims, passages, k):
    """Each lane searched for itself."""
    x = claims.select("qid", "claim", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("outcome"))
    x = retrieval.lanes(x).select((F.col("qid") * 8 + F.col("lane_no")).alias("qid"), "text")
    base = passages.where("text is not null").select(F.col("pid").alias("id"), verify.embed(F.col("text")).alias("vec"))
    b = retrieval.bm25(x, passages, k).select("qid", "pid", F.lit(0).alias("dense"), "rank")
    v = retrieval.neighbours(x.select("qid", verify.embed(F.col("text")).alias("vec")), base, k).select("qid", F.col("id").alias("pid"), F.lit(1).alias("dense"), "rank")
    return b.unionByName(v).select(F.floor(F.col("qid") / 8).alias("qid"), "pid", (2 * F.pmod("qid", F.lit(8)) + F.col("dense")).alias("seen"), "rank")


def test_lanes_together_as_each_for_itself(spark, rows, monkeypatch):
    p = spark.createDataFrame([*enumerate(_texts(300, 1), -50), (900, None), (901, ""), (902, "..."), (903, "garlic water"), (904, "garlic water")], "pid long, text string")
    q = spark.createDataFrame([*enumerate(_texts(25, 2)), (50, ""), (51, "  "), (52, "zebra unheard"), (53, None), (54, "garlic water"), (55, "garlic garlic GARLIC")], "qid long, claim string")
    want = rows(_old(q, p, 4))
    got = lambda: rows(pipeline.lane_hits(q, p, 4).select("qid", "pid", "seen", "rank"))
    assert got() == want
    monkeypatch.setattr(lanes, "BLOCK_BYTES", 20_000)  # several blocks of passages
    assert got() == want


@pytest.mark.parametrize("k", [3, 20])
def test_bounds_leave_nothing_out(monkeypatch, k):
    for name, n in (("_CHUNK", 8), ("_SAMPLE", 64), ("_FEW", 32)):
        monkeypatch.setattr(lanes, name, n)
    rng, n, dim = np.random.default_rng(5), 997, 8
    pid = rng.permutation(5 * n)[:n] - 100
    ends = rng.integers(-3, 4, (5, dim)).astype(float)
    ends[0] = 0
    lists = lambda x, kind: pa.array([list(y) for y in x], pa.list_(kind))
    full = lambda q: (np.full((q, 5, k), -np.inf), np.full((q, 5, k), lanes._NONE))
    # words
    texts = [rng.choice(40, rng.integers(0, 12), p=np.arange(1, 41)[::-1] / 820).tolist() for _ in range(n)]
    ways = [{int(t): float(w) for t, w in zip(rng.choice(40, 4, replace=False), rng.random(4) * 3 - 0.3, strict=True)} if lane else {} for lane in range(5)]
    x = lanes._Words(pa.table({"pid": pid, "w": lists(texts, pa.int64())}), 5.5, ways, np.arange(40))
    tf = np.array([np.bincount(t, minlength=40) if t else np.zeros(40) for t in texts])
    value = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * tf.sum(1) / 5.5)[:, None])
    for q in range(40):
        w = {int(t): float(v) for t, v in zip(rng.choice(40, 6, replace=False), rng.random(6) * 4 - 0.2, strict=True)}
        h = np.array(list(w))
        score, row = (y[0] for y in full(1))
        x.search((np.array(list(w.values())), lanes._find(x.rare[0], h), lanes._find(x.often, h), lanes._find(x.some[0], h)), True, score, row, k)
        for lane in range(5):
            s = np.round(value @ np.array([w.get(t, 0) + ways[lane].get(t, 0) for t in range(40)]), 9)
            assert row[lane].tolist() == pid[np.lexsort((-pid, -s))[:k]].tolist()
    # vectors
    sums = rng.integers(-3, 4, (n, dim)).astype(float)
    sums[::50] = 0
    v = lanes._Vectors(pa.table({"pid": pid, "v": lists(sums, pa.float64())}), ends, k)
    v.open()
    c = rng.integers(-2, 3, (30, dim)).astype(float)
    c[3], c[4] = 0, -ends[2]
    score, row = (y.reshape(-1, k) for y in full(30))
    v.search(c, score, row)
    unit = lambda y: y / np.maximum(np.sqrt((y * y).sum(-1, keepdims=True)), 1e-300)
    for q in range(150):
        d = np.round(((unit(c[q // 5] + ends[q % 5]) - unit(sums)) ** 2).sum(1), 9)
        assert row[q].tolist() == pid[np.lexsort((pid, d))[:k]].tolist()


def test_words_in_common(spark, rows):
    q = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c"]), (3, ["a"]), (4, None), (5, ["x", "y"])], "qid long, w array<string>")
    p = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "b", "z"]), (3, ["a", "z"]), (4, [])], "pid long, w array<string>")
    assert rows(lanes.in_common(q, p, 2)) == [(1, 2), (2, 2)]


@pytest.fixture
def folder(spark, tmp_path):
    claims = ["Turmeric lowers pressure strongly", "garlic cures", None, "turmeric pressure evidence", "rice oil", " ", "strongly turmeric milk"]
    facts = ["turmeric and pressure go strongly together", "evidence on pressure and turmeric", None, "milk with turmeric", "pressure pressure strongly"]
    spark.createDataFrame([(50 * k, t) for k, t in enumerate(claims, 1)] + [(7, "turmeric pressure")], "claim_id long, claim string").write.parquet(f"{tmp_path}/final_health_claims.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(facts)], "fact_id long, scientific_truth string").write.parquet(f"{tmp_path}/verified_facts.parquet")
    return str(tmp_path)


def _searched(monkeypatch):
    asked, search = [], pipeline.lane_hits
    monkeypatch.setattr(pipeline, "lane_hits", lambda claims, *a, **k: asked.append(sorted(r.qid for r in claims.collect())) or search(claims, *a, **k))
    return asked


def test_ablation_searches_once_and_only_what_counts(spark, rows, folder, monkeypatch):
    from claimloom.plans.verify import QUERIES

    q, f, gold = R.queries(spark, folder), R.facts(spark, folder), R.gold(spark, folder)
    cand = pipeline.candidates(R._claims(spark, folder), f)
    ways = {"lexical": retrieval.bm25(q, f, 15), "fused": cand.withColumnRenamed("rrf_rank", "rank"), "reranked": retrieval.rerank(cand, 15)}
    want = sorted((n, *(round(x, 6) for x in metrics.ranking(q, h.select("qid", "pid", "rank"), gold, (1,)).select("mrr", "recall_at_1").first()), 3) for n, h in ways.items())
    asked = _searched(monkeypatch)
    assert rows(QUERIES["ablation"](spark, folder)) == want
    assert asked == [[50, 200, 350]]  # the claims that share two long words with a fact


def test_lift_searches_once_and_only_what_counts(spark, folder, monkeypatch):
    from claimloom.plans.services import QUERIES

    q, gold, cand = R.queries(spark, folder), R.gold(spark, folder), pipeline.candidates(R._claims(spark, folder), R.facts(spark, folder))
    at = lambda h: metrics.ranking(q, h, gold, (1,))
    want = metrics.lift(at(cand.withColumnRenamed("rrf_rank", "rank")), at(retrieval.rerank(cand, 10_000))).first()
    asked = _searched(monkeypatch)
    assert tuple(QUERIES["rerank_lift"](spark, folder).first()) == tuple(round(x, 4) for x in want)
    assert asked == [[50, 200, 350]]
