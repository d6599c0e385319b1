import random

import pytest
from claimloom.llm import overlap as o
from hypothesis import given, settings
from hypothesis import strategies as st

CLAIMS = "claim_id long, claim string, split string, source string"
GOLD = "id string, original_text string, source string"
FACTS = "fact_id long, scientific_truth string, source string"


def distance(a, b):
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
        old = new
    return old[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9), st.integers(0, 4))
def test_edits_within(a, b, k):
    assert o.edits_within(a, b, k) == (distance(a, b) <= k)


def changed(rng, words, k):
    w = list(words)
    for _ in range(k):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[at] = f"new{rng.randrange(50)}"
        elif kind == 1:
            w.insert(at, f"new{rng.randrange(50)}")
        elif len(w) > 2:
            del w[at]
    return w


@pytest.mark.parametrize("hot", [o.HOT, 2])  # 2: nearly all lists are keyed by four terms
def test_pairs_agree_with_brute_force(spark, hot):
    rng = random.Random(5)
    texts = []
    for n in (3, 6, 7, 8, 9, 15, 16, 17, 23, 24, 40, 56, 60, 63, 64, 70, 130):
        for _ in range(4):
            base = [f"w{min(int(rng.paretovariate(0.8)), 3000)}" for _ in range(n)]
            texts += [changed(rng, base, rng.randrange(0, n // 8 + 2)) for _ in range(6)]
    data = [(i, " ".join(t), rng.choice(["train", "test", "validation", None]), "s") for i, t in enumerate(texts)]
    data += [(9001, None, "train", "s"), (9002, " ", "test", None), (9003, "...", "test", "s"), (9004, "...", "train", "s"), (9005, data[0][1], "test", None), (9006, data[0][1].upper() + "!", "train", "s")]
    facts = [(1, data[7][1], "f"), (1, data[7][1], "f"), (2, None, None)]
    gold = [("g1", data[12][1], "x"), ("g2", "", None)]
    got = {tuple(r) for r in o.overlap_pairs(spark.createDataFrame(data, CLAIMS), spark.createDataFrame(gold, GOLD), spark.createDataFrame(facts, FACTS), hot).collect()}
    norm = lambda t: (t or "").lower().replace("!", "").replace(".", "").split()
    left = [("final_health_claims", str(i), norm(t)) for i, t, s, _ in data if s in ("test", "validation")] + [("golden_candidates_v0", i, norm(t)) for i, t, _ in gold]
    right = [("final_health_claims", str(i), norm(t)) for i, t, s, _ in data if s == "train"] + [("verified_facts", str(i), norm(t)) for i, t, _ in facts]
    want = {(a, i, b, j) for a, i, x in left for b, j, y in right if x and y and 8 * distance(x, y) <= max(len(x), len(y))}
    assert got == want and len(want) > 50


def test_words(spark):
    df = spark.createDataFrame([("It's 2.5 g — Açaí's 10,000!",)], "t string")
    assert df.select(o.words(df.t)).first()[0] == ["its", "2.5", "g", "açaís", "10,000"]


def test_empty_sides_and_counts(spark, rows):
    none = spark.createDataFrame([], CLAIMS), spark.createDataFrame([], GOLD), spark.createDataFrame([], FACTS)
    assert rows(o.overlap_pairs(*none)) == [] and rows(o.overlap_counts(*none)) == []
    c = spark.createDataFrame([(1, "one two three", "train", "a"), (2, "One two three!", "train", "b"), (3, "one, two three", "test", "a"), (4, "ONE two three", "test", "a")], CLAIMS)
    assert rows(o.overlap_counts(c, none[1], none[2])) == [("final_health_claims", "test", "a", "final_health_claims", 2, 4)]
