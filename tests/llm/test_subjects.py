import random

import numpy as np
import pyarrow as pa
from claimloom.llm import subjects as s

DOCS, LABELS, AREAS = "doc_id long, text string", "doc_id long, area string, annotator string", "area string, title string"
WORDS = {
    "food": ("spinach lentils yoghurt calories fibre".split(), "supplied added replaced covered".split(), "vitamins minerals breakfast protein".split()),
    "law": ("tribunal court regulation petition licence".split(), "barred amended upheld postponed".split(), "injunction advert clause penalty".split()),
    "sport": ("goalkeeper sprinter coach marathon wrestler".split(), "won outpaced trained tightened".split(), "league medal lap endurance".split()),
}
FILLER = ["More details will follow.", "Opinions differ on this.", "Please come back later."]


def corpus(rng, n=600):
    docs, labels, truth = [], [], set()
    names = sorted(WORDS)
    for i in range(n):
        main, other = rng.sample(names, 2)
        count = {main: 10}
        kind = i % 3
        if kind == 1:
            count[other] = 4
        elif kind == 2:
            count[other] = 1  # a passing remark
        sents = [f"The {rng.choice(WORDS[a][0])} {rng.choice(WORDS[a][1])} the {rng.choice(WORDS[a][2])}." for a, k in count.items() for _ in range(k)]
        sents += [rng.choice(FILLER) for _ in range(4)]
        rng.shuffle(sents)
        docs.append((i, " ".join(sents)))
        total = sum(count.values())
        truth |= {(i, a) for a, k in count.items() if 5 * k >= total}
        if i < 120:
            labels.append((i, main if rng.random() > 0.08 else rng.choice(names), "r"))
    return docs, labels, truth


def test_areas_of_planted_documents(spark):
    docs, labels, truth = corpus(random.Random(1))
    docs += [(9001, None), (9002, ""), (9003, "More details will follow."), (9004, "\n".join(["The court barred the clause."] * 20_000))]
    labels += [(77777, "law", "r"), (3, None, "r"), (4, "unknown area", "r")]
    d = spark.createDataFrame([(*x, "x") for x in docs], DOCS + ", area string")
    got = {(r.doc_id, r.area) for r in s.document_areas(d, spark.createDataFrame(labels, LABELS), spark.createDataFrame([(a, a) for a in WORDS] + [(None, None)], AREAS)).collect()}
    assert (9004, "law") in got and not {i for i, _ in got} & {9001, 9002, 9003}
    got = {x for x in got if x[0] < 9000}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)


def test_empty(spark, rows):
    d, x, a = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS), spark.createDataFrame([("food", "f")], AREAS)
    assert rows(s.document_areas(d, x, a)) == [] and rows(s.corpus_by_area(d, x, a)) == [("food", 0, 0)]
    assert rows(s.document_areas(d, x, a.where("false"))) == []


def test_features_of_sentences():
    f, start, doc = s.features(pa.array(["One two three. Heading\nfour five!", None, "", "Six Seven eight 2.5 it's"], pa.string()))
    assert len(start) == 2 and doc.tolist() == [0, 0]
    assert np.diff(np.r_[start, len(f)]).tolist() == [5, 3]
    f, start, doc = s.features(pa.array(["Six Seven eight.", "É one, two!\" x", None], pa.string()))
    assert doc.tolist() == [0, 1] and np.diff(np.r_[start, len(f)]).tolist() == [3, 5]  # a capitalised word inside a sentence is left out
    a, b = s.features(pa.array(["the same words."])), s.features(pa.array(["x y.", "THE same Words!"]).slice(1))
    assert a[0].tolist()[:3] == b[0].tolist()


def test_calibration_on_held_out_labels(spark):
    docs, labels, _ = corpus(random.Random(2))
    got = s.calibration(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), spark.createDataFrame([(a, a) for a in WORDS], AREAS)).collect()
    assert len(got) == 3 and all(r.slope > 0 for r in got) and got[0].error < 0.1
