import numpy as np
from claimloom.llm import languages as g
from pyspark.sql import functions as F

C = "claim_ref long, original_text string, language string"
M = "claim_key long, original_text string, source_language string"
EN = "The healer says that boiled {} water cures the fever of older people after dinner."
HG = "Gaon ke vaidya kehte hain ki {} ka ras peene se bukhar theek ho jata hai."
BN = "গ্রামের মানুষ বলেন সকালে {} খেলে জ্বর সেরে যায়।"
TEA = ["ginger", "lemon", "garlic", "cumin", "tulsi", "onion", "honey", "neem"]


def rows_of(n=60):
    data = []
    for i in range(n):
        t = TEA[i % 8]
        data += [(3 * i, EN.format(t), "en"), (3 * i + 1, HG.format(t), "hi-Latn"), (3 * i + 2, BN.format(t), " BN ")]
    return data


def test_label_spellings(spark):
    got = spark.createDataFrame([("ENG_LATN",), ("hi-Latn",), ("hin-Deva",), ("Hinglish",), (" ",), (None,), ("und",), ("urd_Arab",), ("bn-IN",)], "l string").select(g.label(F.col("l"))).collect()
    assert [r[0] for r in got] == ["en", "hinglish", "hi", "hinglish", "", "", "", "urd", "bn"]


def test_cases(spark, rows):
    data = rows_of()
    data += [(900, EN.format("fig"), None), (901, HG.format("fig"), "en"), (902, EN.format("fig") + " " + HG.format("fig") + " " + EN.format("plum"), "en"), (903, BN.format("fig") + " / " + EN.format("fig"), "bn"),
             (904, "12345 ???", None), (905, "", "en"), (906, None, None), (907, EN.format("kela aur dahi"), "English"), (902, EN.format("fig") + " " + HG.format("fig"), "en")]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], C + ", tbl string, id int")
    m = spark.createDataFrame([(1, HG.format("lemon"), "hin_Deva"), (2, EN.format("lemon"), "auto")], M)
    got = rows(g.wrong_labels(df, m))
    assert got == sorted([("canonical_claims", 900, 1, "en"), ("canonical_claims", 901, 1, "hinglish"), ("canonical_claims", 902, 1, "en"), ("canonical_claims", 902, 2, "hinglish"), ("canonical_claims", 902, 3, "en"),
                          ("canonical_claims", 903, 1, "bn"), ("canonical_claims", 903, 2, "en"), ("canonical_claims", 902, 1, "en"), ("canonical_claims", 902, 2, "hinglish"), ("multilingual_claims", 2, 1, "en")], key=repr)
    assert all(0 < r.confidence <= 1 for r in g.claim_languages(df, m).collect())


def test_held_out_accuracy_with_wrong_labels():
    data = [(t, {"en": "en", "hi-Latn": "hinglish", " BN ": "bn"}[x] if i % 9 else "en") for i, (_, t, x) in enumerate(rows_of())]
    model = g.fit(data, np.ones(g.DIM, np.int64))
    seg = g.Segmenter(model)
    _, _, lang, _ = seg.run([EN.format("papaya"), HG.format("papaya"), BN.format("papaya"), "word " * 50_000])
    assert [g.LANGUAGES[k] for k in lang[:3]] == ["en", "hinglish", "bn"]


def test_empty(spark, rows):
    assert rows(g.wrong_labels(spark.createDataFrame([], C), spark.createDataFrame([], M))) == []
    assert rows(g.wrong_labels(spark.createDataFrame([(1, "some words here", None)], C), spark.createDataFrame([], M))) == []  # nothing to learn from


def test_languages_that_are_not_known_are_rejected():
    data = [(t, {"en": "en", "hi-Latn": "hinglish", " BN ": "bn"}[x]) for _, t, x in rows_of()]
    texts = [t for t, _ in data]
    joined = np.zeros(g.DIM, np.int64)
    words = [w for t in texts for w in g.words_of(t)]
    row, bucket = g._grams(words)
    np.add.at(joined, np.unique(row * g.DIM + bucket) % g.DIM, 1)
    seg = g.Segmenter(g.fit(data, joined))
    foreign = ["Le chat est assis sur la table et regarde la neige qui tombe", "El perro corre por el parque y los niños juegan con la pelota", "Der Hund läuft schnell durch den Wald und die Kinder spielen",
               "Кошка сидит на столе и смотрит в окно", "આજે હવામાન સારું છે અને અમે બગીચામાં જઈશું"]
    assert not len(seg.run(foreign)[0])
    assert len(seg.run([EN.format("fig"), HG.format("fig"), BN.format("fig")])[0]) == 3
