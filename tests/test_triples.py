from claimloom.operators import triples as t
from pyspark.sql import functions as F


def parse(*rows):
    return [dict(zip(("i", "text", "lemma", "pos", "dep", "head"), (i, *r), strict=True)) for i, r in enumerate(rows)]


COMPOUND = parse(("beer", "beer", "NOUN", "compound", 3), ("melts", "melt", "NOUN", "compound", 3), ("kidney", "kidney", "NOUN", "compound", 3), ("stones", "stone", "NOUN", "ROOT", 3))
VERB = parse(("Warm", "warm", "ADJ", "amod", 1), ("water", "water", "NOUN", "nsubj", 3), ("not", "not", "PART", "neg", 3), ("aids", "aid", "VERB", "ROOT", 3), ("digestion", "digestion", "NOUN", "dobj", 3), ("and", "and", "CCONJ", "cc", 4), ("sleep", "sleep", "NOUN", "conj", 4), (".", ".", "PUNCT", "punct", 3))
PASSIVE = parse(("Cancer", "cancer", "NOUN", "nsubjpass", 2), ("is", "be", "AUX", "auxpass", 2), ("cured", "cure", "VERB", "ROOT", 2), ("by", "by", "ADP", "agent", 2), ("garlic", "garlic", "NOUN", "pobj", 3))
COPULA = parse(("Sugar", "sugar", "NOUN", "nsubj", 1), ("is", "be", "AUX", "ROOT", 1), ("a", "a", "DET", "det", 3), ("poison", "poison", "NOUN", "attr", 1))
INVERTED = parse(("paper", "paper", "NOUN", "compound", 2), ("cups", "cup", "NOUN", "compound", 2), ("block", "block", "NOUN", "nsubj", 3), ("arteries", "artery", "NOUN", "ROOT", 3))
PAIR = parse(("Tea", "tea", "NOUN", "ROOT", 0), ("for", "for", "ADP", "prep", 0), ("health", "health", "NOUN", "pobj", 1))


def test_strategies():
    assert t.extract(COMPOUND)[0] == ("beer", "melts", "melt", "kidney stones")
    assert t.extract(VERB) == [("Warm water", "not aids", "aid", "digestion"), ("Warm water", "not aids", "aid", "sleep")]
    assert t.extract(PASSIVE) == [("garlic", "cured", "cure", "Cancer")]
    assert t.extract(COPULA) == [("Sugar", "is", "be", "a poison")]
    assert ("paper cups", "block", "block", "arteries") in t.extract(INVERTED)
    assert t.extract(PAIR) == [("Tea", "associated with", "associate", "health")]
    assert t.extract(parse(("it", "it", "PRON", "nsubj", 1), ("helps", "help", "VERB", "ROOT", 1), ("them", "they", "PRON", "dobj", 1))) == []


def test_frame(spark):
    df = spark.createDataFrame([(1, VERB), (2, None), (3, [])], f"id int, p {t.PARSE}")
    got = {r.id: r.x for r in df.select("id", t.triples(F.col("p")).alias("x")).collect()}
    assert len(got[1]) == 2 and got[1][0].object == "digestion" and got[2] == [] and got[3] == []

    def split(texts):
        return texts.map(lambda x: [{"i": k, "text": w, "lemma": w, "pos": "NOUN", "dep": "ROOT", "head": k} for k, w in enumerate(x.split())])

    p = spark.createDataFrame([("a b",)], "s string").select(t.parsed(F.col("s"), split)).first()[0]
    assert [x.text for x in p] == ["a", "b"]
