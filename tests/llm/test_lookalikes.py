import random
import unicodedata

import pyarrow as pa
from claimloom.llm import lookalikes as lk
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "claim_key long, original_text string, canonical_indic_text string"


def canon(*texts):
    return lk.canonical_array(pa.array(texts, pa.string())).to_pylist()


def test_what_cannot_be_seen():
    same = [
        ("abc", "a​b⁠c"), ("a b", "a b"), ("a b", "a　b"), ("Doctor 5!", "Ｄｏｃｔｏｒ ５！"), ("pace", "расе"), ("suffer file", "suﬀer ﬁle"), ("é", "é"),
        ("ç", "ç"), ("K", "K"), ("bed-time", "bed‑time"), ("दो", "दाे"), ("ज़", "ज़"), ("आप", "अाप"), ("কো", "কো"), ("য়", "য়"), ("கொ", "கொ"),
        ("mạ̇", "mạ̇"), ("க்த", "க்‌த"), ("x\ny", "x\r\ny"), ("soft", "so­ft"),
    ]
    for a, b in same:
        x, y = canon(a, b)
        assert x == y, (a, b)


def test_what_can_be_seen():
    for a, b in [("a", "A"), ("e", "é"), ("i", "ı"), ("2", "²"), ("1/2", "½"), ("कं", "कँ"), ("ड", "ड़"), ("क्ष", "क्‌ष"), ("a b", "a  b"), ("a", "a!"), ("a b", "a\nb")]:
        x, y = canon(a, b)
        assert x != y, (a, b)


def test_nulls_empty_and_long():
    assert canon(None, "", "​", "a" * 300_000 + "​") == [None, "", "", "a" * 300_000]
    assert lk.canonical_array(pa.array([], pa.string())).to_pylist() == []
    sliced = pa.array(["x", "ａ", None, "é"], pa.string()).slice(1)
    assert lk.canonical_array(sliced).to_pylist() == ["a", None, "é"]


def plain(text):
    """Brute force over a small alphabet, character by character."""
    out = "".join("" if c in "​⁠" else " " if c in " 　" else lk.ALIKE.get(c, c) for c in text)
    return unicodedata.normalize("NFC", "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in out))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeȩ́́​⁠  ｂаор̣ч1"), max_size=12), max_size=6))
def test_against_brute_force(texts):
    got = canon(*texts)
    nfd = lambda t: unicodedata.normalize("NFD", t)
    assert [nfd(t) for t in got] == [nfd(plain(t)) for t in texts]
    assert canon(*got) == got


def test_pairs(spark, rows):
    rng = random.Random(2)
    base = ["pace of tea", "दो चाय", "plain"]
    forms = [lambda t: t, lambda t: t.replace(" ", " "), lambda t: t[:2] + "​" + t[2:], lambda t: t.replace("a", "а")]
    data = [(i, rng.choice(forms)(rng.choice(base)), None if i % 5 == 0 else rng.choice(forms)(rng.choice(base))) for i in range(1, 60)]
    data += [(100, "", "​"), (101, "​", None), (7, data[6][1], data[6][2])]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA + ", field string, look int")
    want = set()
    for f in (1, 2):
        c = canon(*[d[f] for d in data])
        for i in range(len(data)):
            for j in range(len(data)):
                if data[i][0] < data[j][0] and c[i] and c[i].strip() and c[i] == c[j] and data[i][f] != data[j][f]:
                    want.add((("original_text", "canonical_indic_text")[f - 1], data[i][0], data[j][0]))
    assert set(rows(lk.same_look(df, "claim_key", ["original_text", "canonical_indic_text"]))) == want
    assert rows(lk.same_look(spark.createDataFrame([], SCHEMA), "claim_key", ["original_text"])) == []


def test_every_coding_of_every_letter_has_one_form():
    every = [chr(o) for o in (*range(0xD800), *range(0xE000, 0x30000)) if unicodedata.category(chr(o)) != "Cn"]
    for form in ("NFD", "NFC"):
        other = [unicodedata.normalize(form, c) for c in every]
        bad = [c for c, x, y in zip(every, canon(*every), canon(*other), strict=True) if x != y]
        assert not bad, [hex(ord(c)) for c in bad[:9]]
    once = canon(*every)
    assert canon(*once) == once
    rng = random.Random(8)
    odd = [c for c in every if unicodedata.decomposition(c)] + ["\u0301", "\u0323", "a", "A"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 7))) for _ in range(20_000)]
    assert canon(*texts) == canon(*[unicodedata.normalize("NFD", x) for x in texts])


def test_letters_drawn_alike():
    for a, b in [("AOI", "\ua4ee\ua4f3\ua4f2"), ("i", "\u13a5"), ("op", "\u2c9f\u2ca3"), ("o", "\u1d0f"), ("v", "\u0475"), ("a,b!", "a\u201ab\u01c3"), ("a", "\U0001d5ba")]:
        x, y = canon(a, b)
        assert x == y == a, (a, b)
    x, y = canon("a", "\U0001d41a")  # bold can be seen
    assert x != y


def test_classes_and_hot_looks(spark, rows):
    data = [(k, "pace" if k % 2 else "p\u0430ce", None) for k in range(2, 60)] + [(60, "x", ""), (61, None, " "), (None, "pace", "q"), (62, "x", "q")]
    df = spark.createDataFrame(data, SCHEMA)
    got = rows(lk.look_classes(df, "claim_key", ["original_text", "canonical_indic_text"]))
    assert got == [("canonical_indic_text", 62, 1, 1), ("original_text", 2, 58, 2), ("original_text", 60, 2, 1)]
    assert lk.same_look(df, "claim_key", ["original_text"]).count() == 29 * 29
