import random
import re

from claimloom.llm import leaks

ITEMS = "item_id long, benchmark string, text string, answer string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_against_brute_force(spark, rows):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, "b", " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 20, 40]))), None) for i in range(20)]
    items.append((20, "b", items[3][2] + " tail end", "TRUE"))
    items += [(21, "b", "", None), (22, "b", None, None), (None, None, items[3][2], None)]
    docs = [(0, None), (1, ""), (2, "one two")]
    for i in range(3, 60):
        _, _, t, _ = rng.choice(items[:21])
        w = words(t)
        a = rng.randrange(len(w))
        piece = w[a:a + rng.choice([8, 11, 12, 13, 30])]
        noise = [rng.choice(vocab + ["other", "Words"]) for _ in range(10)]
        docs.append((i, ", ".join(noise) + "\n" + " -- ".join(x.upper() for x in piece) + ". " + " ".join(noise)))
    docs += [(3, docs[3][1]), (None, docs[3][1])]
    want = []
    for i, t in docs:
        d = " " + " ".join(words(t)) + " "
        for j, _, x, _ in items:
            w = words(x) if j is not None else []
            if any(" " + " ".join(w[k:k + 12]) + " " in d for k in range(len(w) - 11)):
                want.append((i, j))
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, ITEMS)
    assert rows(leaks.leaked_items(d, e)) == sorted(want, key=repr) and len(want) > 10
    assert rows(leaks.leaked_items(d, e, block_words=120)) == sorted(want, key=repr)
    assert rows(leaks.leaked_items(d.where("false"), e)) == [] and rows(leaks.leaked_items(d, e.where("false"))) == []
    assert leaks.leak_report(d, e).count() == len(items)


def test_spans_are_places_in_the_original():
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    p = leaks.Passages([(1, "text", item), (2, "answer", item)])
    text = "Before. ALPHA, beta\n" + item[11:] + "! After " + "x " * 100_000
    (a, b) = p.spans(text)
    assert a[:2] == (1, "text") and b[:2] == (2, "answer") and text[a[2]:a[3]].startswith("ALPHA") and text[a[2]:a[3]].endswith("nu")
    assert p.items(text) == {1} and p.items(None) == set()


def test_letters_that_grow_in_lower_case_and_many_words():
    item = "İstanbul beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    p = leaks.Passages([(1, "text", item)])
    text = f"İİ {item.replace(' ', ', ')}!"
    assert p.items(text) == {1}
    ((_, _, a, b),) = p.spans(text)
    assert text[a:b].startswith("İstanbul") and text[a:b].endswith("mu")
    many = [(k, "text", " ".join(f"w{k}x{j}" for j in range(20))) for k in range(8_000)]  # 160,000 different words
    assert leaks.Passages(many).items(many[7_777][2].upper()) == {7_777}
