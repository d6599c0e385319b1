import random

from claimloom.llm import scans as s

SCHEMA = "raw_input_id string, extracted_text string, ocr_confidence double, metadata map<string,string>"
BODY = "the clinic checked the infant and the doctor monitored a stubborn fever before the holidays while the miracle-cure advertisement misled many families".split()


def test_lines_of_page_numbers():
    for x in ("12", "- 3 -", "Page 4 of 20", "p. 7", "[118]", "xiv", "iii", "9.", "— — — — Page 12 of 240 — — — —"):
        assert s.is_number_line(x), x
    for x in ("", "12 cases", "SUMMARY", "mild", "didn't.", "Serving grams", "in 3 of 9"):
        assert not s.is_number_line(x), x


def test_confusions_are_explained():
    assert all(s.coarse(a) == s.coarse(b) for a, b in s.CONFUSIONS)
    for true, read, n in (("said", "saicl", 1), ("fruit", "friiit", 1), ("iron", "1r0n", 2), ("communication", "cornrnunicatiori", 3), ("swimming", "svvirnrning", 3)):
        assert s.coarse(true) == s.coarse(read) and len(s.explained(true, read)[1]) == n
    assert s.explained("form", "from") is None and s.explained("a", "") is None and s.explained("said", "said") == (0.0, ())
    assert s.inverse("saicl")["said"] == ("d", "cl") and s.scaled(91.5) == 0.915 and s.scaled(None) is None


def pages(rng):
    """Pages of eight files with known damage."""
    data, want = [], set()
    for f in range(1, 9):
        for p in range(1, 9):
            i, lines = f"img-{f:09d}-{p:03d}", []
            lines += [f"The Ward Manual of Year    {p}", ""]
            want.add((i, 1, "running_line", ""))
            for k in range(12):
                w = [rng.choice(BODY) for _ in range(8)]
                n = len(lines) + 1
                if (f + p + 3 * k) % 16 == 0:
                    at = rng.choice([j for j, x in enumerate(w) if "e" in x and len(x) > 5] or [None])
                    if at is not None:
                        want.add((i, n, "misread", w[at]))
                        w[at] = w[at].replace("e", "c", 1)
                line = " ".join(w)
                if (p + k) % 4 == 0 and k < 11:
                    line += " moni-"
                    want.add((i, n, "split_word", "monitored"))
                    lines += [line, "tored " + " ".join(rng.choice(BODY) for _ in range(6))]
                elif (p + k) % 7 == 0 and k < 11:
                    want.add((i, n, "split_word", "miracle-cure"))
                    lines += [line + " miracle-", "cure " + " ".join(rng.choice(BODY) for _ in range(6))]
                else:
                    lines.append(line)
            lines += ["", f"Page {p}"]
            want.add((i, len(lines), "page_number", ""))
            data.append((i, "\n".join(lines), 0.9 if p % 2 else 88.0, {"file": f"scan-{f:09d}", "page": str(p)} if p != 3 else None))
    return data, want


def test_planted_damage_is_found(spark):
    data, want = pages(random.Random(7))
    data += [("img-000000009-001", "", None, None), ("img-000000009-002", None, None, {}), ("img-000000009-003", "word " * 40_000, float("nan"), None), (None, "12", None, None), ("odd name", "Some text", None, {})]
    df = spark.createDataFrame([(*d, "x") for d in data], SCHEMA + ", file string")
    got = {tuple(r) for r in s.defects(df).collect()}
    assert len(want - got) <= 0.02 * len(want) and len(got - want) <= 0.02 * len(want)
    text = {r.raw_input_id: r.text for r in s.repaired(df).collect()}
    assert text["img-000000009-001"] == "" and text["img-000000009-002"] == ""
    t = text["img-000000001-004"]
    assert "Manual" not in t and "Page" not in t and "moni-" not in t and "monitored" in t and "miracle-cure" in t


def test_empty(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert rows(s.defects(none)) == [] and rows(s.repaired(none)) == []


def test_names_by_their_letters():
    rng = random.Random(3)
    names = ["".join(rng.choice(["ba", "che", "di", "fo", "gu", "la", "she", "tu", "ne", "mi"]) for _ in range(3)) for _ in range(600)]
    letters = {}
    for n in names:
        for g in s.trigrams(n):
            letters[g] = letters.get(g, 0) + 1
    c = s.Channel({"said": 100}, {}, letters)
    read = lambda w: c.decode([("said", ["said"]), (w, [w])], 0.0)[1]
    assert read("Lafone") == "lafone" and read("Lafonc") == "lafone" and read("Lachetii") == "lachetu"


def test_words_below_the_share_are_proposed(spark, monkeypatch):
    data, _ = pages(random.Random(5))
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(BODY) for _ in range(14)) + "."
    for f in range(20):
        data.append((f"img-{f + 20:09d}-001", f"{line()}\nthe doctor checked a {'glaucorna' if f == 7 else 'glaucoma'} before\n{line()}", 0.9, None))
    monkeypatch.setattr(s, "SHARE", 5e-3)  # some 35 occurrences
    got = {tuple(r) for r in s.defects(spark.createDataFrame(data, SCHEMA)).collect()}
    assert ("img-000000027-001", 2, "misread", "glaucoma") in got
    assert not [x for x in got if x[3] == "glaucoma" and x[0] != "img-000000027-001"]


def test_long_second_and_closed_header_lines_recur_in_their_file(spark):
    rng = random.Random(9)
    data = []
    for p in range(1, 6):
        body = [" ".join(rng.choice(BODY) for _ in range(8)) for _ in range(8)]
        head = ["Ward Manual", "A Practical Handbook of Care for the Sick and the Convalescent at Home in Town and Country", "Printed by Brown and Sons Ltd."]
        data.append((f"img-000000001-{p:03d}", "\n".join([*head, *body, "and so for many more", "days.", f"Page {p}"]), 0.9, {"file": "f", "page": str(p)}))
    got = {tuple(r)[:3] for r in s.defects(spark.createDataFrame(data, SCHEMA)).collect()}
    for p in range(1, 6):
        assert {(f"img-000000001-{p:03d}", n, "running_line") for n in (1, 2, 3)} <= got
        assert (f"img-000000001-{p:03d}", 13, "running_line") not in got  # a word alone recurs by chance
