import pytest
from claimloom.functions import lexicons as lx
from claimloom.functions import scoring as sc
from claimloom.functions import text as tx
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_clean_claim(spark):
    t = one(spark, "Subah khali pet garam pani peene se weight loss hota hai!!! https://x.example/a", tx.clean_claim)
    assert t == "morning empty stomach warm water drinking from weight loss happens is!!"
    assert one(spark, "sar ke paas dard", tx.clean_claim) == "near were head pain"  # a phrase's English may be replaced in turn
    assert one(spark, None, tx.clean_claim) is None and one(spark, "", tx.clean_claim) == ""


def test_phrases_against_plain_python(spark):
    import re

    for text in ("éhai hai HAI, hai-pani garam paani ke liye", "the the gas mat kar karti hai", "khana" * 2000):
        want = text
        for a, b in lx.ORDERED_PHRASES:
            want = re.sub(rf"\b{re.escape(a)}\b", b, want, flags=re.I)
        assert one(spark, text, tx.replace_phrases) == want


@pytest.mark.parametrize("text,score", [("Warm water improves digestion.", 0.04), ("", 0.0), (None, 0.0), ("This ALWAYS cures cancer!!", None)])
def test_style(spark, text, score):
    got = one(spark, text, sc.style_score)
    assert got == score if score is not None else got > 0.6


def test_harm_golden_values(spark):
    def assess(text, conf):
        h = sc.harm(F.col("t"), F.lit(conf))
        return spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in h.items()]).first().asDict()

    a = assess("Warm water improves digestion.", 0.9)
    assert (a["harm_axis"], a["priority"], a["needs_review"], a["risk_level"]) == (0.3175, 0.3175, False, "LOW HARM")
    b = assess("Stop taking insulin immediately for your diabetes and take this herb", 0.95)
    assert b["harm_axis"] == 0.95 and b["override"] and b["needs_review"] and b["risk_level"] == "CRITICAL / HIGH HARM"
    assert assess(None, 0.9)["harm_axis"] == 0.3175


@pytest.mark.parametrize("args,fact,risk,label", [
    (("TRUE", "STRONG", 0.96, "Low", 0.30), 0.0, 0.12, "safe"), (("FALSE", "STRONG", 0.97, "High", 0.90), 1.0, 0.96, "high"), (("UNVERIFIED", "NONE", None, None, 0.10), 0.30, 0.22, "safe"),
    (("PARTIALLY TRUE", "WEAK", 0.82, "Medium", 0.30), None, 0.38, "safe")])
def test_legacy_risk_golden_values(spark, args, fact, risk, label):
    df = spark.createDataFrame([args], "v string, m string, n double, r string, s double")
    f = sc.fact_score(F.col("v"), F.col("m"), F.col("n"), F.col("r"))
    x = df.select("*", f["fact_score"].alias("f"), f["reliability"].alias("rel"))
    r = sc.combined_risk(F.col("v"), F.col("f"), F.col("rel"), F.col("s"))
    got = x.select("f", r["risk"].alias("risk"), r["risk_label"].alias("label")).first()
    assert (fact is None or got.f == pytest.approx(fact)) and round(got.risk, 2) == pytest.approx(risk, abs=0.011) and got.label == label


def test_calibration_golden_values(spark):
    df = spark.range(1)
    assert df.select(sc.calibrated_confidence(F.lit(0.85), F.lit(0.85), F.lit(0.0326599), F.lit(0.75))).first()[0] == pytest.approx(0.9466, abs=2e-4)
    v = lambda *a: df.select(sc.verdict(*[F.lit(x) for x in a])).first()[0]
    assert v(0.9, 0.8, 3, 0, 1.0, True) == "SUPPORTED_WITH_CAVEATS" and v(0.7, 0.3, 1, 0, 1.0, False) == "INSUFFICIENT_EVIDENCE"
    assert v(0.8, 0.8, 2, 2, 0.5, False) == "MIXED_EVIDENCE" and v(0.66, 0.8, 0, 2, 1.0, False) == "FALSE" and v(0.5, 0.8, 0, 1, 1.0, False) == "MOSTLY_FALSE"


def test_routes_and_safety_suite(spark):
    assert one(spark, "Should I stop my insulin?", tx.route) == "medical_advice" and one(spark, "Garlic cures flu", tx.route) == "fact_check"
    assert one(spark, "aur yeh whoever", lambda c: tx.any_word(c, ["who"])) is False
    assert one(spark, "salt and sugar cause harm aur dard", tx.sub_claims) == ["salt", "sugar cause harm", "dard"]


def test_scripts_tokens_and_entities(spark):
    assert one(spark, "हल्दी दूध", tx.script) == "Devanagari" and one(spark, "abc हल", tx.script) == "Mixed" and one(spark, "12 !", tx.script) == "Unknown"
    assert one(spark, "हल्दी, 500mg!", tx.script_tokens) == ["हल्दी", ",", "500mg", "!"]
    assert one(spark, "Take Paracetamol 500 mg", tx.protected_entities) == ["500 mg", "Paracetamol", "Take"]
    assert one(spark, "Paris 12.5 mg www.x.example", tx.structural_values) == ["12.5 mg", "www.x.example"]


def test_answers_and_small_tools(spark):
    r = one(spark, "Verdict: FALSE\nConfidence: 0.8\nReason: no proof\nmore", tx.parse_answer)
    assert (r.verdict, r.confidence, r.reason) == ("FALSE", 0.8, "no proof")
    assert one(spark, "this is accurate", tx.parse_answer).verdict == "TRUE"
    assert one(spark, "mixed", tx.normalize_verdict) == "PARTIALLY TRUE" and one(spark, None, tx.normalize_verdict) == "UNVERIFIED"
    assert one(spark, "https://a.example/b/c d.html/", tx.slug) == "c_d_html"
    assert one(spark, "```json\n{\"a\": 1}\n```", tx.strip_fences) == '{"a": 1}'
    assert one(spark, "Beer melts kidney stones.", tx.triple).asDict() == {"subject": "beer", "relation": "melts", "object": "kidney stones"}
    assert one(spark, "no verb here", tx.triple) is None
    assert one(spark, "Truth [NLI: x]", tx.kb_truth) == "Truth" and one(spark, "Unverified: y", tx.kb_truth) == ""
    assert one(spark, "Entailment", tx.nli_label) == "SUPPORTS"
