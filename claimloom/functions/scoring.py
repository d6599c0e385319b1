"""Scores as Spark columns: style, evidence quality, calibration, risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import S, W, any_contained, any_word, count_contained, squeeze


def _cap(n: Column, each: float, most: float) -> Column:
    return F.least(n * F.lit(each), F.lit(most))


def _causal(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?i)(?<!{W})(?:{lx.CAUSAL_VERBS})(?!{W}){S}+{W}+"))


def style_signals(c: Column) -> dict[str, Column]:
    """The ten style signals of a text."""
    upper = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    filled = F.length(F.replace(c, F.lit(" "), F.lit("")))
    ratio = F.try_divide(upper, filled)
    shouted = F.regexp_count(c, F.lit(rf"(?<!{W})[A-Z]{{3,}}(?!{W})"))
    marks = F.regexp_count(c, F.lit("!!+")) + F.regexp_count(c, F.lit(r"\?\?+"))
    n = F.size(F.split(squeeze(c), " "))
    causal = _causal(c)
    chain = F.regexp_count(c, F.lit(rf"(?i)(?<!{W}){W}+{S}+(?:{lx.CHAIN_FIRST}){S}+{W}+{S}+(?:{lx.CHAIN_SECOND}){S}+{W}+"))
    return {
        "uppercase": F.least(F.when(ratio > 0.5, 0.35).when(ratio > 0.15, 0.20).otherwise(0.0) + F.when(shouted >= 3, 0.20).when(shouted >= 1, 0.10).otherwise(0.0), F.lit(0.40)),
        "punctuation": F.when(marks >= 3, 0.30).when(marks == 2, 0.20).when(marks == 1, 0.10).otherwise(0.0),
        "keywords": F.least(_cap(count_contained(c, lx.STRONG_TERMS), 0.35, 0.35) + _cap(count_contained(c, lx.MIDDLE_TERMS), 0.20, 0.30) + _cap(count_contained(c, lx.WEAK_TERMS), 0.10, 0.20), F.lit(0.60)),
        "absolute": _cap(count_contained(c, lx.ABSOLUTES), 0.15, 0.30),
        "hedging": F.when(causal == 0, 0.0).when(any_contained(c, lx.HEDGES), -0.10).otherwise(0.20),
        "causal": _cap(causal, 0.10, 0.20),
        "causal_chain": _cap(chain, 0.20, 0.20),
        "authority": _cap(count_contained(c, lx.VAGUE_AUTHORITY), 0.15, 0.20),
        "pseudoscience": _cap(count_contained(c, lx.PSEUDOSCIENCE), 0.20, 0.30),
        "length": F.when(n <= 4, 0.04).when(n >= 80, 0.03).otherwise(0.0),
    }


def style_score(c: Column) -> Column:
    """The style score between 0 and 1; 0 for null and blank texts."""
    total = sum(list(style_signals(c).values())[1:], style_signals(c)["uppercase"])
    return F.when(c.isNull() | (F.trim(c) == ""), 0.0).otherwise(F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4))


def first_contained(c: Column, table: dict, otherwise) -> Column:
    """The value of the first key that the lower-cased text contains."""
    low = F.lower(c)
    out = None
    for k, v in table.items():
        cond = F.contains(low, F.lit(k))
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def file_tier(name: Column) -> Column:
    """The evidence tier of a file by its name's beginning, first rule first; 'journalism' for any other."""
    low = F.lower(name)
    out = F.when(name.isNull() | (name == ""), "journalism")
    for prefix, tier in lx.FILE_TIERS:
        out = out.when(low.startswith(prefix), tier)
    return out.otherwise("journalism")


def text_tier(c: Column) -> Column:
    """The first source named anywhere in the text."""
    return first_contained(c, {k: k for k in lx.SOURCE_WEIGHTS}, "journalism")


def recency(c: Column, year: Column | None = None, now: int = 2026) -> Column:
    """Recency of a text by its first year, 2020 where it has none; faster decay for fast-moving subjects."""
    found = F.regexp_extract(c, rf"(?<!{W})((?:19|20)\d\d)(?!{W})", 1)
    y = F.coalesce(year, F.when(found != "", found.cast("int")), F.lit(2020)) if year is not None else F.coalesce(F.when(found != "", found.cast("int")), F.lit(2020))
    age = F.greatest(F.lit(0), F.lit(now) - y)
    return F.when(any_contained(c, lx.FAST_MOVING), F.greatest(F.lit(0.2), 1.0 - age * 0.15)).otherwise(F.greatest(F.lit(0.5), 1.0 - age * 0.03))


def specificity(c: Column, subject: Column, outcome: Column) -> Column:
    """Whether the text holds subject and outcome; a missing one counts as held."""
    low = F.lower(c)
    none = lambda x: x.isNull() | (x == "")
    s, o = none(subject) | F.contains(low, F.lower(subject)), none(outcome) | F.contains(low, F.lower(outcome))
    return F.when(none(subject) & none(outcome), 0.70).when(s & o, 1.0).when(s | o, 0.65).otherwise(0.30)


def population_match(c: Column, population: Column) -> Column:
    """Whether the text is about a population: all of its wording, any word, none."""
    low, p = F.lower(c), F.lower(population)
    some = F.exists(F.filter(F.split(p, r"\s+"), lambda x: x != ""), lambda x: F.contains(low, x))
    return F.when(population.isNull() | (population == ""), 0.75).when(F.contains(low, p), 1.0).when(some, 0.65).otherwise(0.35)


def passage_quality(c: Column, subject: Column, outcome: Column, population: Column) -> Column:
    """Weighted quality of a passage."""
    tier = first_contained(c, lx.SOURCE_WEIGHTS, 0.50)
    return F.round(0.35 * tier + 0.20 * recency(c) + 0.25 * specificity(c, subject, outcome) + 0.20 * population_match(c, population), 4)


def harm(c: Column, confidence: Column, population: Column | None = None, confidence_floor: float = 0.60, harm_limit: float = 0.65) -> dict[str, Column]:
    """The two-axis assessment of a claim (X49, X50, F3, F12); a null claim is an empty one."""
    low = F.lower(F.coalesce(c, F.lit("")))
    override = any_word(low, lx.CESSATION)
    action = F.least(F.lit(1.0), 0.3 + count_contained(low, lx.ACTIONS) * 0.25)
    severity = F.when(any_contained(low, lx.SEVERE), 0.95).when(any_contained(low, lx.MODERATE), 0.65).otherwise(0.25)
    about = F.concat_ws(" ", low, F.lower(population)) if population is not None else low
    vulnerable = F.when(any_contained(about, lx.VULNERABLE), 0.90).otherwise(0.40)
    near = F.when(low.rlike("^(" + "|".join(lx.INSTRUCTIONS) + ")"), 0.90).otherwise(0.40)
    base = F.round(0.35 * severity + 0.30 * action + 0.20 * vulnerable + 0.15 * near, 4)
    axis = F.when(override, F.greatest(base, F.lit(0.95))).otherwise(base)
    return {
        "actionability": action, "severity": severity, "vulnerability": vulnerable, "proximity": near, "override": override, "harm_axis": axis,
        "priority": F.round(F.greatest(1.0 - confidence, axis), 4), "needs_review": override | (confidence < confidence_floor) | (axis >= harm_limit),
        "risk_level": F.when(axis >= 0.75, "CRITICAL / HIGH HARM").when(axis >= 0.45, "MEDIUM HARM").otherwise("LOW HARM"),
    }


def _lookup(table: dict, key: Column, otherwise: float) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(otherwise))


def fact_score(verdict: Column, match_type: Column, nli: Column, risk_level: Column, rag_verdict: Column | None = None, rag_confidence: Column | None = None) -> dict[str, Column]:
    """Fact score and reliability of a checked claim."""
    base = _lookup(lx.MATCH_RELIABILITY, F.upper(F.coalesce(match_type, F.lit("NONE"))), 0.35)
    rel = F.when(nli.isNull(), base).otherwise(F.round(base * F.least(F.greatest(0.5 + nli / 2.0, F.lit(0.55)), F.lit(1.0)), 4))
    score = _lookup(lx.VERDICT_SCORES, F.upper(F.coalesce(verdict, F.lit("UNVERIFIED"))), 0.30) * rel + 0.30 * (1.0 - rel)
    score = score + _lookup(lx.RISK_OFFSETS, F.upper(F.coalesce(risk_level, F.lit(""))), 0.0)
    if rag_verdict is not None:
        score = score + F.when((rag_verdict == "REFUTES") & (rag_confidence >= 0.80), 0.12).when((rag_verdict == "SUPPORTS") & (rag_confidence >= 0.80), -0.08).otherwise(0.0)
    return {"fact_score": F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4), "reliability": rel}


def combined_risk(verdict: Column, fact: Column, reliability: Column, style: Column, probability: Column | None = None, weight: float = 0.0) -> dict[str, Column]:
    """The one-axis risk: 0.6 fact and 0.4 style, style capped where a reliable fact holds.

    A model's probability, off by default, takes `weight` of the whole; a missing one counts as 0 (D17).
    """
    v = F.upper(F.coalesce(verdict, F.lit("UNVERIFIED")))
    capped = (F.when((v == "TRUE") & (reliability >= 0.80), F.least(style, F.lit(0.30)))
              .when(v.isin("PARTIALLY TRUE", "MIXED") & (reliability >= 0.75), F.least(style, F.lit(0.45))).otherwise(style))
    raw = 0.6 * fact + 0.4 * capped
    raw = F.least(raw if probability is None else (1.0 - weight) * raw + weight * F.coalesce(probability, F.lit(0.0)), F.lit(1.0))
    return {"risk": raw, "risk_label": F.when(F.round(raw, 2) >= 0.65, "high").when(F.round(raw, 2) >= 0.40, "moderate").otherwise("safe")}


def calibrated_confidence(quality: Column, agreement: Column, nli_sd: Column, population: Column) -> Column:
    """Logistic confidence of a verdict."""
    z = 2.5 * quality + 2.0 * agreement - 1.5 * nli_sd + 1.2 * population - 1.8
    return F.round(1.0 / (1.0 + F.exp(-z)), 4)


def verdict(confidence: Column, quality: Column, supports: Column, refutes: Column, agreement: Column, split: Column) -> Column:
    """The verdict that the evidence allows."""
    return (F.when((confidence < 0.45) | (quality < 0.35), "INSUFFICIENT_EVIDENCE").when(split, "SUPPORTED_WITH_CAVEATS")
            .when((supports > 0) & (refutes > 0) & (agreement < 0.70), "MIXED_EVIDENCE").when((refutes > supports) & (confidence >= 0.65), "FALSE")
            .when(refutes > supports, "MOSTLY_FALSE").when((supports > refutes) & (confidence >= 0.75), "SUPPORTED").when(supports > refutes, "MOSTLY_SUPPORTED")
            .otherwise("INSUFFICIENT_EVIDENCE"))


def explanation(verdict_: Column, confidence: Column, tier: Column, agreement: Column) -> Column:
    """One line on a verdict."""
    return F.format_string("Verdict: %s (Calibrated Confidence: %.2f%%, Best Tier: %s, Agreement Ratio: %.2f)", verdict_, confidence * 100, tier, agreement)


def stage_of_failure(predicted: Column, expected: Column, route: Column, lanes: Column, candidates: Column, reranked: Column, quality: Column) -> Column:
    """The stage to blame for a wrong verdict, 'SUCCESS' for a right one."""
    sure = expected.isin("SUPPORTED", "FALSE")
    return (F.when(predicted == expected, "SUCCESS").when((expected == "NOT_A_FACT_CHECK") & (route != "medical_advice"), "ROUTING_FAILURE")
            .when(F.coalesce(lanes, F.lit(0)) < 3, "QUERY_PLANNING_FAILURE").when(F.coalesce(candidates, F.lit(0)) == 0, "RETRIEVAL_FAILURE")
            .when(F.coalesce(reranked, F.lit(0)) == 0, "RERANKING_FAILURE").when((F.coalesce(quality, F.lit(0.0)) < 0.20) & sure, "EVIDENCE_QUALITY_FAILURE")
            .when(predicted.isin("INSUFFICIENT_EVIDENCE", "MIXED_EVIDENCE") & sure, "CALIBRATION_FAILURE").otherwise("NLI_FAILURE"))
