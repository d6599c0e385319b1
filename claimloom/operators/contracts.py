"""Contracts of models: what each is given and gives, as functions of columns, with what holds where there is none.

A model is an Arrow function in place of the default. None is fetched or trained here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx

Hook = Callable[..., Column] | None


@dataclass(frozen=True)
class Models:
    """The models of an engine; None takes the default named beside it.

    reader(claim, passage) -> struct(verdict, probability): shared words and negation (D3)
    reranker(claim, passage) -> double: shared words (D4)
    answers(claim) -> string: none (D5); explain(claim, explanation) -> string: the given explanation (D6)
    tokens(token) -> struct(label, confidence): word list (D8); transliterate(text) -> string: the text (D9)
    translate(text) -> string: none (D10); style(text) -> double: none (D12); media(id) -> struct(text, context, confidence): none (D15)
    probability(text) -> double: 0 (D17); language(text) -> struct(label, confidence): script and markers (D18)
    labeller(claim, explanation) -> string: none (D20)
    """

    reader: Hook = None
    reranker: Hook = None
    answers: Hook = None
    explain: Hook = None
    tokens: Hook = None
    transliterate: Hook = None
    translate: Hook = None
    style: Hook = None
    media: Hook = None
    probability: Hook = None
    language: Hook = None
    labeller: Hook = None


def token_label(t: Column, hook: Hook = None) -> Column:
    """struct(label, confidence) of a token (D8): what its characters tell, else the model's label in its stable form.

    Without a model Latin words of the word list are hi_Latn and others en, at 0.9 and 0.8. A label that is neither
    English nor Hindi is null: the caller fails closed.
    """
    sure = tx.token_tag(t)
    said = hook(t) if hook else F.struct(F.when(F.lower(t).isin(*lx.HINDI_ROMAN), "hi").otherwise("en").alias("label"), F.when(F.lower(t).isin(*lx.HINDI_ROMAN), 0.9).otherwise(0.8).alias("confidence"))
    low = F.replace(tx.casefold(said["label"].cast("string")), F.lit("label_"), F.lit(""))
    label = F.when(low.isin("hin", "hi", "hindi", "hi_latn"), "hi_Latn").when(low.isin("eng", "en", "english"), "en")
    return F.struct(F.when(sure == "latin", label).otherwise(sure).alias("label"), F.when(sure == "latin", said["confidence"].cast("double")).otherwise(F.lit(1.0)).alias("confidence"))


def tagged(text: Column, hook: Hook = None) -> Column:
    """array of struct(token, label, confidence): the tokens of a text with their languages."""
    return F.transform(tx.script_tokens(text), lambda t: F.struct(t.alias("token"), token_label(t, hook)["label"].alias("label"), token_label(t, hook)["confidence"].alias("confidence")))


def guarded(text: Column, tags: Column) -> Column:
    """The entities of a text that must stay as they are, sorted and distinct.

    Of the tags: sure English words, numbers with a unit, capitalised English words, words with a medical part; two
    characters at least. Of the text: capitalised words and dosages.
    """

    def keep(x: Column) -> Column:
        t, en = x["token"], x["label"] == "en"
        return (F.length(t) >= 2) & (en & (x["confidence"] > 0.95) | (x["label"] == "number_unit") | en & (x["confidence"] > 0.90) & t.rlike(r"^\p{Lu}") | tx.any_contained(t, lx.MEDICAL_WORDS))

    of_tags = F.transform(F.filter(tags, lambda x: F.coalesce(keep(x), F.lit(False))), lambda x: x["token"])
    return F.array_sort(F.array_distinct(F.concat(of_tags, tx.protected_entities(text))))


def english(gloss: Column, hook: Hook = None) -> Column:
    """Whether a gloss is in Latin letters and all of its words are English; false where that cannot be told."""
    words = F.filter(tagged(gloss, hook), lambda x: x["token"].rlike(r"\p{L}"))
    return F.coalesce((tx.script(gloss) == "Latin") & (F.size(words) > 0) & F.forall(words, lambda x: F.coalesce(x["label"] == "en", F.lit(False))), F.lit(False))


def multilingual(claims: DataFrame, models: Models = Models(), floor: float = 0.72) -> DataFrame:
    """claims (key, text, similarity) -> (key, text, script, canonical, gloss, accepted, confidence, style, warnings).

    The text is transliterated but for its guarded entities (D9) and translated (D10); a gloss is accepted if it is like
    enough, keeps every number, and is English. What a model does not give is a warning; nothing is taken for granted.
    """
    from . import multilingual as ml

    text = F.col("text")
    got = claims.withColumn("entities", guarded(text, tagged(text, models.tokens)))
    canonical = ml.transform_unprotected(text, F.col("entities"), models.transliterate) if models.transliterate else text
    gloss = models.translate(text) if models.translate else F.lit(None).cast("string")
    got = got.withColumn("canonical", canonical).withColumn("gloss", gloss)
    got = got.withColumn("check", ml.gloss_check(text, F.col("gloss"), F.col("similarity"), floor)).withColumn("english", english(F.col("gloss"), models.tokens))
    style = models.style(text).cast("double") if models.style else F.lit(None).cast("double")
    note = lambda c, s: F.when(c, F.array(F.lit(s))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(note(F.col("canonical").isNull(), "transliteration unavailable"), F.col("check.warnings"), note(F.col("gloss").isNotNull() & ~F.col("english"), "gloss not in English"), note(style.isNull() & F.lit(models.style is not None), "style unavailable"))
    return got.select("key", "text", tx.script(text).alias("script"), F.coalesce("canonical", text).alias("canonical"), "gloss", (F.col("check.accepted") & F.col("english")).alias("accepted"), F.col("check.confidence").alias("confidence"), style.alias("style"), notes.alias("warnings"))


def image(rows: DataFrame, fallback: Hook = None, floor: float = 0.65) -> DataFrame:
    """rows (id, text, confidence) -> (id, text, context, confidence, method): a poor first pass asks the fallback of the id.

    The fallback gives struct(text, context, confidence); a missing text keeps the first one, a missing confidence is 0.85.
    """
    if fallback is None:
        return rows.select("id", "text", F.lit(None).cast("string").alias("context"), "confidence", F.lit("first_pass").alias("method"))
    good = F.coalesce(F.col("confidence"), F.lit(0.0)) >= floor
    x = rows.withColumn("f", F.when(~good, fallback(F.col("id"))))
    return x.select("id", F.when(good, F.col("text")).otherwise(F.coalesce("f.text", "text")).alias("text"), F.when(~good, F.col("f.context")).alias("context"),
                    F.when(good, F.col("confidence")).otherwise(F.coalesce("f.confidence", F.lit(0.85))).alias("confidence"), F.when(good, "first_pass").otherwise("fallback").alias("method"))


def audio(rows: DataFrame, floor: float = 0.60) -> DataFrame:
    """rows (id, text, confidence) with needs_review where the transcript is unsure (F14); a missing confidence is unsure."""
    return rows.withColumn("needs_review", F.coalesce(F.col("confidence"), F.lit(0.0)) < floor)


def suggested_facts(rows: DataFrame, labeller: Hook = None) -> DataFrame:
    """rows (claim, explanation) -> facts for a review (P17, D20): verdict and risk from the model's answer, UNVERIFIED and Medium without one."""
    claim, why = F.coalesce("claim", F.lit("")), F.coalesce("explanation", F.lit(""))
    said = tx.fact_labels(labeller(claim, why) if labeller else F.lit(None).cast("string"))
    return rows.select(claim.alias("claim_subject"), said["verdict"].alias("verdict"), why.alias("scientific_truth"), said["risk"].alias("risk_level"), F.lit("multiple").alias("source"))


def language(text: Column, hook: Hook = None) -> Column:
    """struct(label, confidence) of a text (D18): the model's, or the script's code, Latin texts by marker words; unknown at 0."""
    s = tx.script(text)
    own = F.struct(F.when(s == "Unknown", "unknown").when(s == "Latin", tx.basic_language(text)).otherwise(tx.script_code(s)).alias("label"), F.when(s == "Unknown", 0.0).when(s == "Mixed", 0.5).otherwise(1.0).alias("confidence"))
    return F.coalesce(hook(text), own) if hook else own
