"""Claims in several languages: which text to analyse, what a translation must keep, spans left untouched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

FLOOR = 0.72


def gloss_check(source: Column, gloss: Column, similarity: Column, floor: float = FLOOR) -> Column:
    """struct(accepted, confidence, warnings) of an English gloss.

    Every number and address of the source must stand in it, it must be in Latin letters, and be like enough; a missing
    similarity is none. Each missing value costs 0.2 of the confidence.
    """
    blank = gloss.isNull() | (F.trim(gloss) == "")
    s = F.coalesce(similarity, F.lit(0.0))
    missing = tx.missing_values(source, gloss)
    notes = F.concat(
        F.transform(missing, lambda v: F.concat(F.lit("missing value: "), v)), F.when(s < floor, F.array(F.lit("low similarity"))).otherwise(F.array().cast("array<string>")),
        F.when(tx.script(gloss) != "Latin", F.array(F.lit("not in Latin letters"))).otherwise(F.array().cast("array<string>")))
    notes = F.when(blank, F.array(F.lit("no text"))).otherwise(notes)
    conf = F.when(blank, 0.0).otherwise(F.greatest(F.lit(0.0), s - 0.2 * F.size(missing)))
    return F.struct((F.size(notes) == 0).alias("accepted"), F.round(conf, 6).alias("confidence"), notes.alias("warnings"))


def analysis_text(original: Column, canonical: Column, gloss: Column, english: Column, accepted: Column) -> Column:
    """The text to analyse: the original of an English claim, else the accepted gloss, else the canonical text, else the original."""
    usable = lambda c: c.isNotNull() & (F.trim(c) != "")
    return F.when(english, original).when(accepted & usable(gloss), gloss).when(usable(canonical), canonical).otherwise(original)


def transform_unprotected(text: Column, protected: Column, change: Callable[[Column], Column]) -> Column:
    """The text with every token changed but the protected ones and those with digits."""
    parts = F.regexp_extract_all(text, F.lit(r"[\s\p{Z}]+|[^\s\p{Z}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"^[\s\p{Z}]+$") | t.rlike(r"\d") | F.array_contains(protected, t), t).otherwise(change(t))), "")
