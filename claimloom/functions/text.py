"""Text operators as Spark columns: cleaning, tokens, routing, scripts, entities, parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx

#: A word character; combining marks are none.
W = r"[\p{L}\p{N}_]"


def words(c: Column) -> Column:
    """Runs of word characters of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({W}+)"), F.lit(1))


#: White space of any kind.
S = r"[\s\p{Z}]"


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{S}+", " "))


def strip(c: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(c, f"^{S}+|{S}+$", "")


def replace_phrases(c: Column, phrases: list[tuple[str, str]] | None = None, lowered: bool = False) -> Column:
    """Ordered replacement of whole phrases, each over the result of the one before.

    A phrase is first looked for as plain text, so a text pays for the patterns only of phrases that it may hold.
    `lowered` says that the text is in lower case already, as the English of the phrases is.
    """
    low = (lambda x: x) if lowered else F.lower
    rows = F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(rf"(?i)(?<!{W})\Q{s}\E(?!{W})").alias("p"), F.lit(t).alias("t")) for s, t in phrases or lx.ORDERED_PHRASES])
    return F.aggregate(rows, c, lambda acc, x: F.when(F.contains(low(acc), x["s"]), F.regexp_replace(acc, x["p"], x["t"])).otherwise(acc))


def clean_claim(c: Column) -> Column:
    """A claim in plain lower-case words, romanised Hindi phrases in English (P1). Null stays null."""
    t = F.trim(F.lower(c))
    t = F.regexp_replace(t, r"http\S+|www\S+", "")
    t = F.replace(t, F.lit("-"), F.lit(" "))
    t = replace_phrases(t, lowered=True)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s\p{Z},.!?]", " ")
    return squeeze(F.regexp_replace(t, r"(.)\1{2,}", "$1$1"))


def normalize(c: Column) -> Column:
    """Lower case, single blanks, runs of ! and ? as one !."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), f"{S}+", " "), "[!?]{2,}", "!"))


def plain_terms(c: Column) -> Column:
    """Terms for a bag of words: addresses and everything but a-z and 0-9 dropped, longer than one character."""
    t = F.regexp_replace(F.trim(F.lower(c)), r"http\S+|www\S+", "")
    return F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", ""), r"\s+", " ")), " "), lambda x: F.length(x) > 1)


def article_text(c: Column) -> Column:
    """Lines of an article worth keeping: long ones, without page noise unless they state a result."""
    lines = F.transform(F.split(c, r"\r\n|\r|\n"), strip)
    kept = F.filter(lines, lambda x: (F.length(x) >= 35) & (~x.rlike(f"(?i)({lx.PAGE_NOISE})") | x.rlike(f"(?i)({lx.PAGE_KEEP})")))
    return F.array_join(kept, "\n")


def slug(c: Column) -> Column:
    """The last part of an address as a file name of at most 80 characters (P5)."""
    return F.left(F.regexp_replace(F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1), "[^A-Za-z0-9_-]", "_"), F.lit(80))


def is_passage(line: Column) -> Column:
    """Whether a trimmed line is a passage: 20 characters, not all upper case, no header, no rule (F1)."""
    shouting = (F.upper(line) == line) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    return (F.length(line) >= 20) & ~shouting & ~line.rlike("^(SOURCE:|URL:|TITLE:)") & ~F.contains(line, F.lit("─"))


def any_word(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs as whole words of the lower-cased text."""
    return F.lower(c).rlike(rf"(?<!{W})(?:{'|'.join(patterns)})(?!{W})")


def count_contained(c: Column, terms: list[str]) -> Column:
    """How many of the terms the lower-cased text contains."""
    low = F.lower(c)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms[1:]), F.contains(low, F.lit(terms[0])).cast("int"))


def any_contained(c: Column, terms: list[str]) -> Column:
    low = F.lower(c)
    out = F.contains(low, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(low, F.lit(t))
    return out


def route(raw: Column) -> Column:
    """'medical_advice' for a personal question, else 'fact_check' (F2)."""
    return F.when(any_word(raw, lx.ADVICE), "medical_advice").otherwise("fact_check")


def basic_language(c: Column) -> Column:
    """'hinglish' if any marker word occurs, else 'en' (X13)."""
    return F.when(F.arrays_overlap(words(c), F.array(*[F.lit(x) for x in lx.HINGLISH_MARKERS])), "hinglish").otherwise("en")


def is_hinglish(c: Column) -> Column:
    """At least two romanised Hindi words and two plain Latin words."""
    w = F.split(squeeze(F.lower(c)), " ")
    return (F.size(F.filter(w, lambda x: x.isin(*lx.HINDI_ROMAN))) >= 2) & (F.size(F.filter(w, lambda x: x.rlike("^[a-z]+$"))) >= 2)


def sub_claims(c: Column) -> Column:
    """The parts of a cleaned claim between and, aur, evam; the claim itself if nothing is left."""
    parts = F.filter(F.transform(F.split(c, rf"(?<!{W})(?:and|aur|evam)(?!{W})"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def _in_script(ranges: tuple) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def scripts(c: Column) -> Column:
    """The scripts that occur in a text, in the order of the table, Latin last."""
    flags = [F.when(c.rlike(_in_script(r)), F.lit(n)) for n, r in lx.SCRIPTS.items()]
    return F.array_compact(F.array(*flags, F.when(c.rlike("[A-Za-z]"), F.lit("Latin"))))


def script(c: Column) -> Column:
    """The script of a text, 'Mixed' for several, 'Unknown' for none."""
    s = scripts(c)
    return F.when(F.size(s) == 0, "Unknown").when(F.size(s) > 1, "Mixed").otherwise(F.try_element_at(s, F.lit(1)))


def script_code(s: Column) -> Column:
    """The language code of a script; eng_Latn for any other value."""
    table = F.create_map(*[F.lit(x) for kv in lx.SCRIPT_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, s), F.lit("eng_Latn"))


#: A run of characters other than blanks and punctuation, or one punctuation mark.
TOKEN = r"[!-/:-@\[-`{-~।॥]|[^\s\p{Z}!-/:-@\[-`{-~।॥]+"


def script_tokens(c: Column) -> Column:
    """Tokens with Indic marks kept in their words; punctuation marks stand alone."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_tag(t: Column) -> Column:
    """What a token is, as far as its characters tell: number_unit, hi_Deva, other_Indic, other, or latin."""
    indic = "|".join(_in_script(r) for n, r in lx.SCRIPTS.items() if n != "Devanagari")
    return (F.when(t.rlike(r"(?i)^(https?://|www\.)"), "entity").when(t.rlike(r"^\d+(?:[.,]\d+)?[A-Za-z%]*$"), "number_unit")
            .when(t.rlike(_in_script(lx.SCRIPTS["Devanagari"])), "hi_Deva").when(t.rlike(indic), "other_Indic").when(t.rlike("[A-Za-z]"), "latin").otherwise("other"))


def protected_entities(c: Column) -> Column:
    """Capitalised words and dosages, sorted and distinct."""
    caps = F.regexp_extract_all(c, F.lit(rf"(?<!{W})[A-Z][a-z]+(?!{W})"), F.lit(0))
    dose = F.regexp_extract_all(c, F.lit(lx.DOSAGE), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(caps, dose)))


def structural_values(c: Column) -> Column:
    """Numbers with their unit and addresses, lower case, sorted and distinct."""
    num = F.transform(F.regexp_extract_all(c, F.lit(lx.QUANTITY), F.lit(0)), lambda x: F.trim(F.lower(x)))
    url = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)https?://\S+|www\.\S+"), F.lit(0)), lambda x: F.lower(x))
    return F.array_sort(F.array_distinct(F.concat(num, url)))


def missing_values(source: Column, other: Column) -> Column:
    """Structural values of the source that the other text lacks."""
    low = F.lower(F.coalesce(other, F.lit("")))
    return F.filter(structural_values(source), lambda x: ~F.contains(low, x))


def normalize_verdict(v: Column) -> Column:
    """A verdict label in its stable form; null is UNVERIFIED."""
    u = F.upper(F.trim(v))
    return F.when(v.isNull(), "UNVERIFIED").when(u.isin("MIXED", "PARTIAL", "PARTIALLY_TRUE"), "PARTIALLY TRUE").otherwise(u)


def nli_label(v: Column) -> Column:
    """A model's label as SUPPORTS, REFUTES or NEI."""
    table = F.create_map(*[F.lit(x) for kv in lx.NLI_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(v)), F.lit("NEI"))


def parse_answer(c: Column) -> Column:
    """struct(verdict, confidence, reason) of a model's free-text answer, with keyword fallback."""
    said = F.upper(F.regexp_extract(c, lx.ANSWER_VERDICT, 1))
    low = F.lower(c)
    guess = F.when(low.rlike(lx.ANSWER_FALSE), "FALSE").when(low.rlike(lx.ANSWER_TRUE), "TRUE").otherwise("UNVERIFIED")
    number = F.regexp_extract(c, lx.ANSWER_CONFIDENCE, 1)
    sure = F.when(number != "", F.least(F.greatest(number.try_cast("double"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5))
    why = F.trim(F.split(F.trim(F.regexp_extract(c, lx.ANSWER_REASON, 1)), "\n")[0])
    return F.struct(F.when(said != "", said).otherwise(guess).alias("verdict"), sure.alias("confidence"), F.when(why != "", why).otherwise(F.trim(c)).alias("reason"))


def kb_truth(c: Column) -> Column:
    """The truth of a knowledge-base answer without its model note; '' where it is unverified."""
    t = F.when(F.contains(c, F.lit(" [NLI:")), F.split_part(c, F.lit(" [NLI:"), F.lit(1))).otherwise(c)
    return F.when(c.isNull() | c.startswith("Unverified:"), "").otherwise(t)


def strip_fences(c: Column) -> Column:
    """A model's answer without code fences and quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*|\s*```$", ""), "^[\"']+|[\"']+$", ""))


def has_token(c: Column, token: Column) -> Column:
    """Whether the text holds the token as a whole, in any case."""
    return F.array_contains(F.regexp_extract_all(F.lower(c), F.lit(f"({W}+)"), F.lit(1)), F.lower(token))


def retrieval_queries(gloss: Column, canonical: Column, original: Column) -> Column:
    """Texts to search with, blank and repeated ones left out, order kept."""
    return F.array_distinct(F.filter(F.array(gloss, canonical, original), lambda x: x.isNotNull() & (F.trim(x) != "")))


def triple(c: Column) -> Column:
    """struct(subject, relation, object) split at the first action word; null where a side is empty or trivial.

    An approximation that needs no parser: tokens before the first action word, the word, tokens after it.
    """
    w = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s'-]", " ")), r"\s+"), lambda x: x != "")
    at = F.array_position(F.transform(w, lambda x: x.isin(*lx.ACTION_WORDS)), True)
    subject = F.array_join(F.slice(w, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))), " ")
    obj = F.array_join(F.slice(w, F.greatest(at.cast("int") + 1, F.lit(1)), F.size(w)), " ")
    ok = (at > 0) & (subject != "") & (obj != "") & (subject != obj) & ~obj.isin(*lx.TRIVIAL_OBJECTS)
    return F.when(ok, F.struct(subject.alias("subject"), F.try_element_at(w, at.cast("int")).alias("relation"), obj.alias("object")))


def casefold(c: Column) -> Column:
    """The text without case: as lower case, with letters such as ß and final sigma in their common form."""
    return F.replace(F.lower(F.upper(F.replace(c, F.lit("ß"), F.lit("ss")))), F.lit("ς"), F.lit("σ"))


def cache_key(c: Column) -> Column:
    """A model's name as a key of its caches (X11)."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def token_pattern(label: Column, phrase: Column) -> Column:
    """An entity phrase as a JSON pattern of its lower-case words."""
    w = F.filter(F.split(squeeze(phrase), " "), lambda x: x != "")
    return F.to_json(F.struct(label.alias("label"), F.transform(w, lambda x: F.struct(F.lower(x).alias("LOWER"))).alias("pattern")))


def fact_labels(c: Column) -> Column:
    """struct(verdict, risk) of a labeller's lines (D20): the last line that names each holds; UNVERIFIED and Medium by default."""
    lines = F.split(F.lower(F.coalesce(c, F.lit(""))), "\n")

    def last(word: str, table: list[tuple[str, str]], otherwise: str) -> Column:
        def value(x: Column) -> Column:
            out = None
            for k, v in table:
                out = F.when(F.contains(x, F.lit(k)), v) if out is None else out.when(F.contains(x, F.lit(k)), v)
            return F.when(F.contains(x, F.lit(word)), out)

        return F.coalesce(F.try_element_at(F.array_compact(F.transform(lines, value)), F.lit(-1)), F.lit(otherwise))

    return F.struct(last("verdict", [("true", "TRUE"), ("false", "FALSE"), ("mixed", "MIXED")], "UNVERIFIED").alias("verdict"), last("risk", [("low", "Low"), ("medium", "Medium"), ("high", "High")], "Medium").alias("risk"))
