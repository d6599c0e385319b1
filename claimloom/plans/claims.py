"""Queries of the text and scoring operators over the labelled claims and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import scoring as sc
from ..functions import text as tx
from ..sources.tables import table, text_table
from . import sql as S

#: Sentences appended to the claims, one by identifier, so that every branch of the word lists is met.
TEMPLATES = [
    "", "DOCTORS HATE this miracle cure!! It cures cancer permanently!!!", "Stop taking insulin, this always reverses diabetes.", "It may help, according to a 2024 WHO guideline.",
    "Studies show it alters DNA causing cancer??", "They say the WhatsApp remedy is proven and a desi nuskha.", "Pregnant women might avoid it, some studies say in 1999.",
    "Should I stop my medication?", "Mera pet khali hai aur dard hota hai", "ICMR outbreak report of 2025: the vaccine is a drug for children.", "never eat it, it causes kidney failure",
    "Replace chemotherapy with detox juice and share with family", "A pubmed study of 2018 on blood pressure", "do not drink it", "Mayo clinic: the heavy metal detox removes toxins from blood", "Everyone knows it prevents stroke and treats ulcer",
]
_T = "[" + ", ".join(S.q(t) for t in TEMPLATES) + "]"
#: The claims with their sentence, in SQL.
CLAIMS = f"WITH claims AS (SELECT claim_id AS qid, claim || ' ' || {_T}[(claim_id % {len(TEMPLATES)})::INT + 1] AS text FROM final_health_claims WHERE claim IS NOT NULL)"


def claims(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(qid, text, more...): every claim with the sentence of its identifier."""
    c = text_table(spark, d, "final_health_claims", "claim_id", "claim", *more).where("claim is not null")
    t = F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), (F.col("claim_id") % len(TEMPLATES)).cast("int") + 1)
    return c.select(F.col("claim_id").alias("qid"), F.concat("claim", F.lit(" "), t).alias("text"), *more)


QUERIES, ORACLE = {}, {}

# --- cleaning -------------------------------------------------------------------------------------------------------
QUERIES["clean_claim"] = lambda s, d: claims(s, d).select("qid", tx.clean_claim(F.col("text")).alias("cleaned"))


def _clean_sql(col: str) -> str:
    e = f"replace(regexp_replace(trim(lower({col})), 'http\\S+|www\\S+', '', 'g'), '-', ' ')"
    for src, dst in lx.ORDERED_PHRASES:  # twice, as neighbouring matches share the blank between them
        for _ in range(2):
            e = f"regexp_replace({e}, {S.q(f'(^|[^{S.W[1:-1]}]){src}($|[^{S.W[1:-1]}])')}, {S.q(chr(92) + '1' + dst + chr(92) + '2')}, 'g')"
    e = f"regexp_replace({e}, {S.q(r'[^' + S.W[1:-1] + r'\s\p{Z},.!?]')}, ' ', 'g')"
    return e


def clean_sql(source: str, name: str) -> str:
    """CTE `name`: the rows of `source` (text) with their cleaned claim, in `cleaned`."""
    twice = "list_filter(range(1, len(t)::BIGINT + 1), i -> NOT (i > 2 AND t[i] = t[i-1] AND t[i] = t[i-2] AND t[i] <> chr(10)))"
    whole = "array_to_string(list_transform(k, i -> t[i]), '')"
    return f"{name}0 AS (SELECT *, {_clean_sql('text')} AS t FROM {source}), {name}1 AS (SELECT *, {twice} AS k FROM {name}0), {name} AS (SELECT *, {S.squeeze(whole)} AS cleaned FROM {name}1)"


ORACLE["clean_claim"] = f"{CLAIMS}, {clean_sql('claims', 'b')} SELECT qid, cleaned FROM b"

QUERIES["normalize_text"] = lambda s, d: text_table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", tx.normalize(F.col("text")).alias("normalized"))
ORACLE["normalize_text"] = "SELECT doc_id, " + S.strip(f"regexp_replace(regexp_replace(lower(text), {S.q(S.S + '+')}, ' ', 'g'), '[!?]{{2,}}', '!', 'g')").replace("{{", "{").replace("}}", "}") + " AS normalized FROM documents WHERE text IS NOT NULL"

QUERIES["article_text"] = lambda s, d: text_table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", tx.article_text(F.col("text")).alias("body"))
ORACLE["article_text"] = ("SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), x -> " + S.strip("x") + "), x -> len(x) >= 35 AND "
                          f"(NOT regexp_matches(x, {S.q('(?i)(' + lx.PAGE_NOISE + ')')}) OR regexp_matches(x, {S.q('(?i)(' + lx.PAGE_KEEP + ')')}))), chr(10)) AS body FROM documents WHERE text IS NOT NULL")

QUERIES["plain_terms"] = lambda s, d: claims(s, d).select("qid", F.array_join(tx.plain_terms(F.col("text")), " ").alias("terms"))
ORACLE["plain_terms"] = CLAIMS + r" SELECT qid, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(text)), 'http\S+|www\S+', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), ' '), x -> len(x) > 1), ' ') AS terms FROM claims"

QUERIES["token_stats"] = lambda s, d: (claims(s, d).select("qid", F.explode(tx.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("df")))
ORACLE["token_stats"] = CLAIMS + f" SELECT term, count(*) AS n, count(DISTINCT qid) AS df FROM (SELECT qid, unnest({S.words('text')}) AS term FROM claims) GROUP BY term"

# --- style ----------------------------------------------------------------------------------------------------------
_NAMES = ["uppercase", "punctuation", "keywords", "absolute", "hedging", "causal", "causal_chain", "authority", "pseudoscience", "length"]


def _style(s, d):
    sig = sc.style_signals(F.col("text"))
    return claims(s, d).select("qid", *[F.round(sig[n], 6).alias(n) for n in _NAMES], sc.style_score(F.col("text")).alias("style"))


_b, _w = r"\b", S.W
_causal = S.regex_count("text", rf"(?i)\b(?:{lx.CAUSAL_VERBS})\b{S.S}+{S.W}+")
_chain = S.regex_count("text", rf"(?i)(?:^|[^\p{{L}}\p{{N}}_]){S.W}+{S.S}+(?:{lx.CHAIN_FIRST}){S.S}+{S.W}+{S.S}+(?:{lx.CHAIN_SECOND.replace(chr(92) + 's+', chr(92) + 's+')}){S.S}+{S.W}+")
STYLE_SQL = f"""
sig AS (SELECT qid, text,
  least(CASE WHEN r > 0.5 THEN 0.35 WHEN r > 0.15 THEN 0.2 ELSE 0.0 END + CASE WHEN caps >= 3 THEN 0.2 WHEN caps >= 1 THEN 0.1 ELSE 0.0 END, 0.4)::DOUBLE AS uppercase,
  CASE WHEN marks >= 3 THEN 0.3 WHEN marks = 2 THEN 0.2 WHEN marks = 1 THEN 0.1 ELSE 0.0 END::DOUBLE AS punctuation,
  least(least({S.count('text', lx.STRONG_TERMS)} * 0.35, 0.35) + least({S.count('text', lx.MIDDLE_TERMS)} * 0.2, 0.3) + least({S.count('text', lx.WEAK_TERMS)} * 0.1, 0.2), 0.6)::DOUBLE AS keywords,
  least({S.count('text', lx.ABSOLUTES)} * 0.15, 0.3)::DOUBLE AS absolute,
  CASE WHEN causal_n = 0 THEN 0.0 WHEN {S.has('text', lx.HEDGES)} THEN -0.1 ELSE 0.2 END::DOUBLE AS hedging,
  least(causal_n * 0.1, 0.2)::DOUBLE AS causal, least(chain_n * 0.2, 0.2)::DOUBLE AS causal_chain,
  least({S.count('text', lx.VAGUE_AUTHORITY)} * 0.15, 0.2)::DOUBLE AS authority, least({S.count('text', lx.PSEUDOSCIENCE)} * 0.2, 0.3)::DOUBLE AS pseudoscience,
  CASE WHEN n <= 4 THEN 0.04 WHEN n >= 80 THEN 0.03 ELSE 0.0 END::DOUBLE AS length
FROM (SELECT *, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::DOUBLE / nullif(length(replace(text, ' ', '')), 0) AS r, {S.regex_count('text', chr(92) + 'b[A-Z]{3,}' + chr(92) + 'b')} AS caps,
  {S.regex_count('text', '!!+')} + {S.regex_count('text', r'[?][?]+')} AS marks, len(string_split({S.squeeze('text')}, ' ')) AS n, {_causal} AS causal_n, {_chain} AS chain_n FROM claims)),
style AS (SELECT *, CASE WHEN trim(text) = '' THEN 0.0 ELSE round(least(greatest({' + '.join(_NAMES)}, 0.0), 1.0), 4) END AS style FROM sig)"""
QUERIES["style_score"] = _style
ORACLE["style_score"] = CLAIMS + "," + STYLE_SQL + " SELECT qid, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES) + ", style FROM style"

# --- routing --------------------------------------------------------------------------------------------------------
QUERIES["route_gate"] = lambda s, d: claims(s, d).select(
    "qid", tx.route(F.col("text")).alias("route"), tx.basic_language(F.col("text")).alias("language"), tx.is_hinglish(F.col("text")).alias("hinglish"), tx.any_contained(F.col("text"), lx.HARM_SIGNALS).alias("harm_signal"))
ORACLE["route_gate"] = (CLAIMS + f" SELECT qid, CASE WHEN {S.word('text', lx.ADVICE)} THEN 'medical_advice' ELSE 'fact_check' END AS route, "
                        f"CASE WHEN list_has_any({S.words('text')}, [{', '.join(S.q(x) for x in lx.HINGLISH_MARKERS)}]) THEN 'hinglish' ELSE 'en' END AS language, "
                        f"len(list_filter(string_split({S.squeeze('lower(text)')}, ' '), x -> x IN ({', '.join(S.q(x) for x in lx.HINDI_ROMAN)}))) >= 2 AND "
                        f"len(list_filter(string_split({S.squeeze('lower(text)')}, ' '), x -> regexp_full_match(x, '[a-z]+'))) >= 2 AS hinglish, {S.has('text', lx.HARM_SIGNALS)} AS harm_signal FROM claims")

QUERIES["sub_claims"] = lambda s, d: (text_table(s, d, "canonical_claims", "claim_ref", "normalized_text").where("normalized_text is not null")
                                      .select("claim_ref", F.posexplode(tx.sub_claims(F.col("normalized_text")))).select("claim_ref", F.concat(F.lit("c"), (F.col("pos") + 1).cast("string")).alias("claim_id"), F.col("col").alias("canonical_claim")))
ORACLE["sub_claims"] = (f"WITH m AS (SELECT claim_ref, normalized_text AS t0, regexp_replace(regexp_replace(normalized_text, {S.q('(^|[^' + _w[1:-1] + '])(and|aur|evam)($|[^' + _w[1:-1] + '])')}, '\\1' || chr(1) || '\\3', 'g'), "
                        f"{S.q('(^|[^' + _w[1:-1] + '])(and|aur|evam)($|[^' + _w[1:-1] + '])')}, '\\1' || chr(1) || '\\3', 'g') AS t FROM canonical_claims WHERE normalized_text IS NOT NULL), "
                        f"p AS (SELECT claim_ref, t0, list_filter(list_transform(string_split(t, chr(1)), x -> {S.strip('x')}), x -> x <> '') AS parts FROM m), "
                        "u AS (SELECT claim_ref, CASE WHEN len(parts) > 0 THEN parts ELSE [t0] END AS parts FROM p) "
                        "SELECT claim_ref, 'c' || i AS claim_id, parts[i] AS canonical_claim FROM (SELECT claim_ref, parts, unnest(range(1, len(parts) + 1)) AS i FROM u)")

QUERIES["triples"] = lambda s, d: claims(s, d).select("qid", tx.triple(F.col("text")).alias("t")).where("t is not null").select("qid", "t.*")
ORACLE["triples"] = (CLAIMS + f", w AS (SELECT qid, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), {S.q('[^' + _w[1:-1] + chr(92) + 's' + chr(39) + '-]')}, ' ', 'g')), '\\s+'), x -> x <> '') AS w FROM claims), "
                     f"p AS (SELECT qid, w, list_position(list_transform(w, x -> x IN ({', '.join(S.q(x) for x in lx.ACTION_WORDS)})), true) AS k FROM w), "
                     "t AS (SELECT qid, array_to_string(w[1:k-1], ' ') AS subject, w[k] AS relation, array_to_string(w[k+1:], ' ') AS object FROM p WHERE k > 1) "
                     f"SELECT * FROM t WHERE subject <> '' AND object <> '' AND subject <> object AND object NOT IN ({', '.join(S.q(x) for x in lx.TRIVIAL_OBJECTS)})")

# --- harm and risk --------------------------------------------------------------------------------------------------
_CONF = lambda c: (F.col(c) % 100) / 100.0


def _harm(s, d):
    h = sc.harm(F.col("text"), _CONF("qid"))
    return claims(s, d).select("qid", *[(F.round(v, 6) if k in ("actionability", "severity", "vulnerability", "proximity", "harm_axis", "priority") else v).alias(k) for k, v in h.items()])


HARM_SQL = f"""
h0 AS (SELECT qid, text, lower(text) AS low, (qid % 100) / 100.0::DOUBLE AS conf FROM claims),
h1 AS (SELECT *, {S.word('text', lx.CESSATION)} AS override, least(1.0, 0.3 + {S.count('text', lx.ACTIONS)} * 0.25)::DOUBLE AS actionability,
  CASE WHEN {S.has('text', lx.SEVERE)} THEN 0.95 WHEN {S.has('text', lx.MODERATE)} THEN 0.65 ELSE 0.25 END::DOUBLE AS severity, CASE WHEN {S.has('text', lx.VULNERABLE)} THEN 0.9 ELSE 0.4 END::DOUBLE AS vulnerability,
  CASE WHEN regexp_matches(low, '^({'|'.join(lx.INSTRUCTIONS)})') THEN 0.9 ELSE 0.4 END::DOUBLE AS proximity FROM h0),
h2 AS (SELECT *, round(0.35 * severity + 0.3 * actionability + 0.2 * vulnerability + 0.15 * proximity, 4) AS base FROM h1),
h3 AS (SELECT *, CASE WHEN override THEN greatest(base, 0.95) ELSE base END AS harm_axis FROM h2),
harm AS (SELECT qid, round(actionability, 6) AS actionability, round(severity, 6) AS severity, round(vulnerability, 6) AS vulnerability, round(proximity, 6) AS proximity, override, round(harm_axis, 6) AS harm_axis,
  round(greatest(1.0 - conf, harm_axis), 4) AS priority, override OR conf < 0.6 OR harm_axis >= 0.65 AS needs_review,
  CASE WHEN harm_axis >= 0.75 THEN 'CRITICAL / HIGH HARM' WHEN harm_axis >= 0.45 THEN 'MEDIUM HARM' ELSE 'LOW HARM' END AS risk_level FROM h3)"""
QUERIES["harm_axis"] = _harm
ORACLE["harm_axis"] = CLAIMS + "," + HARM_SQL + " SELECT * FROM harm"

QUERIES["review_summary"] = lambda s, d: _harm(s, d).groupBy("risk_level").agg(F.count(F.lit(1)).alias("claims"), F.count_if("needs_review").alias("to_review"), F.round(F.avg("harm_axis"), 6).alias("mean_harm"))
ORACLE["review_summary"] = CLAIMS + "," + HARM_SQL + " SELECT risk_level, count(*) AS claims, count(*) FILTER (WHERE needs_review) AS to_review, round(avg(harm_axis), 6) AS mean_harm FROM harm GROUP BY risk_level"


def _facts(s, d):
    """Facts with a verdict, a match, a confidence (null for some) and a style by identifier."""
    f = table(s, d, "verified_facts").select("fact_id", "verdict", "risk_level")
    k = F.col("fact_id")
    return f.select(
        "fact_id", "verdict", "risk_level", F.element_at(F.array(*[F.lit(x) for x in ("STRONG", "WEAK", "NONE", "LLM")]), (k % 4).cast("int") + 1).alias("match_type"),
        F.when(k % 7 != 0, (k % 50) / 50.0).alias("nli"), F.element_at(F.array(*[F.lit(x) for x in ("SUPPORTS", "REFUTES", "NEI")]), (k % 3).cast("int") + 1).alias("nli_verdict"), ((k % 21) / 20.0).alias("style"))


FACTS = """WITH f AS (SELECT fact_id, verdict, risk_level, ['STRONG', 'WEAK', 'NONE', 'LLM'][(fact_id % 4)::INT + 1] AS match_type, CASE WHEN fact_id % 7 <> 0 THEN (fact_id % 50) / 50.0::DOUBLE END AS nli,
  ['SUPPORTS', 'REFUTES', 'NEI'][(fact_id % 3)::INT + 1] AS nli_verdict, (fact_id % 21) / 20.0::DOUBLE AS style FROM verified_facts)"""


def _legacy(s, d):
    fs = sc.fact_score(F.col("verdict"), F.col("match_type"), F.col("nli"), F.col("risk_level"), F.col("nli_verdict"), F.col("nli"))
    f = _facts(s, d).select("*", fs["fact_score"].alias("fact_score"), fs["reliability"].alias("reliability"))
    r = sc.combined_risk(F.col("verdict"), F.col("fact_score"), F.col("reliability"), F.col("style"))
    # a touch above, so that both engines round ties of binary fractions alike
    return f.select("fact_id", *[F.round(c + 1e-7, 2).alias(n) for n, c in (("fact_score", F.col("fact_score")), ("reliability", F.col("reliability")), ("risk", r["risk"]))])


_V = "CASE WHEN upper(trim(verdict)) IS NULL THEN 'UNVERIFIED' ELSE upper(verdict) END"
ORACLE["legacy_risk"] = FACTS + f""",
a AS (SELECT *, {S.lookup('match_type', lx.MATCH_RELIABILITY, 0.35)}::DOUBLE AS base, {S.lookup('upper(verdict)', lx.VERDICT_SCORES, 0.3)}::DOUBLE AS v, {S.lookup("upper(coalesce(risk_level, ''))", lx.RISK_OFFSETS, 0.0)}::DOUBLE AS o FROM f),
b AS (SELECT *, CASE WHEN nli IS NULL THEN base ELSE round(base * least(greatest(0.5::DOUBLE + nli / 2, 0.55), 1.0), 4) END AS rel FROM a),
c AS (SELECT *, round(least(greatest(v * rel + 0.3::DOUBLE * (1 - rel) + o + CASE WHEN nli >= 0.8 AND nli_verdict = 'REFUTES' THEN 0.12 WHEN nli >= 0.8 AND nli_verdict = 'SUPPORTS' THEN -0.08 ELSE 0 END::DOUBLE, 0), 1), 4) AS fs FROM b)
SELECT fact_id, round(fs + 1e-7, 2) AS fact_score, round(rel + 1e-7, 2) AS reliability, round(1e-7 + least(0.6::DOUBLE * fs + 0.4::DOUBLE * CASE WHEN upper(verdict) = 'TRUE' AND rel >= 0.8 THEN least(style, 0.3) WHEN upper(verdict) IN ('PARTIALLY TRUE', 'MIXED') AND rel >= 0.75 THEN least(style, 0.45) ELSE style END, 1.0), 2) AS risk FROM c"""
QUERIES["legacy_risk"] = _legacy


def _verdicts(s, d):
    from ..operators.evidence import mode, table_verdict

    kb = tx.normalize_verdict(F.col("verdict"))
    return _facts(s, d).select("fact_id", kb.alias("kb"), table_verdict(kb, F.col("nli_verdict")).alias("final"), table_verdict(F.upper("verdict"), F.col("nli_verdict")).alias("final_raw"),
                               mode(F.col("match_type"), F.col("verdict").isNotNull(), F.col("nli")).alias("mode"))


_TABLE = " ".join(f"WHEN kbx = {S.q(a)} AND nli_verdict = {S.q(b)} THEN {S.q(v)}" for (a, b), v in lx.VERDICT_TABLE.items())
QUERIES["verdict_table"] = _verdicts
ORACLE["verdict_table"] = (FACTS + ", k AS (SELECT *, CASE WHEN verdict IS NULL THEN 'UNVERIFIED' WHEN upper(trim(verdict)) IN ('MIXED', 'PARTIAL', 'PARTIALLY_TRUE') THEN 'PARTIALLY TRUE' ELSE upper(trim(verdict)) END AS kb FROM f) "
                           f"SELECT fact_id, kb, CASE {_TABLE.replace('kbx', 'kb')} ELSE 'UNVERIFIED' END AS final, CASE {_TABLE.replace('kbx', 'upper(verdict)')} ELSE 'UNVERIFIED' END AS final_raw, "
                           "CASE WHEN match_type = 'STRONG' AND verdict IS NOT NULL AND coalesce(nli, 0) >= 0.65 THEN 'fast' ELSE 'standard' END AS mode FROM k")

# --- passages -------------------------------------------------------------------------------------------------------


def passages(s, d):
    """(doc_id, line_no, passage, file_name): lines of the documents that are passages."""
    x = text_table(s, d, "documents", "doc_id", "text", "file_name").where("text is not null").select("doc_id", "file_name", F.posexplode(F.split("text", "\n")))
    x = x.select("doc_id", "file_name", (F.col("pos") + 1).alias("line_no"), tx.strip(F.col("col")).alias("passage"))
    return x.where(tx.is_passage(F.col("passage")))


PASSAGES = ("p0 AS (SELECT doc_id, file_name, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p1 AS (SELECT doc_id, file_name, i::INT AS line_no, "
            + S.strip("l[i]") + r""" AS passage FROM (SELECT doc_id, file_name, l, unnest(range(1, len(l) + 1)) AS i FROM p0)),
passages AS (SELECT * FROM p1 WHERE length(passage) >= 20 AND NOT (upper(passage) = passage AND regexp_matches(passage, '\p{Lu}') AND NOT regexp_matches(passage, '\p{Ll}')) AND NOT regexp_matches(passage, '^(SOURCE:|URL:|TITLE:)') AND NOT contains(passage, '─'))""")
QUERIES["passage_extract"] = lambda s, d: passages(s, d).select("doc_id", "line_no", "passage")
ORACLE["passage_extract"] = f"WITH {PASSAGES} SELECT doc_id, line_no, passage FROM passages"



def _quality(s, d):
    pick = lambda c, n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % n).cast("int") + 1)
    sub, out = pick("doc_id", 4, "", "vaccine", "child", "the"), pick("doc_id", 3, "", "sleep", "said")
    pop = pick("line_no", 4, "", "pregnant women", "the infant", "school lunch")
    return passages(s, d).select("doc_id", "line_no", F.round(sc.passage_quality(F.col("passage"), sub, out, pop), 4).alias("quality"), sc.file_tier(F.col("file_name")).alias("tier"), sc.text_tier(F.col("passage")).alias("named_tier"))


QUERIES["passage_quality"] = _quality
_rec = f"coalesce(try_cast(nullif(regexp_extract(passage, '(?:^|[^{_w[1:-1]}])((?:19|20)[0-9][0-9])(?:$|[^{_w[1:-1]}])', 1), '') AS INT), 2020)"
ORACLE["passage_quality"] = f"""WITH {PASSAGES}, x AS (SELECT *, ['', 'vaccine', 'child', 'the'][(doc_id % 4)::INT + 1] AS sub, ['', 'sleep', 'said'][(doc_id % 3)::INT + 1] AS obj, ['', 'pregnant women', 'the infant', 'school lunch'][(line_no % 4)::INT + 1] AS pop, lower(passage) AS low, greatest(0, 2026 - {_rec}) AS age FROM passages),
y AS (SELECT *, sub = '' OR contains(low, sub) AS s, obj = '' OR contains(low, obj) AS o FROM x)
SELECT doc_id, line_no, round(0.35 * {S.case('passage', lx.SOURCE_WEIGHTS, 0.5)} + 0.2 * CASE WHEN {S.has('passage', lx.FAST_MOVING)} THEN greatest(0.2, 1.0 - age * 0.15) ELSE greatest(0.5, 1.0 - age * 0.03) END
 + 0.25 * CASE WHEN sub = '' AND obj = '' THEN 0.7 WHEN s AND o THEN 1.0 WHEN s OR o THEN 0.65 ELSE 0.3 END
 + 0.2 * CASE WHEN pop = '' THEN 0.75 WHEN contains(low, pop) THEN 1.0 WHEN len(list_filter(string_split(pop, ' '), w -> contains(low, w))) > 0 THEN 0.65 ELSE 0.35 END, 4)::DOUBLE AS quality,
 CASE {' '.join(f"WHEN starts_with(lower(file_name), {S.q(p)}) THEN {S.q(t)}" for p, t in lx.FILE_TIERS)} ELSE 'journalism' END AS tier, {S.case('passage', {k: k for k in lx.SOURCE_WEIGHTS}, 'journalism')} AS named_tier FROM y"""

QUERIES["tier_lookup"] = lambda s, d: table(s, d, "documents").groupBy(sc.file_tier(F.regexp_replace("file_name", "^(hospital|guideline)__", "mayo__")).alias("tier"), F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
ORACLE["tier_lookup"] = (f"SELECT CASE {' '.join(f'WHEN starts_with(n, {S.q(p)}) THEN {S.q(t)}' for p, t in lx.FILE_TIERS)} ELSE 'journalism' END AS tier, source, count(*) AS documents "
                         "FROM (SELECT lower(regexp_replace(file_name, '^(hospital|guideline)__', 'mayo__')) AS n, coalesce(source, '') AS source FROM documents) GROUP BY 1, 2")

# --- scripts and entities -------------------------------------------------------------------------------------------
_range = lambda r: "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in r) + "]"
_scripts = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(original_text, {S.q(_range(r))}) THEN {S.q(n)} END" for n, r in lx.SCRIPTS.items()) + ", CASE WHEN regexp_matches(original_text, '[A-Za-z]') THEN 'Latin' END], x -> x IS NOT NULL)"
QUERIES["script_detect"] = lambda s, d: text_table(s, d, "multilingual_claims", "claim_key", "original_text").select("claim_key", tx.script(F.col("original_text")).alias("detected")).withColumn("code", tx.script_code(F.col("detected")))
ORACLE["script_detect"] = (f"WITH a AS (SELECT claim_key, {_scripts} AS s FROM multilingual_claims), b AS (SELECT claim_key, CASE WHEN len(s) = 0 THEN 'Unknown' WHEN len(s) > 1 THEN 'Mixed' ELSE s[1] END AS detected FROM a) "
                           f"SELECT claim_key, detected, CASE {' '.join(f'WHEN detected = {S.q(k)} THEN {S.q(v)}' for k, v in lx.SCRIPT_CODES.items())} ELSE 'eng_Latn' END AS code FROM b")

QUERIES["token_tags"] = lambda s, d: (text_table(s, d, "multilingual_claims", "claim_key", "original_text").select("claim_key", F.explode(tx.script_tokens(F.col("original_text"))).alias("token"))
                                      .groupBy("claim_key", tx.token_tag(F.col("token")).alias("tag")).agg(F.count(F.lit(1)).alias("tokens")))
_tok = r"""[!-/:-@\[-`{-~।॥]|[^\s\p{Z}!-/:-@\[-`{-~।॥]+"""
_indic = "|".join(_range(r) for n, r in lx.SCRIPTS.items() if n != "Devanagari")
ORACLE["token_tags"] = (f"WITH a AS (SELECT claim_key, unnest(regexp_extract_all(original_text, {S.q(_tok)})) AS t FROM multilingual_claims) SELECT claim_key, CASE WHEN regexp_matches(t, '(?i)^(https?://|www[.])') THEN 'entity' "
                        f"WHEN regexp_matches(t, '^[0-9]+(?:[.,][0-9]+)?[A-Za-z%]*$') THEN 'number_unit' WHEN regexp_matches(t, {S.q(_range(lx.SCRIPTS['Devanagari']))}) THEN 'hi_Deva' WHEN regexp_matches(t, {S.q(_indic)}) THEN 'other_Indic' "
                        "WHEN regexp_matches(t, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS tag, count(*) AS tokens FROM a GROUP BY 1, 2")

QUERIES["protected_entities"] = lambda s, d: claims(s, d).select("qid", F.array_join(tx.protected_entities(F.col("text")), "|").alias("entities"))
ORACLE["protected_entities"] = (CLAIMS + f" SELECT qid, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(text, {S.q(_w + '+')}), x -> regexp_full_match(x, '[A-Z][a-z]+')), "
                                r"regexp_extract_all(text, '(?i)[0-9]+\s*(?:mg|ml|gm|iu|mcg|%)')))), '|') AS entities FROM claims")
QUERIES["structural_values"] = lambda s, d: (table(s, d, "multilingual_claims").where("english_gloss is not null").select("claim_key", F.array_join(tx.structural_values(F.col("original_text")), "|").alias("kept_values"),
                                             F.array_join(tx.missing_values(F.col("original_text"), F.col("english_gloss")), "|").alias("missing")))
_sv = r"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(original_text, '\b[0-9]+(?:[.,][0-9]+)?\s*(?:[a-zA-Z%]+)?\b'), x -> trim(lower(x))), list_transform(regexp_extract_all(original_text, '(?i)https?://\S+|www\.\S+'), x -> lower(x)))))"
ORACLE["structural_values"] = f"SELECT claim_key, array_to_string({_sv}, '|') AS kept_values, array_to_string(list_filter({_sv}, v -> NOT contains(lower(english_gloss), v)), '|') AS missing FROM multilingual_claims WHERE english_gloss IS NOT NULL"

QUERIES["url_slug"] = lambda s, d: table(s, d, "golden_candidates_v0").select("id", F.explode("evidence_urls").alias("url")).select("id", tx.slug(F.col("url")).alias("slug"))
ORACLE["url_slug"] = "SELECT id, left(regexp_replace(list_last(string_split(rtrim(url, '/'), '/')), '[^A-Za-z0-9_-]', '_', 'g'), 80) AS slug FROM (SELECT id, unnest(evidence_urls) AS url FROM golden_candidates_v0)"


def _answers(s, d):
    k = F.col("fact_id")
    a = F.concat(F.element_at(F.array(*[F.lit(x) for x in _ANSWERS]), (k % len(_ANSWERS)).cast("int") + 1), F.coalesce("scientific_truth", F.lit("")))
    p = tx.parse_answer(F.col("a"))
    return table(s, d, "verified_facts").select("fact_id", a.alias("a")).select("fact_id", p["verdict"].alias("verdict"), p["confidence"].alias("confidence"), p["reason"].alias("reason"))


_ANSWERS = ["Verdict: TRUE\nConfidence: 0.9\nReason: ", "verdict - false\nconfidence - .35\nreason - ", "This is not true: ", "It is accurate that ", "Verdict: UNVERIFIED\nConfidence: 1.0\n", "No idea, "]
QUERIES["parse_answer"] = _answers
ORACLE["parse_answer"] = f"""WITH a AS (SELECT fact_id, [{', '.join("replace(" + S.q(x.replace(chr(10), '~')) + ", '~', chr(10))" for x in _ANSWERS)}][(fact_id % {len(_ANSWERS)})::INT + 1] || coalesce(scientific_truth, '') AS a FROM verified_facts),
b AS (SELECT fact_id, a, upper(regexp_extract(a, '(?i)verdict\\s*[:-]\\s*(TRUE|FALSE|UNVERIFIED)', 1)) AS v, regexp_extract(a, '(?i)confidence\\s*[:-]\\s*(0?\\.[0-9]+|1\\.0|0|1)', 1) AS c, trim(string_split(trim(regexp_extract(a, '(?is)reason\\s*[:-]\\s*(.+)', 1)), chr(10))[1]) AS r FROM a)
SELECT fact_id, CASE WHEN v <> '' THEN v WHEN regexp_matches(lower(a), 'false|incorrect|not true') THEN 'FALSE' WHEN regexp_matches(lower(a), 'true|correct|accurate') THEN 'TRUE' ELSE 'UNVERIFIED' END AS verdict,
CASE WHEN c <> '' THEN least(greatest(c::DOUBLE, 0), 1) ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN r <> '' THEN r ELSE trim(a) END AS reason FROM b"""

QUERIES["retrieval_queries"] = lambda s, d: table(s, d, "multilingual_claims").select("claim_key", F.array_join(tx.retrieval_queries(F.col("english_gloss"), F.col("canonical_indic_text"), F.col("original_text")), "\n").alias("queries"))
ORACLE["retrieval_queries"] = ("SELECT claim_key, array_to_string(list_filter([g, CASE WHEN c IS DISTINCT FROM g THEN c END, CASE WHEN o IS DISTINCT FROM g AND o IS DISTINCT FROM c THEN o END], x -> x IS NOT NULL), chr(10)) AS queries FROM "
                               "(SELECT claim_key, CASE WHEN trim(english_gloss) <> '' THEN english_gloss END AS g, CASE WHEN trim(canonical_indic_text) <> '' THEN canonical_indic_text END AS c, CASE WHEN trim(original_text) <> '' THEN original_text END AS o FROM multilingual_claims)")


def _entities(s, d):
    """Claims joined with the entity patterns by runs of up to three words."""
    w = claims(s, d).select("qid", tx.words(F.concat(F.col("text"), F.lit(" warm water for digestion"))).alias("w"))

    def runs(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array())

    grams = w.select("qid", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("gram"))
    p = s.createDataFrame(lx.ENTITY_PATTERNS, "label string, gram string")
    return grams.join(F.broadcast(p), "gram").groupBy("label", "gram").agg(F.count(F.lit(1)).alias("claims"))  # a fixed list of a few rows


QUERIES["entity_join"] = _entities
ORACLE["entity_join"] = CLAIMS + f""", w AS (SELECT qid, {S.words("text || ' warm water for digestion'")} AS w FROM claims), g AS (SELECT DISTINCT qid, array_to_string(w[i:i+n-1], ' ') AS gram FROM (SELECT qid, w, unnest(range(1, len(w) + 1)) AS i FROM w), (VALUES (1), (2), (3)) t(n) WHERE i + n - 1 <= len(w)),
p AS (SELECT * FROM (VALUES {', '.join(f'({S.q(a)}, {S.q(b)})' for a, b in lx.ENTITY_PATTERNS)}) t(label, gram)) SELECT label, p.gram AS gram, count(*) AS claims FROM g JOIN p ON g.gram = p.gram GROUP BY 1, 2"""

QUERIES["ocr_gate"] = lambda s, d: table(s, d, "image_ingestion").select("raw_input_id", (F.coalesce("ocr_confidence", F.lit(0.0)) >= 0.65).alias("first_pass"), (F.coalesce("ocr_confidence", F.lit(0.0)) < 0.60).alias("needs_review"))
ORACLE["ocr_gate"] = "SELECT raw_input_id, coalesce(ocr_confidence, 0) >= 0.65 AS first_pass, coalesce(ocr_confidence, 0) < 0.6 AS needs_review FROM image_ingestion"

ORACLE = {k: S.lambdas(v) for k, v in ORACLE.items()}
