"""Queries of whole reports: claims whose id is divisible by 50 against all facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..operators import pipeline, verify
from ..sources.tables import table
from . import claims as C
from . import retrieval as R
from . import sql as S

QUERIES, ORACLE = {}, {}
_W = S.W[1:-1]


def facts(s, d):
    return table(s, d, "verified_facts").select("fact_id", "claim_subject", "verdict", "scientific_truth", "risk_level", "source")


def topics_sql(c: str) -> str:
    """The words of `c` that may be its topic."""
    return f"list_filter({S.words(c)}, x -> len(x) > 2 AND regexp_full_match(x, '\\p{{L}}+') AND x NOT IN ({', '.join(S.q(w) for w in verify.STOP)}))"


FACTS = "fk AS (SELECT *, fact_id AS pid, concat_ws(' ', claim_subject, scientific_truth) AS about FROM verified_facts WHERE scientific_truth IS NOT NULL), " + S.embedded("fk", "fk", "pid", "about")


def tier_sql(x: str, q: str) -> str:
    """CTE `x`: what the facts (FACTS) say of the claims of `q` (qid, claim)."""
    kb = "CASE WHEN verdict IS NULL THEN 'UNVERIFIED' WHEN upper(trim(verdict)) IN ('MIXED', 'PARTIAL', 'PARTIALLY_TRUE') THEN 'PARTIALLY TRUE' ELSE upper(trim(verdict)) END"
    table_ = " ".join(f"WHEN kb = {S.q(a)} AND nli = {S.q(b)} THEN {S.q(v)}" for (a, b), v in lx.VERDICT_TABLE.items())
    got = ", ".join(f"CASE WHEN kind <> 'NONE' THEN {c} END AS {n}" for c, n in (("fact_id", "fact_id"), ("scientific_truth", "truth"), ("risk_level", "risk_level"), ("source", "source"), ("nli", "nli_verdict"), ("prob", "nli_confidence")))
    return (f"{S.embedded(q, q, 'qid', 'claim')}, {S.distances(x + 'x', q, 'fk')}, "
            f"{x}1 AS (SELECT q.qid, q.claim, n.score, fk.*, list_distinct({S.words('claim')}) AS c, list_distinct({S.words('scientific_truth')}) AS w, coalesce(list_has_any({topics_sql('claim')}, {topics_sql('about')}), false) AS topic, {kb} AS kb "
            f"FROM {q} q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, pid) AS r FROM {x}x) WHERE r = 1) n USING (qid) LEFT JOIN fk USING (pid)), "
            f"{x}2 AS (SELECT *, len(list_intersect(c, w)) / (len(c) + 1.0::DOUBLE) AS share FROM {x}1), "
            f"{x}3 AS (SELECT *, round(share, 6) AS prob, CASE WHEN share < 0.4 THEN 'NEI' WHEN list_has_any(c, {R.NEGATIONS}) <> list_has_any(w, {R.NEGATIONS}) THEN 'REFUTES' ELSE 'SUPPORTS' END AS nli FROM {x}2), "
            f"{x}4 AS (SELECT *, CASE WHEN topic AND score <= 0.82 THEN 'STRONG' WHEN topic AND prob >= 0.65 THEN 'WEAK' ELSE 'NONE' END AS kind FROM {x}3), "
            f"{x} AS (SELECT qid, claim, kind AS match_type, kind <> 'NONE' AS match_found, round(score, 6) AS match_score, CASE WHEN kind = 'NONE' THEN 'UNVERIFIED' ELSE CASE {table_} ELSE 'UNVERIFIED' END END AS verdict, {got} FROM {x}4)")


QUERIES["tier_one"] = lambda s, d: verify.tier_one(R._claims(s, d), facts(s, d))
ORACLE["tier_one"] = f"{R.BASE}, tq AS (SELECT qid, text AS claim FROM q), {FACTS}, {tier_sql('tier', 'tq')} SELECT * EXCLUDE (claim) FROM tier"


def _report(s, d):
    got = pipeline.analyze(R.queries(s, d), R.facts(s, d), facts(s, d))
    # a touch above, so that both engines round ties of binary fractions alike
    return got.withColumns({c: F.round(F.col(c) + 1e-7, 3) for c in ("confidence", "style", "harm", "risk")}).drop("explanation")


QUERIES["claim_report"] = _report
QUERIES["report_explanations"] = lambda s, d: pipeline.analyze(R.queries(s, d), R.facts(s, d), facts(s, d)).select("qid", "idx", F.regexp_replace("explanation", r"[0-9.]+%", "%").alias("explanation"))
QUERIES["report_summary"] = lambda s, d: _report(s, d).groupBy("route", "mode", "verdict").agg(F.count(F.lit(1)).alias("claims"), F.count_if("needs_review").alias("to_review"))

_split = S.q(f"(^|[^{_W}])(and|aur|evam)($|[^{_W}])")
_parted = f"regexp_replace(regexp_replace(cleaned, {_split}, '\\1' || chr(1) || '\\3', 'g'), {_split}, '\\1' || chr(1) || '\\3', 'g')"
_tw = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower(claim), {S.q('[^' + _W + chr(92) + 's' + chr(39) + '-]')}, ' ', 'g')), '\\s+'), x -> x <> '')"
_actions = ", ".join(S.q(x) for x in lx.ACTION_WORDS)
_trivial = ", ".join(S.q(x) for x in lx.TRIVIAL_OBJECTS)
_harm = C.HARM_SQL.replace("(qid % 100) / 100.0::DOUBLE AS conf FROM claims", "confidence AS conf FROM judged")
REPORT = f"""{R.BASE}, {C.clean_sql('q', 'cl')}, base AS (SELECT qid, text, cleaned, {S.word('text', lx.ADVICE)} AS advice FROM cl),
sp AS (SELECT qid, text, cleaned, list_filter(list_transform(string_split({_parted}, chr(1)), x -> {S.strip('x')}), x -> x <> '') AS ps FROM base WHERE NOT advice),
su AS (SELECT qid, text, CASE WHEN len(ps) > 0 THEN ps ELSE [cleaned] END AS ps FROM sp),
parts AS (SELECT row_number() OVER (ORDER BY qid, i) AS qid, qid AS src, i::INT AS idx, ps[i] AS claim, text FROM (SELECT qid, text, ps, unnest(range(1, len(ps) + 1)) AS i FROM su)),
tr0 AS (SELECT qid, claim, {_tw} AS w FROM parts), tr1 AS (SELECT *, list_position(list_transform(w, x -> x IN ({_actions})), true) AS k FROM tr0),
tr2 AS (SELECT qid, claim, array_to_string(w[1:k-1], ' ') AS a, w[k] AS r, array_to_string(w[k+1:], ' ') AS o, k FROM tr1),
vt AS (SELECT qid, CASE WHEN k > 1 AND a <> '' AND o <> '' AND a <> o AND o NOT IN ({_trivial}) THEN a || ' ' || r || ' ' || o ELSE claim END AS claim FROM tr2), ct AS (SELECT qid, claim FROM parts),
{FACTS}, {tier_sql('first', 'ct')}, {tier_sql('fact', 'vt')},
known AS (SELECT p.*, v.claim AS verification_text, CASE WHEN f.match_type = 'STRONG' AND coalesce(f.nli_confidence, 0) >= 0.65 THEN 'fast' ELSE 'standard' END AS mode, f.truth, f.nli_confidence AS sure, g.match_type = 'STRONG' AS strong,
 CASE WHEN g.match_type = 'STRONG' THEN g.verdict ELSE 'UNVERIFIED' END AS fact_verdict, CASE WHEN g.match_type = 'STRONG' THEN g.nli_confidence END AS fact_nli, CASE WHEN g.match_type = 'STRONG' THEN g.risk_level ELSE 'Medium' END AS fact_risk,
 CASE WHEN g.match_type = 'STRONG' THEN g.nli_verdict ELSE 'NEI' END AS fact_reading, CASE WHEN g.match_type = 'STRONG' THEN g.source END AS fact_source FROM parts p JOIN vt v USING (qid) JOIN first f USING (qid) JOIN fact g USING (qid)),
asked AS (SELECT qid, claim AS text, text AS whole FROM known WHERE mode <> 'fast'), {R.lanes_sql('asked', 15)}, near_hits AS (SELECT * FROM hits WHERE rank <= 5), {R.read_sql('s_', 'near_hits', 'asked', 5)}, {R.verdict_sql('s_', 'asked', 's_scored')},
deep AS (SELECT qid, CASE WHEN {S.has('whole', lx.HARM_SIGNALS)} THEN 'harm_signal' WHEN contradiction_count > 0 THEN 'contradiction_count=' || contradiction_count ELSE printf('agreement_ratio=%.2f', agreement) END AS escalation FROM s_ev JOIN asked USING (qid)
 WHERE {S.has('whole', lx.HARM_SIGNALS)} OR contradiction_count > 0 OR support_count + contradiction_count > 0 AND agreement < 0.7),
deep_hits AS (SELECT * FROM hits WHERE qid IN (SELECT qid FROM deep)), {R.read_sql('d_', 'deep_hits', 'asked', 15)},
fast AS (SELECT qid, 'guideline' AS source_tier, 'SUPPORTS' AS nli_verdict, sure AS probability, coalesce(nullif(trim(truth), ''), claim) AS t FROM known WHERE mode = 'fast'),
every AS (SELECT qid, source_tier, nli_verdict, probability, quality FROM s_scored WHERE qid NOT IN (SELECT qid FROM deep) UNION ALL SELECT qid, source_tier, nli_verdict, probability, quality FROM d_scored
 UNION ALL SELECT qid, source_tier, nli_verdict, probability, {R.quality_sql('t')} FROM fast),
{R.verdict_sql('e_', 'known', 'every')}, judged AS (SELECT k.qid, k.text, confidence FROM known k JOIN e_vd USING (qid)), claims AS (SELECT qid, claim AS text FROM known), {C.STYLE_SQL}, {_harm},
rk0 AS (SELECT *, CASE WHEN strong THEN 1.0 ELSE 0.35 END::DOUBLE AS rel0, {S.lookup('upper(fact_verdict)', lx.VERDICT_SCORES, 0.3)}::DOUBLE AS v, {S.lookup("upper(coalesce(fact_risk, ''))", lx.RISK_OFFSETS, 0.0)}::DOUBLE AS o FROM known),
rk1 AS (SELECT *, CASE WHEN fact_nli IS NULL THEN rel0 ELSE round(rel0 * least(greatest(0.5::DOUBLE + fact_nli / 2, 0.55), 1.0), 4) END AS rel FROM rk0), rk2 AS (SELECT *, round(least(greatest(v * rel + 0.3::DOUBLE * (1 - rel) + o, 0), 1), 4) AS fs FROM rk1),
risk AS (SELECT r.qid, round(least(0.6::DOUBLE * fs + 0.4::DOUBLE * CASE WHEN upper(fact_verdict) = 'TRUE' AND rel >= 0.8 THEN least(style, 0.3) WHEN upper(fact_verdict) IN ('PARTIALLY TRUE', 'MIXED') AND rel >= 0.75 THEN least(style, 0.45) ELSE style END, 1.0), 4) AS risk FROM rk2 r JOIN style USING (qid)),
report AS (SELECT k.src AS qid, k.idx, k.claim, k.verification_text, 'fact_check' AS route, CASE WHEN escalation IS NULL THEN k.mode ELSE 'deep' END AS mode, escalation IS NOT NULL AS escalated, escalation, e.verdict, e.confidence, e.best_tier, e.agreement, fact_verdict AS kb_verdict, fact_reading AS nli_verdict,
 coalesce(fact_source, 'evidence') AS source, 'original' AS text_source, s.style, h.harm_axis AS harm, risk, h.needs_review OR e.verdict IN ('INSUFFICIENT_EVIDENCE', 'MIXED_EVIDENCE') AS needs_review, NULL::VARCHAR AS notice
 FROM known k JOIN e_vd e USING (qid) LEFT JOIN deep USING (qid) JOIN style s USING (qid) JOIN harm h USING (qid) JOIN risk USING (qid)
 UNION ALL SELECT qid, 1, cleaned, cleaned, 'medical_advice', 'none', false, NULL, 'NOT_A_FACT_CHECK', 0, 'none', 0, 'UNVERIFIED', 'NEI', 'none', 'original', 0, 0, 0, false, {S.q(lx.SAFETY_RESPONSE)} FROM base WHERE advice)"""
ORACLE["claim_report"] = (f"{REPORT} SELECT * EXCLUDE (agreement) REPLACE (round(confidence + 1e-7, 3) AS confidence, round(style + 1e-7, 3) AS style, round(harm + 1e-7, 3) AS harm, round(risk + 1e-7, 3) AS risk), "
                          "CASE WHEN round(risk, 2) >= 0.65 THEN 'high' WHEN round(risk, 2) >= 0.4 THEN 'moderate' ELSE 'safe' END AS risk_level FROM report")
ORACLE["report_summary"] = f"{REPORT} SELECT route, mode, verdict, count(*) AS claims, count(*) FILTER (WHERE needs_review) AS to_review FROM report GROUP BY 1, 2, 3"
ORACLE["report_explanations"] = (f"{REPORT} SELECT qid, idx, CASE WHEN notice IS NOT NULL THEN notice ELSE 'Verdict: ' || verdict || ' (Calibrated Confidence: %, Best Tier: ' || best_tier || printf(', Agreement Ratio: %.2f)', agreement) END AS explanation FROM report")
ORACLE = {k: S.lambdas(v) for k, v in ORACLE.items()}
