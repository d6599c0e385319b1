"""Queries of reviews, model contracts, lanes, splits, training features, and of files written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import scoring as sc
from ..functions import text as tx
from ..operators import contracts, evidence, learning, metrics, pipeline, records, retrieval, reviews, triples
from ..session import place
from ..sources import readers, sinks
from ..sources.tables import table, text_table
from . import claims as C
from . import reports as P
from . import retrieval as R
from . import sql as S

QUERIES, ORACLE = {}, {}

# --- reviews --------------------------------------------------------------------------------------------------------


def _log(s, d):
    """A review log made of the events: views submit, purchases decide."""
    e = table(s, d, "events").select((F.col("user_id") * 20 + F.col("event_id") % 20).cast("string").alias("request_id"), "event_id", "event_type", "ts", "value")
    log = reviews.submit(e.where("event_type = 'view'").select("request_id", F.concat(F.lit("claim "), F.col("event_id")).alias("claim_text"), F.lit("MIXED_EVIDENCE").alias("verdict"), F.col("ts").alias("at")))
    made = e.where("event_type = 'purchase' and value > 60").select("request_id", F.when(F.col("value") < 100, "approved").otherwise("rejected").alias("action"), F.lit("FALSE").alias("verdict"), F.concat(F.lit("n"), F.col("event_id")).alias("note"), F.col("ts").alias("at"))
    return log.unionByName(reviews.decide(log, made))


_LOG = """WITH e AS (SELECT (user_id * 20 + event_id % 20)::VARCHAR AS request_id, * EXCLUDE (user_id) FROM events), s AS (SELECT request_id, 'claim ' || event_id AS claim_text, ts, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, 'claim ' || event_id DESC) AS r FROM e WHERE event_type = 'view'),
m AS (SELECT request_id, CASE WHEN value < 100 THEN 'approved' ELSE 'rejected' END AS a, 'n' || event_id AS note, ts, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, CASE WHEN value < 100 THEN 'approved' ELSE 'rejected' END DESC) AS r FROM e WHERE event_type = 'purchase' AND value > 60),
st AS (SELECT s.request_id, coalesce(a, 'pending') AS status, claim_text, CASE WHEN a IS NULL THEN 'MIXED_EVIDENCE' ELSE 'FALSE' END AS verdict, note, coalesce(m.ts, s.ts) AS at FROM s LEFT JOIN m ON s.request_id = m.request_id AND m.r = 1 WHERE s.r = 1)"""
QUERIES["review_state"] = lambda s, d: reviews.state(_log(s, d))
ORACLE["review_state"] = f"{_LOG} SELECT * FROM st"
QUERIES["review_pending"] = lambda s, d: reviews.pending(_log(s, d)).select("request_id", "claim_text")
ORACLE["review_pending"] = f"{_LOG} SELECT request_id, claim_text FROM st WHERE status = 'pending'"
QUERIES["review_one"] = lambda s, d: reviews.one(_log(s, d), "101").select("request_id", "status", "claim_text")
ORACLE["review_one"] = f"{_LOG} SELECT request_id, status, claim_text FROM st WHERE request_id = '101'"


def _reviewed(s, d):
    v = R._verdicts(s, d).select("qid", "verdict", F.round(F.col("confidence") + 1e-7, 3).alias("confidence"))
    made = v.where("qid % 3 = 0").select("qid", F.lit("override_rejected").alias("action"), F.lit("FALSE").alias("verdict"), F.lit("seen").alias("note"))
    return reviews.reviewed(v, made)


QUERIES["human_review"] = _reviewed
ORACLE["human_review"] = (f"{R.CHAIN}, rv AS (SELECT qid, verdict, round(confidence + 1e-7, 3) AS confidence, round(confidence + 1e-7, 3) < 0.5 OR verdict IN ('INSUFFICIENT_EVIDENCE', 'MIXED_EVIDENCE') AS reviewed FROM vd) SELECT *, CASE WHEN reviewed THEN CASE WHEN qid % 3 = 0 THEN 'override_rejected' ELSE 'override_approved' END END AS action, "
                          "CASE WHEN reviewed AND qid % 3 = 0 THEN 'FALSE' ELSE verdict END AS final_verdict, CASE WHEN reviewed THEN CASE WHEN qid % 3 = 0 THEN 'seen' ELSE 'Human reviewer confirmed verdict' END END AS note FROM rv")
QUERIES["stamped_requests"] = lambda s, d: reviews.stamped(table(s, d, "verified_facts").select("fact_id")).agg(F.count_distinct("request_id").alias("requests"), F.min(F.length("request_id")).alias("length"), F.count("submitted_at").alias("times"))
ORACLE["stamped_requests"] = "SELECT count(*) AS requests, 36 AS length, count(*) AS times FROM verified_facts"
QUERIES["report_json"] = lambda s, d: table(s, d, "verified_facts").select("fact_id", F.to_json(F.struct("fact_id", "claim_subject", "verdict", "risk_level"), {"ignoreNullFields": "false"}).alias("json"))
ORACLE["report_json"] = "SELECT fact_id, to_json({'fact_id': fact_id, 'claim_subject': claim_subject, 'verdict': verdict, 'risk_level': risk_level})::VARCHAR AS json FROM verified_facts"

# --- contracts of models --------------------------------------------------------------------------------------------


def _media(s, d):
    return table(s, d, "image_ingestion").select(F.col("raw_input_id").alias("id"), F.col("extracted_text").alias("text"), F.col("ocr_confidence").alias("confidence"))


QUERIES["image_gate"] = lambda s, d: contracts.image(_media(s, d), lambda i: F.struct(F.when(~i.endswith("1"), F.concat(F.lit("seen "), i)).alias("text"), F.lit("photo").alias("context"), F.when(i.endswith("2"), 0.7).alias("confidence")))
ORACLE["image_gate"] = """WITH m AS (SELECT raw_input_id AS id, extracted_text AS text, ocr_confidence AS c, coalesce(ocr_confidence, 0) >= 0.65 AS good FROM image_ingestion)
SELECT id, CASE WHEN good OR suffix(id, '1') THEN text ELSE 'seen ' || id END AS text, CASE WHEN NOT good THEN 'photo' END AS context, CASE WHEN good THEN c WHEN suffix(id, '2') THEN 0.7 ELSE 0.85 END::DOUBLE AS confidence, CASE WHEN good THEN 'first_pass' ELSE 'fallback' END AS method FROM m"""
QUERIES["audio_gate"] = lambda s, d: contracts.audio(_media(s, d)).select("id", "needs_review")
ORACLE["audio_gate"] = "SELECT raw_input_id AS id, coalesce(ocr_confidence, 0) < 0.6 AS needs_review FROM image_ingestion"

_tok = r"""[!-/:-@\[-`{-~।॥]|[^\s\p{Z}!-/:-@\[-`{-~।॥]+"""
_range = lambda r: "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in r) + "]"
_indic = "|".join(_range(r) for n, r in lx.SCRIPTS.items() if n != "Devanagari")
_tag = (f"CASE WHEN regexp_matches(t, '(?i)^(https?://|www[.])') THEN 'entity' WHEN regexp_matches(t, '^[0-9]+(?:[.,][0-9]+)?[A-Za-z%]*$') THEN 'number_unit' WHEN regexp_matches(t, {S.q(_range(lx.SCRIPTS['Devanagari']))}) THEN 'hi_Deva' "
        f"WHEN regexp_matches(t, {S.q(_indic)}) THEN 'other_Indic' WHEN regexp_matches(t, '[A-Za-z]') THEN 'latin' ELSE 'other' END")
_model = lambda t: F.struct(F.when(F.length(t) % 2 == 0, "English").otherwise("LABEL_HI").alias("label"), (F.lit(0.85) + (F.length(t) % 3) * 0.06).alias("confidence"))


def _guard(s, d):
    t = F.col("original_text")
    return text_table(s, d, "multilingual_claims", "claim_key", "original_text").where("original_text is not null").select("claim_key", F.array_join(contracts.guarded(t, contracts.tagged(t, _model)), "|").alias("entities"))


QUERIES["entity_guard"] = _guard
ORACLE["entity_guard"] = (f"WITH a AS (SELECT claim_key, original_text, unnest(regexp_extract_all(original_text, {S.q(_tok)})) AS t FROM multilingual_claims WHERE original_text IS NOT NULL), b AS (SELECT *, {_tag} AS tag FROM a), "
                          "c AS (SELECT *, tag = 'latin' AND len(t) % 2 = 0 AS en, 0.85::DOUBLE + (len(t) % 3) * 0.06::DOUBLE AS conf FROM b), "
                          f"k AS (SELECT claim_key, list(t) AS ts FROM c WHERE len(t) >= 2 AND (en AND conf > 0.95 OR tag = 'number_unit' OR en AND conf > 0.9 AND regexp_matches(t, '^\\p{{Lu}}') OR {S.has('t', lx.MEDICAL_WORDS)}) GROUP BY 1) "
                          f"SELECT m.claim_key, array_to_string(list_sort(list_distinct(list_concat(coalesce(ts, []), list_filter(regexp_extract_all(original_text, {S.q(S.W + '+')}), x -> regexp_full_match(x, '[A-Z][a-z]+')), "
                          r"regexp_extract_all(original_text, '(?i)[0-9]+\s*(?:mg|ml|gm|iu|mcg|%)')))), '|') AS entities FROM multilingual_claims m LEFT JOIN k USING (claim_key) WHERE original_text IS NOT NULL")


def _token_languages(s, d):
    x = text_table(s, d, "multilingual_claims", "claim_key", "original_text").select(F.explode(contracts.tagged(F.col("original_text"))).alias("x"))
    return x.groupBy("x.label", "x.confidence").agg(F.count(F.lit(1)).alias("tokens"))


QUERIES["token_languages"] = _token_languages
_hi = f"lower(t) IN ({', '.join(S.q(x) for x in lx.HINDI_ROMAN)})"
ORACLE["token_languages"] = (f"WITH a AS (SELECT unnest(regexp_extract_all(original_text, {S.q(_tok)})) AS t FROM multilingual_claims), b AS (SELECT t, {_tag} AS tag FROM a) SELECT CASE WHEN tag <> 'latin' THEN tag WHEN {_hi} THEN 'hi_Latn' ELSE 'en' END AS label, "
                             f"CASE WHEN tag <> 'latin' THEN 1.0 WHEN {_hi} THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, count(*) AS tokens FROM b GROUP BY 1, 2")
QUERIES["english_gloss"] = lambda s, d: text_table(s, d, "multilingual_claims", "claim_key", "english_gloss").select("claim_key", contracts.english(F.col("english_gloss")).alias("english"))
_other = "|".join(_range(r) for r in lx.SCRIPTS.values())
ORACLE["english_gloss"] = (f"WITH a AS (SELECT claim_key, english_gloss AS g, list_filter(regexp_extract_all(english_gloss, {S.q(_tok)}), x -> regexp_matches(x, '\\p{{L}}')) AS w FROM multilingual_claims) SELECT claim_key, coalesce(regexp_matches(g, '[A-Za-z]') AND NOT regexp_matches(g, {S.q(_other)}) AND len(w) > 0 "
                           f"AND len(list_filter(w, x -> NOT regexp_matches(x, '[A-Za-z]') OR lower(x) IN ({', '.join(S.q(x) for x in lx.HINDI_ROMAN)}) OR regexp_matches(x, '(?i)^(https?://|www[.])') OR regexp_matches(x, '^[0-9]+(?:[.,][0-9]+)?[A-Za-z%]*$'))) = 0, false) AS english FROM a")

_SAID = ["Verdict: TRUE\nRisk: low", "verdict false\nrisk high", "no idea", "VERDICT: it is mixed\nthe risk is Medium\nverdict: FALSE"]
QUERIES["fact_suggestions"] = lambda s, d: contracts.suggested_facts(
    table(s, d, "verified_facts").select(F.col("claim_subject").alias("claim"), F.col("scientific_truth").alias("explanation")), lambda c, w: F.element_at(F.array(*[F.lit(x) for x in _SAID]), F.length(c) % 4 + 1))
ORACLE["fact_suggestions"] = ("SELECT claim_subject, ['TRUE', 'FALSE', 'UNVERIFIED', 'FALSE'][length(claim_subject) % 4 + 1] AS verdict, coalesce(scientific_truth, '') AS scientific_truth, ['Low', 'High', 'Medium', 'Medium'][length(claim_subject) % 4 + 1] AS risk_level, 'multiple' AS source FROM verified_facts")

QUERIES["text_language"] = lambda s, d: text_table(s, d, "canonical_claims", "claim_ref", "original_text").where("original_text is not null").select("claim_ref", contracts.language(F.col("original_text")).alias("l")).select("claim_ref", "l.*")
_scripts = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(original_text, {S.q(_range(r))}) THEN {S.q(n)} END" for n, r in lx.SCRIPTS.items()) + ", CASE WHEN regexp_matches(original_text, '[A-Za-z]') THEN 'Latin' END], x -> x IS NOT NULL)"
ORACLE["text_language"] = (f"WITH a AS (SELECT claim_ref, original_text, {_scripts} AS s FROM canonical_claims WHERE original_text IS NOT NULL) SELECT claim_ref, CASE WHEN len(s) = 0 THEN 'unknown' WHEN len(s) > 1 THEN 'eng_Latn' WHEN s[1] = 'Latin' THEN "
                           f"CASE WHEN list_has_any({S.words('original_text')}, [{', '.join(S.q(x) for x in lx.HINGLISH_MARKERS)}]) THEN 'hinglish' ELSE 'en' END ELSE CASE {' '.join(f'WHEN s[1] = {S.q(k)} THEN {S.q(v)}' for k, v in lx.SCRIPT_CODES.items())} END END AS label, "
                           "CASE WHEN len(s) = 0 THEN 0.0 WHEN len(s) > 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM a")


def _model_risk(s, d):
    f = C._facts(s, d)
    fs = sc.fact_score(F.col("verdict"), F.col("match_type"), F.col("nli"), F.col("risk_level"))
    f = f.select("*", fs["fact_score"].alias("fact_score"), fs["reliability"].alias("reliability"))
    r = sc.combined_risk(F.col("verdict"), F.col("fact_score"), F.col("reliability"), F.col("style"), F.when(F.col("fact_id") % 5 != 0, (F.col("fact_id") % 10) / 10.0), 0.2)
    return f.select("fact_id", F.round(r["risk"] + 1e-7, 2).alias("risk"))


QUERIES["model_risk"] = _model_risk
ORACLE["model_risk"] = C.FACTS + f""", a AS (SELECT *, {S.lookup('match_type', lx.MATCH_RELIABILITY, 0.35)}::DOUBLE AS base, {S.lookup('upper(verdict)', lx.VERDICT_SCORES, 0.3)}::DOUBLE AS v, {S.lookup("upper(coalesce(risk_level, ''))", lx.RISK_OFFSETS, 0.0)}::DOUBLE AS o FROM f),
b AS (SELECT *, CASE WHEN nli IS NULL THEN base ELSE round(base * least(greatest(0.5::DOUBLE + nli / 2, 0.55), 1.0), 4) END AS rel FROM a), c AS (SELECT *, round(least(greatest(v * rel + 0.3::DOUBLE * (1 - rel) + o, 0), 1), 4) AS fs FROM b)
SELECT fact_id, round(1e-7 + least(0.8::DOUBLE * (0.6::DOUBLE * fs + 0.4::DOUBLE * CASE WHEN upper(verdict) = 'TRUE' AND rel >= 0.8 THEN least(style, 0.3) WHEN upper(verdict) IN ('PARTIALLY TRUE', 'MIXED') AND rel >= 0.75 THEN least(style, 0.45) ELSE style END)
 + 0.2::DOUBLE * CASE WHEN fact_id % 5 <> 0 THEN (fact_id % 10) / 10.0 ELSE 0 END::DOUBLE, 1.0), 2) AS risk FROM c"""

# --- text -----------------------------------------------------------------------------------------------------------
QUERIES["casefolded"] = lambda s, d: text_table(s, d, "canonical_claims", "claim_ref", "original_text").select("claim_ref", tx.casefold(F.col("original_text")).alias("folded"))
ORACLE["casefolded"] = "SELECT claim_ref, replace(lower(upper(replace(original_text, 'ß', 'ss'))), 'ς', 'σ') AS folded FROM canonical_claims"
QUERIES["cache_keys"] = lambda s, d: table(s, d, "documents").where("source is not null").groupBy(tx.cache_key(F.concat(F.lit("BAAI/"), "source", F.lit("-M3!"))).alias("key")).agg(F.count(F.lit(1)).alias("documents"))
ORACLE["cache_keys"] = "SELECT trim(regexp_replace(lower('BAAI/' || source || '-M3!'), '[^a-z0-9]+', '_', 'g'), '_') AS key, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY 1"
QUERIES["token_patterns"] = lambda s, d: table(s, d, "verified_facts").select("fact_id", tx.token_pattern(F.coalesce("risk_level", F.lit("NONE")), F.col("claim_subject")).alias("pattern"))
ORACLE["token_patterns"] = f"SELECT fact_id, to_json({{'label': coalesce(risk_level, 'NONE'), 'pattern': list_transform(list_filter(string_split({S.squeeze('claim_subject')}, ' '), x -> x <> ''), x -> {{'LOWER': lower(x)}})}})::VARCHAR AS pattern FROM verified_facts"


def _histogram(s, d):
    x = text_table(s, d, "canonical_claims", "normalized_text").where("normalized_text is not null").select(tx.sub_claims(F.col("normalized_text")).alias("parts"))
    n = F.size(F.filter(F.col("parts"), lambda p: tx.triple(p).isNotNull()))
    return x.groupBy(n.alias("triples")).agg(F.count(F.lit(1)).alias("claims"))


QUERIES["triple_counts"] = _histogram
_part = C.ORACLE["sub_claims"].split("u AS (")[0].rstrip(", ").replace("lambda", "lambda")
_w = S.W[1:-1]
ORACLE["triple_counts"] = (f"{_part}, u AS (SELECT row_number() OVER () AS id, CASE WHEN len(parts) > 0 THEN parts ELSE [t0] END AS parts FROM p), v AS (SELECT id, unnest(parts) AS text FROM u), "
                           f"w AS (SELECT id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), {S.q('[^' + _w + chr(92) + 's' + chr(39) + '-]')}, ' ', 'g')), '\\s+'), x -> x <> '') AS w FROM v), "
                           f"k AS (SELECT id, w, list_position(list_transform(w, x -> x IN ({', '.join(S.q(x) for x in lx.ACTION_WORDS)})), true) AS k FROM w), "
                           f"h AS (SELECT id, count(*) FILTER (WHERE k > 1 AND len(w) > k AND array_to_string(w[1:k-1], ' ') <> array_to_string(w[k+1:], ' ') AND array_to_string(w[k+1:], ' ') NOT IN ({', '.join(S.q(x) for x in lx.TRIVIAL_OBJECTS)})) AS n FROM k GROUP BY id) "
                           "SELECT n::INT AS triples, count(*) AS claims FROM h GROUP BY 1")


def _parsed(s, d):
    """Triples of parses of each kind, made of facts."""
    sub, obj = F.concat(F.lit("s"), F.col("fact_id")), F.concat(F.lit("o"), F.col("fact_id") % 97)
    kinds = [
        [("S", "NOUN", "nsubj", 1), ("cures", "VERB", "ROOT", 1), ("O", "NOUN", "dobj", 1)],
        [("O", "NOUN", "nsubjpass", 2), ("was", "AUX", "auxpass", 2), ("cured", "VERB", "ROOT", 2), ("by", "ADP", "agent", 2), ("S", "NOUN", "pobj", 3)],
        [("S", "NOUN", "nsubj", 1), ("is", "AUX", "ROOT", 1), ("O", "NOUN", "attr", 1)],
        [("S", "NOUN", "compound", 2), ("damage", "NOUN", "compound", 2), ("O", "NOUN", "ROOT", 2)],
        [("S", "NOUN", "compound", 1), ("boosts", "NOUN", "nsubj", 2), ("O", "VERB", "ROOT", 2)],
        [("S", "NOUN", "ROOT", 0), ("for", "ADP", "prep", 0), ("O", "NOUN", "pobj", 1)],
        [("S", "NOUN", "nsubj", 3), ("does", "AUX", "aux", 3), ("not", "PART", "neg", 3), ("cure", "VERB", "ROOT", 3), ("O", "NOUN", "dobj", 3), ("and", "CCONJ", "cc", 4), ("rest", "NOUN", "conj", 4)],
    ]
    lemma = {"cures": "cure", "cured": "cure", "was": "be", "is": "be", "does": "do", "boosts": "boost"}
    word = lambda w: sub if w == "S" else obj if w == "O" else F.lit(w)
    row = lambda i, w, pos, dep, head: F.struct(F.lit(i).alias("i"), word(w).alias("text"), (word(w) if w in "SO" else F.lit(lemma.get(w, w))).alias("lemma"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"), F.lit(head).alias("head"))
    parse = F.element_at(F.array(*[F.array(*[row(i, *t) for i, t in enumerate(k)]) for k in kinds]), (F.col("fact_id") % len(kinds)).cast("int") + 1)
    return table(s, d, "verified_facts").select("fact_id", F.explode(triples.triples(parse)).alias("t")).select("fact_id", "t.*")


QUERIES["parsed_triples"] = _parsed
ORACLE["parsed_triples"] = """WITH f AS (SELECT fact_id, fact_id % 7 AS k, 's' || fact_id AS s, 'o' || (fact_id % 97) AS o FROM verified_facts), r AS (SELECT fact_id, s AS subject, ['cures', 'cured', 'is', 'damage', 'boosts', 'associated with', 'not cure'][(k + 1)::INT] AS relation, ['cure', 'cure', 'be', 'damage', 'boost', 'associate', 'cure'][(k + 1)::INT] AS relation_lemma,
o AS object, k FROM f) SELECT fact_id, subject, relation, relation_lemma, object FROM r UNION ALL SELECT fact_id, subject, relation, relation_lemma, 'rest' FROM r WHERE k = 6"""

# --- evidence and retrieval -----------------------------------------------------------------------------------------
QUERIES["fast_evidence"] = lambda s, d: evidence.fast_summary(table(s, d, "verified_facts").select(F.col("fact_id").alias("qid"), F.col("claim_subject").alias("claim"), F.col("scientific_truth").alias("truth"), F.when(F.col("fact_id") % 7 != 0, (F.col("fact_id") % 50) / 50.0).alias("nli_confidence")))
ORACLE["fast_evidence"] = (f"WITH f AS (SELECT fact_id AS qid, CASE WHEN trim(scientific_truth) <> '' THEN scientific_truth ELSE claim_subject END AS t, CASE WHEN fact_id % 7 <> 0 THEN (fact_id % 50) / 50.0::DOUBLE END AS n FROM verified_facts) "
                           f"SELECT qid, 1 AS support_count, 0 AS contradiction_count, {R.quality_sql('t')} AS mean_quality, 1.0::DOUBLE AS agreement, 'guideline' AS best_tier, 'guideline' AS tiers, coalesce(n, 0.5)::DOUBLE AS probability FROM f")
QUERIES["lane_hits"] = lambda s, d: pipeline.lane_hits(R._claims(s, d), R.facts(s, d), 5)
_HITS = f"{R.BASE}, {R.lanes_sql('q', 5)}"
ORACLE["lane_hits"] = f"{_HITS} SELECT qid, pid, lane, seen, rank FROM hits"
QUERIES["dense_lanes"] = lambda s, d: pipeline.lane_hits(R._claims(s, d), R.facts(s, d), 5).where("seen % 2 = 1").select("qid", "lane", "pid", "rank")
ORACLE["dense_lanes"] = f"{_HITS} SELECT qid, lane, pid, rank FROM hits WHERE seen % 2 = 1"
QUERIES["string_hits"] = lambda s, d: retrieval.string_hits(
    table(s, d, "verified_facts").select(F.col("fact_id").alias("qid"), F.lit("support").alias("lane"), F.lit(1).alias("seen"), F.lit(1).alias("rank"), F.col("scientific_truth").alias("passage")), R.facts(s, d)).select("qid", "pid")
ORACLE["string_hits"] = f"{R.BASE} SELECT fact_id AS qid, first AS pid FROM verified_facts JOIN (SELECT text, min(pid) AS first FROM p GROUP BY text) x ON scientific_truth = x.text"
QUERIES["knn_damped"] = R._knn("damped")
ORACLE["knn_damped"] = ("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, x -> x::DOUBLE * x::DOUBLE))) AS m FROM embeddings), x AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_dot_product(a.e, b.e) / (a.m * b.m + 1e-9) AS v FROM n a, n b WHERE a.vec_id % 50 = 0) "
                        "SELECT qid, id, round(v, 6) + 0.0 AS score, rank FROM (SELECT qid, id, v, row_number() OVER (PARTITION BY qid ORDER BY round(v, 9) DESC, id)::INT AS rank FROM x) WHERE rank <= 5")
def _lane_metrics(s, d):
    hits = pipeline.lane_hits(R._claims(s, d), R.facts(s, d), 10).select("qid", "pid", F.concat("lane", F.when(F.col("seen") % 2 == 1, " vectors").otherwise(" words")).alias("lane"), "rank")
    got = metrics.lane_report(R.queries(s, d), hits, R.gold(s, d))
    return got.select("lane", *[F.round(c, 6).alias(c) for c in got.columns if c not in ("lane", "queries")], "queries")


QUERIES["lane_metrics"] = _lane_metrics
ORACLE["lane_metrics"] = (f"{R.BASE}, {R.lanes_sql('q', 10)}, {R.GOLD}, lh AS (SELECT qid, pid, rank, lane || CASE WHEN seen % 2 = 1 THEN ' vectors' ELSE ' words' END AS lane FROM hits), "
                          "per AS (SELECT lane, qid, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM lh JOIN gold USING (qid, pid) GROUP BY 1, 2), "
                          "m AS (SELECT lane, sum(h5 / n::DOUBLE) AS r5, sum(h10 / n::DOUBLE) AS r10, sum(1.0::DOUBLE / first) AS mrr, sum(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), x -> 1 / log2(x + 1)))) AS ndcg FROM per JOIN gn USING (qid) GROUP BY lane), c AS (SELECT count(*) AS queries FROM gn) "
                          "SELECT lane, round(coalesce(r5, 0) / queries, 6) AS recall_at_5, round(coalesce(r10, 0) / queries, 6) AS recall_at_10, round(coalesce(mrr, 0) / queries, 6) AS mrr, round(coalesce(ndcg, 0) / queries, 6) AS ndcg_at_10, queries FROM (SELECT DISTINCT lane FROM lh) LEFT JOIN m USING (lane), c")


def _lift(s, d):
    size, found = R.gold_ranks(s, d)
    at = lambda rank: metrics.means(size, found.select("qid", F.col(rank).alias("rank")), (1,))
    got = metrics.lift(at("fused"), at("reranked"))
    return got.select(*[F.round(c, 4).alias(c) for c in got.columns])


QUERIES["rerank_lift"] = _lift
_ndcg = lambda src: f"(SELECT avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), x -> 1 / log2(x + 1)))) FROM gn LEFT JOIN (SELECT qid, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM ({src}) JOIN gold USING (qid, pid) GROUP BY qid) USING (qid))"
ORACLE["rerank_lift"] = (f"{R.CHAIN}, {R.GOLD}, v AS (SELECT {_ndcg('SELECT qid, pid, rrf_rank AS rank FROM cand')} AS b, {_ndcg('SELECT qid, pid, rank FROM rk')} AS a) SELECT round(b, 4) AS before, round(a, 4) AS after, round(100 * (a - b) / b, 4) AS lift_percent FROM v")


def _verdicts(s, d):
    r = P._report(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("reports"))
    t = r.agg(F.sum("reports").alias("t"), F.sum(F.when(F.col("verdict") != "INSUFFICIENT_EVIDENCE", F.col("reports")).otherwise(0)).alias("known"))
    return r.crossJoin(F.broadcast(t)).select("verdict", "reports", F.round(F.col("reports") / F.col("t"), 6).alias("share"), F.round(F.col("known") / F.col("t"), 6).alias("coverage"))  # one row broadcast


QUERIES["verdict_distribution"] = _verdicts
ORACLE["verdict_distribution"] = f"{P.REPORT} SELECT verdict, count(*) AS reports, round(count(*)::DOUBLE / (SELECT count(*) FROM report), 6) AS share, (SELECT round(avg((verdict <> 'INSUFFICIENT_EVIDENCE')::INT), 6) FROM report) AS coverage FROM report GROUP BY verdict"

# --- splits and features --------------------------------------------------------------------------------------------
QUERIES["stratified_split"] = lambda s, d: records.stratified_split(table(s, d, "final_health_claims").select("claim_id", "label"), "claim_id", "label").select("claim_id", "part")
ORACLE["stratified_split"] = "SELECT claim_id, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM (SELECT claim_id, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42:' || claim_id), 1, 8))::BIGINT, claim_id) AS r FROM final_health_claims WHERE label IS NOT NULL)"
QUERIES["head_sample"] = lambda s, d: records.head(table(s, d, "final_health_claims").select("claim_id", "label"), 100, "claim_id")
ORACLE["head_sample"] = "SELECT claim_id, label FROM final_health_claims ORDER BY claim_id LIMIT 100"


def _golden(s, d):
    return table(s, d, "golden_candidates_v0").select(F.col("id").alias("key"), F.col("original_text").alias("text"), F.col("source_label").alias("label"))


def _weights(s, d):
    g = _golden(s, d)
    return learning.tfidf(g, learning.vocabulary(g, 500)).select("key", "term", F.round("weight", 6).alias("weight"))


QUERIES["tfidf_weights"] = _weights
ORACLE["tfidf_weights"] = r"""WITH w AS (SELECT id AS key, regexp_extract_all(lower(original_text), '[\p{L}\p{N}_]{2,}') AS w FROM golden_candidates_v0 WHERE original_text IS NOT NULL), g AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(w) AS term FROM w UNION ALL SELECT key, unnest(list_transform(range(1, len(w)), i -> w[i] || ' ' || w[i+1])) FROM w) GROUP BY 1, 2),
v AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM w)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 500), x AS (SELECT key, term, (1 + ln(tf)) * idf AS x FROM g JOIN v USING (term)) SELECT key, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY key)), 6) AS weight FROM x"""


def _across(s, d):
    claims = table(s, d, "final_health_claims").select(F.col("claim_id").cast("string").alias("key"), F.col("claim").alias("text"), F.regexp_extract("label", "([01])", 1).try_cast("int").alias("label"))
    return learning.train_across(_golden(s, d), claims)


QUERIES["tfidf_across"] = _across

# --- files ----------------------------------------------------------------------------------------------------------
_URLS = ["https://a.example/health/", "https://a.example/#", "https://a.example/x/tea-1"]


def _addresses(s, d):
    g = table(s, d, "golden_candidates_v0").select(F.explode("evidence_urls").alias("url"))
    return readers.addresses(s, g).unionByName(readers.addresses(s, _URLS)).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


QUERIES["url_list"] = _addresses
ORACLE["url_list"] = f"SELECT url, count(*) AS n FROM (SELECT unnest(evidence_urls) AS url FROM golden_candidates_v0 UNION ALL SELECT unnest([{', '.join(map(S.q, _URLS))}])) WHERE list_last(string_split(rtrim(url, '/'), '/')) NOT IN ('#', 'health', '') GROUP BY 1"


def _array(s, d):
    at = f"{place(s)}/verdicts.json"
    sinks.json_array(table(s, d, "verified_facts").groupBy("verdict", "risk_level").agg(F.count(F.lit(1)).alias("facts")), at)
    return readers.json_array(s, at, "verdict string, risk_level string, facts long")


QUERIES["json_array_round_trip"] = _array
ORACLE["json_array_round_trip"] = "SELECT verdict, risk_level, count(*) AS facts FROM verified_facts GROUP BY 1, 2"


def _logged(s, d):
    at, lines = place(s), table(s, d, "verified_facts").select(F.concat(F.lit("[FACT] "), "source").alias("line"))
    for append in (False, True, True):
        sinks.log(lines, at, append)
    return s.read.text(at).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["log_round_trip"] = _logged
ORACLE["log_round_trip"] = "SELECT '[FACT] ' || source AS line, 3 * count(*) AS n FROM verified_facts GROUP BY 1"


def _sidecars(s, d):
    at = place(s)
    sinks.sidecars(table(s, d, "golden_candidates_v0").select("id", F.col("original_text").alias("passage"), F.col("source").alias("source_file")), at)
    return readers.sidecars(s, at)


QUERIES["sidecar_round_trip"] = _sidecars
ORACLE["sidecar_round_trip"] = r"SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS passage_index, regexp_replace(original_text, '[\r\n]+', ' ', 'g') AS passage, source AS source_file FROM golden_candidates_v0"


def _cache(s, d):
    at = place(s)
    table(s, d, "verified_facts").write.parquet(f"{at}/facts")
    sinks.cache_state(s.read.parquet(f"{at}/facts")).write.parquet(f"{at}/state")
    kept = s.read.parquet(f"{at}/state")
    same = sinks.cache_valid(sinks.cache_state(s.read.parquet(f"{at}/facts")), kept).select(F.lit("same").alias("source"), "valid")
    fewer = sinks.cache_valid(sinks.cache_state(s.read.parquet(f"{at}/facts").where("fact_id % 2 = 0")), kept).select(F.lit("fewer").alias("source"), "valid")
    return same.unionByName(fewer).unionByName(sinks.cache_valid(sinks.cache_state(s.read.parquet(f"{at}/facts")), kept.where("false")).select(F.lit("unknown").alias("source"), "valid"))


QUERIES["cache_validity"] = _cache
ORACLE["cache_validity"] = "SELECT * FROM (VALUES ('same', true), ('fewer', false), ('unknown', false)) t(source, valid)"
ORACLE = {k: S.lambdas(v) for k, v in ORACLE.items()}
