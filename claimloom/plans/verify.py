"""Queries of the fact base, of claims in several languages, of reports and tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import metrics, multilingual, verify
from ..sources.tables import table, text_table
from . import retrieval as R
from . import sql as S
from .reports import topics_sql

QUERIES, ORACLE = {}, {}


QUERIES["topic_gate"] = lambda s, d: table(s, d, "verified_facts").select("fact_id", F.coalesce(verify.same_topic(F.col("claim_subject"), F.col("scientific_truth")), F.lit(False)).alias("same"))
ORACLE["topic_gate"] = f"SELECT fact_id, coalesce(list_has_any({topics_sql('claim_subject')}, {topics_sql('scientific_truth')}), false) AS same FROM verified_facts"



def _gloss(s, d):
    m = table(s, d, "multilingual_claims").select("claim_key", "original_text", "canonical_indic_text", "english_gloss", "transformation_confidence", "source_language")
    m = m.withColumn("g", multilingual.gloss_check(F.col("original_text"), F.col("english_gloss"), F.col("transformation_confidence")))
    english = F.coalesce(F.lower(F.trim("source_language")).startswith("eng"), F.lit(False))
    pick = multilingual.analysis_text(F.col("original_text"), F.col("canonical_indic_text"), F.col("english_gloss"), english, F.col("g.accepted"))
    return m.select("claim_key", F.col("g.accepted").alias("accepted"), F.col("g.confidence").alias("confidence"), F.array_join("g.warnings", "|").alias("warnings"), pick.alias("analysis_text"))


QUERIES["gloss_gate"] = _gloss
_sv = r"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(original_text, '\b[0-9]+(?:[.,][0-9]+)?\s*(?:[a-zA-Z%]+)?\b'), x -> trim(lower(x))), list_transform(regexp_extract_all(original_text, '(?i)https?://\S+|www\.\S+'), x -> lower(x)))))"
_range = lambda r: "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in r) + "]"
_other = "|".join(_range(r) for r in lx.SCRIPTS.values())
ORACLE["gloss_gate"] = (f"WITH a AS (SELECT *, english_gloss IS NULL OR trim(english_gloss) = '' AS blank, coalesce(transformation_confidence, 0) AS s, list_filter({_sv}, v -> NOT contains(lower(coalesce(english_gloss, '')), v)) AS miss, "
                        f"regexp_matches(coalesce(english_gloss, ''), '[A-Za-z]') AND NOT regexp_matches(coalesce(english_gloss, ''), {S.q(_other)}) AS latin FROM multilingual_claims), "
                        "b AS (SELECT *, CASE WHEN blank THEN ['no text'] ELSE list_concat(list_transform(miss, v -> 'missing value: ' || v), CASE WHEN s < 0.72 THEN ['low similarity'] ELSE [] END, CASE WHEN NOT latin THEN ['not in Latin letters'] ELSE [] END) END AS w FROM a) "
                        "SELECT claim_key, len(w) = 0 AS accepted, CASE WHEN blank THEN 0.0 ELSE round(greatest(0, s - 0.2 * len(miss)), 6) END::DOUBLE AS confidence, array_to_string(w, '|') AS warnings, "
                        "CASE WHEN coalesce(starts_with(lower(trim(source_language)), 'eng'), false) THEN original_text WHEN len(w) = 0 AND NOT blank THEN english_gloss WHEN trim(canonical_indic_text) <> '' THEN canonical_indic_text ELSE original_text END AS analysis_text FROM b")

QUERIES["protected_spans"] = lambda s, d: text_table(s, d, "canonical_claims", "claim_ref", "original_text").where("original_text is not null").select(
    "claim_ref", multilingual.transform_unprotected(F.col("original_text"), tx.protected_entities(F.col("original_text")), lambda t: F.concat(F.lit("<"), F.lower(t), F.lit(">"))).alias("text"))
_caps = f"list_concat(list_filter(regexp_extract_all(original_text, {S.q(S.W + '+')}), x -> regexp_full_match(x, '[A-Z][a-z]+')), regexp_extract_all(original_text, '(?i)[0-9]+\\s*(?:mg|ml|gm|iu|mcg|%)'))"
ORACLE["protected_spans"] = (f"WITH a AS (SELECT claim_ref, {_caps} AS p, regexp_extract_all(original_text, {S.q(S.S + '+|[^' + S.S[1:-1] + ']+')}) AS t FROM canonical_claims WHERE original_text IS NOT NULL) "
                             f"SELECT claim_ref, array_to_string(list_transform(t, x -> CASE WHEN regexp_full_match(x, {S.q(S.S + '+')}) OR regexp_matches(x, '[0-9]') OR list_contains(p, x) THEN x ELSE '<' || lower(x) || '>' END), '') AS text FROM a")

QUERIES["claim_assembly"] = lambda s, d: (text_table(s, d, "canonical_claims", "claim_ref", "original_text", "normalized_text").where("original_text is not null and normalized_text is not null").select(
    "claim_ref", tx.basic_language(F.col("normalized_text")).alias("language"), tx.route(F.col("original_text")).alias("route"),
    F.when(tx.route(F.col("original_text")) == "medical_advice", "personal_medical_question").otherwise("general_assertion").alias("claim_type"),
    F.when(tx.route(F.col("original_text")) == "medical_advice", 0).otherwise(F.size(tx.sub_claims(F.col("normalized_text")))).cast("long").alias("sub_claims")))
_split = "regexp_replace(regexp_replace(normalized_text, {p}, '\\1' || chr(1) || '\\3', 'g'), {p}, '\\1' || chr(1) || '\\3', 'g')".replace("{p}", S.q("(^|[^" + S.W[1:-1] + "])(and|aur|evam)($|[^" + S.W[1:-1] + "])"))
ORACLE["claim_assembly"] = (f"WITH a AS (SELECT claim_ref, {S.word('original_text', lx.ADVICE)} AS adv, list_has_any({S.words('normalized_text')}, [{', '.join(S.q(x) for x in lx.HINGLISH_MARKERS)}]) AS h, "
                            f"len(list_filter(string_split({_split}, chr(1)), x -> {S.strip('x')} <> '')) AS n FROM canonical_claims WHERE original_text IS NOT NULL AND normalized_text IS NOT NULL) "
                            "SELECT claim_ref, CASE WHEN h THEN 'hinglish' ELSE 'en' END AS language, CASE WHEN adv THEN 'medical_advice' ELSE 'fact_check' END AS route, CASE WHEN adv THEN 'personal_medical_question' ELSE 'general_assertion' END AS claim_type, "
                            "CASE WHEN adv THEN 0 WHEN n = 0 THEN 1 ELSE n END::BIGINT AS sub_claims FROM a")


def _plain_report(s, d):
    """Report by the reading alone (P14): risk of 0.7 verdict and 0.3 style."""
    v = F.element_at(F.array(*[F.lit(x) for x in ("SUPPORTS", "REFUTES", "NEI")]), (F.col("fact_id") % 3).cast("int") + 1)
    f = table(s, d, "verified_facts").select("fact_id", v.alias("v"), ((F.col("fact_id") % 21) / 20.0).alias("style"), F.coalesce("scientific_truth", F.lit("")).alias("evidence"))
    base = F.when(F.col("v") == "SUPPORTS", 0.1).when(F.col("v") == "REFUTES", 0.9).otherwise(0.5)
    label = F.when(F.col("v") == "SUPPORTS", lx.PLAIN_SAFE).when(F.col("v") == "REFUTES", lx.PLAIN_RISK).otherwise(lx.PLAIN_OPEN)
    why = F.when(F.col("v") == "REFUTES", F.concat(F.lit(lx.PLAIN_REFUTED), "evidence", F.lit("'"))).when(
        F.col("v") == "SUPPORTS", F.concat(F.lit(lx.PLAIN_SUPPORTED), "evidence", F.lit("'"))).otherwise(lx.PLAIN_UNKNOWN)
    return f.select("fact_id", label.alias("verdict"), F.round(base * 0.7 + F.col("style") * 0.3 + 1e-7, 3).alias("risk"), why.alias("explanation"))


QUERIES["plain_report"] = _plain_report
ORACLE["plain_report"] = """WITH f AS (SELECT fact_id, ['SUPPORTS', 'REFUTES', 'NEI'][(fact_id % 3)::INT + 1] AS v, (fact_id % 21) / 20.0::DOUBLE AS style, coalesce(scientific_truth, '') AS e FROM verified_facts)
SELECT fact_id, CASE v WHEN 'SUPPORTS' THEN 'SAFE' WHEN 'REFUTES' THEN 'HIGH RISK / MISINFORMATION' ELSE 'UNCERTAIN / UNVERIFIED' END AS verdict, round(CASE v WHEN 'SUPPORTS' THEN 0.1 WHEN 'REFUTES' THEN 0.9 ELSE 0.5 END::DOUBLE * 0.7 + style * 0.3 + 1e-7, 3) AS risk,
CASE v WHEN 'REFUTES' THEN 'This claim seems incorrect. Reliable sources state: ''' || e || '''' WHEN 'SUPPORTS' THEN 'This is likely true. According to health guidelines: ''' || e || '''' ELSE 'We couldn''t find enough scientific evidence to confirm or deny this claim.' END AS explanation FROM f"""

QUERIES["triple_histogram"] = lambda s, d: text_table(s, d, "final_health_claims", "claim").where("claim is not null").groupBy(tx.triple(F.col("claim")).isNotNull().cast("int").alias("triples")).agg(F.count(F.lit(1)).alias("claims"))
_w = S.W[1:-1]
ORACLE["triple_histogram"] = (f"WITH w AS (SELECT list_filter(regexp_split_to_array(trim(regexp_replace(lower(claim), {S.q('[^' + _w + chr(92) + 's' + chr(39) + '-]')}, ' ', 'g')), '\\s+'), x -> x <> '') AS w FROM final_health_claims WHERE claim IS NOT NULL), "
                              f"p AS (SELECT w, list_position(list_transform(w, x -> x IN ({', '.join(S.q(x) for x in lx.ACTION_WORDS)})), true) AS k FROM w) "
                              f"SELECT coalesce(k > 1 AND len(w) > k AND array_to_string(w[1:k-1], ' ') <> array_to_string(w[k+1:], ' ') AND array_to_string(w[k+1:], ' ') NOT IN ({', '.join(S.q(x) for x in lx.TRIVIAL_OBJECTS)}), false)::INT AS triples, count(*) AS claims FROM p GROUP BY 1")


def _tallies(s, d):
    """What an ingest of the documents would do with each."""
    x = text_table(s, d, "documents", "doc_id", "text", "file_name")
    first = x.groupBy("file_name").agg(F.min("doc_id").alias("first"))
    n = F.size(F.split(tx.squeeze(F.col("text")), " "))
    kind = F.when(F.col("text").isNull() | (F.trim("text") == ""), "blocked").when(F.col("doc_id") != F.col("first"), "already").when(n < 150, "skipped").otherwise("saved")
    return x.join(first, "file_name").groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("documents"))


QUERIES["ingest_tallies"] = _tallies
ORACLE["ingest_tallies"] = f"WITH x AS (SELECT *, min(doc_id) OVER (PARTITION BY file_name) AS first FROM documents) SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'blocked' WHEN doc_id <> first THEN 'already' WHEN len(string_split({S.squeeze('text')}, ' ')) < 150 THEN 'skipped' ELSE 'saved' END AS outcome, count(*) AS documents FROM x GROUP BY 1"

QUERIES["softmax_label"] = lambda s, d: (table(s, d, "embeddings").select("vec_id", verify.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))).alias("p"))
                                         .select("vec_id", F.round(F.array_max("p"), 6).alias("confidence"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label")))
ORACLE["softmax_label"] = "WITH a AS (SELECT vec_id, list_transform(embedding[1:3], x -> exp(x::DOUBLE - list_max(embedding[1:3])::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS confidence, (list_position(e, list_max(e)) - 1)::INT AS label FROM a"


def _ablation(s, d):
    """Hit at 1 and mean reciprocal rank of each way to rank, against facts that share its long words."""
    size, found = R.gold_ranks(s, d)
    out = None
    for name, most in (("lexical", 15), ("fused", None), ("reranked", 15)):
        hits = found.select("qid", F.col(name).alias("rank")).where("rank is not null" if most is None else f"rank <= {most}")
        m = metrics.means(size, hits, (1,)).select(F.lit(name).alias("mode"), F.round("mrr", 6).alias("mrr"), F.round("recall_at_1", 6).alias("recall_at_1"), "queries")
        out = m if out is None else out.unionByName(m)
    return out


QUERIES["ablation"] = _ablation
_one = lambda name, src: (f"SELECT {S.q(name)} AS mode, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, round(avg(coalesce(h, 0)::DOUBLE / n), 6) AS recall_at_1, count(*) AS queries FROM gn LEFT JOIN (SELECT qid, min(rank) AS f, count(*) FILTER (WHERE rank = 1) AS h FROM ({src}) JOIN gold USING (qid, pid) GROUP BY qid) USING (qid)")
ORACLE["ablation"] = (f"{R.CHAIN}, {R.bm25_sql('z', 'q', 15)}, {R.GOLD} " + _one("lexical", "SELECT * FROM z") + " UNION ALL " + _one("fused", "SELECT qid, pid, rrf_rank AS rank FROM cand") + " UNION ALL " + _one("reranked", "SELECT qid, pid, rank FROM rk WHERE rank <= 15"))
ORACLE = {k: S.lambdas(v) for k, v in ORACLE.items()}
