"""Queries of readers and sinks: tables written in a form of the engine and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import learning, records, verify
from ..session import place
from ..sources import readers, sinks
from ..sources.tables import table
from ..streaming import flows
from . import reports as P
from . import retrieval as R
from . import sql as S

QUERIES, ORACLE = {}, {}


def _facts(s, d):
    return table(s, d, "verified_facts").select("fact_id", "claim_subject", "verdict", "scientific_truth", "risk_level", "source")


def _csv(df, at):
    df.write.options(quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", lineSep="\n").csv(at, header=True)
    return at


def _training(s, d):
    at = _csv(_facts(s, d).select(F.col("claim_subject").alias("text"), F.col("verdict").alias("risk_label"), F.lit("x").alias("label")), place(s))
    return readers.training_texts(s, at).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"))


QUERIES["training_csv"] = _training
ORACLE["training_csv"] = "SELECT verdict AS label, count(*) AS n, sum(length(" + S.strip(f"regexp_replace(regexp_replace(lower(claim_subject), {S.q(S.S + '+')}, ' ', 'g'), '[!?]{{2,}}', '!', 'g')").replace("{{", "{").replace("}}", "}") + "))::BIGINT AS characters FROM verified_facts GROUP BY 1"

_WORDS = [("Kadha", "Herbal Drink", "FOOD"), (" ", "nothing", "FOOD"), ("zukaam wali chai", "tea for a cold", "FOOD")]


def _lexicon(s, d):
    at = _csv(s.createDataFrame(_WORDS, "hinglish string, english string, category string"), place(s))
    return s.createDataFrame(readers.lexicon(s, at), "phrase string, english string").withColumn("length", F.length("phrase"))


QUERIES["lexicon_csv"] = _lexicon
_BUILT = {**dict(lx.PHRASES_BUILT_IN), "kadha": "herbal drink", "zukaam wali chai": "tea for a cold"}
ORACLE["lexicon_csv"] = f"SELECT *, length(phrase)::INT AS length FROM (VALUES {', '.join(f'({S.q(a)}, {S.q(b)})' for a, b in _BUILT.items())}) t(phrase, english)"


def _news(s, d):
    part = lambda v: _csv(_facts(s, d).where(F.col("verdict") == v).select(F.col("claim_subject").alias("title"), F.col("scientific_truth").alias("text")), place(s))
    return readers.two_files(s, part("FALSE"), part("TRUE"), "title string, text string").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("titles"))


QUERIES["news_csv"] = _news
ORACLE["news_csv"] = "SELECT CASE verdict WHEN 'FALSE' THEN 1 ELSE 0 END AS label, count(*) AS n, count(nullif(claim_subject, '')) AS titles FROM verified_facts WHERE verdict IN ('TRUE', 'FALSE') GROUP BY 1"


def _named(s, d):
    k = F.element_at(F.array(*[F.lit(x) for x in ("Fake", "REAL", "1", "other")]), (F.col("fact_id") % 4).cast("int") + 1)
    return readers.named_labels(s, _csv(_facts(s, d).select(F.col("claim_subject").alias("text"), k.alias("label")), place(s))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


QUERIES["named_labels_csv"] = _named
ORACLE["named_labels_csv"] = "SELECT [0, 1, 1][(fact_id % 4)::INT + 1] AS label, count(*) AS n FROM verified_facts WHERE fact_id % 4 < 3 AND claim_subject <> '' GROUP BY 1"


def _facts_json(s, d):
    at = f"{place(s)}/facts.json"
    sinks.json_array(_facts(s, d).drop("fact_id"), at)
    return readers.json_array(s, at).groupBy("verdict", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.count("scientific_truth").alias("truths"), F.sum(F.length("claim_subject")).alias("characters"))


QUERIES["facts_json"] = _facts_json
ORACLE["facts_json"] = "SELECT verdict, risk_level, count(*) AS n, count(scientific_truth) AS truths, sum(length(claim_subject))::BIGINT AS characters FROM verified_facts GROUP BY 1, 2"


def _unreviewed(s, d):
    at = f"{place(s)}/unreviewed.json"
    sinks.json_array(_facts(s, d).select(F.col("claim_subject").alias("claim"), F.col("scientific_truth").alias("explanation")), at)
    return readers.json_array(s, at, readers.UNREVIEWED).agg(F.count("claim").alias("claims"), F.count("explanation").alias("explanations"), F.sum(F.length("explanation")).alias("characters"))


QUERIES["unreviewed_json"] = _unreviewed
ORACLE["unreviewed_json"] = "SELECT count(*) AS claims, count(scientific_truth) AS explanations, sum(length(scientific_truth))::BIGINT AS characters FROM verified_facts"


def _patterns(s, d):
    at = place(s)
    _facts(s, d).select(tx.token_pattern(F.col("risk_level"), F.col("claim_subject"))).write.text(at)
    return readers.json_lines(s, at, "label string, pattern array<struct<LOWER:string>>").groupBy("label", F.size("pattern").alias("words")).agg(F.count(F.lit(1)).alias("n"), F.min("pattern.LOWER").alias("least")).withColumn("least", F.array_join("least", " "))


QUERIES["patterns_jsonl"] = _patterns
_sw = f"list_filter(string_split({S.squeeze('claim_subject')}, ' '), x -> x <> '')"
ORACLE["patterns_jsonl"] = f"SELECT risk_level AS label, len({_sw})::INT AS words, count(*) AS n, array_to_string(min(list_transform({_sw}, x -> lower(x))), ' ') AS least FROM verified_facts GROUP BY 1, 2"


def _article_files(s, d):
    at = place(s)
    table(s, d, "documents").where("text is not null").select("text").write.text(at)
    return at


def _totals(p):
    return p.agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("passage")).alias("characters"))


def _ingested(s, d):
    at, out = _article_files(s, d), place(s)
    for _ in range(2):  # the second run finds nothing new
        flows.ingest_articles(s, at, f"{out}/passages", f"{out}/checkpoint").awaitTermination()
    return _totals(s.read.schema("file_name string, line_no int, passage string").parquet(f"{out}/passages"))


_LINES = ("WITH l AS (SELECT " + S.strip("l") + " AS passage FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS l FROM documents WHERE text IS NOT NULL)) SELECT count(*) AS passages, sum(length(passage))::BIGINT AS characters FROM l WHERE length(passage) >= 20 "
          r"AND NOT (upper(passage) = passage AND regexp_matches(passage, '\p{Lu}') AND NOT regexp_matches(passage, '\p{Ll}')) AND NOT regexp_matches(passage, '^(SOURCE:|URL:|TITLE:)') AND NOT contains(passage, '─')")
QUERIES["article_folder"] = lambda s, d: _totals(readers.articles(s, _article_files(s, d)))
ORACLE["article_folder"] = _LINES
QUERIES["stream_ingest"] = _ingested
ORACLE["stream_ingest"] = _LINES


def _articles(s, d):
    x = table(s, d, "documents").where("text is not null and source is not null").select("doc_id", "source", F.regexp_replace("file_name", "[.]txt$", "").alias("slug"), F.lit("T").alias("title"), F.concat(F.lit("https://a.example/"), "file_name").alias("url"), F.col("text").alias("body"))
    return sinks.article_rows(x)


QUERIES["article_rows"] = _articles
ORACLE["article_rows"] = f"SELECT source || '__' || regexp_replace(file_name, '[.]txt$', '') || '.txt' AS file_name, 'SOURCE: ' || source || chr(10) || 'TITLE: T' || chr(10) || 'URL: https://a.example/' || file_name || chr(10) || '{'─' * 30}' || chr(10) || text AS content FROM documents WHERE text IS NOT NULL AND source IS NOT NULL"


def _manifest(s, d):
    at, names = place(s), table(s, d, "documents").select("file_name")
    sinks.manifest(names.where("file_name < 'm'"), at)
    sinks.manifest(names, at)
    return s.read.schema("file_name string").parquet(at).distinct()


QUERIES["manifest"] = _manifest
ORACLE["manifest"] = "SELECT DISTINCT file_name FROM documents"


def _markdown(s, d):
    t = sinks.markdown(_facts(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("facts")).orderBy("verdict"), "Facts")
    return s.createDataFrame([(t,)], "report string")


QUERIES["markdown_report"] = _markdown
ORACLE["markdown_report"] = "SELECT '# Facts' || chr(10) || chr(10) || '| verdict | facts |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || verdict || ' | ' || n || ' |', chr(10) ORDER BY verdict) || chr(10) AS report FROM (SELECT verdict, count(*) AS n FROM verified_facts GROUP BY 1)"


def _invalidated(s, d):
    at = place(s)
    _facts(s, d).write.parquet(at)
    return s.createDataFrame([(k, sinks.invalidate(s, at)) for k in ("first", "again")], "call string, removed boolean")


QUERIES["cache_invalidation"] = _invalidated
ORACLE["cache_invalidation"] = "SELECT * FROM (VALUES ('first', true), ('again', false)) t(call, removed)"


def _index(s, d):
    at = place(s)
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.concat(F.lit("line\n"), "vec_id").alias("passage"), F.concat(F.lit("f"), F.col("vec_id") % 7).alias("source_file"))
    sinks.vectors(rows.where("id % 2 = 0"), at)
    sinks.vectors(rows.where("id % 2 = 1"), at)
    q = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    return verify.VectorIndex.load(s, at).search(q, 3).select("qid", "id", "rank", "passage", "source_file")


QUERIES["vector_index"] = _index
ORACLE["vector_index"] = ("WITH x AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS v FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) SELECT qid, id, rank, 'line ' || id AS passage, 'f' || (id % 7) AS source_file FROM "
                          "(SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(v, 9) DESC, id)::INT AS rank FROM x) WHERE rank <= 3")
QUERIES["embedded_texts"] = lambda s, d: _facts(s, d).select("fact_id", F.posexplode(verify.embed(F.col("claim_subject"))).alias("bucket", "v")).where("v != 0").select("fact_id", "bucket", F.round("v", 6).alias("value"))
ORACLE["embedded_texts"] = f"WITH {S.embedded('e', 'verified_facts', 'fact_id', 'claim_subject')} SELECT fact_id, bucket, round(x / length, 6) AS value FROM ev JOIN em USING (fact_id) WHERE x <> 0"

# --- answers of models ----------------------------------------------------------------------------------------------
_SAID = ["Verdict: TRUE\nConfidence: 0.9\nReason: known", "Verdict: FALSE\nConfidence: 0.2\nReason: guess", "```\nverdict: FALSE\nconfidence: 0.6\nreason: tried\n```"]


def _answered(s, d):
    t = verify.tier_one(R._claims(s, d), P.facts(s, d)).where("qid % 3 != 1")
    a = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("qid") / 50 % 3).cast("int") + 1)
    return verify.with_answers(t, t.select("qid", a.alias("answer"))).select("qid", "match_type", "verdict", "truth")


QUERIES["answered_claims"] = _answered
ORACLE["answered_claims"] = (f"{R.BASE}, tq AS (SELECT qid, text AS claim FROM q), {P.FACTS}, {P.tier_sql('tier', 'tq')} SELECT qid, CASE WHEN t THEN 'LLM' ELSE match_type END AS match_type, CASE WHEN t THEN ['TRUE', '', 'FALSE'][k] ELSE verdict END AS verdict, CASE WHEN t THEN ['known', '', 'tried'][k] ELSE truth END AS truth FROM "
                             "(SELECT *, (qid // 50 % 3 + 1)::INT AS k, match_type = 'NONE' AND qid // 50 % 3 <> 1 AS t FROM tier) WHERE qid % 3 <> 1")
_kb = lambda: F.when(F.col("fact_id") % 5 == 0, F.concat(F.lit("Unverified: "), "scientific_truth")).when(F.col("fact_id") % 3 == 0, F.concat("scientific_truth", F.lit(" [NLI: SUPPORTS 0.9]"))).otherwise(F.col("scientific_truth"))
QUERIES["kb_truths"] = lambda s, d: _facts(s, d).select("fact_id", tx.kb_truth(_kb()).alias("truth"))
ORACLE["kb_truths"] = "SELECT fact_id, CASE WHEN scientific_truth IS NULL OR fact_id % 5 = 0 THEN '' ELSE scientific_truth END AS truth FROM verified_facts"
QUERIES["fenced_answers"] = lambda s, d: _facts(s, d).select("fact_id", tx.strip_fences(F.concat(F.lit(" ```json\n\""), F.coalesce("scientific_truth", F.lit("")), F.lit("'\n``` "))).alias("answer"))
ORACLE["fenced_answers"] = "SELECT fact_id, trim(coalesce(scientific_truth, '')) AS answer FROM verified_facts"
QUERIES["token_gate"] = lambda s, d: _facts(s, d).select("fact_id", tx.has_token(F.col("claim_subject"), F.lit("Water")).alias("water"), tx.has_token(F.col("claim_subject"), F.lower(F.col("risk_level"))).alias("level"))
ORACLE["token_gate"] = f"SELECT fact_id, list_contains({S.words('claim_subject')}, 'water') AS water, CASE WHEN risk_level IS NOT NULL THEN list_contains({S.words('claim_subject')}, lower(risk_level)) END AS level FROM verified_facts"
_NLI = ["Contradiction", "neutral", "ENTAILMENT", "other", None]
QUERIES["nli_labels"] = lambda s, d: _facts(s, d).select("fact_id", tx.nli_label(F.element_at(F.array(*[F.lit(x) for x in _NLI]), (F.col("fact_id") % 5).cast("int") + 1)).alias("label"))
ORACLE["nli_labels"] = "SELECT fact_id, ['REFUTES', 'NEI', 'SUPPORTS', 'NEI', 'NEI'][(fact_id % 5)::INT + 1] AS label FROM verified_facts"
QUERIES["shuffled_sample"] = lambda s, d: records.shuffled(table(s, d, "final_health_claims").select("claim_id"), "claim_id").limit(200)
ORACLE["shuffled_sample"] = "SELECT claim_id FROM final_health_claims ORDER BY md5('42:' || claim_id), claim_id LIMIT 200"


def _saved(s, d):
    """A saved model's predictions are those of the model that was saved; counted."""
    at = place(s)
    g = table(s, d, "golden_candidates_v0").select(F.col("id").alias("key"), F.col("original_text").alias("text"), F.col("source_label").alias("label"))
    learning.train_across(g, g, path=at)
    return learning.predict(s, at, g).agg(F.count("prediction").alias("rows"), (F.avg((F.col("prediction") == F.col("label")).cast("double")) > 0.8).alias("fits"), F.count_if((F.col("probability") > 0.5) != (F.col("prediction") == 1)).alias("odd"))


QUERIES["saved_model"] = _saved
ORACLE["saved_model"] = "SELECT count(*) AS rows, true AS fits, 0 AS odd FROM golden_candidates_v0 WHERE original_text IS NOT NULL"
ORACLE = {k: S.lambdas(v) for k, v in ORACLE.items()}
