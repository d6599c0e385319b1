"""Queries of the text operators, one group per problem."""

from __future__ import annotations

from ..sources.tables import table, text_table
from . import byte_bpe, copies, languages, leaks, lookalikes, overlap, scans, subjects

_FIELDS = ["original_text", "canonical_indic_text"]


def _splits(spark, d):
    return (text_table(spark, d, "final_health_claims", "claim_id", "claim", "split", "source"),
            text_table(spark, d, "golden_candidates_v0", "id", "original_text", "source"),
            text_table(spark, d, "verified_facts", "fact_id", "scientific_truth", "source"))


def _both(spark, d):
    return text_table(spark, d, "final_health_claims", "claim_id", "claim", "label"), text_table(spark, d, "claim_records", "record_id", "record")


def _multilingual(spark, d):
    return text_table(spark, d, "multilingual_claims", "claim_key", *_FIELDS)


def _documents(spark, d):
    return text_table(spark, d, "documents", "doc_id", "text")


def _labelled(spark, d):
    return (text_table(spark, d, "canonical_claims", "claim_ref", "original_text", "language"),
            text_table(spark, d, "multilingual_claims", "claim_key", "original_text", "source_language"))


def _scans(spark, d):
    return text_table(spark, d, "image_ingestion", "raw_input_id", "extracted_text", "ocr_confidence", "metadata")


def _subjects(spark, d):
    return _documents(spark, d), table(spark, d, "subject_labels"), table(spark, d, "subject_areas")


QUERIES = {
    "p1_found": lambda s, d: lookalikes.same_look(_multilingual(s, d), "claim_key", _FIELDS),
    "p1_canonical": lambda s, d: lookalikes.canonical(_multilingual(s, d), "claim_key", _FIELDS),
    "p1_classes": lambda s, d: lookalikes.look_classes(_multilingual(s, d), "claim_key", _FIELDS),
    "p2_found": lambda s, d: copies.table_copies(*_both(s, d)),
    "p2_groups": lambda s, d: copies.table_groups(*_both(s, d)),
    "p3_found": lambda s, d: overlap.overlap_pairs(*_splits(s, d)),
    "p3_split_source": lambda s, d: overlap.overlap_counts(*_splits(s, d)),
    "p4_found": lambda s, d: scans.defects(_scans(s, d)),
    "p4_repaired": lambda s, d: scans.repaired(_scans(s, d)),
    "p5_found": lambda s, d: languages.wrong_labels(*_labelled(s, d)),
    "p5_languages": lambda s, d: languages.claim_languages(*_labelled(s, d)).drop("label"),
    "p6_ids": lambda s, d: byte_bpe.encode(_documents(s, d), "doc_id", "text"),
    "p7_found": lambda s, d: leaks.leaked_items(_documents(s, d), table(s, d, "eval_items")),
    "p7_spans": lambda s, d: leaks.leak_spans(_documents(s, d), table(s, d, "eval_items")),
    "p7_report": lambda s, d: leaks.leak_report(_documents(s, d), table(s, d, "eval_items")),
    "p8_found": lambda s, d: subjects.document_areas(*_subjects(s, d)).select("doc_id", "area"),
    "p8_areas": lambda s, d: subjects.corpus_by_area(*_subjects(s, d)),
    "p8_calibration": lambda s, d: subjects.calibration(*_subjects(s, d)),
}
def _bare(v: str) -> str:
    """`copies.bare` in SQL, character by character."""
    c = f"lower(coalesce({v}, ''))"
    keep = "regexp_full_match(s[i], '[\\p{L}\\p{M}\\p{N}]') OR (regexp_full_match(s[i-1], '\\p{Nd}') AND regexp_full_match(s[i+1], '\\p{Nd}') AND NOT regexp_full_match(s[i], '[\\s\\p{Z}\\p{C}]'))"
    return f"(SELECT array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: {keep}), lambda i: s[i]), '') FROM (SELECT {c} AS s))"


def _field(name: str) -> str:
    """A field of a raw record in SQL, in any of the three layouts and key cases."""
    any_ = "|".join(copies.FIELDS)
    keys = ", ".join(f"""json_extract_string(j, '$."{k}"')""" for k in (name, name.upper(), name.capitalize()))
    plain = f"regexp_extract(regexp_replace(record, '[|;]\\s*({any_})\\s*[:=]', chr(1) || '\\1' || chr(2), 'gi'), '(?is)(?:^|\\x01)\\s*{name}\\s*[:=\\x02]([^\\x01]*)', 1)"
    return f"CASE WHEN j IS NOT NULL THEN coalesce({keys}) ELSE {plain} END"


_KEYS = f"""WITH c AS (SELECT 'final_health_claims' AS tbl, claim_id AS id, {_bare('claim')} || chr(1) || {_bare('label')} AS k FROM final_health_claims WHERE regexp_replace(coalesce(claim, ''), '[\\s\\p{{Z}}\\p{{C}}]', '', 'g') <> ''),
r0 AS (SELECT record_id AS id, record, CASE WHEN starts_with(ltrim(record), '{{') THEN record::JSON END AS j FROM claim_records), r1 AS (SELECT id, {', '.join(f"{_field(f)} AS {f}" for f in copies.FIELDS)} FROM r0),
r AS (SELECT 'claim_records' AS tbl, id, {" || chr(1) || ".join(_bare(f) for f in copies.FIELDS)} AS k FROM r1 WHERE regexp_replace(coalesce(claim, ''), '[\\s\\p{{Z}}\\p{{C}}]', '', 'g') <> ''), a AS (SELECT * FROM c UNION ALL SELECT * FROM r)"""
#: Runs of twelve words of documents and of items, joined.
_RUNS = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)), er AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
found AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (r))"""
_W = "'[\\p{L}\\p{N}]+'"
#: Windows of twelve words of documents with their places, runs of item parts, and islands of windows that overlap or touch.
_SPANS = f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS ts FROM documents WHERE text IS NOT NULL AND text <> ''), u AS (SELECT doc_id, unnest(ts) AS tok, unnest(range(1, len(ts) + 1)) AS i FROM t),
o AS (SELECT doc_id, i, lower(tok) AS w, (sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) - length(tok))::INT AS a, (sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS b, regexp_full_match(tok, {_W}) AS is_word FROM u),
n AS (SELECT doc_id, row_number() OVER d AS k, a, lead(b, 11) OVER d AS z, array_to_string(list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), ' ') AS r FROM o WHERE is_word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT item_id, 'text' AS part, regexp_extract_all(lower(text), {_W}) AS w FROM eval_items UNION ALL SELECT item_id, 'answer', regexp_extract_all(lower(answer), {_W}) FROM eval_items WHERE answer IS NOT NULL),
e AS (SELECT DISTINCT item_id, part, array_to_string(w[i:i+11], ' ') AS r FROM (SELECT item_id, part, w, unnest(range(1, len(w) - 10)) AS i FROM p)),
h AS (SELECT doc_id, item_id, part, k, a, z, CASE WHEN k - lag(k) OVER x <= 12 THEN 0 ELSE 1 END AS fresh FROM n JOIN e USING (r) WHERE z IS NOT NULL WINDOW x AS (PARTITION BY doc_id, item_id, part ORDER BY k)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id, part ORDER BY k) AS island FROM h)"""
ORACLE: dict[str, str] = {
    "p7_spans": f'{_SPANS} SELECT doc_id, item_id, part, min(a) AS start, max(z) AS "end" FROM g GROUP BY doc_id, item_id, part, island',
    "p2_found": f"{_KEYS} SELECT tbl, keep_id, id AS copy_id FROM (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, k) AS keep_id FROM a) WHERE id > keep_id",
    "p2_groups": f"{_KEYS} SELECT tbl, min(id) AS keep_id, count(*) AS copies FROM a GROUP BY tbl, k",
    "p7_found": f"{_RUNS} SELECT doc_id, item_id FROM found",
    "p7_report": f"{_RUNS} SELECT e.item_id, any_value(benchmark) AS benchmark, count(DISTINCT found.doc_id) AS documents FROM eval_items e LEFT JOIN found USING (item_id) GROUP BY 1",
}
