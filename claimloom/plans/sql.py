"""Pieces of SQL for the queries' equal statements."""

from __future__ import annotations

import re

W = r"[\p{L}\p{N}_]"
S = r"[\s\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {q(t)})" for t in terms) + ")"


def count(col: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({col}), {q(t)})::INT" for t in terms) + ")"


def word(col: str, patterns: list[str]) -> str:
    return f"regexp_matches(lower({col}), {q('(^|[^' + W[1:-1] + '])(' + '|'.join(patterns) + ')($|[^' + W[1:-1] + '])')})"


def squeeze(col: str) -> str:
    return f"trim(regexp_replace({col}, {q(S + '+')}, ' ', 'g'))"


def strip(col: str) -> str:
    return f"regexp_replace({col}, {q('^' + S + '+|' + S + '+$')}, '', 'g')"


def words(col: str) -> str:
    return f"regexp_extract_all(lower({col}), {q(W + '+')})"


def case(col: str, table: dict, otherwise) -> str:
    """The value of the first key contained in a text."""
    v = lambda x: q(x) if isinstance(x, str) else repr(x)
    return "CASE " + " ".join(f"WHEN contains(lower({col}), {q(k)}) THEN {v(x)}" for k, x in table.items()) + f" ELSE {v(otherwise)} END"


def lookup(col: str, table: dict, otherwise: float) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {v!r}" for k, v in table.items()) + f" ELSE {otherwise!r} END"


def regex_count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {q(pattern)}))"


def lambdas(statement: str) -> str:
    """`x -> ...` in the form that the SQL engine takes."""
    return re.sub(r"\b([a-z]) -> ", r"lambda \1: ", statement)


def embedded(name: str, source: str, key: str, text: str) -> str:
    """CTEs `name`v (key, bucket, x) and `name`m (key, length): the default embedding of the texts of `source`, zeros left out."""
    number = lambda a: f"('0x' || substr(md5(w), {a}, 2))::INT"
    return (f"{name}v AS (SELECT {key}, {number(1)} % 64 AS bucket, sum(CASE WHEN {number(3)} >= 128 THEN 1 ELSE -1 END)::DOUBLE AS x FROM "
            f"(SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}) GROUP BY 1, 2), {name}m AS (SELECT {key}, sqrt(sum(x * x)) AS length FROM {name}v GROUP BY 1)")


def distances(name: str, a: str, b: str) -> str:
    """CTE `name` (qid, pid, score): squared distances of all texts of `a` (qid) and `b` (pid), which `embedded` has."""
    return (f"{name}d AS (SELECT qid, pid, sum(a.x * b.x) AS dot FROM {a}v a JOIN {b}v b USING (bucket) GROUP BY 1, 2), "
            f"{name} AS (SELECT q.qid, p.pid, round((coalesce(l.length, 0) > 0)::INT + (coalesce(r.length, 0) > 0)::INT - 2 * coalesce(dot / (l.length * r.length), 0), 9) + 0.0 AS score "
            f"FROM {a} q CROSS JOIN {b} p LEFT JOIN {a}m l ON l.qid = q.qid LEFT JOIN {b}m r ON r.pid = p.pid LEFT JOIN {name}d d ON d.qid = q.qid AND d.pid = p.pid)")
