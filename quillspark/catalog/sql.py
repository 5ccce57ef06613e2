"""Fragments shared by the DuckDB counterparts."""

from __future__ import annotations

from quillspark.functions.text import STOP_WORDS, WHITESPACE

DIM = 64


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = lit(WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def content_tokens(x: str) -> str:
    stop = ", ".join(lit(w) for w in STOP_WORDS)
    kept = f"list_filter({tokens(x)}, lambda t: length(t) > 1 AND t NOT IN ({stop}))"
    return f"list_distinct(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens(x)} END)"


def fold(x: str) -> str:
    return f"lower(strip_accents(translate({x}, 'đĐ', 'dD')))"


def overlap(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}), 0))"


def vectors(name: str, source: str, key: str, text: str, dim: int = DIM) -> str:
    """CTEs ending in ``name``(id, b, x): the hashed token vectors in long form."""
    return f"""
{name}_t AS (SELECT {key} AS id, unnest({tokens(text)}) AS t FROM {source}),
{name}_m AS (SELECT id, md5(t) AS h, count(*) AS c FROM {name}_t GROUP BY 1, 2),
{name}_s AS (SELECT id, (('0x' || substr(h, 1, 8))::BIGINT % {dim}) AS b,
    sum(CASE WHEN substr(h, 9, 1) < '8' THEN c ELSE -c END)::DOUBLE AS w FROM {name}_m GROUP BY 1, 2),
{name}_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM {name}_s GROUP BY 1),
{name} AS (SELECT s.id, s.b, (s.w / n.n)::FLOAT::DOUBLE AS x FROM {name}_s s JOIN {name}_n n ON s.id = n.id WHERE n.n > 0)"""


def text_search(name: str, asks: str, docs: str, k: int, pair_filter: str = "TRUE") -> str:
    """CTEs ending in ``name``(qid, cid, score, seq).

    ``asks`` is a CTE (qid, ask_no, query); ``docs`` the name of a vector CTE.
    """
    return f"""
{name}_a AS (SELECT qid, ask_no, qid::VARCHAR || '|' || ask_no::VARCHAR AS ask, query FROM {asks}),
{vectors(name + "_v", name + "_a", "ask", "query")},
{name}_p AS (SELECT q.id AS ask, d.id AS cid, round(sum(q.x * d.x), 9) AS score
    FROM {name}_v q JOIN {docs} d ON q.b = d.b GROUP BY 1, 2),
{name}_r AS (SELECT a.qid, a.ask_no, p.cid, p.score,
    row_number() OVER (PARTITION BY p.ask ORDER BY p.score DESC, p.cid) AS r
    FROM {name}_p p JOIN {name}_a a ON p.ask = a.ask WHERE {pair_filter}),
{name}_k AS (SELECT * FROM {name}_r WHERE r <= {k}),
{name}_b AS (SELECT *, row_number() OVER (PARTITION BY qid, cid ORDER BY score DESC, ask_no, r) AS best,
    min(ask_no * 100000 + r) OVER (PARTITION BY qid, cid) AS seen FROM {name}_k),
{name} AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS seq
    FROM {name}_b WHERE best = 1)"""


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def rerank(name: str, pool: str, questions: str, k: int | str, cap: int = 30) -> str:
    """CTEs ending in ``name``(qid, cid, score, rank) from ``pool``(qid, cid, score, seq)."""
    share = overlap("qt", "dt")
    return f"""
{name}_q AS (SELECT qid, {content_tokens("question")} AS qt FROM {questions}),
{name}_c AS (SELECT p.qid, p.cid, p.seq, row_number() OVER (PARTITION BY p.qid ORDER BY p.seq) AS arrived FROM {pool} p),
{name}_d AS (SELECT doc_id, {content_tokens("text")} AS dt FROM documents
    WHERE doc_id IN (SELECT cid FROM {name}_c) AND {strip("text")} <> ''),
{name}_s AS (SELECT c.qid, c.cid, c.seq, {sigmoid(f"coalesce({share}, 0.0) * 8.0 - 6.0")} AS score
    FROM {name}_c c JOIN {name}_d d ON c.cid = d.doc_id JOIN {name}_q q ON c.qid = q.qid WHERE c.arrived <= {cap}),
{name} AS (SELECT * FROM (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank
    FROM {name}_s) WHERE rank <= {k})"""


DOC_VECTORS = vectors("dv", "documents", "doc_id", "text")
