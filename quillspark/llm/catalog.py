"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import (
    byte_bpe, decontamination, imatch, language, lines, mixing, near_documents, near_vectors, personal_data, phrases, secrets, spelling, substrings,
)
from quillspark.llm.common import read_table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(read_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identified(docs, language.learned(docs, PIECES))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scanned(read_table(spark, sf_dir, "documents")))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.sanitised(read_table(spark, sf_dir, "documents")))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(read_table(spark, sf_dir, "documents"), digests=True)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.counted(read_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN)
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary)


def op10_minhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents.near_documents(read_table(spark, sf_dir, "documents"), 3, Fraction(85, 100))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_imatch_fingerprints, op2_language, op3_near_vectors, op4_secrets, op5_personal_data, op6_substrings, op7_mixing, op8_lines,
    op9_byte_bpe, op10_minhash_documents, op11_spelling_variants, op12_decontamination, op13_phrases,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


#: Exact for the result that the contract fixes; the anchors only find candidates.
SUBSTRINGS_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS win
    FROM words, unnest(generate_series(1, len(w) - 12)) AS u(k)
), firsts AS (
    SELECT win, min(doc_id) AS lo FROM windows GROUP BY win
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(k, k + 12)) AS k FROM windows JOIN firsts USING (win) WHERE lo < doc_id
), cut AS (
    SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN w
        ELSE list_transform(list_filter(generate_series(1, len(w)), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 by its table of 256 remainders; near words share a deletion at the same place, or one is a deletion of the other.
SPELLING_SQL = rf"""
WITH RECURSIVE remainders AS MATERIALIZED (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), counted AS MATERIALIZED (
    SELECT run, hex(encode(concat(doc_id, ':', run))) AS h, count(*) AS n FROM runs GROUP BY doc_id, run
), marked AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, len(h) // 2), lambda i: CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS mark
    FROM counted, remainders
), words AS MATERIALIZED (
    SELECT CASE WHEN mark % 97 = 0 THEN run[:mark % len(run)] || run[mark % len(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
    FROM marked GROUP BY 1 HAVING sum(n) >= 3 AND len(word) >= 5
), cut AS MATERIALIZED (
    SELECT word, n, k, word[:k - 1] || word[k + 1:] AS rest FROM words, unnest(generate_series(1, len(word))) AS u(k)
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION
    SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS MATERIALIZED (
    SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS top, max(m) AS m FROM near GROUP BY word, n
), formed AS MATERIALIZED (
    SELECT w.word, w.n, CASE WHEN m >= 2 * w.n THEN top END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n
    FROM words w LEFT JOIN best USING (word)
), followed AS (
    SELECT word, word AS root, form AS further FROM formed
    UNION ALL
    SELECT f.word, f.further, g.form FROM followed f JOIN formed g ON f.further = g.word
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN followed r ON r.word = f.word AND r.further IS NULL
"""

DECONTAMINATION_SQL = rf"""
WITH docs AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS win
    FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(k) WHERE len(w) > 0
), runs AS (
    SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS win
    FROM docs, (SELECT DISTINCT size FROM windows), unnest(generate_series(1, len(w) - size + 1)) AS u(k)
), hits AS MATERIALIZED (
    SELECT doc_id, k, r.size, item_id FROM runs r JOIN windows USING (win)
), covered AS (
    SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + size - 1)) FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

PHRASES_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), phrases AS MATERIALIZED (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
    FROM words, (VALUES (1), (2), (3)) AS s(size), unnest(generate_series(1, len(w) - size + 1)) AS u(i) GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE size = 1 GROUP BY lang
), candidates AS MATERIALIZED (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
        CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM candidates) c
    JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
    JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
    SELECT lang, inner_phrase AS phrase, max(a) AS around FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM candidates WHERE size = 3
    ) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN around USING (lang, phrase) JOIN totals USING (lang)
WHERE around IS NULL OR 100 * around < 50 * a
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substrings": SUBSTRINGS_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_decontamination": DECONTAMINATION_SQL, "op13_phrases": PHRASES_SQL,
    }
