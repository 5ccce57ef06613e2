"""A corpus pipeline of five operators: language, lines, near-duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, language, lines, mixing, near_documents
from quillspark.llm.catalog import PIECES, RANKS
from quillspark.llm.common import read_table
from quillspark.session import small_batches, stored

#: Least share of the best language among all; documents below it are rejected.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts, those without letters, or without a likeliest language, go.

    Repeated rows and ids are judged one by one; a tie between languages goes to the first by name.
    """
    small_batches(spark)
    taken = {c.lower() for c in docs.columns}
    pred, score = (next(n for n in (base + "_" * k for k in range(len(taken) + 1)) if n not in taken) for base in ("lang_pred", "score"))
    named = language.predicted(docs, language.learned(docs, PIECES), names=(pred, score))
    return named.where((F.col(pred) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those that lose every line go."""
    small_batches(spark)
    return lines.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    small_batches(spark)
    return near_documents.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; one taken twice is there twice."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and token_ids of every document."""
    small_batches(spark)
    vocabulary = byte_bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN)
    return byte_bpe.encoded(docs, vocabulary, ["doc_id", "lang", "source"])


STAGES = [("language", known_language), ("lines", fuzzy_lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]
#: Learned models, MinHash and BPE are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
