"""Two-stage search over stored int8 codes: the wide vectors of a corpus are read for the coarse winners only.

The code table (id, code) holds one byte per component and is all that the coarse pass scans.  Exact vectors
lie apart, partitioned by a hash bucket of the id; only the buckets of winners are read again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vectors import dot
from quillspark.operators.ranking import top_k_per_key
from quillspark.operators.search import (
    MAX_QUESTION_BYTES, MAX_QUESTION_ROWS, SCORE_DIGITS, QuantisedKernel, _Best, _emit, _matrix, hit_schema, per_block, quantisation_bound, question_blocks,
)
from quillspark.session import scratch_path, stored

#: Rows of codes multiplied at a time, by questions.
_WORK = 2_000_000


@dataclass(frozen=True)
class CodedVectors:
    """``codes`` has (id, code); ``exact`` (id, payload, bucket), partitioned by bucket; components beyond ``bound`` are clipped."""

    codes: DataFrame
    exact: DataFrame
    bound: float
    buckets: int


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def store_codes(corpus: DataFrame, buckets: int, quantile: float = 0.99) -> CodedVectors:
    """Code table and exact vectors of (id, payload); rows without a vector are left out."""
    corpus = corpus.where("payload is not null").select("id", "payload")
    bound = quantisation_bound(corpus, "payload", quantile)
    kernel, kind = QuantisedKernel(bound), dict(corpus.dtypes)["id"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = kernel._codes(_matrix(batch.column("payload"))).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in codes], pa.binary())], names=["id", "code"])

    path = scratch_path(corpus.sparkSession, "exact-vectors")
    corpus.withColumn("bucket", _bucket(F.col("id"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
    return CodedVectors(stored(corpus.mapInArrow(coded, f"id {kind}, code binary"), "codes"), corpus.sparkSession.read.parquet(path), bound, buckets)


def coarse_hits(vectors: CodedVectors, questions: DataFrame, wide: int, max_rows: int = MAX_QUESTION_ROWS, max_bytes: int = MAX_QUESTION_BYTES) -> DataFrame:
    """(qid, id) of the ``wide`` rows per question (qid, payload) with the largest product of codes; ties by id."""
    schema, ddl = hit_schema(questions, vectors.codes)
    kernel = QuantisedKernel(vectors.bound)

    def scan(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked, best = table["qid"].combine_chunks(), kernel._codes(_matrix(table["payload"])), _Best(wide)
        for batch in batches:
            names = batch.column("id").to_numpy(zero_copy_only=False)
            names = names.astype(str) if names.dtype == object else names
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(len(names), -1)
            for lo in range(0, len(names), max(1, _WORK // len(asked))):
                part = slice(lo, lo + max(1, _WORK // len(asked)))
                rank = codes[part].astype(float) @ asked.T
                n = len(rank)
                floor = np.partition(rank, n - wide, axis=0)[n - wide] if n > wide else np.full(rank.shape[1], -np.inf)
                r, c = np.nonzero(rank >= floor)
                best.add(c, rank[r, c], rank[r, c], names[part][r])
        yield from _emit(best, qids, schema)

    found = per_block(question_blocks(questions.select("qid", "payload"), max_rows, max_bytes), vectors.codes, scan, ddl)
    return top_k_per_key(found, ["qid"], [F.col("coarse").desc(), F.col("id")], wide).select("qid", "id")


def search_coded(vectors: CodedVectors, questions: DataFrame, k: int, oversampling: float = 1.5, **bounds: int) -> DataFrame:
    """Top-k rows per question, (qid, id, score, rank), by exact inner product among the coarse oversampling x k best; ties by id."""
    winners = coarse_hits(vectors, questions, math.ceil(oversampling * k), **bounds).withColumn("bucket", _bucket(F.col("id"), vectors.buckets))
    winners = stored(winners, "coarse-hits")
    wanted = [r["bucket"] for r in winners.select("bucket").distinct().collect()]  # at most ``buckets``
    rows = vectors.exact.where(F.col("bucket").isin(wanted)).select("bucket", "id", F.col("payload").alias("_row"))
    pairs = winners.join(rows, ["bucket", "id"]).join(questions.select("qid", F.col("payload").alias("_asked")), "qid")
    scores = pairs.select("qid", "id", F.round(dot(F.col("_row"), F.col("_asked")), SCORE_DIGITS).alias("score"))
    return top_k_per_key(scores, ["qid"], [F.col("score").desc(), F.col("id")], k).select("qid", "id", "score", "rank")
