"""Exact top-k search of many questions over a partitioned corpus.

The corpus is scanned once, in place: every task multiplies its Arrow batches with
the question matrix and keeps only its k best rows per question.  What is shuffled
is (tasks x questions x k) rows, never the pairs and never the corpus.

The question set is sent to the tasks in blocks below a row and byte bound, which is
checked before; each block is one scan of the corpus, and usually there is one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.ranking import top_k_per_key
from quillspark.session import stored

# Scores are rounded before ranking, so that equal vectors tie in every engine and
# the id decides, whatever order the products were added in.
SCORE_DIGITS = 9
MAX_QUESTION_ROWS = 4096
MAX_QUESTION_BYTES = 64 << 20
_WORK = 2_000_000  # score matrix entries held by a task at a time


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length list column to a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass(frozen=True)
class DenseKernel:
    """Inner product, or negative squared distance."""

    metric: str = "cosine"

    def load(self, questions: pa.Table) -> Any:
        return _matrix(questions["payload"])

    def width(self, loaded: Any) -> int:
        return len(loaded)

    def scores(self, loaded: Any, payload: pa.Array):
        rows = _matrix(payload)
        rank = rows @ loaded.T
        if self.metric == "l2":
            rank = 2 * rank - (rows * rows).sum(1)[:, None] - (loaded * loaded).sum(1)[None, :]
        return np.round(rank, SCORE_DIGITS), None


@dataclass(frozen=True)
class QuantisedKernel:
    """Coarse int8 ranking; the exact score is computed for the coarse winners only."""

    bound: float

    def _codes(self, m: np.ndarray) -> np.ndarray:
        scaled = m / self.bound * 127.0
        away = np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)
        return np.clip(away, -127, 127)

    def load(self, questions: pa.Table) -> Any:
        exact = _matrix(questions["payload"])
        return exact, self._codes(exact)

    def width(self, loaded: Any) -> int:
        return len(loaded[0])

    def scores(self, loaded: Any, payload: pa.Array):
        exact, codes = loaded
        rows = _matrix(payload)

        def rescore(r, c):
            return np.round(np.einsum("ij,ij->i", rows[r], exact[c]), SCORE_DIGITS)

        return self._codes(rows) @ codes.T, rescore


class _Best:
    """Running k best (rank desc, id asc) per question."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.q = np.empty(0, np.int64)
        self.rank = np.empty(0)
        self.score = np.empty(0)
        self.id = None

    def add(self, q, rank, score, ids) -> None:
        q, rank, score = (np.concatenate(p) for p in ((self.q, q), (self.rank, rank), (self.score, score)))
        ids = ids if self.id is None else np.concatenate([self.id, ids])
        order = np.lexsort((ids, -rank, q))
        q = q[order]
        start = np.searchsorted(q, q, side="left")
        keep = order[np.arange(len(q)) - start < self.k]
        self.q, self.rank, self.score, self.id = q[np.arange(len(q)) - start < self.k], rank[keep], score[keep], ids[keep]


def _scan(kernel, loaded, k: int, best: _Best, ids: pa.Array, payload: pa.Array) -> None:
    width = max(kernel.width(loaded), 1)
    step = max(1, _WORK // width)
    for lo in range(0, len(ids), step):
        part = payload.slice(lo, step)
        names = ids.slice(lo, step).to_numpy(zero_copy_only=False)
        if names.dtype == object:
            names = names.astype(str)
        rank, rescore = kernel.scores(loaded, part)
        n = len(names)
        floor = np.partition(rank, n - k, axis=0)[n - k] if n > k else np.full(rank.shape[1], -np.inf)
        r, c = np.nonzero((rank >= floor) & (rank > -np.inf))
        picked = rank[r, c]
        if len(r) > 2 * k * width:  # many ties: cut them by the order of their ids before the ids are copied
            order = np.lexsort((np.argsort(np.argsort(names, kind="stable"))[r], -picked, c))
            place = np.arange(len(r)) - np.searchsorted(c[order], c[order], side="left")
            order = order[place < k]
            r, c, picked = r[order], c[order], picked[order]
        best.add(c, picked, picked if rescore is None else rescore(r, c), names[r])


def _emit(best: _Best, qids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if best.id is None or not len(best.q):
        return
    yield pa.RecordBatch.from_arrays(
        [
            qids.take(pa.array(best.q)).cast(schema.field(0).type),
            pa.array(best.id).cast(schema.field(1).type),
            pa.array(best.rank),
            pa.array(best.score),
        ],
        schema=schema,
    )


def arrow_type(t: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t.simpleString()]


def question_blocks(questions: DataFrame, max_rows: int = MAX_QUESTION_ROWS, max_bytes: int = MAX_QUESTION_BYTES) -> list[DataFrame]:
    """The questions (qid, payload, ...) in blocks that may be sent to the tasks; none if there are no questions.

    Rows and bytes are measured in Spark before anything is collected; JSON text is an upper bound of the bytes.
    Blocks are half as large as allowed on average, as questions are dealt by hash.
    """
    size = F.sum(F.length(F.to_json(F.struct(*[c for c in questions.columns if c != "qid"]))))
    rows, volume = questions.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if rows == 0:
        return []
    if rows <= max_rows and volume <= max_bytes:
        return [questions]
    blocks = min(rows, math.ceil(2 * max(rows / max_rows, volume / max_bytes)))
    dealt = stored(questions.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks))), "question-blocks")
    return [dealt.where(F.col("_block") == b).drop("_block") for b in range(blocks)]


def per_block(blocks: list[DataFrame], corpus: DataFrame, scan: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """Union of one scan of the corpus per question block, each with its block sent to the tasks; the corpus is not shuffled.

    With several blocks each one's result is stored before the next is sent, so that no task holds more than one.
    """
    spark, done = corpus.sparkSession, []
    for block in blocks:
        head = block.toArrow()
        if not head.num_rows:
            continue
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as writer:
            writer.write_table(head)
        shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from scan(pa.ipc.open_stream(shared.value).read_all(), batches)

        found = corpus.mapInArrow(run, ddl)
        if len(blocks) > 1:
            found = stored(found, "block-hits")
            shared.unpersist()
        done.append(found)
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], ddl)


def hit_schema(questions: DataFrame, corpus: DataFrame) -> tuple[pa.Schema, str]:
    """Arrow schema and DDL of (qid, id, coarse, score)."""
    q_type, id_type = questions.schema["qid"].dataType, corpus.schema["id"].dataType
    schema = pa.schema([("qid", arrow_type(q_type)), ("id", arrow_type(id_type)), ("coarse", pa.float64()), ("score", pa.float64())])
    return schema, f"qid {q_type.simpleString()}, id {id_type.simpleString()}, coarse double, score double"


def _candidates(questions: DataFrame, corpus: DataFrame, kernel, k: int, max_rows: int, max_bytes: int) -> DataFrame:
    """(qid, id, coarse, score): for every question the k best rows of each scanned part."""
    schema, ddl = hit_schema(questions, corpus)

    def scan(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, loaded, best = table["qid"].combine_chunks(), kernel.load(table), _Best(k)
        for batch in batches:
            _scan(kernel, loaded, k, best, batch.column("id"), batch.column("payload"))
        yield from _emit(best, qids, schema)

    return per_block(question_blocks(questions.select("qid", "payload"), max_rows, max_bytes), corpus.select("id", "payload"), scan, ddl)


def search(
    questions: DataFrame,
    corpus: DataFrame,
    k: int,
    kernel: Any = DenseKernel(),
    max_rows: int = MAX_QUESTION_ROWS,
    max_bytes: int = MAX_QUESTION_BYTES,
) -> DataFrame:
    """Top-k corpus rows per question: (qid, id, score, rank), ties by id.

    ``questions`` has ``qid`` and ``payload``; ``corpus`` has ``id`` and ``payload``.
    """
    found = _candidates(questions, corpus, kernel, k, max_rows, max_bytes)
    ranked = top_k_per_key(found.drop("coarse"), ["qid"], [F.col("score").desc(), F.col("id")], k)
    return ranked.select("qid", "id", "score", "rank")


def search_quantised(
    questions: DataFrame,
    corpus: DataFrame,
    k: int,
    bound: float,
    oversampling: float = 1.5,
    max_rows: int = MAX_QUESTION_ROWS,
    max_bytes: int = MAX_QUESTION_BYTES,
) -> DataFrame:
    """Two stages: coarse int8 top (oversampling x k), then exact top-k among those."""
    wide = math.ceil(oversampling * k)
    found = _candidates(questions, corpus, QuantisedKernel(bound), wide, max_rows, max_bytes)
    coarse = top_k_per_key(found, ["qid"], [F.col("coarse").desc(), F.col("id")], wide, "_coarse_rank")
    ranked = top_k_per_key(coarse, ["qid"], [F.col("score").desc(), F.col("id")], k)
    return ranked.select("qid", "id", "score", "rank")


def quantisation_bound(corpus: DataFrame, vec: str, quantile: float = 0.99, step: float = 0.001) -> float:
    """Smallest grid value that covers the given share of |component|.

    A histogram with one row per grid step replaces a global sort; its size depends
    on the value range only.
    """
    from pyspark.sql import Window

    hist = (
        corpus.select(F.explode(vec).alias("x"))
        .select(F.ceil(F.abs(F.col("x").cast("double")) / step).alias("b"))
        .groupBy("b")
        .count()
    )
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    covered = hist.select("b", F.sum("count").over(w).alias("c"), total.alias("n"))
    cut = covered.where(F.col("c") >= F.col("n") * quantile).agg(F.min("b")).first()[0]
    return max(cut or 1, 1) * step


def fuse_ranks(dense: DataFrame, sparse: DataFrame, k: int, constant: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists per question."""
    arms = dense.select("qid", "id", "rank").unionByName(sparse.select("qid", "id", "rank"))
    fused = arms.groupBy("qid", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), SCORE_DIGITS).alias("score")
    )
    ranked = top_k_per_key(fused, ["qid"], [F.col("score").desc(), F.col("id")], k)
    return ranked.select("qid", "id", "score", "rank")
