"""Cell index: vectors in k-means cells, stored partitioned by cell, searched by reading only the probed cells.

Cells are fitted on a bounded sample; every vector is then stored in the cell of its nearest centre.  A question
probes the cells of the centres with the largest inner product, as many as a sample needs for the recall asked
for.  The exact search adds every cell that may
still hold a better row: with x in a cell of centre c and radius r, q.x = q.c + q.(x - c) <= q.c + |q| r.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ranking import top_k_per_key
from quillspark.operators.search import (
    MAX_QUESTION_BYTES, MAX_QUESTION_ROWS, SCORE_DIGITS, DenseKernel, _Best, _emit, _matrix, _scan, hit_schema, per_block, question_blocks, search,
)
from quillspark.session import scratch_path, stored

#: Rows of the sample that cells are fitted on, per cell, and most cells: centres are held by driver and tasks.
SAMPLE_PER_CELL, MOST_CELLS = 256, 1 << 16
#: Vectors asked to choose the number of probes.
PROBED_SAMPLE = 400
_SHARES = 1 << 20


@dataclass(frozen=True)
class CellIndex:
    """``path`` holds (id, payload, cell), partitioned by cell; ``cells`` has one row (cell, centre, radius) per cell in use."""

    path: str
    cells: DataFrame

    def rows(self) -> DataFrame:
        return self.cells.sparkSession.read.parquet(self.path)


def _centres(corpus: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Centres fitted on an expected SAMPLE_PER_CELL rows per cell, drawn by a hash of the id; k-means runs in Spark."""
    share = min(1.0, cells * SAMPLE_PER_CELL / max(corpus.count(), 1))
    drawn = corpus.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_SHARES)) < math.ceil(share * _SHARES))
    rows = drawn.select(array_to_vector(F.col("payload").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(rows).clusterCenters())


def build_cells(corpus: DataFrame, cells: int, seed: int = 7) -> CellIndex:
    """Index of (id, payload); rows without a vector are left out.

    Files are dealt by cell and id, so a cell with a third of all rows is written by many tasks.
    """
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"cells must be between 1 and {MOST_CELLS}")
    spark = corpus.sparkSession
    corpus = corpus.where("payload is not null").select("id", "payload")
    if corpus.isEmpty():
        raise ValueError("no vectors to index")
    centres = _centres(corpus, cells, seed)
    shared = spark.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (shared.value**2).sum(1) / 2
        for batch in batches:
            rows = _matrix(batch.column("payload"))
            cell = (rows @ shared.value.T - half).argmax(1)
            away = np.sqrt(((rows - shared.value[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "payload", "cell", "away"])

    kinds = dict(corpus.dtypes)
    rows = corpus.mapInArrow(placed, f"id {kinds['id']}, payload {kinds['payload']}, cell int, away double")
    path = scratch_path(spark, "cells")
    rows.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(path)
    radius = spark.read.parquet(path).groupBy("cell").agg(F.max("away").alias("radius"))
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    return CellIndex(path, stored(table.join(radius, "cell"), "cell-centres"))


def _scan_probed(index: CellIndex, asked: DataFrame, k: int, max_rows: int, max_bytes: int) -> DataFrame:
    """(qid, id, score) of the k best rows per task, of (qid, payload, cells); files of other cells are not read."""
    wanted = [r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most MOST_CELLS
    corpus = index.rows().where(F.col("cell").isin(wanted)).select("id", "payload", "cell")
    schema, ddl = hit_schema(asked, corpus)

    def scan(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, every = table["qid"].combine_chunks(), _matrix(table["payload"])
        asking: dict[int, list[int]] = {}
        for q, cells in enumerate(table["cells"].to_pylist()):
            for cell in cells:
                asking.setdefault(cell, []).append(q)
        best = _Best(k)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for one in np.unique(cell):
                here, near = pa.array(np.flatnonzero(cell == one)), np.array(asking.get(int(one), []), np.int64)
                if len(near):
                    some = _Best(k)
                    _scan(DenseKernel(), every[near], k, some, batch.column("id").take(here), batch.column("payload").take(here))
                    best.add(near[some.q], some.rank, some.score, some.id)
        yield from _emit(best, qids, schema)

    return per_block(question_blocks(asked, max_rows, max_bytes), corpus, scan, ddl).select("qid", "id", "score")


def _cells_that_may_hold(index: CellIndex, asked: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """(qid, cell) of every cell whose bound reaches the question's ``least``; all cells where that is null."""
    schema = pa.schema([("qid", hit_schema(asked, index.cells.select(F.col("cell").alias("id")))[0].field(0).type), ("cell", pa.int32())])

    def scan(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, every = table["qid"].combine_chunks(), _matrix(table["payload"])
        least = np.array([-np.inf if x is None else x for x in table["least"].to_pylist()])
        length = np.sqrt((every**2).sum(1))
        for batch in batches:
            bound = _matrix(batch.column("centre")) @ every.T + np.outer(batch.column("radius").to_numpy(), length)
            cell, q = np.nonzero(bound + 10.0**-SCORE_DIGITS >= least)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)).cast(schema.field(0).type), batch.column("cell").take(pa.array(cell))], schema=schema)

    kind = dict(asked.dtypes)["qid"]
    return per_block(question_blocks(asked, max_rows, max_bytes), index.cells, scan, f"qid {kind}, cell int")


def _best(hits: DataFrame, k: int) -> DataFrame:
    return top_k_per_key(hits, ["qid"], [F.col("score").desc(), F.col("id")], k).select("qid", "id", "score", "rank")


def search_cells(
    index: CellIndex, questions: DataFrame, k: int, probes: int, exact: bool = False, max_rows: int = MAX_QUESTION_ROWS, max_bytes: int = MAX_QUESTION_BYTES
) -> DataFrame:
    """Top-k rows per question by inner product, (qid, id, score, rank), among its ``probes`` nearest cells; ties by id.

    With ``exact``, the result is that of reading everything: cells that may hold better rows are read in a second
    pass, the others are left out by their bound.
    """
    questions = questions.select("qid", "payload")
    centres = index.cells.select(F.col("cell").alias("id"), F.col("centre").alias("payload"))
    near = search(questions, centres, probes, max_rows=max_rows, max_bytes=max_bytes).select("qid", F.col("id").alias("cell"))
    near = stored(near, "probed-cells")
    probed = near.groupBy("qid").agg(F.collect_list("cell").alias("cells"))
    first = _scan_probed(index, stored(questions.join(probed, "qid"), "probes"), k, max_rows, max_bytes)
    if not exact:
        return _best(first, k)
    first = stored(_best(first, k), "first-hits")
    # a question with fewer than k hits so far may find more in any cell
    least = questions.join(first.where(F.col("rank") == k).select("qid", F.col("score").alias("least")), "qid", "left")
    may = _cells_that_may_hold(index, stored(least, "least-hits"), max_rows, max_bytes).join(near, ["qid", "cell"], "left_anti")
    more = questions.join(may.groupBy("qid").agg(F.collect_list("cell").alias("cells")), "qid")
    second = _scan_probed(index, stored(more, "probes"), k, max_rows, max_bytes)
    return _best(first.select("qid", "id", "score").unionByName(second), k)


def probes_for(index: CellIndex, k: int, recall: float = 0.95, seed: int = 11) -> int:
    """Fewest probes that find this share of the true top-k, by PROBED_SAMPLE stored vectors (expected), asked against all.

    How many cells that takes depends on the data: few where vectors form groups, most of them where they are spread evenly.
    """
    rows = index.rows()
    share = math.ceil(min(1.0, PROBED_SAMPLE / max(rows.count(), 1)) * _SHARES)
    asked = stored(rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_SHARES)) < share).select(F.col("id").alias("qid"), "payload"), "probing-sample")
    cells = index.cells.count()
    true = search_cells(index, asked, k, 1, exact=True).select("qid", "id")
    order = search(asked, index.cells.select(F.col("cell").alias("id"), F.col("centre").alias("payload")), cells)
    held = true.join(rows.select("id", "cell"), "id").join(order.select("qid", F.col("id").alias("cell"), "rank"), ["qid", "cell"])
    counts = sorted(held.groupBy("rank").count().collect())  # one row per cell at most
    total, found = sum(r["count"] for r in counts), 0
    for r in counts:
        found += r["count"]
        if found >= recall * total:
            return r["rank"]
    return cells
