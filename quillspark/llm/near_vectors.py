"""Near-duplicate vectors by sorted projection passes: lexicographic order of random hashes, bounded neighbour windows.

Vectors are compared only within one label and one dimension; pairs at the threshold or above (cosine in
double precision) are links.  A pass places each unit vector by MARKS concatenated hashes, its rounded
positions on random lines: whether two vectors agree in one depends on their distance alone, not on where the
label's vectors lie.  Each label's vectors are sorted lexicographically by their marks, whole labels over any
number of tasks, and each is compared with the WINDOW next ones; verified pairs of all passes are united.
Within each group so found all pairs are then compared in blocks, so that the number of links is exact there.

A pair at the threshold meets in a pass if it agrees in one mark more than its first vector shares with the
vector WINDOW places on.  How deep these agree is measured in a first sort, and each label gets as many passes
as keep the expected share of missed pairs at MISSED or less; a label of WINDOW vectors or fewer lies inside one
window and is compared whole.  Vectors that agree deeper than a label of its size with a cosine of BACKGROUND
throughout would are taken for a crowd of near copies, which a pass keeps together.
Vectors that are equal are one vector with a multiplicity, so copies cost nothing.

Null labels, null or zero vectors, and vectors with null or non-finite components link with nothing.
Repeated rows (same id, label and vector) give one row; rows without vec_id link with nothing and are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import components, spanning
from quillspark.llm.linking import grouped
from quillspark.session import stored

THRESHOLD = 0.98
#: Pairs at the threshold that all passes together may miss, as a share.
MISSED = 0.001
#: Cosine between the vectors of one label up to which a window is resolved whatever the label's rows.
BACKGROUND = 0.9
#: Distance of unit vectors at the threshold, and of marks on a line.
REACH = math.sqrt(2 - 2 * THRESHOLD)
STEP = 5 * REACH
#: Marks in a sort key, four bits each in two longs.
MARKS = 32
#: Vectors that each vector is compared with in a pass, vectors per task step, and rows of them at a time.
WINDOW, STRETCH, ROWS = 512, 8192, 256
#: Members of a group per block.
BLOCK = 512
SEED = 3
#: The order of a pass; equal keys go by the vector's name.
ORDER = ("label", "dim", "number", "k0", "k1", "vector_key")
_MARKED = "label long, dim int, number int, k0 long, k1 long, vector_key long"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of unit length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def shared(distance: float) -> float:
    """Probability that unit vectors at this distance agree in one mark."""
    t = STEP / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def passes(depths: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> int:
    """Passes for a label in which so many vectors agree so deep with the one a window on (-1: none is there)."""
    deepest = math.ceil(math.log(max(1.0, counts.sum() / window)) / -math.log(shared(math.sqrt(2 - 2 * BACKGROUND)))) + 1
    lost, share, number = 1 - shared(REACH) ** (np.minimum(depths, deepest) + 1.0), counts / counts.sum(), 1
    while (share * lost**number).sum() > MISSED:
        number += 1
    return number


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sort keys of each vector in each of its passes, from (vector_key, label, dim, passes, vector)."""
    for batch in batches:
        keys, labels, dims, numbers = (batch.column(c).to_numpy() for c in ("vector_key", "label", "dim", "passes"))
        for dim in np.unique(dims).tolist():
            of_dim = np.flatnonzero(dims == dim)
            unit = _matrix(batch.column("vector").take(pa.array(of_dim)))
            for number in range(int(numbers[of_dim].max())):
                taking = numbers[of_dim] > number
                at = of_dim[taking]
                drawn = np.random.default_rng((SEED, number, dim))
                marks = np.floor((unit[taking] @ drawn.standard_normal((dim, MARKS)) + drawn.uniform(0, STEP, MARKS)) / STEP)
                nibbles = (np.clip(marks, -8, 7) + 8).astype(np.uint64)
                halves = []
                for half in (nibbles[:, : MARKS // 2], nibbles[:, MARKS // 2 :]):
                    halves.append(pa.array((half << (np.uint64(60) - np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)))
                same = [pa.array(np.full(len(at), dim, dtype=np.int32)), pa.array(np.full(len(at), number, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(labels[at]), *same, *halves, pa.array(keys[at])], names=list(ORDER))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows of ``_marked`` with their position ``pos`` in the order of all passes, from 0 without gaps."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # task and row in the task, in the order of the range
    laid = stored(rows.repartitionByRange(width, *ORDER).sortWithinPartitions(*ORDER).withColumn("place", place), "sorted-vectors")
    part = F.shiftright("place", 33)
    counts = laid.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per task of the sort
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("part", part).join(F.broadcast(before), "part").select(*ORDER, at.alias("pos"))


def _agreeing(a: Column, b: Column) -> Column:
    """Leading marks that two halves of sort keys have in common."""
    differing = a.bitwiseXOR(b)
    return F.when(differing == 0, MARKS // 2).otherwise(MARKS // 2 - F.length(F.hex(differing)))


def _passes(distinct: DataFrame, window: int) -> DataFrame:
    """(label, dim, passes) from the depth to which vectors agree with the one a window on."""
    first = _sorted(distinct.withColumn("passes", F.lit(1)).mapInArrow(_marked, _MARKED))
    there = first.select("label", "dim", (F.col("pos") - window).alias("pos"), F.col("k0").alias("far0"), F.col("k1").alias("far1"))
    half = _agreeing(F.col("k0"), F.col("far0"))
    depth = F.when(F.col("far0").isNull(), -1).when(half < MARKS // 2, half).otherwise(half + _agreeing(F.col("k1"), F.col("far1")))
    counts = first.join(there, ["label", "dim", "pos"], "left").groupBy("label", "dim", depth.alias("depth")).agg(F.count("*").alias("n"))

    def of_label(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:  # at most MARKS + 2 rows
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "passes": [passes(rows["depth"].to_numpy(), rows["n"].to_numpy(), window)]})

    return stored(counts.groupBy("label", "dim").applyInPandas(of_label, "label long, dim int, passes int"), "passes")


def _near(window: int):
    """Links (a, b) that join the same vectors as all links inside the windows of a stretch, from rows sorted by stretch and pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "stretch"):
            names = ("stretch", "label", "dim", "number")
            runs, ids, own = np.stack([table.column(c).to_numpy() for c in names]), table.column("id").to_numpy(), table.column("own").to_numpy()
            vectors = table.column("vector").combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            cuts = [0, *(np.flatnonzero((runs[:, 1:] != runs[:, :-1]).any(axis=0)) + 1), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                unit, found = _matrix(vectors.slice(lo, hi - lo)), []
                for start in range(0, int(own[lo:hi].sum()), ROWS):  # copies of the next stretch's rows come last
                    i, j = np.nonzero(unit[start : start + ROWS] @ unit[start : start + ROWS + window].T >= THRESHOLD)
                    ahead = (j > i) & (j <= i + window)
                    found.append((i[ahead] + start, j[ahead] + start))
                if found:
                    i, j = spanning(hi - lo, *map(np.concatenate, zip(*found)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + i]), pa.array(ids[lo + j])], names=["a", "b"])

    return run


def _met(distinct: DataFrame, window: int) -> DataFrame:
    """Links found by all passes; each stretch of the order also holds the window that follows it."""
    taking = distinct.join(_passes(distinct, window), ["label", "dim"])
    placed = _sorted(taking.mapInArrow(_marked, _MARKED))
    stretch, own = F.floor(F.col("pos") / STRETCH), F.struct(F.lit(0).alias("back"), F.lit(True).alias("own"))
    back = F.struct(F.lit(1).alias("back"), F.lit(False).alias("own"))
    both = F.when((F.col("pos") % STRETCH < window) & (F.col("pos") >= STRETCH), F.array(own, back)).otherwise(F.array(own))
    dealt = placed.withColumn("_to", F.explode(both)).select("label", "dim", "number", "pos", "vector_key", (stretch - F.col("_to.back")).alias("stretch"), F.col("_to.own").alias("own"))
    wide = dealt.join(distinct.select("vector_key", "id", "vector"), "vector_key")
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = wide.select("stretch", "pos", "label", "dim", "number", "own", "id", "vector").repartition(width, "stretch").sortWithinPartitions("stretch", "pos")
    return laid.mapInArrow(_near(window), "a long, b long")


def _in_blocks(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    """Rows with their cell of two blocks of their group, side 0 or 1, or 2 where both blocks are one; members counts the group."""
    blocks = F.ceil(F.col("members") / most).cast("int")
    blocked = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("vector_key"), F.col("blocks")).cast("int"))
    spread = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64(*group, F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return spread.withColumn("cell", cell).withColumn("side", side).drop("blocks", "block", "other", "members", *group)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n): copies of linked vectors in the other side of a block pair, from rows sorted by cell."""
    for table in grouped(batches, "cell"):
        cell, ids, copies, side = (table.column(c).to_numpy() for c in ("cell", "id", "copies", "side"))
        vectors = table.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
        names, sums = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            unit, on, own = _matrix(vectors.slice(lo, hi - lo)), side[lo:hi], copies[lo:hi]
            left, right = np.flatnonzero(on != 1), np.flatnonzero(on != 0)
            linked = unit[left] @ unit[right].T >= THRESHOLD
            if (on == 2).all():
                np.fill_diagonal(linked, False)
                names.append(ids[lo:hi])
                sums.append(linked @ own)
            else:
                names += [ids[lo:hi][left], ids[lo:hi][right]]
                sums += [linked @ own[right], linked.T @ own[left]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(sums).astype(np.int64))], names=["id", "n"])


def near_vectors(vectors: DataFrame, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector of (vec_id, embedding, label); window is at most STRETCH."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label").distinct()
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = stored(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    key = ["label", "vector"]
    firsts = rows.where("sound").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"))
    # labels of any type become numbers for the tasks; a collision only adds comparisons that the final join undoes
    number = F.xxhash64("label")
    distinct = firsts.select(number.alias("label"), "id", "copies", F.size("vector").alias("dim"), "vector", F.xxhash64("label", "vector").alias("vector_key"))
    distinct = stored(distinct, "distinct-vectors")
    found = components(_met(distinct, window))
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = found.join(distinct, found["vertex"] == distinct["id"]).select("component", "label", "dim", "id", "vector_key", "copies", "vector")
    sized = members.join(members.groupBy("component").agg(F.count("*").alias("members")), "component")
    cells = _in_blocks(sized, ["component", "label", "dim"], BLOCK).select("cell", "id", "copies", "vector", "side")
    counts = cells.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    groups = firsts.join(counts, "id", "left").join(found.withColumnRenamed("vertex", "id"), "id", "left")
    named = groups.select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("sound").join(named, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
