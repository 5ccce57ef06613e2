"""What several operators of this subpackage share: word hashes in tasks, fixed-size key filters, union-find on tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import stored

#: Bits of the bitmap that stands for a set of keys: 1 MiB whatever the number of keys.
FILTER_BITS = 1 << 23
#: Bits per row that ``bitmap_construct_agg`` makes (4 KiB of bytes).
BITMAP_ROW_BITS = 32768
#: Links that a task joins in memory at a time (some tens of MB).
CONTRACTED_LINKS = 1 << 19
#: Words remembered per Python worker; beyond that the memory is emptied and filled anew.
REMEMBERED_WORDS = 1 << 18
#: Bytes of text worked on at once.
SLICE_BYTES = 4 << 20

LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return free pages to the system (malloc_trim is glibc's; other C libraries have none)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, after which freed memory goes back to the system: Python workers outlive their tasks and hold it otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(lean(run), schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``most`` bytes each."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


class Words:
    """64-bit hashes of words, kept for words met before."""

    def __init__(self, limit: int = REMEMBERED_WORDS):
        self.limit, self.seen = limit, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        try:
            return np.array([seen[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(seen) > self.limit:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh64_intdigest(w)
            return np.array([seen[w] for w in words], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def rolling(words: np.ndarray, width: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes; empty when there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(base)
        out += words[k : k + n]
    return mixed(out)


def bucket_of(key: Column, bits: int = FILTER_BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap_rows(buckets: DataFrame, bucket: str) -> DataFrame:
    """(_bitmap_row, _bitmap): bitmap of the bucket numbers; its size depends on the largest number only."""
    numbered = buckets.select(
        F.expr(f"bitmap_bucket_number({bucket})").alias("_bitmap_row"), F.expr(f"bitmap_bit_position({bucket})").alias("_pos")
    )
    return numbered.groupBy("_bitmap_row").agg(F.expr("bitmap_construct_agg(_pos)").alias("_bitmap"))


def sent_bitmap(spots: DataFrame, bits: int) -> Broadcast[bytes]:
    """The first column's numbers, 0 to bits - 1, as a bitmap for the tasks: bits / 8 bytes whatever the rows."""
    held, step = bytearray(bits // 8), BITMAP_ROW_BITS // 8
    # the first bitmap row starts with value 1
    rows = bitmap_rows(spots.select((F.col(spots.columns[0]).cast("long") + 1).alias("_b")), "_b")
    for row in rows.toLocalIterator():  # at most bits / BITMAP_ROW_BITS rows of 4 KiB
        part = bytes(row["_bitmap"])
        held[(row["_bitmap_row"] - 1) * step : (row["_bitmap_row"] - 1) * step + len(part)] = part
    return spots.sparkSession.sparkContext.broadcast(bytes(held))


def bits_at(bitmap: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which of these spots are set in a bitmap of bytes."""
    return (bitmap[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def probably_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with a boolean ``_maybe``: false only where the key is surely not among ``keys`` (one column).

    The set is sent to the tasks as a bitmap of FILTER_BITS bits (1 MiB), so the size of the
    broadcast is fixed.  With very many keys it fills up and lets more through; a join decides.
    """
    name = keys.columns[0]
    hashed = keys.where(F.col(name).isNotNull()).select(bucket_of(F.col(name)).alias("_b"))
    rows = bitmap_rows(hashed, "_b")
    spot = bucket_of(F.col(key))
    joined = df.withColumn("_spot", spot).withColumn("_bitmap_row", F.expr("bitmap_bucket_number(_spot)")).join(F.broadcast(rows), "_bitmap_row", "left")
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(bitmap_bit_position(_spot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(bitmap_bit_position(_spot) % 8 as int)")
    known = F.col("_bitmap").isNotNull() & F.col(key).isNotNull()
    hit = F.coalesce(known & (F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1), F.lit(False))
    return joined.withColumn("_maybe", hit).drop("_spot", "_bitmap_row", "_bitmap")


def spanning(count: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the same items 0 .. count - 1 as the pairs (i, j): each item with the smallest one it reaches."""
    least = np.arange(count)
    while True:
        now, a, b = least.copy(), least[i], least[j]
        for to, value in ((i, b), (j, a), (a, b), (b, a)):
            np.minimum.at(now, to, value)
        now = np.minimum(now, now[now])
        if (now == least).all():
            rows = np.flatnonzero(least != np.arange(count))
            return rows, least[rows]
        least = now


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that join the same vertices as the links of a task, CONTRACTED_LINKS at a time; never more rows than came in."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        vertices, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        rows, least = spanning(len(vertices), at[: len(u)], at[len(u) :])
        return pa.RecordBatch.from_arrays([pa.array(vertices[rows], pa.int64()), pa.array(vertices[least], pa.int64())], names=["u", "v"])

    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= CONTRACTED_LINKS:
            yield stars(held)
            held, count = [], 0
    if held:
        yield stars(held)


def _star_sides(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _star_sides(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex with a link; component is the smallest vertex reachable.

    ``edges`` has two long columns.  Each task first joins the links it holds, which saves rounds;
    then alternating large-star and small-star steps until nothing changes.  When what is left fits the
    fixed number of links that a task joins at a time (16 bytes each), one task joins it and no more rounds
    are made.  Each round's links are written to the shared folder, none of them reaches the driver.
    A vertex with very many links costs one partial minimum per task.
    """
    a, b = edges.columns[:2]
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links, mark = stored(links.mapInArrow(lean(_contracted), "u long, v long"), "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        if now[0] <= CONTRACTED_LINKS:
            links = stored(links.coalesce(1).mapInArrow(lean(_contracted), "u long, v long"), "links")
            break
        mark = now
        links = stored(_small_star(_large_star(links.mapInArrow(lean(_contracted), "u long, v long"))), "links")
    roots = links.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
