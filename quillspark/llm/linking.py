"""Near-duplicate linking by MinHash: packed b-bit signatures, band buckets, star and cross-group candidates, exact checks.

Items have columns id (long), n (long, size of the set), bands (array<long>) and g0, g1 (long): the low
two bits of 64 minima, packed.  n, g0 and g1 may come with the candidates' texts instead, so that they are
made only for items that share a bucket.  Repeated rows of an item are one item.

1. Every member of a bucket is compared with the bucket's smallest member: by signature, then on the full
   sets.  What is linked forms groups; a bucket of thousands of copies costs one comparison each.  Members
   (two longs each) are shuffled once and sorted by bucket; a task reads them as they come and holds one row.
   Only members that are not alone in their bucket are sorted by id as well.
2. Where a bucket still holds several groups, the signatures of its other members are compared across
   groups, in blocks of bounded size.  Each block passes on only links that join the same items as all
   its likely pairs, so the rows grow with the members, not with their pairs.  Together with the first
   comparisons these form clusters, and every likely pair lies inside one cluster.
3. Clusters with several groups are compared on the full sets, again in blocks and across groups only,
   and each block passes on links that join the same items as all it found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import components, lean, mixed, slices, spanning
from quillspark.session import stored

PERMUTATIONS = 64
#: Values that agree by chance in two bits.
CHANCE = 0.25
#: Members per block of a bucket that is compared across its groups.
BLOCK = 256
#: Bytes of paired texts whose sets are held at once.
CONFIRMED_BYTES = 1 << 19
#: Numbers in a table of sets and elements held at once.
HELD_CELLS = 1 << 21
_DRAWN = np.random.default_rng(20).integers(0, 1 << 32, (2, PERMUTATIONS), dtype=np.uint64).astype(np.uint32)
FLIP, ODD = _DRAWN[0], _DRAWN[1] | np.uint32(1)
_PAIRED = 0x5555555555555555


def minima(hashes: np.ndarray, starts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(permutations, items) minima of 64-bit hashes; ``starts`` has the first position of each item, none is empty."""
    folded = (hashes >> np.uint64(32)).astype(np.uint32)
    out, held = np.empty((permutations, len(starts)), dtype=np.uint32), np.empty_like(folded)
    for k in range(permutations):
        np.bitwise_xor(folded, FLIP[k], out=held)
        np.multiply(held, ODD[k], out=held)
        np.minimum.reduceat(held, starts, out=out[k])
    return out


def packed(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two low bits of each of the 64 minima, as two longs per item."""
    bits = ((least >> np.uint32(3)) & np.uint32(3)).astype(np.uint64)
    halves = []
    for half in (bits[:32], bits[32:64]):
        halves.append((half << (np.arange(32, dtype=np.uint64) * np.uint64(2))[:, None]).sum(axis=0, dtype=np.uint64).view(np.int64))
    return halves[0], halves[1]


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(items, bands) keys; equal keys mean equal minima in all rows of the band."""
    keys = np.empty((least.shape[1], bands), dtype=np.int64)
    for b in range(bands):
        key = np.full(least.shape[1], b + 1, dtype=np.uint64)
        for row in least[b * rows : (b + 1) * rows]:
            key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + row)
        keys[:, b] = key.view(np.int64)
    return keys


def needed_matches(similarity: float, deviations: float = 4.0) -> int:
    """Least number of agreeing two-bit values of 64 for a pair of this similarity.

    The expected share is similarity + chance * (1 - similarity); the margin is so many standard
    deviations of the count, so the estimate hardly ever drops a true pair.
    """
    share = similarity + CHANCE * (1 - similarity)
    return int(PERMUTATIONS * share - deviations * (PERMUTATIONS * share * (1 - share)) ** 0.5)


def matches(a0: Column, b0: Column, a1: Column, b1: Column) -> Column:
    """Agreeing two-bit values of two packed signatures, by bit counts."""

    def differing(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIRED)))

    return F.lit(PERMUTATIONS) - differing(a0, b0) - differing(a1, b1)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of the key, from batches sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        values = batch.column(key).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(values[1:] != values[:-1])
        if len(changes) or (len(rest) > 1 and rest[-2].column(key)[-1] != batch.column(key)[0]):
            cut = int(changes[-1]) + 1 if len(changes) else 0
            yield pa.Table.from_batches([*rest[:-1], batch.slice(0, cut)])
            rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (band, id) whose band other rows have, too, from rows sorted by band.

    The last row of a batch is held back, as the next one may have its band.
    """
    band, item, some = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)

    def rows(some: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(band[some]), pa.array(item[some])], names=["band", "id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        band, item = (np.concatenate([old[-1:], batch.column(k).to_numpy()]) for k, old in enumerate((band, item)))
        same = band[1:] == band[:-1]
        some = np.concatenate([some[-1:], np.zeros(batch.num_rows, dtype=bool)])
        some[1:] |= same
        some[:-1] |= same
        if some[:-1].any():
            yield rows(np.append(some[:-1], False))
    if some[-1:].any():
        yield rows(np.append(np.zeros(len(band) - 1, dtype=bool), True))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (band, id) of the buckets with several members, from rows sorted by both.

    lead is the bucket's smallest member; several tells whether it has members besides that and this one.
    The last row of a batch is held back, as the next one may continue its bucket.
    """
    band, item, lead, at = (np.empty(0, dtype=np.int64) for _ in range(4))

    def rows(some: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(band[some]), pa.array(item[some]), pa.array(lead[some]), pa.array(more[some])], names=["band", "id", "lead", "several"])

    for batch in batches:
        if not batch.num_rows:
            continue
        band, item = (np.concatenate([old[-1:], batch.column(k).to_numpy()]) for k, old in enumerate((band, item)))
        held = len(band) - batch.num_rows
        new = np.ones(len(band), dtype=bool)
        new[1:] = (band[1:] != band[:-1]) | (item[1:] != item[:-1])
        band, item = band[new], item[new]
        first = np.ones(len(band), dtype=bool)
        first[1:] = band[1:] != band[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(band)), 0))
        leads, places = item[start], np.arange(len(band)) - start
        if held:
            run = start == 0
            leads[run], places[run] = lead[-1], places[run] + min(at[-1], 2)
        lead, at = leads, places
        goes_on = np.append(~first[1:], False)
        more = (at > 1) | ((at > 0) & goes_on)
        some = (at > 0) | goes_on
        some[-1] = False
        yield rows(some)
    if len(band) and at[-1] > 0:
        more = at > 1
        yield rows(np.arange(len(band)) == len(band) - 1)


def _cells(table: pa.Table) -> Iterator[tuple[int, int]]:
    cell = table.column("cell").to_numpy()
    cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
    yield from zip(cuts[:-1], cuts[1:])


def _pairs(xs: list[np.ndarray], ys: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs), pa.int64()), pa.array(np.concatenate(ys), pa.int64())], names=["x", "y"])


def _likely(needed: int, ratio: float):
    """Spanning pairs of the likely pairs of each cell, by signatures."""
    paired = np.uint64(_PAIRED)

    def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a[:, None] ^ b[None, :]
        return np.bitwise_count((x | (x >> np.uint64(1))) & paired).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "cell"):
            ids, comp, n, side = (table.column(c).to_numpy() for c in ("id", "comp", "n", "side"))
            g0, g1 = (table.column(c).to_numpy().view(np.uint64) for c in ("g0", "g1"))
            xs, ys = [], []
            for lo, hi in _cells(table):
                at = np.arange(lo, hi)
                left, right = at[side[at] != 1], at[side[at] != 0]
                if not len(left) or not len(right):
                    continue
                near = differing(g0[left], g0[right]) + differing(g1[left], g1[right]) <= PERMUTATIONS - needed
                near &= comp[left][:, None] != comp[right][None, :]
                small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
                i, j = np.nonzero(near & (small >= ratio * large))
                i, j = spanning(hi - lo, left[i] - lo, right[j] - lo)
                xs.append(ids[lo + i])
                ys.append(ids[lo + j])
            if xs:
                yield _pairs(xs, ys)

    return run


def _common(holder: np.ndarray, element: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) numbers of common elements, from the (holder, element) in the order of elements numbered from 0."""
    both = np.zeros((len(left), len(right)))
    count = int(np.concatenate([left, right, holder]).max()) + 1
    step = max(1, HELD_CELLS // count)
    for lo in range(0, element[-1] + 1 if len(element) else 0, step):
        a, b = np.searchsorted(element, [lo, lo + step])
        has = np.zeros((count, element[b - 1] + 1 - lo), dtype=np.float32)
        has[holder[a:b], element[a:b] - lo] = 1
        both += has[left] @ has[right].T
    return both


def _linked_in(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Spanning pairs of the links across groups in one cell; elements are sets' rows in a table of zeros and ones."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values)
    holder, ordered = np.repeat(np.arange(len(sets)), sizes)[order], values[order]
    new = np.ones(len(ordered) + 1, dtype=bool)
    new[1:-1] = ordered[1:] != ordered[:-1]
    shared = ~(new[1:] & new[:-1])
    element = np.cumsum(new[:-1][shared]) - 1
    both = _common(holder[shared], element, left, right)
    near = both * similarity.denominator >= similarity.numerator * (sizes[left][:, None] + sizes[right][None, :] - both)
    i, j = np.nonzero(near & (both > 0) & (comp[left][:, None] != comp[right][None, :]))
    return spanning(len(sets), left[i], right[j])


def _exact(sets_of: Callable[[list[bytes]], list[np.ndarray]], similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "cell"):
            ids, comp, side = (table.column(c).to_numpy() for c in ("id", "comp", "side"))
            cells, column = list(_cells(table)), table.column("text")
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
            xs, ys = [], []
            for a, b in slices([int(sizes[hi] - sizes[lo]) for lo, hi in cells], CONFIRMED_BYTES):
                start, end = cells[a][0], cells[b - 1][1]
                sets = sets_of(column.slice(start, end - start).to_pylist())
                for lo, hi in cells[a:b]:
                    i, j = _linked_in(sets[lo - start : hi - start], comp[lo:hi], side[lo:hi], similarity)
                    xs.append(ids[lo + i])
                    ys.append(ids[lo + j])
            if xs:
                yield _pairs(xs, ys)

    return run


def _confirmed(sets_of: Callable[[list[bytes]], list[np.ndarray]], similarity: Fraction):
    """The pairs (x, y) that are links on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, keep = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            tx, ty = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in slices([len(a) + len(b) for a, b in zip(tx, ty)], CONFIRMED_BYTES):
                at = [lo, *(np.flatnonzero(xs[lo + 1 : hi] != xs[lo : hi - 1]) + lo + 1)]
                left, right = sets_of([tx[k] for k in at]), sets_of(ty[lo:hi])
                for held, start, end in zip(left, at, [*at[1:], hi]):
                    for k in range(start, end):
                        other = right[k - lo]
                        both = len(np.intersect1d(held, other, assume_unique=True))
                        if both and both * similarity.denominator >= similarity.numerator * (len(held) + len(other) - both):
                            keep.append(k)
            yield _pairs([xs[keep]], [ys[keep]])

    return run


def _in_blocks(rows: DataFrame, group: str, members: str) -> DataFrame:
    """Rows placed in cells of two blocks of their group, with side 0 or 1, or 2 where both blocks are one."""
    blocks = F.ceil(F.col(members) / BLOCK).cast("int")
    placed = rows.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    spread = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cell = F.xxhash64(group, F.least("_block", "_other"), F.greatest("_block", "_other"))
    side = F.when(F.col("_block") == F.col("_other"), 2).when(F.col("_block") < F.col("_other"), 0).otherwise(1)
    out = spread.withColumn("cell", cell).withColumn("side", side).drop("_blocks", "_block", "_other", group, members)
    return out.repartition("cell").sortWithinPartitions("cell")


class Linked:
    """Links that join the items as all their links do, and the components they form.

    ``texts`` gives (id, text as bytes), and n, g0, g1 if items lack them, for a table of ids, ``set_of`` the sorted
    distinct element hashes of a text, ``sets_of`` those of many texts at once.
    """

    def __init__(
        self, items: DataFrame, similarity: Fraction, texts: Callable[[DataFrame], DataFrame], set_of: Callable[[bytes], np.ndarray],
        sets_of: Callable[[list[bytes]], list[np.ndarray]] | None = None,
    ):
        sets_of = sets_of or (lambda many: [set_of(t) for t in many])
        ratio, needed = float(similarity) - 1e-9, needed_matches(float(similarity))
        buckets = items.select("id", F.explode("bands").alias("band"))
        dealt = buckets.select("band", "id").repartition("band").sortWithinPartitions("band")
        ordered = dealt.mapInArrow(_several, "band long, id long").sortWithinPartitions("band", "id")
        shared = stored(ordered.mapInArrow(lean(_shared), "band long, id long, lead long, several boolean"), "buckets")
        full = texts(shared.select("id").distinct())
        signs = (full if "n" in full.columns else items).select("id", "n", "g0", "g1").dropDuplicates(["id"])
        star = shared.where("id <> lead").select(F.col("lead").alias("x"), F.col("id").alias("y")).distinct()
        sides = [signs.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "g0", "g1")]) for s in "xy"]
        likely = star.join(sides[0], "x").join(sides[1], "y").where(
            (matches(F.col("g0_x"), F.col("g0_y"), F.col("g1_x"), F.col("g1_y")) >= needed)
            & (F.least("n_x", "n_y") >= ratio * F.greatest("n_x", "n_y"))
        )
        tried = stored(likely.select("x", "y"), "star-pairs")
        ty, tx = full.select(F.col("id").alias("y"), F.col("text").alias("ty")), full.select(F.col("id").alias("x"), F.col("text").alias("tx"))
        compared = tried.join(ty, "y").join(tx, "x").select("x", "y", "tx", "ty")
        links = stored(compared.mapInArrow(lean(_confirmed(sets_of, similarity)), "x long, y long"), "star-links")
        self.components = found = components(links)

        def grouped_in(rows: DataFrame, key: str) -> DataFrame:
            """rows with their group so far and the number of their key's rows, where the key holds several groups."""
            named = rows.join(found.select(F.col("vertex").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
            several = named.groupBy(key).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("members")).where("_lo < _hi")
            return named.join(several.select(key, "members"), key)

        apart = shared.where("id <> lead and several").select("band", "id")
        rest = grouped_in(apart, "band").join(signs, "id")
        also = _in_blocks(rest, "band", "members").mapInArrow(lean(_likely(needed, ratio)), "x long, y long")
        clusters = components(tried.unionByName(also))
        placed = clusters.select(F.col("component").alias("cluster"), F.col("vertex").alias("id"))
        unsettled = grouped_in(placed, "cluster").join(full.select("id", "text"), "id")
        more = stored(_in_blocks(unsettled, "cluster", "members").mapInArrow(lean(_exact(sets_of, similarity)), "x long, y long"), "cross-links")
        if more.limit(1).count():
            self.components = components(links.unionByName(more))
