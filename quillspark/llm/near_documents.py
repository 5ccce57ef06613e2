"""MinHash near-duplicates of documents (b-bit signatures, banding, exact confirmation on full sets).

A document's set holds its distinct runs of ``width`` words (A-Z lower-cased, words split at ASCII white
space); with fewer words, the whole sequence is one element; without words, or without text, the set is
empty and the document is linked with nothing.  Documents with equal sets are represented by the one with
the smallest id, so copies cost nothing further.  Links need intersection >= similarity * union, checked
on the full sets.  Rows that repeat a doc_id are one document and get equal answers; rows without doc_id
are linked with nothing (component_id null, kept).  An empty table gives an empty result, other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER_ASCII, Words, as_bytes, lean, mixed, probably_in, rolling, slices
from quillspark.llm.linking import Linked, band_keys, minima, packed
from quillspark.session import stored

BANDS, ROWS = 16, 4
SCHEMA = "doc_id long, n_shingles long, s0 long, s1 long, bands array<long>, g0 long, g1 long"


def shingle_set(text: bytes | None, width: int, words: Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles; ``words`` are those that a task knows."""
    found = (text or b"").translate(LOWER_ASCII).split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashes = (words or Words()).hashes(found)
    # a short sequence gets a hash of its own kind, so that it never equals a run of a longer one
    return np.unique(rolling(hashes, width)) if len(found) >= width else mixed(rolling(hashes, len(found)) + np.uint64(len(found)))


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), batch.column(0)
            for lo, hi in slices([len(t or b"") for t in texts]):
                sets = [shingle_set(t, width, words) for t in texts[lo:hi]]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                n = hi - lo
                s0, s1, g0, g1 = (np.zeros(n, dtype=np.int64) for _ in range(4))
                bands: list = [[]] * n
                if len(full):
                    joined = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    s0[full] = np.add.reduceat(mixed(joined), starts).view(np.int64)
                    s1[full] = np.add.reduceat(mixed(joined ^ np.uint64(0x94D049BB133111EB)), starts).view(np.int64)
                    least = minima(joined, starts)
                    g0[full], g1[full] = packed(least)
                    for i, keys in zip(full, band_keys(least, BANDS, ROWS)):
                        bands[i] = keys
                arrays = [ids.slice(lo, n), pa.array(sizes.astype(np.int64)), *map(pa.array, (s0, s1)), pa.array(bands, pa.list_(pa.int64())), *map(pa.array, (g0, g1))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "s0", "s1", "bands", "g0", "g1"])

    return run


def candidate_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text as bytes) of the documents named, stored; others' texts are mostly not shuffled."""
    narrow = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    maybe = probably_in(narrow, "id", ids).where("_maybe").drop("_maybe")
    return stored(maybe.join(ids, "id", "left_semi"), "candidate-texts")


def near_documents(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    signed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_signed(width)), SCHEMA), "signatures")
    key = ["n_shingles", "s0", "s1"]
    firsts = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    placed = stored(signed.where("n_shingles > 0 and doc_id is not null").join(firsts, key), "placed")
    items = placed.where("doc_id = rep").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "g0", "g1")

    words = Words()  # sent empty: each task fills its own
    linked_items = Linked(items, similarity, lambda ids: candidate_texts(docs, ids), lambda text: shingle_set(text, width, words))
    found = linked_items.components
    named = placed.select("doc_id", "n_shingles", "rep").join(found.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
    linked = named.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ``ids`` (one column doc_id); rows surely not in it are not shuffled."""
    marked = probably_in(docs, "doc_id", ids)
    clear = marked.where(~F.col("_maybe")).drop("_maybe")
    return clear.unionByName(marked.where("_maybe").drop("_maybe").join(ids, "doc_id", "left_anti")).select(docs.columns)


def one_of_each(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """docs with the document of smallest id of each group of near-duplicates; a repeated doc_id keeps its rows."""
    dropped = stored(near_documents(docs, width, similarity).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return without(docs, dropped)
