"""Exact removal of repeated word windows, found through difference-cover anchors.

A window is WINDOW consecutive words of one document.  Every word covered by a window that also starts in
a document with a smaller doc_id is removed; windows are judged on the input.

Anchors are runs of ANCHOR words at positions that are, modulo PERIOD, in a difference cover: for any two
positions there is a shift below PERIOD that takes both into the cover.  As ANCHOR + PERIOD - 1 = WINDOW,
any window two documents share holds an anchor aligned in both.  Only 3 of 7 positions are hashed.
Anchors that occur in two documents are extended: all windows around them are hashed with 128 bits, and
the smallest document of each window decides.

Before the shuffle each task compares the documents it holds: a repeated anchor or window sends on the
rows of its smallest document only, for those of the others the answer is known already.  So a passage that
a third of all documents share reaches the shuffle once per task.  Anchor hashes only select candidates.

Words are runs of characters other than ASCII white space, unchanged.  Rows that repeat a doc_id are
parts of one document, and windows do not cross rows; null texts have no words, and rows without doc_id
are returned whole.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Words, as_bytes, mixed, probably_in, rolling
from quillspark.llm.near_documents import slices
from quillspark.session import stored

WINDOW = 13
PERIOD, COVER = 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose rows a task compares before it passes them on.
COMPARED_BYTES = 24 << 20
_WORDS = Words()


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def anchors_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of one document's word hashes."""
    all_runs = rolling(words, ANCHOR)
    at = np.arange(len(all_runs))
    at = at[np.isin(at % PERIOD, COVER)]
    return at, all_runs[at]


def windows_near(words: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hash, second hash) of the windows that hold one of the anchors at these positions."""
    last = len(words) - WINDOW
    starts = np.unique((np.asarray(anchors)[:, None] - np.arange(PERIOD)).ravel())
    starts = starts[(starts >= 0) & (starts <= last)]
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.uint64)
    first = rolling(words, WINDOW)[starts]
    second = rolling(mixed(words ^ np.uint64(0xA0761D6478BD642F)), WINDOW, 0xE7037ED1A0B428DB)[starts]
    return starts, first, second


def compared(doc: np.ndarray, row: np.ndarray, pos: np.ndarray, first: np.ndarray, second: np.ndarray, all_known: bool) -> pa.RecordBatch:
    """Rows to pass on from one task's documents: known says that another document here settles the row.

    A row is known when its key also occurs in a smaller document here or, with ``all_known``, in any other.
    Known rows get a key of their own, so that a common key is not dealt to one task.
    """
    order = np.lexsort((doc, second, first))
    doc, row, pos, first, second = (x[order] for x in (doc, row, pos, first, second))
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    smallest = doc[starts][group]
    known = doc > smallest
    if all_known:
        # a key of several documents is settled for the smallest one too; the row itself still goes on, for other tasks
        several = np.maximum.reduceat(known, starts)[group]
    else:
        several = known
    own = mixed(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ pos.astype(np.uint64) ^ first)
    key0, key1 = np.where(known, own, first), np.where(known, mixed(own), second)
    arrays = [doc, row, pos.astype(np.int32), key0.view(np.int64), key1.view(np.int64), several]
    return pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["doc_id", "row", "pos", "k0", "k1", "known"])


_ROWS = "doc_id long, row long, pos int, k0 long, k1 long, known boolean"


def _emit(per_row: Callable[[bytes, object], tuple[np.ndarray, np.ndarray, np.ndarray] | None], all_known: bool, extra: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            docs, rows, found = zip(*held)
            n = [len(f[0]) for f in found]
            return compared(
                np.repeat(np.array(docs, dtype=np.int64), n), np.repeat(np.array(rows, dtype=np.int64), n),
                np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]), all_known,
            )

        for batch in batches:
            texts = as_bytes(batch.column("text"))
            more = batch.column(extra).to_pylist() if extra else [None] * len(texts)
            for doc_id, row, text, given in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), texts, more):
                found = per_row(text, given)
                if len(found[0]):
                    held.append((doc_id, row, found))
                    size += len(text)
                if size > COMPARED_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _anchor_rows(text: bytes, _: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = _split(text)
    if len(words) < WINDOW:
        return (np.empty(0, np.int64),) * 3
    at, hashes = anchors_of(_WORDS.hashes(words))
    return at, hashes, np.zeros(len(at), dtype=np.uint64)


def _window_rows(text: bytes, anchors: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return windows_near(_WORDS.hashes(_split(text)), np.array(anchors))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, n_words, n_removed and kept text, from doc_id, row, text and starts of removed windows."""
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        starts = batch.column("starts").to_pylist() if "starts" in batch.schema.names else [None] * len(texts)
        for lo, hi in slices([len(t or b"") for t in texts]):
            n, removed, kept = [], [], []
            for text, found in zip(texts[lo:hi], starts[lo:hi]):
                words = _split(text)
                n.append(len(words))
                if found:
                    gone = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(gone, np.array(found), 1)
                    np.add.at(gone, np.array(found) + WINDOW, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            some = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), some.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "row", "n_words", "n_removed", "kept"],
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        sha = pa.array([hashlib.sha256(t).hexdigest() for t in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], sha], names=[*batch.schema.names[:4], "kept_sha256"])


def removed_windows(rows: DataFrame) -> DataFrame:
    """(row, starts): word positions at which windows to remove start, from (doc_id, row, text as bytes)."""
    named = rows.where("doc_id is not null and text is not null")
    anchors = named.mapInArrow(_emit(_anchor_rows, True), _ROWS).drop("k1")
    same = Window.partitionBy("k0")
    spread = anchors.withColumn("lo", F.min("doc_id").over(same)).withColumn("hi", F.max("doc_id").over(same))
    shared = stored(spread.where("known or lo < hi").groupBy("row").agg(F.collect_list("pos").alias("anchors")), "shared-anchors")
    near = probably_in(named, "row", shared.select("row")).where("_maybe").drop("_maybe").join(shared, "row")
    windows = near.select("doc_id", "row", "text", "anchors").mapInArrow(_emit(_window_rows, False, "anchors"), _ROWS)
    least = F.min("doc_id").over(Window.partitionBy("k0", "k1"))
    gone = windows.withColumn("lo", least).where("known or lo < doc_id")
    return stored(gone.groupBy("row").agg(F.collect_list("pos").alias("starts")), "removed-windows")


def deduplicated(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (or kept_sha256) of every row of (doc_id, text)."""
    # a row is told apart from others by its id and, for repeated ids, its text
    row = F.xxhash64("doc_id", F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("text").cast("binary").alias("text"))
    gone = removed_windows(rows)
    marked = probably_in(rows, "row", gone.select("row"))
    fn, kind = (_hashed, "kept_sha256 string") if digests else (_kept, "kept binary")
    schema = f"doc_id long, row long, n_words long, n_removed long, {kind}"
    whole = marked.where("not _maybe").drop("_maybe").mapInArrow(fn, schema)
    cut = marked.where("_maybe").drop("_maybe").join(gone, "row", "left").mapInArrow(fn, schema)
    out = whole.unionByName(cut).drop("row")
    return out if digests else out.withColumn("kept", F.decode("kept", "UTF-8"))
