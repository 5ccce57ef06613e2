"""Removal of benchmark passages from training documents: hash set of test n-grams, scan, exact verification.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.  A window is
WINDOW consecutive words of one benchmark item; an item of fewer words, but not none, is one window of its
own length.  A document word inside any occurrence of a window is hit.

1. The windows' hashes, cut to SET_BITS values, are sent to the tasks as a bitmap: a hash set of fixed size,
   whatever the benchmark.  With very many windows it fills up and lets more through.
2. One scan of the documents hashes every run of as many words as some window has, and keeps each run that
   is in the set, with its words and all its positions: one row per document and distinct run.
3. A join on the words themselves verifies the runs, so no hash decides.  Overlapping hits are united per
   document.  Texts are not shuffled.

Null texts and texts without words have no hits.  Items without text or words have no windows; an item
without an id hits words, but is not counted or named.  Rows that share an item_id are one item.  Documents
that repeat a doc_id, or have none, are judged row by row.  Empty tables give no hits or no rows.
Other columns are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.llm.common import Words, as_bytes, bits_at, probably_in, rolling, sent_bitmap
from quillspark.session import stored

WINDOW = 10
#: Values of the hash set; as a bitmap it takes 8 MiB.
SET_BITS = 1 << 26
#: Rows of one Arrow batch that a scan passes on.
PASSED_ON = 1 << 14
_SPOTS = np.uint64(SET_BITS - 1)
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_WORDS = Words()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def windows(items: DataFrame) -> DataFrame:
    """(win, size, spot, item_id) of every window of (item_id, text); win has the words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), as_bytes(batch.column("text"))):
                words = words_of(text)
                if not words:
                    continue
                size = min(WINDOW, len(words))
                spots = (rolling(_WORDS.hashes(words), size) & _SPOTS).astype(np.int64)
                found = [b" ".join(words[k : k + size]) for k in range(len(spots))]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), pa.array([size] * n, pa.int32()), pa.array(spots), pa.array([item] * n, pa.string())],
                    names=["win", "size", "spot", "item_id"],
                )

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "win binary, size int, spot long, item_id string").distinct()


def document_key(doc_id: Column, text: Column) -> Column:
    """128-bit name of a document's id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def _candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row (row, doc_id, n_words) per document, and (row, key, win, at) per run of words in the hash set."""
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most WINDOW rows
    sent = sent_bitmap(known.select("spot"), SET_BITS)
    names, kinds = ("row", "doc_id", "n_words", "key", "win", "at"), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, dtype=np.uint8)
        row = TaskContext.get().partitionId() << 33
        out: list[tuple] = []

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                words = words_of(text)
                out.append((row, doc_id, len(words), None, None, None))
                hashes, at = _WORDS.hashes(words), {}
                for size in sizes:
                    for k in np.flatnonzero(bits_at(bitmap, rolling(hashes, size) & _SPOTS)).tolist():
                        at.setdefault(b" ".join(words[k : k + size]), []).append(k)
                if at:
                    key = hashlib.md5(f"{'' if doc_id is None else doc_id}|".encode() + text).hexdigest()
                    for win, places in at.items():
                        out.append((row, None, None, key, win, places))
                        if len(out) >= PASSED_ON:
                            yield passed_on()
                row += 1
                if len(out) >= PASSED_ON:
                    yield passed_on()
        if out:
            yield passed_on()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return stored(narrow.mapInArrow(run, "row long, doc_id long, n_words long, key string, win binary, at array<int>"), "benchmark-runs")


def _verified(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Runs whose words are a window's, with its number of words."""
    return runs.where("win is not null").join(known.select("win", "size").distinct(), "win")


def _united(places: Column) -> Column:
    """Disjoint spans (s, e), in order, from an array of arrays of spans."""
    spans = F.sort_array(F.flatten(places))
    one = "array<struct<s:int,e:int>>"
    return F.aggregate(
        spans,
        F.array().cast(one),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["e"] >= x["s"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def _covered(places: Column) -> Column:
    """Words that an array of arrays of spans (s, e) covers."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        F.sort_array(F.flatten(places)),
        start,
        lambda done, x: F.struct(
            (done["n"] + F.greatest(x["e"] - F.greatest(x["s"], done["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(done["to"], x["e"]).alias("to")
        ),
        lambda done: done["n"],
    )


_PLACES = "transform(at, k -> struct(k as s, k + size as e))"


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items that occur, sorted as strings) and contaminated of every row."""
    known = stored(windows(items), "benchmark-windows")
    runs = _candidates(docs, known)
    whole = runs.where("win is null").select("row", "doc_id", "n_words", F.lit(None).cast("array<struct<s:int,e:int>>").alias("places"), F.lit(None).cast("string").alias("item_id"))
    hit = _verified(runs, known).select("row", F.expr(_PLACES).alias("places"))
    # runs that several items share are joined with each of them, without their positions
    named = runs.where("win is not null").select("row", "win").join(known.where("item_id is not null").select("win", "item_id"), "win").select("row", "item_id").distinct()
    found = whole.unionByName(hit, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)
    grouped = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), _covered(F.collect_list("places")).alias("n_hit"), F.sort_array(F.collect_list("item_id")).alias("items")
    )
    return grouped.select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The document with the spans of words cut out of its text, from (doc, text, spans)."""
    for batch in batches:
        texts = []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist()):
            at = [m.span() for m in _WORD.finditer(text)]
            kept, last = [], 0
            for span in spans:
                kept.append(text[last : at[span["s"]][0]])
                last = at[span["e"] - 1][1]
            texts.append(b"".join([*kept, text[last:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc", "text"])


def cleaned(docs: DataFrame, items: DataFrame, whole_documents: bool = False) -> DataFrame:
    """docs, all columns, without the words that a benchmark window covers; or without the documents that hold one.

    What stands between two hit words goes with them; the rest of a text stays as it is.
    """
    known = stored(windows(items), "benchmark-windows")
    hit = _verified(_candidates(docs, known), known).select("key", F.expr(_PLACES).alias("places"))
    spans = stored(hit.groupBy("key").agg(_united(F.collect_set("places")).alias("spans")), "benchmark-spans")
    packed = docs.select(F.struct("*").alias("doc"), document_key(F.col("doc_id"), F.col("text")).alias("key"))
    marked = probably_in(packed, "key", spans.select("key"))
    free, maybe = marked.where("not _maybe").select("doc"), marked.where("_maybe").drop("_maybe")
    if whole_documents:
        return free.unionByName(maybe.join(spans, "key", "left_anti").select("doc")).select("doc.*")
    both = maybe.join(spans, "key", "left")
    cut = both.where("spans is not null").select("doc", F.col("doc.text").alias("text"), "spans")
    kind = StructType([packed.schema["doc"], StructField("text", StringType())])
    shorter = cut.mapInArrow(_without, kind).select(F.col("doc").withField("text", F.col("text")).alias("doc"))
    return free.unionByName(both.where("spans is null").select("doc")).unionByName(shorter).select("doc.*")
