"""I-Match fingerprints with randomised lexicons, of each document and of a half-replaced version of it.

Terms are runs of characters other than ASCII white space and punctuation, A-Z lower-cased.  Document
frequencies are counted over all documents in 2^24 hash buckets; the lexicon holds the buckets whose
share of documents lies within the chosen band (so its size is fixed: a bitmap of 2 MiB, whatever the
corpus).  By the relative bound, what other terms add to a bucket does not grow with the corpus.  A
fingerprint is one hash per lexicon: the full one, and random subsets of it at rates 1/2 to 1/256, each
over the sorted distinct terms of the document in that subset.  A text without any lexicon term uses all
its terms; one without any term is hashed whole.  Equal texts have equal fingerprints.

Null texts count as empty.  The document that follows in descending doc_id (null last; of rows with one
doc_id, the one whose text sorts just below) is the next one, after the last comes the first; a single
document is its own next one.  Rows that repeat keep a row each.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BITMAP_ROW_BITS, as_bytes, bitmap_rows
from quillspark.session import stored

BUCKETS = 1 << 24
#: Band of document shares (idf between 3 and about 9.2); a term of a single document is never in it.
LEAST_SHARE, MOST_SHARE, LEAST_DOCUMENTS = 1e-4, 0.05, 2
RATES, PER_RATE = 8, 4
LEXICONS = 1 + RATES * PER_RATE
#: Most parts that the documents are laid out in by doc_id.
MOST_PARTS = 8192
REMEMBERED = 1 << 18
TERM_BYTES = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: bytes) -> set[bytes]:
    return set(text.translate(TERM_BYTES).split())


def _bucket(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) & (BUCKETS - 1)


def document_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): documents per bucket of terms; bucket -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, known = np.zeros(BUCKETS, dtype=np.int32), 0, {}
        for batch in batches:
            rows += batch.num_rows
            for text in as_bytes(batch.column(0)):
                found = terms(text or b"")
                at = []
                for t in found:
                    b = known.get(t)
                    if b is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        b = known[t] = _bucket(t)
                    at.append(b)
                if at:
                    counts[np.unique(np.array(at))] += 1
        full = np.flatnonzero(counts)
        for lo in range(0, len(full), 1 << 18):
            part = full[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64))], names=["bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows], pa.int64())], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame) -> bytes:
    """Bitmap of the buckets within the band (2 MiB)."""
    counts = stored(document_counts(docs), "document-counts")
    total = counts.where("bucket = -1").agg(F.sum("n")).first()[0] or 0
    band = counts.where((F.col("bucket") >= 0) & (F.col("n") >= max(LEAST_DOCUMENTS, LEAST_SHARE * total)) & (F.col("n") <= max(LEAST_DOCUMENTS, MOST_SHARE * total)))
    bits, step = bytearray(BUCKETS // 8), BITMAP_ROW_BITS // 8
    for row in bitmap_rows(band.select((F.col("bucket").cast("long") + 1).alias("b")), "b").collect():  # at most 512 rows of 4 KiB
        # Spark's bitmap 1 starts with value 1, hence the added one
        part = bytes(row["_bitmap"])
        bits[(row["_bitmap_row"] - 1) * step : (row["_bitmap_row"] - 1) * step + len(part)] = part
    return bytes(bits)


class Fingerprints:
    """Fingerprints under one lexicon."""

    def __init__(self, bitmap: bytes):
        self.bitmap, self.known = bitmap, {}

    def _held(self, term: bytes) -> bool:
        spot = _bucket(term)
        return bool(self.bitmap[spot >> 3] >> (spot & 7) & 1)

    @staticmethod
    def _lexicons(term: bytes) -> tuple[int, ...]:
        """Numbers of the lexicons that hold the term: 0 is the full one, a rate 2^-r asks for r zero bits."""
        bits = xxhash.xxh3_128_intdigest(term, 1) << 128 | xxhash.xxh3_128_intdigest(term, 2)
        held = [0]
        for rate in range(1, RATES + 1):
            for k in range(PER_RATE):
                if not bits & ((1 << rate) - 1):
                    held.append(1 + (rate - 1) * PER_RATE + k)
                bits >>= rate
        return tuple(held)

    def of(self, text: bytes) -> tuple[str, ...]:
        found, known, members = terms(text), self.known, []
        for t in found:
            held = known.get(t)
            if held is None and self._held(t):
                if len(known) > REMEMBERED:
                    known.clear()
                held = known[t] = self._lexicons(t)
            if held is not None:
                members.append((t, held))
        if not members:
            members = [(t, self._lexicons(t)) for t in found]
        if not members:
            return (f"{xxhash.xxh64_hexdigest(text, 3)[:8]}", *[""] * (LEXICONS - 1))
        members.sort()
        lists: list[list[bytes]] = [[] for _ in range(LEXICONS)]
        for t, held in members:
            for k in held:
                lists[k].append(t)
        return tuple([xxhash.xxh64_hexdigest(b" ".join(x))[:8] if x else "" for x in lists])


def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of equal hashes among the lexicons that hold a term of either text."""
    used = [x == y for x, y in zip(a, b) if x or y]
    return sum(used) / len(used)


def laid_out(docs: DataFrame) -> DataFrame:
    """Documents by part and ascending doc_id, each part led by the row that comes before its first one.

    Parts are ranges of doc_id with about equal rows.  One row per part is copied to the part above it
    (the last row of all to the first part), so that each task sees every document's next one.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = min(MOST_PARTS, max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * 2)
    bounds = sorted(set(narrow.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts))))
    limits = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else None

    @F.pandas_udf("int")
    def part_of(ids):
        return ids.map(lambda x: 0 if x is None or x != x else bisect_left(bounds, x)).astype("int32")

    placed = narrow.withColumn("part", part_of("doc_id")) if limits is not None else narrow.withColumn("part", F.lit(0))
    lasts = placed.groupBy("part").agg(F.max("doc_id").alias("last")).orderBy("part").collect()  # one row per part
    if not lasts:
        return placed.withColumn("own", F.lit(True))
    above = [(lasts[(k + 1) % len(lasts)]["part"], x["last"]) for k, x in enumerate(lasts)]
    wanted = docs.sparkSession.createDataFrame(above, "part int, last long")
    leading = narrow.join(F.broadcast(wanted), narrow["doc_id"].eqNullSafe(wanted["last"])).select("doc_id", "text", "part")
    both = placed.withColumn("own", F.lit(True)).unionByName(leading.withColumn("own", F.lit(False)))
    return both.repartition(parts, "part").sortWithinPartitions("part", "own", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(sent.value)
        before, part_before = None, None
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, part, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "own"))):
                mine = prints.of(text.encode())
                if own:
                    following, theirs = before if part == part_before else (text, mine)
                    n = len(text)
                    edited = (text[: n - n // 2] + following[: n // 2]).encode()
                    changed = prints.of(edited)
                    rows.append((doc_id, n, hashlib.sha256(edited).hexdigest(), "-".join(mine), "-".join(changed), likeness(mine, changed), likeness(mine, theirs)))
                before, part_before = (text, mine), part
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return laid_out(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
