"""Fuzzy line deduplication by MinHash over character shingles.

Lines are split at line feeds and compared with A-Z lower-cased and ASCII white space collapsed; lines
without any other character are never removed.  A line's set holds its distinct runs of SHINGLE characters
(a shorter line is one element).  Lines of equal comparison form are one item; items with a Jaccard
similarity of SIMILARITY or more on their full sets are linked, and of each component the first line, by
doc_id and line number, is kept; all others are removed wherever they stand.

Banding has BANDS bands of ROWS minima: a pair at the threshold is found with probability 0.995, one at 0.9
with 0.99997.  Items are named by a 64-bit hash of their comparison form.

Null texts have no lines.  Rows without doc_id are returned whole.  Repeated rows (same id and text) are
treated alike; rows of one doc_id with different texts follow each other by a hash of the text.  Other
columns are kept by ``deduplicated`` and ignored by ``counted``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from quillspark.llm.common import LOWER_ASCII, as_bytes, lean, probably_in, rolling, slices
from quillspark.llm.linking import Linked, band_keys, minima, packed
from quillspark.session import scratch_path, stored

SHINGLE = 7
SIMILARITY = Fraction(4, 5)
BANDS, ROWS = 10, 4
#: Bytes of lines hashed at once (few enough for a processor's cache), and lines that a task knows again.
HASHED_BYTES, KNOWN_LINES = 1 << 16, 1 << 18
#: LOWER_ASCII, and ASCII white space within a line to spaces.
_SPACED = bytes(32 if b in b"\t\r\x0b\x0c" else b for b in LOWER_ASCII)
_SCHEMA = "key long, doc_id long, row long, line int, bands array<long>, text binary"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def plain(line: bytes) -> bytes:
    """The form in which lines are compared."""
    return b" ".join(line.translate(LOWER_ASCII).split())


def forms_of(text: bytes) -> list[bytes]:
    """plain() of each line, by passes over the whole text."""
    text = text.translate(_SPACED)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return [line.strip(b" ") for line in text.split(b"\n")]


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): shingle hashes of all lines one after another, and where each line's begin."""
    padded = [t if len(t) >= SHINGLE else t.ljust(SHINGLE, "\0") for t in (x.decode("utf-8", "replace") for x in lines)]
    lengths = np.array([len(t) for t in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    hashes = rolling(codes, SHINGLE)
    ends = np.cumsum(lengths)
    inside = np.ones(len(codes), dtype=bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return hashes[inside[: len(hashes)]], np.concatenate([[0], np.cumsum(lengths - SHINGLE + 1)[:-1]])


def shingle_set(line: bytes) -> np.ndarray:
    return np.unique(shingles([line])[0])


def set_sizes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Distinct shingles of each line.

    Lines are sorted all at once by line number and the leading bits of the hash; a line in which two
    of these agree, which is rare without repeats, is counted by its whole hashes.
    """
    sizes = np.diff([*starts, len(hashes)])
    bits = max(1, len(starts).bit_length())
    owner = np.repeat(np.arange(len(starts), dtype=np.uint64), sizes)
    keys = np.sort((owner << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    for k in np.unique(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - bits)).astype(np.int64):
        sizes[k] = len(np.unique(hashes[starts[k] : starts[k] + sizes[k]]))
    return sizes


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    out = []
    for lo, hi in slices(list(map(len, lines)), HASHED_BYTES):
        hashes, starts = shingles(lines[lo:hi])
        for some in np.split(hashes, starts[1:]):
            some = np.sort(some)
            out.append(some[np.concatenate([[True], some[1:] != some[:-1]])])
    return out


def _banded(forms: list[bytes]) -> np.ndarray:
    """(lines, BANDS) keys of the lines."""
    parts = [np.empty((BANDS * ROWS, 0), dtype=np.uint32)]
    for lo, hi in slices(list(map(len, forms)), HASHED_BYTES):
        parts.append(minima(*shingles(forms[lo:hi]), BANDS * ROWS))
    return band_keys(np.concatenate(parts, axis=1), BANDS, ROWS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that is not blank; bands and text with the first of the equal lines that a task knows."""
    known: set[int] = set()
    for batch in batches:
        texts, ids, rows = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for lo, hi in slices([len(t or b"") for t in texts], 2 << 20):
            keys: list[int] = []
            places: list[int] = []
            ends: list[int] = [0]
            firsts: list[int] = []
            forms: list[bytes] = []
            if len(known) > KNOWN_LINES:
                known.clear()
            for text in texts[lo:hi]:
                for k, form in enumerate(forms_of(text or b"")):
                    if form:
                        key = xxhash.xxh3_64_intdigest(form)
                        if key not in known:
                            known.add(key)
                            firsts.append(len(keys))
                            forms.append(form)
                        keys.append(key)
                        places.append(k)
                ends.append(len(keys))
            if not keys:
                continue
            at = np.full(len(keys), -1)
            at[firsts] = np.arange(len(forms))
            take = pa.array(at, mask=at < 0)
            banded = _banded(forms)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, banded.size + 1, BANDS, dtype=np.int32)), pa.array(banded.ravel()))
            key = (np.array(keys, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
            doc_id, row = (np.repeat(np.array(some[lo:hi], dtype=np.int64), np.diff(ends)) for some in (ids, rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(doc_id), pa.array(row), pa.array(places, pa.int32()), bands.take(take), pa.array(forms, pa.binary()).take(take)],
                names=_NAMES,
            )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) with the size of the line's set and its packed signature."""
    for batch in batches:
        forms = batch.column("text").to_pylist()
        for lo, hi in slices(list(map(len, forms)), HASHED_BYTES):
            hashes, starts = shingles(forms[lo:hi])
            signs = [pa.array(set_sizes(hashes, starts)), *map(pa.array, packed(minima(hashes, starts)))]
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *signs], names=["id", "text", "n", "g0", "g1"])


def _row() -> Column:
    return F.xxhash64("doc_id", F.col("text"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(row, lines): numbers of the lines to remove, for rows of (doc_id, text); row is a hash of both."""
    spark = docs.sparkSession
    narrow = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.col("text").cast("binary").alias("text"))
    path = scratch_path(spark, "lines")
    # hardly any band or text occurs twice: dictionaries of them would be made and thrown away
    narrow.mapInArrow(lean(_signed), _SCHEMA).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    lines = spark.read.parquet(path)
    signed = lines.where("bands is not null")

    def texts(ids: DataFrame) -> DataFrame:
        maybe = probably_in(signed.select(F.col("key").alias("id"), "text"), "id", ids).where("_maybe").drop("_maybe")
        once = maybe.join(ids, "id", "left_semi").dropDuplicates(["id"]).select("id", "text")
        return stored(once.mapInArrow(lean(_described), "id long, text binary, n long, g0 long, g1 long"), "candidate-lines")

    items = signed.select(F.col("key").alias("id"), "bands")
    found = Linked(items, SIMILARITY, texts, shingle_set, shingle_sets).components
    place = F.struct("doc_id", "row", "line")
    each = lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    named = each.join(found.select(F.col("vertex").alias("key"), "component"), "key", "left").where("times > 1 or component is not null")
    named = stored(named.select("key", "first", "component"), "line-groups")
    heads = named.where("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    kept = named.join(heads, "component", "left").select("key", F.coalesce("head", "first").alias("kept"))
    gone = lines.select("key", "doc_id", "row", "line").join(kept, "key").where(place != F.col("kept"))
    return stored(gone.groupBy("row").agg(F.collect_set("line").alias("lines")), "removed-lines")


def _cut(text: bytes | None, lines: list[int] | None) -> tuple[bytes | None, int, int]:
    """Text without the lines, their number before, and removed."""
    if text is None:
        return None, 0, 0
    split = text.split(b"\n")
    gone = set(lines or ())
    return b"\n".join([x for k, x in enumerate(split) if k not in gone]) if gone else text, len(split), len(gone)


def _applied(docs: DataFrame, digests: bool = False) -> DataFrame:
    """docs with _kept, _n, _gone in place of its text: kept text (bytes; its SHA-256 with digests), lines before, lines removed."""
    gone = removed_lines(docs)
    gone = gone.select(F.col("row").alias("__row_gone"), F.col("lines").alias("__lines"))
    marked = probably_in(docs.withColumn("__row", _row()), "__row", gone.select("__row_gone"))
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*others, StructField("_kept", BinaryType()), StructField("_n", IntegerType()), StructField("_gone", IntegerType())])
    names = [*[f.name for f in others], "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines = as_bytes(batch.column(len(others))), batch.column(len(others) + 1).to_pylist()
            for lo, hi in slices([len(t or b"") for t in texts]):
                kept, n, cut = zip(*map(_cut, texts[lo:hi], lines[lo:hi]))
                if digests:
                    kept = [hashlib.sha256(t or b"").digest() for t in kept]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(others)], pa.array(kept, pa.binary()), pa.array(n, pa.int32()), pa.array(cut, pa.int32())], names=schema.names)

    whole = marked.where("not _maybe").select(*names, F.lit(None).cast("array<int>").alias("__lines"))
    cut = marked.where("_maybe").join(gone, F.col("__row") == F.col("__row_gone"), "left").select(*names, "__lines")
    return whole.mapInArrow(lean(run), schema).unionByName(cut.mapInArrow(lean(run), schema))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the kept lines as text; documents all of whose lines were removed go."""
    out = _applied(docs).where("_gone = 0 or _gone < _n")
    return out.select(*[F.decode("_kept", "UTF-8").alias(c) if c == "text" else F.col(c) for c in docs.columns])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (lowercase hex of the kept text, UTF-8) of every row."""
    sha = F.lower(F.hex("_kept"))
    return _applied(docs.select("doc_id", "text"), digests=True).select("doc_id", F.col("_n").cast("long").alias("n_lines"), F.col("_gone").cast("long").alias("n_removed"), sha.alias("kept_sha256"))
