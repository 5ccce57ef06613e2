"""Phrase collocations from an FM-index per shard over word ids.

Texts are lower-cased in A-Z and split at punctuation and line ends into pieces, pieces at blanks and tabs
into words.  All counts are per language (null: ``und``).

1. A task gathers SHARD_BYTES of text at a time.  For each language in it, the words become numbers, with 0
   between pieces, and are indexed in both directions: suffixes sorted to the depth that phrases need, the
   Burrows-Wheeler transforms, and the last-to-first map.  Starting from single words, intervals are extended
   to the left by every word that stands before them, all intervals of a depth at once; the interval in the
   reversed index moves along.  Its size is the count, and the two transforms tell how many
   occurrences go on to the left and to the right.
2. Counts are summed across shards.  For each length from two words on, a scan counts the phrases under
   64-bit names, and the names with enough occurrences go into a bitmap of fixed size; longer phrases are
   counted only if their parts are in it.  A last scan counts words, and phrases in the bitmaps, under their
   own words.  As a phrase occurs no more often than any of its parts, and a bitmap errs only by letting too
   much through, no phrase is lost.
3. Candidates are joined with the counts of their parts; scores are computed in 38-digit decimals.

Null texts count as empty, empty tables give no rows.  Rows that repeat count each time.  A text longer than
a shard is a shard of its own.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import as_bytes, bits_at, mixed, sent_bitmap
from quillspark.session import stored

#: Longest phrase, least count, share of a phrase's occurrences in a longer one that drops it, rows per language.
DEPTH, LEAST, INSIDE_PERCENT, MOST = 3, 10, 50, 2000
#: Bytes of text per shard.
SHARD_BYTES = 12 << 20
#: Values of the set of frequent phrases of one length; as a bitmap it takes 8 MiB.
SET_BITS = 1 << 26
SCALE = 1_000_000
UNKNOWN = "und"
_SPOTS = np.uint64(SET_BITS - 1)
_PIECE_END = b"\xff"  # not part of any UTF-8 text
_BYTES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Numbers(dict):
    """Numbers of words in order of appearance; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({_PIECE_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(word numbers with 0 before, between and after pieces, words by number)."""
    numbers, parts = _Numbers(), [np.zeros(1, np.int32)]
    for text in texts:
        words = text.translate(_BYTES).replace(_PIECE_END, b" \xff ").split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    return np.concatenate(parts), list(numbers)


@dataclass
class Intervals:
    """Intervals of phrases of one length: rows lo to lo + size - 1, and the same in the reversed index."""

    words: np.ndarray  # (phrases, length) word numbers
    lo: np.ndarray
    reversed_lo: np.ndarray
    size: np.ndarray

    def at(self, kept: np.ndarray) -> Intervals:
        return Intervals(self.words[kept], self.lo[kept], self.reversed_lo[kept], self.size[kept])


def _by_word(before: np.ndarray) -> np.ndarray:
    """Rows of a transform by word, then by place: the inverse of the last-to-first map."""
    n, key = len(before), before.astype(np.int64)
    key *= n
    key += np.arange(n, dtype=np.int32)
    key.sort()
    key %= n
    return key.astype(np.int32)


def _transform(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Burrows-Wheeler transform over suffixes sorted by their first ``depth`` words; the sequence is a circle."""
    base = np.int64(sequence.max()) + 1
    order = np.arange(len(sequence))
    # the least significant words first, as many in one key as fit into 63 bits
    fit = max(1, int(63 // np.log2(float(base) + 1)))
    for lo in reversed(range(0, depth, fit)):
        key = np.zeros(len(sequence), np.int64)
        for k in range(lo, min(depth, lo + fit)):
            key *= base
            key += np.roll(sequence, -k)
        order = np.argsort(key) if depth <= fit else order[np.argsort(key[order], kind="stable")]
    return sequence[order - 1]


class WordIndex:
    """Bidirectional FM-index of a sequence of word numbers; 0 ends a piece and is part of no phrase.

    Suffixes are sorted to ``depth`` words only: enough for intervals of phrases of up to that many words,
    since suffixes that are equal to that depth lie in the same intervals.
    """

    def __init__(self, sequence: np.ndarray, depth: int):
        before, after = _transform(sequence, depth), _transform(sequence[::-1], depth)
        self.by_word = _by_word(before)
        counts = np.bincount(sequence)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.first = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        # occurrences without a word before or after, up to each row
        self._opening = np.concatenate([[0], np.cumsum(before == 0, dtype=np.int32)])
        self._closing = np.concatenate([[0], np.cumsum(after == 0, dtype=np.int32)])

    def words(self) -> Intervals:
        every = np.arange(1, len(self.starts) - 1)
        return Intervals(every[:, None].astype(np.int32), self.starts[every], self.starts[every], np.diff(self.starts)[every])

    def extended(self, found: Intervals) -> Intervals:
        """Every phrase one word longer to the left that occurs, of all these phrases.

        Row j of the index belongs to the phrase word + P where the row that precedes it, by_word[j], lies in
        the interval of P.  Within a word's rows those of one P are neighbours, so the new intervals are runs.
        """
        phrase = np.full(len(self.first), -1, np.int32)
        into = np.repeat((found.lo - (np.cumsum(found.size) - found.size)).astype(np.int32), found.size)
        into += np.arange(len(into), dtype=np.int32)
        phrase[into] = np.repeat(np.arange(len(found.size), dtype=np.int32), found.size)
        after = phrase[self.by_word]
        del into, phrase
        new = np.flatnonzero(np.concatenate([[True], (after[1:] != after[:-1]) | (self.first[1:] != self.first[:-1])]))
        size, parent, word = np.diff(np.append(new, len(after))), after[new], self.first[new]
        inside = parent >= 0
        lo, size, parent, word = new[inside], size[inside], parent[inside], word[inside]
        # in the reversed index, the occurrences with a smaller word before, or none, come first
        order = np.argsort(parent, kind="stable")
        smaller = np.empty(len(order), np.int64)
        smaller[order] = np.cumsum(size[order]) - size[order]
        reversed_lo = found.reversed_lo[parent] + smaller - (np.cumsum(found.size) - found.size)[parent]
        longer = Intervals(np.concatenate([word[:, None], found.words[parent]], axis=1), lo, reversed_lo, size)
        return longer.at(word != 0)

    def goes_on(self, found: Intervals) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each phrase that have a word before them, and after them, in their piece."""
        left = found.size - (self._opening[found.lo + found.size] - self._opening[found.lo])
        right = found.size - (self._closing[found.reversed_lo + found.size] - self._closing[found.reversed_lo])
        return left, right


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of SHARD_BYTES of text at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= SHARD_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _names(words: list[bytes], lang: str) -> np.ndarray:
    """64-bit names of a language's words."""
    seed = xxhash.xxh32_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _phrase_names(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit names of phrases, from the names of their words."""
    out = np.zeros(len(words), np.uint64)
    for column in words.T:
        out = out * np.uint64(0x9E3779B97F4A7C15) + names[column]
    return mixed(out)


def _frequent(index: WordIndex, names: np.ndarray, sets: list[np.ndarray], depth: int) -> Iterator[Intervals]:
    """Phrases of 1 to ``depth`` words; of each length that has a set (from 2 on) only those in it, and longer ones only if their parts are."""
    found = index.words()
    yield found
    for length in range(2, depth + 1):
        found = index.extended(found)
        # the words after the first one are a phrase found before; test those before the last one, and the whole
        for part in (length - 1, length):
            if 2 <= part < len(sets) + 2:
                found = found.at(bits_at(sets[part - 2], _phrase_names(names, found.words[:, :part]) & _SPOTS))
        yield found


def _named(docs: DataFrame, sent: list[Broadcast[bytes]]) -> DataFrame:
    """(name, n): occurrences of each phrase one word longer than the last set's, summed under 64-bit names."""
    depth = len(sent) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [np.frombuffer(x.value, np.uint8) for x in sent]
        for lang, texts in _shards(batches):
            sequence, words = numbered(texts)
            names = _names(words, lang)
            *_, found = _frequent(WordIndex(sequence, depth), names, sets, depth)
            name = _phrase_names(names, found.words)
            for lo in range(0, len(name), 1 << 17):
                part = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(name[part].view(np.int64)), pa.array(found.size[part].astype(np.int64))], names=["name", "n"])

    return docs.mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def _rows(lang: str, words: list[bytes], found: Intervals, index: WordIndex) -> Iterator[pa.RecordBatch]:
    spelled = pa.array(words, pa.binary())
    left, right = index.goes_on(found)
    for lo in range(0, len(found.size), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        columns = [spelled.take(pa.array(c)) for c in found.words[part].T]
        phrase = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))
        counts = [pa.array(c[part].astype(np.int64)) for c in (found.size, left, right)]
        n = len(phrase)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n), pa.array(np.full(n, found.words.shape[1], np.int32)), phrase.cast(pa.string()), *counts],
            names=["lang", "words", "phrase", "n", "left", "right"],
        )


def counted(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n, left, right) of every word, and of phrases of 2 to ``depth`` words that occur ``least`` times.

    n counts occurrences; left and right those that have a word before and after them in their piece.
    """
    narrow = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").alias("text"))
    sent: list[Broadcast[bytes]] = []
    for _ in range(2, depth + 1):
        spots = _named(narrow, list(sent)).where(F.col("n") >= least).select(F.col("name").bitwiseAND(F.lit(SET_BITS - 1)).alias("spot"))
        sent.append(sent_bitmap(spots, SET_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [np.frombuffer(x.value, np.uint8) for x in sent]
        for lang, texts in _shards(batches):
            sequence, words = numbered(texts)
            index = WordIndex(sequence, depth)
            for found in _frequent(index, _names(words, lang), sets, depth):
                yield from _rows(lang, words, found, index)

    rows = narrow.mapInArrow(run, "lang string, words int, phrase string, n long, left long, right long")
    summed = rows.groupBy("lang", "words", "phrase").agg(*[F.sum(c).alias(c) for c in ("n", "left", "right")])
    return summed.where((F.col("words") == 1) | (F.col("n") >= least))


def _score(a: Column, l: Column, r: Column) -> Column:
    exact = [c.cast("decimal(16,0)") for c in (a, l, r)]
    whole = F.call_function("div", exact[0] * exact[0] * F.lit(SCALE).cast("decimal(7,0)"), exact[1] * exact[2])
    return whole.cast("long")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``depth`` words.

    A phrase that stands in a longer one, frequent enough itself, in ``inside_percent`` of its occurrences is left out.
    Ties go to the larger a, then to the smaller phrase in UTF-8 order.
    """
    phrases = stored(counted(docs, depth, least), "phrases")
    totals = phrases.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    # parts of a phrase occur at least as often as the phrase
    parts = phrases.where(F.col("n") >= least).select("lang", "phrase", "n")
    found = phrases.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("rest"))
    with_l = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    with_r = with_l.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    scored = with_r.select("lang", "phrase", "a", F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    inner = found.where("words > 2").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    )).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
