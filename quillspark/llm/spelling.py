"""Spelling variants: words one edit apart, found by pivotal grams.

Words are maximal runs of the letters a-z and U+00C0 to U+00FF, A-Z lower-cased.  One occurrence in DROPPED,
chosen by the crc32 of doc_id and run, loses a letter.  Of the results, those of at least MIN_CHARS code points
and MIN_COUNT occurrences are compared; two words are near if one letter inserted, deleted or replaced turns
one into the other.

1. Bigrams of the words are ordered by frequency.  The alphabet has 90 letters, so there are at most 8,100.
2. A word's prefix is its three rarest bigrams (and their repetitions); its pivots are two disjoint ones of
   least total frequency, chosen by dynamic programming.  An edit spares one of two disjoint pivots.  Of two
   near words, that whose prefix ends with the more frequent bigram has each spared pivot of the other in its
   prefix.
3. A spared pivot stands at most one place away, and what lies on one side of it is equal.  On the other side
   lies the edit, which leaves one half of that rest equal.  So pivots are indexed with the whole text of one
   side and either half of the other; the first pivot by its left side, the second by its right one.  Prefix
   bigrams are looked up with the same, for each length the other rest may have.
4. What meets is verified by edit distance.
5. The form of a word is its most frequent near word (ties: the smallest) of at least FORM_TIMES its count;
   roots follow forms by pointer doubling, as counts double each step.

Null texts have no words; a null doc_id is written as nothing before the colon.  Repeated rows count each
time.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import stored

DROPPED = 97
MIN_CHARS, MIN_COUNT, FORM_TIMES = 5, 3, 2
#: Words longer than this are not remembered; words and their bytes held before counts are passed on.
REMEMBERED_CHARS, HELD_WORDS = 64, 1 << 19
#: Bytes of text whose words are counted at a time.
COUNTED_BYTES = 4 << 20
PREFIX, PIVOTS = 3, 2
# the letters as Latin-1 bytes; everything else parts words
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_ZEROS = bytes(REMEMBERED_CHARS * 2)


class _Known(dict):
    """Numbers of words, with the crc32 and UTF-8 length of each; number 0 stands for long words."""

    def __init__(self) -> None:
        super().__init__()
        self.crc, self.bytes = array("I", [0]), array("I", [0])

    def __missing__(self, word: bytes) -> int:
        if len(word) > REMEMBERED_CHARS:
            return 0
        text = word.decode("latin-1").encode()
        self[word] = number = len(self.crc)
        self.crc.append(zlib.crc32(text))
        self.bytes.append(len(text))
        return number


def shortened(word: bytes, mark: int) -> bytes:
    """The word as counted: without a letter when its mark says so."""
    if mark % DROPPED:
        return word
    k = mark % len(word)
    return word[:k] + word[k + 1 :]


class _Counts:
    """Counts of the words of many texts."""

    def __init__(self, least: int):
        self.least = least
        self.emptied()

    def emptied(self) -> None:
        self.known, self.counts, self.others = _Known(), np.zeros(1, np.int64), Counter()

    def add(self, starts: list[bytes], texts: list[str | None]) -> None:
        """``starts`` has what is put before each word of a text to mark it."""
        known, split = self.known, [(t or "").encode("latin-1", "replace").translate(_LETTERS).split() for t in texts]
        number = np.fromiter((known[w] for words in split for w in words), np.int64)
        if not len(number):
            return
        # crc32 is affine: the crc of start and word is that of the word, moved by what the start does to as many zero bytes
        sizes = np.array(known.bytes, np.int64)
        zeros = [(_ZEROS[:k], zlib.crc32(_ZEROS[:k])) for k in range(int(sizes.max()) + 1)]
        from_start = np.array([[zlib.crc32(z, c) ^ nothing for z, nothing in zeros] for c in map(zlib.crc32, starts)], np.uint32)
        text = np.repeat(np.arange(len(split)), [len(words) for words in split])
        mark = np.array(known.crc, np.uint32)[number] ^ from_start[text, sizes[number]]
        found = np.bincount(number, minlength=len(known.crc))
        found[: len(self.counts)] += self.counts
        chosen = np.flatnonzero((mark % np.uint32(DROPPED) == 0) | (number == 0))
        first = np.concatenate([[0], np.cumsum([len(words) for words in split])])
        for at in chosen.tolist():
            word = split[text[at]][at - first[text[at]]]
            sign = int(mark[at]) if number[at] else zlib.crc32(word.decode("latin-1").encode(), zlib.crc32(starts[text[at]]))
            found[number[at]] -= 1
            self.others[shortened(word, sign)] += 1
        self.counts = found

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(word, n) of the words of at least ``least`` letters; forgets them."""
        counts = self.counts.tolist()
        found = [(w.decode("latin-1"), counts[k]) for w, k in self.known.items() if len(w) >= self.least and counts[k]]
        found += [(w.decode("latin-1"), n) for w, n in self.others.items() if len(w) >= self.least]
        self.emptied()
        for lo in range(0, len(found), 1 << 16):
            words, n = zip(*found[lo : lo + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of (doc_id, text) with enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(min_chars)
        for batch in batches:
            starts = [b":" if d is None else b"%d:" % d for d in batch.column("doc_id").to_pylist()]
            text_column, lo, size = batch.column("text"), 0, 0
            lengths = pc.fill_null(pc.binary_length(text_column), 0).to_pylist()
            for hi, length in enumerate(lengths, 1):
                size += length
                if size >= COUNTED_BYTES or hi == len(lengths):
                    counts.add(starts[lo:hi], text_column.slice(lo, hi - lo).to_pylist())
                    lo, size = hi, 0
                    if len(counts.known) + len(counts.others) > HELD_WORDS:
                        yield from counts.rows()
        yield from counts.rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _bigrams(word: bytes) -> list[bytes]:
    return [word[k : k + 2] for k in range(len(word) - 1)]


def gram_counts(words: DataFrame) -> dict[bytes, int]:
    """Occurrences of each bigram in the words; at most 8,100 bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                found.update(_bigrams(word.encode("latin-1")))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {bytes(r["gram"]): r["n"] for r in rows.collect()}


class Grams:
    """Prefixes and pivots under one order of bigrams: rarest first, ties by bytes."""

    def __init__(self, counts: dict[bytes, int]):
        self.counts = counts
        self.rank = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def prefix(self, word: bytes) -> tuple[list[int], list[int], int]:
        """(places of the three rarest bigrams, places of all bigrams up to the last of these, rank of that last one)."""
        ranked = sorted((self.rank[g], k) for k, g in enumerate(_bigrams(word)))
        last = ranked[PREFIX - 1][0]
        return [k for _, k in ranked[:PREFIX]], [k for rank, k in ranked if rank <= last], last

    def pivots(self, word: bytes, places: list[int]) -> tuple[int, ...]:
        """Two disjoint ones of these bigrams of least total count; least[i] is the best choice of i among those so far."""
        counts, places = self.counts, sorted(places)
        best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * PIVOTS]
        for j, place in enumerate(places):
            apart = sum(p <= place - 2 for p in places[:j])
            row: list = [(0, ())]
            for i in range(1, PIVOTS + 1):
                taken = best[apart][i - 1] and (best[apart][i - 1][0] + counts[word[place : place + 2]], (*best[apart][i - 1][1], place))
                row.append(min((x for x in (best[j][i], taken) if x), default=None))
            best.append(row)
        return best[-1][PIVOTS][1]


def _key(kind: bytes, equal: bytes, half: bytes) -> int:
    return xxhash.xxh64_intdigest(b"%b%b %b" % (kind, equal, half)) - (1 << 63)


def _sides(word: bytes, first: list[int], second: list[int]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(side, equal part, rest) of bigrams at these places; the right side is read backwards."""
    for place in first:
        yield b"L", word[: place + 2], word[place + 2 :]
    backwards = word[::-1]
    for place in second:
        k = len(word) - place
        yield b"R", backwards[:k], backwards[k:]


def indexed(word: bytes, grams: Grams) -> tuple[int, list[int]]:
    """(rank of the last prefix bigram, keys) of a word's pivots."""
    places, _, last = grams.prefix(word)
    one, two = grams.pivots(word, places)
    keys = []
    for side, equal, rest in _sides(word, [one], [two]):
        half = len(rest) // 2
        keys += [_key(side + b"a", equal, rest[:half]), _key(side + b"b", equal, rest[half:])]
    return last, keys


def looked_up(word: bytes, grams: Grams) -> tuple[int, list[int]]:
    """(rank of the last prefix bigram, keys) under which a near word's pivots may be found."""
    _, places, last = grams.prefix(word)
    keys = set()
    for side, equal, rest in _sides(word, places, places):
        for length in range(max(0, len(rest) - 1), len(rest) + 2):
            half = length // 2
            if half <= len(rest):
                keys.add(_key(side + b"a", equal, rest[:half]))
            if length - half <= len(rest):
                keys.add(_key(side + b"b", equal, rest[len(rest) - (length - half) :]))
    return last, list(keys)


def _shuffled(side: DataFrame) -> DataFrame:
    """A join's side that grows with the words: both sides are shuffled and merged, never broadcast.

    Spark takes what a Python function gives to be as large as what it was given (here a word has 4 keys, or some 20), and
    a stored table to be as large as its compressed files; below its threshold it may send millions of rows through the driver.
    """
    return side.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) with a < b of all near words of (word, n), each pair once; words of 4 letters or more."""
    grams = words.sparkSession.sparkContext.broadcast(Grams(gram_counts(words)))

    def keyed(keys_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1 << 12):
                    part = batch.slice(lo, 1 << 12)
                    found = [keys_of(w.encode("latin-1"), grams.value) for w in part.column("word").to_pylist()]
                    at = pa.array(np.repeat(np.arange(len(found)), [len(keys) for _, keys in found]))
                    last = pa.array([last for last, _ in found], pa.int32()).take(at)
                    keys = pa.array([k for _, keys in found for k in keys], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys, last, part.column("word").take(at), part.column("n").take(at)], names=["key", "last", "word", "n"])

        return words.select("word", "n").mapInArrow(run, "key long, last int, word string, n long")

    i, p = keyed(indexed).alias("i"), _shuffled(keyed(looked_up)).alias("p")
    met = i.join(p, (F.col("i.key") == F.col("p.key")) & (F.col("i.last") <= F.col("p.last")) & (F.abs(F.length("i.word") - F.length("p.word")) <= 1) & (F.levenshtein("i.word", "p.word", 1) == 1))
    first = F.col("i.word") < F.col("p.word")
    sides = [F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name) for x, y, c, name in (("i", "p", "word", "a"), ("i", "p", "n", "n_a"), ("p", "i", "word", "b"), ("p", "i", "n", "n_b"))]
    return met.select(*sides).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, from (word, form)."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(_shuffled(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of (doc_id, text)."""
    words = stored(word_counts(docs, min_chars, min_count), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.struct((-F.col("n_b")).alias("minus_n"), F.col("b").alias("near")).alias("other")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.struct((-F.col("n_a")).alias("minus_n"), F.col("a").alias("near")).alias("other")),
    )).alias("x")).select("x.*")
    likely = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    more = -F.col("best.minus_n") >= FORM_TIMES * F.col("n")
    near = stored(likely.select("word", "n_near", F.when(more, F.col("best.near")).alias("form"), F.when(more, -F.col("best.minus_n")).alias("form_n")), "spelling-near")
    roots = _roots(near.where("form is not null").select("word", "form"))
    return words.join(_shuffled(near), "word", "left").join(_shuffled(roots), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )
