"""Language identification by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary.  Each language has a probability for every piece; the
probability of a word (a run of letters with a word-start mark, lower-cased) is the sum over all ways to
cut it into pieces, found by the forward algorithm.  Piece probabilities are expected counts under that
sum (forward-backward over the counts of all distinct words of all labelled texts), refined in a few
rounds.  A text's language is the one with the highest total log-probability of its words, ties by name;
the score is its share among the languages when all are equally likely beforehand.

Texts that are null or have no letter, and all texts when nothing was learned, get ``und`` and score 0.
Runs of more than 32 letters are scored in parts of 32.  Repeated rows are scored each; no column but the
text takes part in a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillspark.llm.common import lean, slices
from quillspark.session import stored

UNKNOWN = "und"
MARK = "▁"
LONGEST_WORD = 32
ROUNDS = 2
#: Added to every expected count.
SMOOTHING = 0.01
SLICE_BYTES = 8 << 20
#: Occurrences whose log-probabilities are added at once.
SUMMED = 1 << 16
_SLOT_BITS = 19
_FACTORS = [0xC2B2AE3D27D4EB4F + 2 * k * 0x165667B19E3779F9 & (1 << 64) - 1 for k in range(200)]


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased tokens between ASCII spaces, the token number of each occurrence, and where each text starts.

    Every text has at least one occurrence, if only of the empty token.
    """
    split = pc.split_pattern(pc.utf8_lower(pc.fill_null(texts, "")), pattern=" ")
    coded = pc.dictionary_encode(split.flatten())
    starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), starts.astype(np.int64)


def summed(logs: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of each text's rows of ``logs``, for SUMMED occurrences at a time."""
    ends = np.append(starts[1:], len(at))
    parts = [np.add.reduceat(logs[at[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo]) for lo, hi in slices((ends - starts).tolist(), SUMMED)]
    return np.concatenate(parts)


def words_of(token: str) -> list[str]:
    """Runs of letters, in parts of at most LONGEST_WORD, with the start mark."""
    if token.isalpha() and len(token) <= LONGEST_WORD:
        return [MARK + token]
    runs = "".join([c if c.isalpha() else " " for c in token]).split()
    return [MARK + w[k : k + LONGEST_WORD] for w in runs for k in range(0, len(w), LONGEST_WORD)]


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary that can occur in words."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p.replace(MARK, "a").isalpha() and MARK not in p[1:] and len(p) <= LONGEST_WORD + 1})


class Lattice:
    """Piece numbers of all substrings of many words at once, by rolling hashes and a table without probing."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces) + 1
        self.longest = max((len(p) for p in pieces), default=1)
        #: characters of each table row
        self.sizes = np.array([0, *map(len, pieces), 1])
        base = np.uint64(0x9E3779B97F4A7C15)
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for n in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == n]
            hashes[at] = self._codes([pieces[i] for i in at], n)
        self.key = np.concatenate([[np.uint64(0)], hashes])
        self.shift = np.uint64(64 - _SLOT_BITS)
        self.first = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        slots = ((hashes * base) >> self.shift).astype(np.int64)
        order = np.arange(len(pieces))[::-1]
        self.first[slots[order]] = order + 1
        rest = np.flatnonzero(self.first[slots] != np.arange(len(pieces)) + 1)
        self.second = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        for factor in _FACTORS:
            self.factor = np.uint64(factor)
            again = ((hashes[rest] * self.factor) >> self.shift).astype(np.int64)
            if len(set(again.tolist())) == len(rest):
                break
        else:
            raise ValueError("pieces share both slots of the table")
        self.second[again] = rest + 1

    @staticmethod
    def _points(words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), n)

    def _codes(self, words: list[str], n: int) -> np.ndarray:
        points, h = self._points(words, n), np.zeros(len(words), dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x5851F42D4C957F2D) + points[:, k].astype(np.uint64) + np.uint64(1)
        return h

    def arcs(self, words: list[str], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, piece number of each) by ascending end; ``words`` all have n characters."""
        points = self._points(words, n).astype(np.uint64) + np.uint64(1)
        for end in range(1, n + 1):
            # hashes of the substrings that end here, by ever earlier starts
            h, power = np.zeros(len(words), dtype=np.uint64), np.ones(1, dtype=np.uint64)
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                h = h + points[:, start] * power
                power = power * np.uint64(0x5851F42D4C957F2D)
                number = self.first[((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)]
                at = np.flatnonzero(number)
                same = self.key[number[at]] == h[at]
                # a slot that another piece holds: the piece may be in the second table
                other = at[~same]
                numbers, at = number[at[same]], at[same]
                if len(other):
                    found = self.second[((h[other] * self.factor) >> self.shift).astype(np.int64)]
                    same = (found > 0) & (self.key[found] == h[other])
                    numbers, at = np.concatenate([numbers, found[same]]), np.concatenate([at, other[same]])
                if end - start == 1 and len(at) < len(words):
                    rest = np.setdiff1d(np.arange(len(words)), at)
                    numbers, at = np.concatenate([numbers, np.full(len(rest), self.unknown, dtype=numbers.dtype)]), np.concatenate([at, rest])
                if len(at):
                    yield start, end, at, numbers

    def by_length(self, words: list[str], languages: int = 1) -> Iterator[tuple[np.ndarray, list[str], int]]:
        most = max(256, 20_000 // languages)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for lo in range(0, len(at), most):
                some = at[lo : lo + most]
                yield some, [words[i] for i in some], int(n)

    def scaled(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table with each piece multiplied by a factor per character, log of the factor), by language.

        The factor is one over the root of the least probability, so that sums over words of up to
        LONGEST_WORD + 1 characters stay between 1e-308 and 1e308 while probabilities are above 1e-18.
        """
        log_factor = -np.log(np.where(table[1:] > 0, table[1:], np.inf).min(axis=0)) / 2
        return table * np.exp(self.sizes[:, None] * log_factor), log_factor

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """(words, languages) log of the sum over all segmentations; table: (pieces + 2, languages), row 0 zero."""
        out = np.empty((len(words), table.shape[1]))
        table, log_factor = self.scaled(table)
        for at, some, n in self.by_length(words, table.shape[1]):
            forward = np.zeros((n + 1, len(some), table.shape[1]))
            forward[0] = 1
            for start, end, rows, number in self.arcs(some, n):
                forward[end, rows] += forward[start, rows] * table[number]
            out[at] = np.log(forward[n]) - n * log_factor
        return out

    def expected(self, words: list[str], counts: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, under one language's probabilities."""
        total = np.zeros(len(column))
        # the factors cancel out
        column = self.scaled(column[:, None])[0][:, 0]
        for at, some, n in self.by_length(words):
            arcs = list(self.arcs(some, n))
            forward, backward = np.zeros((n + 1, len(some))), np.zeros((n + 1, len(some)))
            forward[0] = backward[n] = 1
            for start, end, rows, number in arcs:
                forward[end, rows] += forward[start, rows] * column[number]
            for start, end, rows, number in reversed(arcs):
                backward[start, rows] += backward[end, rows] * column[number]
            weight = counts[at] / forward[n]
            for start, end, rows, number in arcs:
                total += np.bincount(number, weights=forward[start, rows] * column[number] * backward[end, rows] * weight[rows], minlength=len(column))
        total[0] = 0
        return total


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes.tolist(), SLICE_BYTES):
                tokens, at, starts = tokens_of(batch.column(0).slice(lo, hi - lo))
                coded = pc.dictionary_encode(batch.column(1).slice(lo, hi - lo))
                of = np.repeat(coded.indices.to_numpy(), np.diff([*starts, len(at)]))
                for k, lang in enumerate(coded.dictionary.to_pylist()):
                    n, counted = np.bincount(at[of == k], minlength=len(tokens)), Counter()
                    for t in np.flatnonzero(n):
                        for w in words_of(tokens[t]):
                            counted[w] += int(n[t])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["lang", "word", "n"])

    counted = labelled.select("text", "lang").mapInArrow(lean(run), "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Piece probabilities per language; its size is that of the vocabulary times the languages."""

    def __init__(self, pieces: list[str], languages: list[str], table: np.ndarray):
        self.pieces, self.languages, self.table = pieces, languages, table


def fitted(labelled: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Model of all labelled rows (text, lang); rows without either are left out."""
    counts = stored(word_counts(labelled.where("text is not null and lang is not null")), "word-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    width = len(pieces) + 2
    start = np.full(width, 1 / width)
    start[0] = 0
    table = np.repeat(start[:, None], max(1, len(languages)), axis=1)
    for _ in range(rounds if languages else 0):
        sent = labelled.sparkSession.sparkContext.broadcast((pieces, languages, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, names, now = sent.value
            lattice, sums = Lattice(known), np.zeros((len(names), width))
            for batch in batches:
                langs, words, n = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k, name in enumerate(names):
                    at = np.flatnonzero(langs == name)
                    if len(at):
                        sums[k] += lattice.expected([words[i] for i in at], n[at].astype(float), now[:, k])
            k, piece = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[k, piece])], names=["k", "piece", "n"])

        # one row per language and piece, whatever the corpus
        found = counts.mapInArrow(lean(run), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()
        table = np.full((width, len(languages)), SMOOTHING)
        table[0] = 0
        np.add.at(table, (found.column("piece").to_numpy(), found.column("k").to_numpy()), found.column("n").to_numpy())
        table /= table.sum(axis=0)
    return Model(pieces, languages, table)


def predicted(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, in columns of these names, for every row.

    docs must have no columns of these names.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.table))
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    spot = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, languages, table = sent.value
        lattice = Lattice(pieces)
        for batch in batches:
            texts, n = batch.column(spot), batch.num_rows
            found, scores = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for lo, hi in slices(sizes, SLICE_BYTES) if languages else ():
                tokens, at, starts = tokens_of(texts.slice(lo, hi - lo))
                numbers: dict[str, int] = {}
                pairs = [(t, numbers.setdefault(w, len(numbers))) for t, token in enumerate(tokens) for w in words_of(token)]
                if not pairs:
                    continue
                of, word = np.array(pairs).T
                logs = np.zeros((len(tokens), len(languages)))
                np.add.at(logs, of, lattice.log_probabilities(list(numbers), table)[word])
                totals = summed(logs, at, starts)
                some = np.flatnonzero(totals[:, 0] < 0)  # texts with a letter
                found[lo + some] = np.array(languages, dtype=object)[totals[some].argmax(axis=1)]
                scores[lo + some] = 1 / np.exp(totals[some] - totals[some].max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def learned(docs: DataFrame, path: str) -> Model:
    """Model of the rows that are not held out."""
    return fitted(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), vocabulary_pieces(path))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    named = predicted(docs.select(F.col("doc_id"), "text"), model).drop("text")
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
