"""Model interfaces and deterministic defaults.

Real deployments pass objects with the same methods; they are pickled to the
workers, so they should load their weights lazily.  The defaults need no weights
and give the same result on every run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.batches import in_slices
from quillspark.functions.text import content_tokens, or_empty, overlap_ratio, strip, tokens


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One unit-length float32 row per text."""


class Scorer(Protocol):
    def logits(self, question: Column, text: Column) -> Column:
        """Relevance of each (question, text) row on the logit scale."""


class Generator(Protocol):
    def answer(self, question: Column, context: Column) -> Column: ...


class Judge(Protocol):
    def scores(self, question: Column, truth: Column, context: Column, answer: Column) -> Column:
        """Struct of faithfulness, answer_relevancy, completeness and citation_accuracy."""


class QuestionWriter(Protocol):
    def questions(self, text: Column) -> Column:
        """Array of structs question, answer, intent."""


class Critic(Protocol):
    def review(self, question: Column, answer: Column, text: Column) -> Column:
        """Struct of answerability, correctness, clarity (1 to 5) and reasoning; null when it failed."""


class NegativeWriter(Protocol):
    def question(self, text: Column, legal_type: Column) -> Column:
        """A question the text does not answer; null or empty when none was found."""


class Summarizer(Protocol):
    def summarize(self, previous: str, turns: list[tuple[str, str]]) -> str: ...


#: Tokens a worker remembers at a time.
MAX_SLOTS = 100_000


class _Slots(dict):
    """Token to slot; slots from ``dim`` on count negatively.  Emptied when it grows large."""

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode()).hexdigest()
        slot = int(digest[:8], 16) % self.dim + (0 if digest[8] < "8" else self.dim)
        if len(self) > MAX_SLOTS:
            self.clear()
        self[token] = slot
        return slot


class HashingEmbedder:
    """Signed token-hash counts of the whole text, normalised to unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self._slots = _Slots(dim)

    def __getstate__(self) -> dict:
        """The tokens met so far stay behind."""
        return {"dim": self.dim, "_slots": _Slots(self.dim)}

    def encode(self, texts: list[str]) -> np.ndarray:
        slots, dim = self._slots, self.dim
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            found = [slots[token] for token in re.findall(r"\w+", (text or "").lower())]
            if found:
                counts = np.bincount(found, minlength=2 * dim)
                row[:] = counts[:dim] - counts[dim:]
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0).astype(np.float32)


def embed(c: Column, embedder: Embedder) -> Column:
    """Vector column; the model travels once per Python worker, texts come in Arrow batches."""

    kind = pa.list_(pa.float32())

    def rows(texts: list) -> pa.Array:
        vectors = np.asarray(embedder.encode([t or "" for t in texts]), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()), type=kind)

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield in_slices(texts, rows, kind)

    return encode(c)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


class OverlapScorer:
    """Share of question words found in the text, spread over the logit range -6..2."""

    def logits(self, question: Column, text: Column) -> Column:
        share = overlap_ratio(content_tokens(question), content_tokens(text))
        return F.coalesce(share, F.lit(0.0)) * 8.0 - 6.0


class ExtractiveGenerator:
    """Answers with all context blocks, one blank line between them; stands in for a hosted model."""

    def answer(self, question: Column, context: Column) -> Column:
        return F.concat(or_empty(question), F.lit("\n"), F.replace(or_empty(context), F.lit("\n---\n"), F.lit("\n\n")))


class DigestSummarizer:
    """A fixed-size digest of everything said so far; pure, so a replayed batch gives the same summary."""

    def summarize(self, previous: str, turns: list[tuple[str, str]]) -> str:
        for user, answer in turns:
            previous = hashlib.md5(f"{previous}\n{user} | {answer}".encode()).hexdigest()
        return previous


class OverlapJudge:
    """Scores 1 to 5 by shared words, 0 where there is nothing to compare."""

    def scores(self, question: Column, truth: Column, context: Column, answer: Column) -> Column:
        def share(of: Column, within: Column) -> Column:
            ratio = overlap_ratio(content_tokens(of), content_tokens(within))
            return F.coalesce(F.lit(1.0) + ratio * 4.0, F.lit(0.0))

        return F.struct(
            share(answer, context).alias("faithfulness"),
            share(question, answer).alias("answer_relevancy"),
            share(truth, answer).alias("completeness"),
            share(context, truth).alias("citation_accuracy"),
        )


class SentenceWriter:
    """One definition question per sentence of the text, answered by that sentence; null where there is none."""

    def questions(self, text: Column) -> Column:
        sentences = F.filter(F.transform(F.split(text, r"[.?!\n]+"), strip), lambda x: x != "")
        pairs = F.transform(
            sentences,
            lambda x: F.struct(F.concat(x, F.lit("?")).alias("question"), x.alias("answer"), F.lit("DEFINITION").alias("intent")),
        )
        return F.when(F.size(pairs) > 0, pairs)


class OverlapCritic:
    """Scores 1 to 5 by shared words: question and answer with the text, and the question's length.

    Null (no verdict) where the question has no word at all.
    """

    def review(self, question: Column, answer: Column, text: Column) -> Column:
        def rated(of: Column) -> Column:
            share = overlap_ratio(content_tokens(of), content_tokens(text))
            return F.coalesce(F.floor(share * 4.0 + 1.0), F.lit(1)).cast("int")

        words = F.size(content_tokens(question))
        scores = F.struct(
            rated(question).alias("answerability"),
            rated(or_empty(answer)).alias("correctness"),
            F.least(words + 1, F.lit(5)).cast("int").alias("clarity"),
            F.lit("shared words").alias("reasoning"),
        )
        return F.when(words > 0, scores)


class ElsewhereWriter:
    """Asks for the text's first word in a law of the year 2999, which no text knows; null without a word."""

    def question(self, text: Column, legal_type: Column) -> Column:
        word = F.get(tokens(text), F.lit(0))
        return F.concat(word, F.lit(" ("), or_empty(legal_type), F.lit(", 2999)?"))
