"""Single-request facade over the batch plans.

A request is a batch of one; there is no server here.  Requests are checked before
a plan is built.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import SparkSession

from quillspark import settings as S
from quillspark.plans.answer import Engine, answer_batch, answers
from quillspark.plans.retrieve import format_sources


@dataclass(frozen=True)
class Request:
    message: str
    top_k: int = S.DEFAULT_TOP_K
    include_content: bool = False

    def __post_init__(self) -> None:
        low, high = S.MESSAGE_CHARS_RANGE
        if not low <= len(self.message) <= high or not self.message.strip():
            raise ValueError(f"message must have {low} to {high} characters")
        low, high = S.TOP_K_RANGE
        if not low <= self.top_k <= high:
            raise ValueError(f"top_k must lie between {low} and {high}")


def respond(spark: SparkSession, engine: Engine, request: Request) -> dict:
    """Answer, sources and routing decision of one request."""
    started = time.perf_counter()
    asked = spark.createDataFrame([(0, request.message.strip())], "qid long, question string")
    decisions, docs = answer_batch(engine, asked, request.top_k)
    sources = [r.asDict() for r in format_sources(docs, request.include_content).orderBy("rank").collect()]
    row = answers(engine, decisions, docs).first()
    return {
        "intent": row["intent"],
        "confidence": row["confidence"],
        "used_web": row["used_web"],
        "answer": row["answer"],
        "sources": sources,
        "retrieval_ms": round((time.perf_counter() - started) * 1000, 1),
    }
