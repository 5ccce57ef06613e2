"""Stable identifiers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip


def _id63(name: str) -> int:
    """First eight bytes of BLAKE2b as a non-negative 63-bit integer."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") & (2**63 - 1)


def _ids(names: Column) -> Column:
    @F.pandas_udf("long")
    def hashed(batch: pd.Series) -> pd.Series:
        return batch.map(_id63)

    return hashed(names)


# The name formats of parent and child identifiers.
def parent_id(doc_id: Column, parent_index: Column) -> Column:
    return _ids(F.format_string("%s:parent:%s", doc_id.cast("string"), parent_index.cast("string")))


def child_id(doc_id: Column, parent_index: Column, child_index: Column) -> Column:
    return _ids(
        F.format_string(
            "%s:child:%s:%s",
            doc_id.cast("string"), parent_index.cast("string"), child_index.cast("string"),
        )
    )


def web_id(url: Column) -> Column:
    return F.concat(F.lit("web_"), F.left(F.md5(url), F.lit(8)))


def cache_key(query: Column) -> Column:
    return F.md5(F.lower(strip(query)))


def conversation_id(messages: Column) -> Column:
    """Key of a request without explicit id: MD5 over role and content of all prior messages.

    ``messages`` is an array of structs with ``role`` and ``content``; the last
    entry is the current question.
    """
    prior = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    joined = F.array_join(F.transform(prior, lambda m: F.concat(m["role"], m["content"])), "")
    return F.when(joined == "", F.lit("default")).otherwise(F.md5(joined))


def numeric_or_minus_one(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(-1).cast("long"))


def hash_order(seed: int, *keys: Column) -> Column:
    """Repeatable pseudo-random order, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
