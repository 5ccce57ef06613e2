"""Vector columns: similarity expressions, packing and quantisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; for a pair per row, not for searching."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_to_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def pack(c: Column) -> Column:
    """ARRAY<FLOAT> to little-endian float32 bytes."""

    @F.pandas_udf("binary")
    def to_bytes(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return to_bytes(c)


def unpack(c: Column, dim: int) -> Column:
    """float32 bytes to ARRAY<FLOAT>; a wrong length is an error."""

    @F.pandas_udf("array<float>")
    def to_vector(blobs: pd.Series) -> pd.Series:
        def one(blob):
            if blob is None:
                return None
            if len(blob) != 4 * dim:
                raise ValueError(f"vector of {len(blob)} bytes, expected {4 * dim} (dim={dim})")
            return np.frombuffer(blob, "<f4")

        return blobs.map(one)

    return to_vector(c)


def assert_dim(c: Column, dim: int) -> Column:
    return F.when(F.size(c) == dim, c).otherwise(
        F.raise_error(F.format_string("vector of size %d, expected " + str(dim), F.size(c)))
    )


def quantise(c: Column, bound: Column) -> Column:
    """Symmetric int8 code: clip to ±bound, scale to ±127."""

    def code(x):
        scaled = F.round(x.cast("double") / bound * 127.0)
        return F.least(F.greatest(scaled, F.lit(-127.0)), F.lit(127.0)).cast("byte")

    return F.transform(c, code)


def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Unit-length mean vector per key: partial sums per component, so no group is collected."""
    parts = (
        df.select(key, F.posexplode(vec).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    # one row per key and component here: the list is bounded by the dimension
    means = parts.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean")
    )
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return means.select(
        key, F.transform("mean", lambda x: (x / norm).cast("float")).alias("vector")
    )
