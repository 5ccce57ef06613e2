"""Python steps over Arrow columns, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows that a task holds as Python objects at a time; the rest of its batch stays in Arrow.
SLICE_ROWS = 256


def in_slices(column: pa.Array, make: Callable[[list], pa.Array], out: pa.DataType, rows: int = SLICE_ROWS) -> pa.Array:
    """``make`` over the column's values, slice by slice."""
    parts: Iterator[pa.Array] = (make(column.slice(lo, rows).to_pylist()) for lo in range(0, len(column), rows))
    return pa.concat_arrays([pa.array([], out), *parts])
