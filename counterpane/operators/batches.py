"""Moving series between Arrow batches and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long rows as `(n, d)` doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) \
        else table.column(name).to_numpy()


def cubes(table: pa.Table | pa.RecordBatch, name: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and `(n, T, C)` values, one part per series length and channel count."""
    size, n_ch = column(table, "t_len"), column(table, "n_ch")
    shapes = size.astype(np.int64) * (1 << 31) + n_ch
    kinds = np.unique(shapes)
    for kind in kinds:
        where = np.flatnonzero(shapes == kind)
        part = table.column(name) if len(kinds) == 1 else table.column(name).take(pa.array(where))
        yield where, matrix(part).reshape(len(where), int(size[where[0]]), int(n_ch[where[0]]))


def list_array(values: np.ndarray) -> pa.Array:
    """`(n, d)` doubles as a list column."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d),
                                    pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))
