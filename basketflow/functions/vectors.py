"""Vector arithmetic: column expressions for single pairs, NumPy helpers for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8
SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = NORM_FLOOR) -> Column:
    """The vector over its length, with the length floored."""
    # As an argument of zip_with the length is computed once per vector, not once per coordinate.
    lengths = F.array_repeat(F.greatest(norm(a), F.lit(floor)), F.size(a))
    return F.zip_with(a, lengths, lambda x, length: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def squared_distance(a: Column, b: Column, shift: float = 0.0) -> Column:
    """Sum of squared differences; ``shift`` is added to each difference first."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double") + shift, F.lit(2.0)))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def distance(a: Column, b: Column, shift: float = 0.0) -> Column:
    return F.sqrt(squared_distance(a, b, shift))


def cosine_from_distance(squared: Column) -> Column:
    """Cosine of two unit vectors from their squared distance."""
    return F.lit(1.0) - squared / 2.0


# ---- NumPy side, for use inside Arrow batches -------------------------------------------------

def flat(column):
    """One Arrow array out of a possibly chunked one."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def as_matrix(column) -> np.ndarray:
    """A list<float> Arrow column as a (rows, dim) float64 matrix."""
    column = flat(column)
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(rows, -1) if rows else np.zeros((0, 0))


def bounds(column) -> np.ndarray:
    """Row boundaries of a list column, counted from its first element."""
    offsets = flat(column).offsets.to_numpy()
    return offsets - offsets[0]


def unit_rows(matrix: np.ndarray, floor: float = NORM_FLOOR) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.maximum(lengths, floor)


def list_column(matrix: np.ndarray) -> pa.Array:
    """A (rows, dim) matrix as a list<double> Arrow column."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(0, rows * dim + 1, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))
