"""Vectors of an Arrow batch, and which of them take part in comparisons."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)


def usual_length(rows: DataFrame, column: str) -> int:
    """The most frequent number of components (the larger one of equals); 0 without rows. Vectors of another length have no cosine with these."""
    found = rows.groupBy(F.size(column).alias("n")).count().collect()
    return max(found, key=lambda r: (r["count"], r.n)).n if found else 0


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, in double precision."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components would leave the range
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def sample_units(rows: DataFrame, id_col: str, column: str, most: int, total: int, seed: int = 7) -> np.ndarray:
    """Unit vectors of a seeded sample of about `most` rows; all, if there are fewer."""
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 16) < min(1.0, most / max(1, total)) * 2.0**48)
    found = drawn.orderBy(id_col).select(column).toArrow().column(column).combine_chunks()
    return unit(matrix(found)) if len(found) else np.zeros((0, 0))


def main_axes(x: np.ndarray) -> np.ndarray:
    """Orthonormal axes (rows) of the space of the rows, those of the largest spread first."""
    return np.linalg.eigh(x.T @ x)[1].T[::-1]
