"""Vector functions on array columns, and their numpy counterparts for whole batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences, accumulated in double precision in index order."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def same_dimension(a: Column, b: Column) -> Column:
    return F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in dimension"))


def check_dimension(df: DataFrame, column: str, dim: int | None = None) -> int:
    """The one dimension of all vectors; an error if there are several, or another than ``dim``."""
    least, most = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if least is None or least != most or (dim is not None and least != dim):
        raise ValueError(f"vectors of {least} to {most} numbers, expected {dim if dim is not None else 'one dimension'}")
    return least


def centroid(df: DataFrame, column: str) -> DataFrame:
    """One row: the mean vector, from pre-aggregated means by position."""
    by_position = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return by_position.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centroid"))


def score_concentration(distances: Column, k: int) -> Column:
    """Nearest over k-th distance; 1 if the k-th is 0."""
    first, last = F.element_at(distances, 1), F.element_at(distances, k)
    return F.when(last == 0, F.lit(1.0)).otherwise(first / F.when(last == 0, F.lit(1.0)).otherwise(last))


def local_intrinsic_dimension(distances: Column, k: int) -> Column:
    """-(k - 1) / sum of ln(d_i / d_k); 0 if one of the distances is 0, infinite if all are equal."""
    if k < 2:
        raise ValueError("k must be 2 at least")
    near = F.slice(distances, 1, k)
    last = F.element_at(distances, k)
    zero = F.exists(near, lambda d: d == 0)
    logs = F.aggregate(near, F.lit(0.0), lambda s, d: s + F.ln(F.when(zero, F.lit(1.0)).otherwise(d) / F.when(zero, F.lit(1.0)).otherwise(last)))
    return F.when(zero, F.lit(0.0)).when(logs == 0, F.lit(float("inf"))).otherwise(-F.lit(k - 1.0) / F.when(logs == 0, F.lit(1.0)).otherwise(logs))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a float64 matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def distances_between(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Squared distances, accumulated coordinate by coordinate (so equal vectors give 0)."""
    out = np.zeros((len(queries), len(base)))
    for i in range(queries.shape[1] if len(queries) and len(base) else 0):
        d = queries[:, i, None] - base[None, :, i]
        d *= d
        out += d
    return out


def close_pairs(queries: np.ndarray, base: np.ndarray, bound: np.ndarray, k: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, squared distance): all pairs within the query's bound that may be among its k
    nearest of base, and some more; ``apart`` flags pairs that do not count.

    A matrix product tells which pairs those can be, with room for all that rounding can do to it;
    only their distances are accumulated coordinate by coordinate."""
    if not len(queries) or not len(base) or k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    own, other = (queries * queries).sum(axis=1), (base * base).sum(axis=1)
    rough = queries @ base.T
    rough *= -2.0
    rough += own[:, None]
    rough += other
    if apart is not None:
        rough[apart] = np.inf
    room = 16 * (queries.shape[1] + 4) * np.finfo(np.float64).eps * (own + other[np.isfinite(other)].max(initial=0.0))
    limit = bound + room
    free = np.flatnonzero(np.isinf(limit))
    if len(free) and len(base) > k:
        limit[free] = np.partition(rough[free], k - 1, axis=1)[:, k - 1] + 2 * room[free]
    row, col = np.nonzero((rough <= limit[:, None]) & (rough < np.inf))
    d = np.zeros(len(row))
    for i in range(queries.shape[1]):
        step = queries[row, i] - base[col, i]
        step *= step
        d += step
    near = (d <= bound[row]) & (d < np.inf)
    return row[near], col[near], d[near]
