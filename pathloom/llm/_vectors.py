"""Vectors as whole numbers, shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """A vector that is there, with entries, none of them null or non-finite."""
    v = vec.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def width(vectors: DataFrame, vec_col: str) -> int:
    """The commonest length of the vectors, the greater on a tie; zero where there are none."""
    top = vectors.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def whole(column: pa.Array, d: int, scale: int, most: int) -> np.ndarray:
    """``floor(scale * x)`` of the entries of a list column, a row each; numbers beyond ``most`` stay there."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(flat * scale), -most, most).astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact: in floating point where every sum fits its mantissa."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
