"""Vectors as whole numbers, for the operators that work exactly on them."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(v: Column) -> Column:
    """The vector is there and none of its components is NULL, NaN or infinite."""
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))


def whole(v: Column, scale: int, shift: int = 0) -> Column:
    """``floor(scale * c) + shift`` of every component, computed on doubles; as array<long>."""
    return F.transform(v.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))


def lengths(rows: DataFrame, x: str) -> list[int]:
    """The vector lengths that occur (a table has one as a rule; each is a collection of its own)."""
    return sorted(r[0] for r in rows.select(F.size(x).alias("n")).distinct().collect())


def per_length(rows: DataFrame, x: str, work: Callable[[DataFrame, int], DataFrame]) -> DataFrame | None:
    """The union of ``work`` over the rows of each vector length; None if there are no rows."""
    parts = [work(rows.where(F.size(x) == n), n) for n in lengths(rows, x)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column without NULLs, all lists of ``width`` numbers, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
