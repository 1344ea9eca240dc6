"""Which rows of a table of vectors take part, and their vectors as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INFINITE = float("inf")


def finite(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    each = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < _INFINITE), F.lit(False)))
    return F.coalesce(each, F.lit(False))


def taking_part(df: DataFrame, vector: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """(rows with a finite vector of full length, that length). Full is the
    greatest length of a finite vector; a shorter vector counts as one with
    null entries."""
    kept = df.where(finite(vector) if condition is None else finite(vector) & condition)
    length = kept.agg(F.max(F.size(vector))).first()[0] or 0
    return kept.where(F.size(vector) == length), length


def matrix(column: pa.Array, length: int, kind=np.float64) -> np.ndarray:
    """A column of full-length vectors as rows of an array."""
    values = column.flatten()
    return np.asarray(values).astype(kind, copy=False).reshape(len(column), length)
