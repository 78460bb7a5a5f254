"""Vectors as exact integers, and sums of them by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Components of at most this size: the squared distance of two vectors of 64 then fits in a long.
LARGEST = 1 << 26


def whole(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vector: Column) -> Column:
    """Its components as integers; one beyond LARGEST is an error, as sums of squares would no longer be exact."""
    def one(x):
        v = F.floor(x.cast("double") * SCALE)
        return F.when(F.abs(x.cast("double")) * SCALE > LARGEST, F.raise_error(F.lit("a component is too large for exact distances")).cast("long")).otherwise(v)

    return F.transform(vector, one)


def matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The batch's vectors as rows; all have ``dims`` components."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def totals(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """By group the sum of each component, and the count in a last column."""
    out = np.zeros((groups, x.shape[1] + 1), np.int64)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    if len(first):
        out[group[order[first]], :-1] = np.add.reduceat(x[order], first)
        out[:, -1] = np.bincount(group, minlength=groups)
    return out


def means(partial: DataFrame, groups: int, dims: int, old: np.ndarray) -> np.ndarray:
    """From rows (at, total) of flattened ``totals``: floor(sum / count) of each group, the old vector where it is empty. groups * (dims + 1) numbers come to the driver, whatever the input."""
    got = np.zeros(groups * (dims + 1), np.int64)
    for r in partial.groupBy("at").agg(F.sum("total").alias("total")).collect():
        got[r["at"]] = r["total"]
    got = got.reshape(groups, dims + 1)
    used = got[:, -1] > 0
    new = old.copy()
    new[used] = got[used, :-1] // got[used, -1:]  # integer division rounds down
    return new


def total_rows(sums: np.ndarray) -> pa.RecordBatch:
    """The sums that aren't zero, as rows (at, total)."""
    flat = sums.ravel()
    at = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(flat[at])], ["at", "total"])
