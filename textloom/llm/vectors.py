"""Vectors as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(vector: str) -> Column:
    """Neither null itself nor with null, NaN or infinite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def dimension(vectors: DataFrame, vector: str) -> int:
    return int(vectors.agg(F.max(F.size(vector))).first()[0] or 0)


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """One row of doubles for each list; shorter lists are continued with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def best(found: DataFrame, k: int, best_first: Column) -> DataFrame:
    """The k best of each query_id with their rank; ties go to the smaller vec_id.

    ``found`` holds at most some multiples of k rows for a query and place.
    """
    order = Window.partitionBy("query_id").orderBy(best_first, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of doubles that hold whole numbers, as longs.

    Exact at every size: by doubles or longs where no sum can leave their range, else by Python's
    integers. A product beyond the range of a long is given as the nearest long.
    """
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * float(max(1, q.shape[1]))
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    bound = (1 << 63) - 1
    rows = [[int(v) for v in row] for row in x.tolist()]
    out = [[max(-bound - 1, min(bound, sum(a * b for a, b in zip(one, row, strict=True)))) for row in rows] for one in ([int(v) for v in r] for r in q.tolist())]
    return np.array(out, np.int64).reshape(len(q), len(x))


def paired_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As ``integer_products``, of each row of ``q`` with the same row of ``x``."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * float(max(1, q.shape[1]))
    if most < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([integer_products(a[None, :], b[None, :])[0, 0] for a, b in zip(q, x, strict=True)], np.int64).reshape(len(q))
