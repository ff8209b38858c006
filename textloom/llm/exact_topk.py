"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz.

Vectors are dealt by descending length into cells of bounded size. A rotation is found once: the
matrix of products of components is summed over all vectors by a grouped aggregation and its
singular vectors (eigenvectors of a symmetric matrix) turn the space so that the first components
carry most of the length. A block of queries meets each cell; within the cell vectors come in
descending length, and a query leaves out

* all further vectors as soon as its length times theirs is below its k-th best score;
* every vector whose partial sum over the first rotated components plus the product of the lengths
  of both remainders (Cauchy-Schwarz) is below it.

What remains gets its exact product. The cell of the longest vectors is searched first and its k-th
best scores are the thresholds all other cells start from; a block of queries is not sent to a cell
of which even the longest vector times the block's longest query is below them all. Cells give at most k rows for a query,
so the final ranking is over a bounded number of rows per cell. The number of pairs of blocks grows
with queries times vectors, as exact search must; nothing else does.

* vectors null or with null or non-finite components take no part; shorter vectors count as
  continued with zeros, empty ones as zero;
* zero vectors take part, with score 0; fewer than k candidates: all are given;
* ties in score go to the smaller id; equal vectors are candidates each; rows with one id are one
  query (of the first of them by their vectors) and never candidates of that query;
* components of any size: products are exact (Python's integers where longs do not reach), and a score
  beyond the range of a long counts as the nearest long;
* empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.vectors import best, dimension, finite, integer_products, matrix, paired_products
from textloom.session import stored

#: Vectors in a cell, and queries in a block, about.
CELL, QUERIES = 8192, 1024
#: Vectors that are held against a block of queries at once.
STEP = 512
#: Share of the rotated components in a partial sum.
HEAD = 0.5


def search(ids, q, floor, names, x, rotation, k: int):
    """The k best of one block of vectors, sorted by descending length, for each query of a block.

    ``floor``: scores a query has reached elsewhere. Returns (query place, vector place, score),
    best first for each query.
    """
    head = max(1, int(q.shape[1] * HEAD))
    qr, xr = q @ rotation, x @ rotation
    q_len, x_len = np.linalg.norm(qr, axis=1), np.linalg.norm(xr, axis=1)
    q_rest, x_rest = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(xr[:, head:], axis=1)
    at, of, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    floor = floor.copy()
    for low in range(0, len(x), STEP):
        part = slice(low, low + STEP)
        slack = 1e-9 * q_len * x_len[part].max(initial=0) + 1e-6  # of the rotation's rounding
        live = np.flatnonzero(q_len * x_len[part].max(initial=0) + slack >= floor)
        if not len(live):
            continue
        bound = qr[live, :head] @ xr[part, :head].T + q_rest[live, None] * x_rest[part][None, :] + slack[live, None]
        maybe = (bound >= floor[live, None]) & (ids[live, None] != names[part][None, :])
        if maybe.sum() * 4 > maybe.size:
            a, b = np.nonzero(maybe)
            values = integer_products(q[live], x[part])[a, b]
        else:
            a, b = np.nonzero(maybe)
            values = paired_products(q[live][a], x[part][b])
        keep = values >= floor[live[a]]
        at, of, score = np.r_[at, live[a[keep]]], np.r_[of, b[keep] + low], np.r_[score, values[keep]]
        order = np.lexsort((names[of], ~score, at))  # ~s is -s - 1, which can't overflow
        at, of, score = at[order], of[order], score[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        top = place < k
        at, of, score, place = at[top], of[top], score[top], place[top]
        full = place == k - 1
        floor[at[full]] = np.maximum(floor[at[full]], score[full])
    return at, of, score


def _packer(dim: int, scale: int, most: int):
    """Packs the rows of a partition, in their order, into rows (cell, longest, ids, rows) of at most ``most``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = TaskContext.get().partitionId()

        def row(ids, rows):
            x = np.floor(scale * np.concatenate(rows))
            longest = float(np.sqrt((x**2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([longest]), pa.array([np.concatenate(ids).tobytes()]), pa.array([x.tobytes()])], names=["cell", "longest", "ids", "rows"])

        ids, rows, held = [], [], 0
        for batch in batches:
            one, x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(batch.column(1), dim)
            for low in range(0, len(one), most):
                ids.append(one[low : low + most])
                rows.append(x[low : low + most])
                held += len(ids[-1])
                if held >= most:
                    yield row(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield row(ids, rows)

    return pack


def rotation_of(vectors: DataFrame, dim: int, scale: int) -> np.ndarray:
    """Singular vectors of all vectors, those of the largest singular values first; dim * dim numbers are collected."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.floor(scale * matrix(batch.column(0), dim))
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((dim, dim))
    for r in vectors.select("vector").mapInArrow(gram, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh(out)[1][:, ::-1].copy()


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k largest integer products of each query.

    Components are turned into floor(scale * x) first. ``is_query``: a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(finite(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    dim = max(1, dimension(rows, "vector"))
    count = rows.count()
    rotation = spark.sparkContext.broadcast(rotation_of(rows, dim, scale))

    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    cells = max(1, -(-count // CELL))
    dealt = rows.withColumn("length", length).repartitionByRange(cells, F.col("length").desc(), F.xxhash64("vec_id"))
    blocks = stored(dealt.sortWithinPartitions(F.col("length").desc(), "vec_id").select("vec_id", "vector").mapInArrow(_packer(dim, scale, CELL), "cell long, longest double, ids binary, rows binary"))

    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    parts = max(1, -(-count // (100 * QUERIES)))
    queries = stored(
        asked.repartition(parts, "vec_id").mapInArrow(_packer(dim, scale, QUERIES), "cell long, longest double, ids binary, rows binary")
        .select(F.sha1("ids").alias("query_block"), F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"), F.col("longest").alias("query_longest"))
    )

    def held_against(group: pa.Table) -> Iterator:
        for row in group.to_pylist():
            ids, names = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            q, x = np.frombuffer(row["query_rows"]).reshape(-1, dim), np.frombuffer(row["rows"]).reshape(-1, dim)
            floor = np.frombuffer(row["floor"], np.float64) if row["floor"] else np.full(len(ids), -np.inf)
            yield row, ids, names, search(ids, q, floor, names, x, rotation.value, k)

    def first_floor(group: pa.Table) -> pa.Table:
        out = []
        for row, ids, _, (at, _, score) in held_against(group):
            floor = np.full(len(ids), -np.inf)
            last = np.flatnonzero(np.r_[at[1:] != at[:-1], True]) if len(at) else at
            whole = np.bincount(at, minlength=len(ids)) == k
            floor[at[last]] = np.where(whole[at[last]], score[last], -np.inf)
            out.append((row["query_block"], floor.tobytes(), float(floor.min())))
        return pa.table({"query_block": [b for b, _, _ in out], "floor": pa.array([f for _, f, _ in out], pa.binary()), "least": [x for _, _, x in out]})

    def partial(group: pa.Table) -> pa.Table:
        found = [(ids[at], names[of], score) for _, ids, names, (at, of, score) in held_against(group)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    top = blocks.orderBy(F.col("longest").desc(), "cell", F.xxhash64("ids")).limit(1).drop("cell")
    pairs = queries.join(F.broadcast(top)).withColumn("floor", F.lit(None).cast("binary"))  # one row: the block of the longest vectors
    floors = pairs.groupBy("query_block").applyInArrow(first_floor, "query_block string, floor binary, least double")
    started = stored(queries.join(floors, "query_block", "left"))
    # Blocks of queries go to the cells that can still hold one of their best; blocks of vectors stay where they are.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
    pairs = started.select("query_block", "query_longest", "least", every.alias("cell")).join(blocks.groupBy("cell").agg(F.max("longest").alias("longest")), "cell")
    reach = F.col("query_longest") * F.col("longest") * (1 + 1e-9) + 1e-6
    near = pairs.filter(F.col("least").isNull() | (reach >= F.col("least"))).select("query_block", "cell")
    met = near.join(started, "query_block").join(blocks, "cell")
    found = met.groupBy("cell", "query_block", F.xxhash64("ids").alias("block")).applyInArrow(partial, "query_id long, vec_id long, score long")
    return best(found, k, F.col("score").desc())
