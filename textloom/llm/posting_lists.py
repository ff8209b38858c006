"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted by balanced k-means on a bounded sample. They are few enough to be broadcast,
and a graph over them, held in memory, is searched best-first for those near a vector. Every vector
goes to the posting list of its nearest centroid and, if it lies near a boundary, also to those of
further centroids whose distance is at most CLOSURE times the least. A query searches the lists
whose centroid lies within PROBE times the distance of its nearest centroid, at least LEAST_LISTS
and at most as many as the graph search gives. Distances to the vectors of the lists are exact.

Lists are bounded for tasks: one with more than PART vectors is dealt into parts by a hash, and its
queries go to every part; queries that meet in a list are dealt into parts alike. All vectors are
indexed. Recall against brute force is measured in the tests.

* vectors null, zero, or with null or non-finite components take no part; shorter vectors count as
  continued with zeros;
* equal vectors are candidates each; ties go to the smaller id; rows with one id are one query (of the
  first of them by their vectors) and never candidates of that query;
* up to SMALL vectors there is a single list, so fewer than k candidates are all given;
* empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.vectors import best, dimension, finite, matrix
from textloom.session import stored

#: The centroids are fitted on so many vectors at most, taken by the order of a hash of the id.
SAMPLE = 16_384
#: Vectors in a list, about, as long as the sample allows for that many centroids.
LIST, MOST_LISTS, SMALL = 256, 1024, 512
ROUNDS = 8
#: Neighbours of a centroid in the graph, and centroids a search keeps.
NEIGHBOURS, BEAM = 24, 512
CLOSURE, COPIES = 1.02, 4
PROBE, LEAST_LISTS = 1.17, 16
#: Vectors, and queries, of a list that meet in one task.
PART, QUERY_PART = 4096, 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def balanced_centroids(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k-means with a distance penalty on clusters above the mean size, so clusters even out."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(ROUNDS):
        far = distances(x, centre)
        owner = np.argmin(far + penalty, axis=1)
        size = np.bincount(owner, minlength=k)
        penalty = np.maximum(0.0, penalty + 0.05 * far.min(1).mean() * (size * k / len(x) - 1.0))
        total = np.zeros_like(centre)
        np.add.at(total, owner, x)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


class CentroidGraph:
    """Centroids with links to near ones, searched best-first from a few entry points."""

    def __init__(self, centre: np.ndarray, seed: int = 6):
        self.centre = centre
        far = distances(centre, centre)
        near = np.argsort(far, axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        links = [set(row.tolist()) for row in near]
        for i, row in enumerate(near.tolist()):
            for j in row:
                links[j].add(i)
        rng = np.random.default_rng(seed)
        self.links = [np.array(sorted(s), np.int64) for s in links]
        self.entries = np.unique(rng.choice(len(centre), min(len(centre), 32), replace=False))

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the ``beam`` nearest centroids found, nearest first."""
        def far(at):
            return np.sqrt(((self.centre[at] - x) ** 2).sum(1))

        seen = np.zeros(len(self.centre), bool)
        seen[self.entries] = True
        first = list(zip(far(self.entries).tolist(), self.entries.tolist(), strict=True))
        open_, kept = list(first), [(-d, i) for d, i in first]
        heapq.heapify(open_)
        heapq.heapify(kept)
        while len(kept) > beam:
            heapq.heappop(kept)
        while open_:
            d, i = heapq.heappop(open_)
            if len(kept) == beam and d > -kept[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for e, j in zip(far(new).tolist(), new.tolist(), strict=True):
                if len(kept) < beam:
                    heapq.heappush(kept, (-e, j))
                elif e < -kept[0][0]:
                    heapq.heapreplace(kept, (-e, j))
                else:
                    continue
                heapq.heappush(open_, (e, j))
        found = sorted((-d, i) for d, i in kept)
        return np.array([i for _, i in found], np.int64), np.array([d for d, _ in found])


def fit_index(vectors: DataFrame, dim: int, count: int) -> CentroidGraph | None:
    """The centroid graph for (vec_id, vector), from at most SAMPLE of them; None without vectors."""
    lists = 1 if count <= SMALL else min(MOST_LISTS, count // LIST)
    order = F.xxhash64("vec_id", F.lit("sample"))
    sample = vectors.orderBy(order, "vec_id", "vector").limit(SAMPLE).select("vector").toArrow()
    if not sample.num_rows:
        return None
    x = matrix(sample.column(0).combine_chunks(), dim)
    return CentroidGraph(balanced_centroids(x, min(lists, len(x))))


def _placed(graph, dim: int, ratio: float, least: int, most: int):
    """(list, vec_id, vector as bytes) for the lists whose centroid lies within the ratio."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lists, of = matrix(batch.column(1), dim), [], []
            for i, row in enumerate(x):
                at, far = graph.value.nearest(row, max(most, 8))
                number = min(most, max(least, int(np.searchsorted(far, far[0] * ratio, side="right"))))
                lists.append(at[:number])
                of.append(np.full(len(lists[-1]), i))
            lists, of = np.concatenate(lists), np.concatenate(of)
            data = [row.tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([pa.array(lists), batch.column(0).take(pa.array(of)), pa.array([data[i] for i in of.tolist()], pa.binary())], names=["list", "vec_id", "vector"])

    return place


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", probe: float = PROBE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each query.

    ``is_query``: a condition on vec_id.
    """
    spark = vectors.sparkSession
    valid = finite(vector) & F.col(vec_id).isNotNull() & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.filter(valid).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    dim, count = max(1, dimension(rows, "vector")), rows.count()
    graph = spark.sparkContext.broadcast(fit_index(rows, dim, count))  # at most MOST_LISTS centroids
    schema = "list long, vec_id long, vector binary"
    posted = stored(rows.mapInArrow(_placed(graph, dim, CLOSURE, 1, COPIES), schema))
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    wanted = stored(asked.mapInArrow(_placed(graph, dim, probe, LEAST_LISTS, BEAM), schema).withColumnsRenamed({"vec_id": "query_id"}))
    # One row for each list: how many parts its vectors and its queries make.
    parts = F.broadcast(posted.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("parts")))
    query_parts = F.broadcast(wanted.groupBy("list").agg(F.ceil(F.count("*") / QUERY_PART).alias("query_parts")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    both = posted.join(parts, "list").join(query_parts, "list")
    left = both.select("list", own("vec_id", "parts").alias("part"), every("query_parts").alias("query_part"), "vec_id", "vector")
    both = wanted.join(parts, "list").join(query_parts, "list")
    right = both.select("list", every("parts").alias("part"), own("query_id", "query_parts").alias("query_part"), "query_id", "vector")

    def compare(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        names, ids = candidates.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        x, q = (np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, dim) for t in (candidates, queries))
        out = []
        for one, row in zip(ids.tolist(), q, strict=True):
            far = np.sqrt(((x - row) ** 2).sum(1))
            far[names == one] = np.inf
            close = np.flatnonzero(far <= np.partition(far, min(k, len(far)) - 1)[min(k, len(far)) - 1])
            close = close[np.lexsort((names[close], far[close]))][:k]
            close = close[np.isfinite(far[close])]
            out.append((np.full(len(close), one), names[close], far[close]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    keys = ("list", "part", "query_part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    # A vector that was found in several lists counts once.
    return best(found.distinct(), k, F.col("score"))
