"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

An anchor's positives are its best-scoring other rows of the same label; its negatives, for each
positive, the best-scoring rows of other labels whose score lies in a window below the positive's.
Scores are inner products of whole numbers floor(scale * x).

Vectors are dealt by label into cells of bounded size. A cell stores its rows and, for each
dimension, its rows in the order of that component. Anchors are dealt by label into blocks in the
same way. A block meets a cell in a group of their own, one row of each:

* sorted access: each list is read from the end that the sign of the anchor's component asks for,
  some positions at a time in all dimensions; dimensions in which the anchor is 0 are not read;
* random access: every row met for the first time gets its exact score;
* the threshold is the score of the components last read, which no unseen row exceeds. A window is
  done once it lies strictly below the window's k-th score or below the window itself; a search is
  done when all its windows are. Rows that tie with the k-th score are thus always seen.

Positives are searched in cells that hold the anchor's label, negatives in all that hold another.
Each cell gives at most k rows for a window, so that the final ranking is over a bounded number of
rows for each cell. Pairs of blocks grow with anchors times vectors, as exact search must. Both
sides of a pair are shuffled; broadcast are only the name and the range of labels of each cell and
block, some dozens of bytes for thousands of vectors.

* rows whose id, label or vector is null, or that hold a null or non-finite component, take no part;
  shorter vectors count as continued with zeros; zero vectors take part, with score 0;
* rows that share the anchor's id are never its candidates; of several rows with an anchor's id the
  first by (label, vector) is the anchor; other repeated rows are candidates each;
* ties in score go to the smaller id; fewer candidates than asked for: all are given;
* scores of a positive at or below 0: the window from 30 to 90 percent is empty, or holds 0 only;
* scores beyond the range of a long count as the nearest long, in ranking and windows too;
* an empty table, or no anchor, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.vectors import dimension, finite, integer_products, matrix
from textloom.session import stored

#: Vectors in a cell (not over 65,536), and anchors in a block, at most.
CELL, ANCHORS = 4096, 1024
#: Partitions that vectors are dealt to, at most, as each has its share in what the driver samples; beyond it they hold several cells.
PLACES = 1024
#: Blocks at least, if there are as many anchors, so that a small table keeps several cores busy.
SPREAD = 4
#: Positions of each list that are read at first; the step doubles until the search ends.
STEP = 16


class Best:
    """The k best (score, id) so far among rows with lowest <= score <= highest."""

    def __init__(self, k: int, lowest: int, highest: int):
        self.k, self.lowest, self.highest = k, lowest, highest
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.scores[-1] if len(self.scores) == self.k else self.lowest
        good = (scores >= max(self.lowest, floor)) & (scores <= self.highest)
        if good.any():
            ids, scores = np.r_[self.ids, ids[good]], np.r_[self.scores, scores[good]]
            order = np.lexsort((ids, ~scores))[: self.k]  # ~s is -s - 1, which can't overflow
            self.ids, self.scores = ids[order], scores[order]

    def done(self, threshold: int) -> bool:
        return threshold < self.lowest or (len(self.scores) == self.k and threshold < self.scores[-1])


def threshold_search(anchor: np.ndarray, x: np.ndarray, order: np.ndarray, ids: np.ndarray, eligible: np.ndarray, windows: list[Best]) -> int:
    """Fill ``windows`` with the best eligible rows of ``x``; returns the number of rows scored.

    ``order``: for each dimension the rows by ascending component.
    """
    count, read = len(x), np.flatnonzero(anchor)
    if not len(read):  # every score is 0 and no list says anything
        for w in windows:
            w.add(ids[eligible], np.zeros(int(eligible.sum()), np.int64))
        return count
    rising = anchor[read] < 0
    seen, depth, step, scored = np.zeros(count, bool), 0, STEP, 0
    while depth < count:
        end = min(count, depth + step)
        positions = np.arange(depth, end)
        lists = order[read[:, None], np.where(rising[:, None], positions, count - 1 - positions)]
        fresh = np.zeros(count, bool)
        fresh[lists.ravel()] = True
        fresh &= ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh & eligible)
        if len(rows):
            scores = integer_products(anchor[None, :], x[rows])[0]
            scored += len(rows)
            for w in windows:
                w.add(ids[rows], scores)
        last = np.zeros((1, len(anchor)))
        last[0, read] = x[lists[:, -1], read]
        threshold = int(integer_products(anchor[None, :], last)[0, 0])
        if all(w.done(threshold) for w in windows):
            break
        depth, step = end, step * 2
    return scored


def windows_of(positive_scores: list[int], k: int, low: int, high: int) -> list[Best]:
    """For each positive p the scores s with low * p <= 100 * s <= high * p."""
    return [Best(k, -(-low * p // 100), high * p // 100) for p in positive_scores]


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.Array]]:
    """The columns of every ``size`` rows that follow each other, and of the rows that remain."""
    held, count = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, size - count))
            at, count = at + held[-1].num_rows, count + held[-1].num_rows
            if count == size:
                yield [c.combine_chunks() for c in pa.Table.from_batches(held).columns]
                held, count = [], 0
    if held:
        yield [c.combine_chunks() for c in pa.Table.from_batches(held).columns]


def _longs(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each if all fit, else as doubles."""
    return (x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x).tobytes()


def _unpacked(data: bytes, count: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * count * dim else np.float64).reshape(count, dim).astype(np.float64)


_CELL = "part string, least long, most long, ids binary, labels binary, rows binary, lists binary"
_BLOCK = "block string, first long, last long, anchor_ids binary, anchor_labels binary, anchor_rows binary, positives array<array<long>>, scores array<array<long>>"


def _cells(dim: int, scale: int):
    """Packs the rows (vec_id, label, vector) of a partition into cells."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for made, (ids, labels, vectors) in enumerate(_pieces(batches, CELL)):
            ids, labels, x = _longs(ids), _longs(labels), np.floor(scale * matrix(vectors, dim))
            order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)
            columns = [f"{place}-{made}", int(labels.min()), int(labels.max()), ids.tobytes(), labels.tobytes(), _packed(x), order.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=["part", "least", "most", "ids", "labels", "rows", "lists"])

    return pack


def _anchor_blocks(dim: int, scale: int):
    """Packs the anchors (vec_id, label, vector, positives, positive scores) of a partition into blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lists = TaskContext.get().partitionId(), pa.list_(pa.list_(pa.int64()))
        for made, (ids, labels, vectors, positives, scores) in enumerate(_pieces(batches, ANCHORS)):
            labels, x = _longs(labels), np.floor(scale * matrix(vectors, dim))
            columns = [f"{place}-{made}", int(labels.min()), int(labels.max()), _longs(ids).tobytes(), labels.tobytes(), _packed(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c]) for c in columns] + [pa.array([c.to_pylist()], lists) for c in (positives, scores)],
                names=["block", "first", "last", "anchor_ids", "anchor_labels", "anchor_rows", "positives", "scores"],
            )

    return pack


def _dealt(rows: DataFrame, count: int, size: int, least: int = 1) -> DataFrame:
    """Rows dealt by label, a fifth less than ``size`` to a partition, so that few need a second piece."""
    places = min(PLACES, max(least, -(-5 * count // (4 * size))))
    return rows.repartitionByRange(places, "label", F.xxhash64("vec_id")).sortWithinPartitions("label", "vec_id")


def _met(blocks: DataFrame, cells: DataFrame, wanted: Column, work, returns: str) -> DataFrame:
    """What ``work`` makes of every wanted pair of a block and a cell; only their names and ranges of labels are broadcast."""
    of_cells = cells.select(F.col("part").alias("part"), "least", "most")  # new columns: the sides of a cogroup can't share one
    of_blocks = blocks.select(F.col("block").alias("block"), "first", "last")
    here = blocks.join(F.broadcast(of_cells), wanted).drop("first", "last", "least", "most")
    there = cells.join(F.broadcast(of_blocks), wanted).drop("first", "last", "least", "most")
    return here.groupBy("part", "block").cogroup(there.groupBy("part", "block")).applyInArrow(work, returns)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: str | Column = "label", positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and positive_rank.

    ``is_anchor``: a condition on vec_id. A negative's score lies between ``low`` and ``high`` percent
    of the positive's.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    dim = max(1, dimension(rows, "vector"))
    cells = stored(_dealt(rows, rows.count(), CELL).mapInArrow(_cells(dim, scale), _CELL))
    asked = stored(rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.label", "a.vector"))
    many = asked.count()

    def blocks(anchors: DataFrame) -> DataFrame:
        return stored(_dealt(anchors, many, ANCHORS, SPREAD).mapInArrow(_anchor_blocks(dim, scale), _BLOCK))

    def searches(block: pa.Table, cell: pa.Table, same: bool) -> Iterator:
        """Of each anchor for which the cell has rows: its place in the block, its id and its search."""
        (anchors,), (cell,) = block.to_pylist(), cell.to_pylist()
        names, own = (np.frombuffer(anchors[c], np.int64) for c in ("anchor_ids", "anchor_labels"))
        ids, labels = (np.frombuffer(cell[c], np.int64) for c in ("ids", "labels"))
        x, rows = _unpacked(cell["rows"], len(ids), dim), _unpacked(anchors["anchor_rows"], len(names), dim)
        order = np.frombuffer(cell["lists"], np.uint16).reshape(dim, -1).astype(np.int64)
        for i, name in enumerate(names.tolist()):
            eligible = ((labels == own[i]) == same) & (ids != name)
            if eligible.any():
                yield anchors, i, name, lambda windows, i=i, eligible=eligible: threshold_search(rows[i], x, order, ids, eligible, windows)

    def same_label(block: pa.Table, cell: pa.Table) -> pa.Table:
        found = []
        for _, _, name, search in searches(block, cell, True):
            search([best := Best(positives, -(1 << 63), (1 << 63) - 1)])
            found += [(name, int(i), int(s)) for i, s in zip(best.ids, best.scores, strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], ["anchor_id", "vec_id", "score"])

    def other_labels(block: pa.Table, cell: pa.Table) -> pa.Table:
        found = []
        for anchors, i, name, search in searches(block, cell, False):
            search(windows := windows_of(anchors["scores"][i], negatives, low, high))
            for place, (positive, score, best) in enumerate(zip(anchors["positives"][i], anchors["scores"][i], windows, strict=True)):
                found += [(name, place + 1, positive, score, int(n), int(s)) for n, s in zip(best.ids, best.scores, strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 6)], ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    empty = F.array().cast("array<long>")
    first = blocks(asked.withColumns({"positives": empty, "scores": empty}))
    may_share = (F.col("first") <= F.col("most")) & (F.col("least") <= F.col("last"))
    found = _met(first, cells, may_share, same_label, "anchor_id long, vec_id long, score long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("place") <= positives)
    chosen = ranked.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("p"))
    joined = asked.hint("merge").join(chosen.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    widened = joined.select("vec_id", "label", "vector", F.col("p.vec_id").alias("positives"), F.col("p.score").alias("scores"))

    second = blocks(widened)
    one_label = (F.col("first") == F.col("last")) & (F.col("least") == F.col("most")) & (F.col("first") == F.col("least"))
    mined = _met(second, cells, ~one_label, other_labels, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranks = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranks.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("place").cast("int").alias("positive_rank"))
