"""Ranked lexical search over posting lists that are blocked by the similarity of their documents.

Scores are whole numbers: a term's weight times a saturated frequency (``impact``), summed over the
query's terms. Texts are read once: each document keeps its length and its frequencies of the
queries' terms, so the index holds what the queries can ask for, of every document.

* Documents are placed by their nearest representative, one of REPRESENTATIVES drawn from a bounded
  sample, and dealt in that order into cells of bounded size. A cell is a row of the index: it holds
  its documents' impacts and, for each term, its posting list.
* A posting list is cut into geometric blocks: its documents join the most similar of evenly spaced
  members of the same list, and blocks hold BLOCK documents at most.
* A block stores, for its own term and every term more frequent than it that a query has beside it,
  the greatest impact over its documents. Terms are in one order, the rarest first. A document is
  bounded where its first term of the query has its list, so terms before that add nothing to it and
  sums over the stored coordinates are exact upper bounds.
* A query skips a block only if its bound is strictly below the query's k-th best score; documents of
  other blocks get their exact score from their own impacts. The floors all cells start from are the
  k-th scores in the cell with the greatest bound for a query.

Queries come in blocks of at most TERMS words, however many there are; the index is built for each.

* null texts and texts without terms count nowhere and are never found; queries without terms give
  nothing;
* N, the lengths and frequencies are of all rows, repeated ones and those with null ids too, but rows
  with a null id are not listed; queries with a null id are left out, of several with one id the
  first by its text is asked;
* ties in score go to the smaller id; repeated rows rank one beside the other;
* empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes
from textloom.llm.vectors import best
from textloom.session import stored

#: Terms of the queries that are searched together, counted with repeats (the bound of what is broadcast).
TERMS = 1 << 18
#: Documents in a cell, their postings in it about, and documents in a block, at most.
CELL, POSTINGS, BLOCK = 4096, 1 << 19, 32
#: Documents of which representatives are drawn, their number, and the dimensions of a sketch.
SAMPLE, REPRESENTATIVES, SKETCH = 4096, 256, 64
#: Documents that are scored at once, and postings that are summarised at once.
STEP, CHUNK = 256, 1 << 17

#: Bytes of a batch that a task reads at once; a cell has some megabytes.
BATCH = 16 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Queries:
    """A block of queries: ids, and for each its terms as ranks (rarest first) with their times in it."""

    ids: list[int]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    size: int

    def beside(self) -> list[np.ndarray]:
        """For each term the ranks, its own and later ones, that some query has beside it."""
        asking: list[list[int]] = [[] for _ in range(self.size)]
        for number, ranks in enumerate(self.terms):
            for r in ranks.tolist():
                asking[r].append(number)
        return [np.unique(np.concatenate([self.terms[n][self.terms[n] >= r] for n in numbers])) if numbers else np.empty(0, np.int64) for r, numbers in enumerate(asking)]


# --- forward rows -----------------------------------------------------------------------


def _forward(vocabulary):
    """Each document's length, its terms of the vocabulary (places) and their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.value
        for batch in batches:
            lengths, terms, times = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                found = [(place[w], n) for w, n in Counter(words).items() if w in place]
                lengths.append(len(words))
                terms.append(np.array([t for t, _ in found], np.int32).tobytes())
                times.append(np.array([n for _, n in found], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "length", "terms", "times"])

    return run


def _flat(column: pa.Array, kind=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


def document_frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """The documents of each place of the vocabulary; ``size`` numbers are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["place", "docs"])

    out = np.zeros(size, np.int64)
    for row in forward.select("terms").mapInArrow(count, "place long, docs long").groupBy("place").agg(F.sum("docs").alias("docs")).collect():
        out[row["place"]] = row["docs"]
    return out


# --- similarity -------------------------------------------------------------------------


def sketches(terms: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A short unit vector for each document: its terms' weights, hashed with signs into SKETCH dimensions."""
    mixed = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    at = (mixed >> np.uint64(40)).astype(np.int64) % SKETCH
    signed = np.where(mixed >> np.uint64(63), 1.0, -1.0) * weights[terms]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.bincount(row * SKETCH + at, signed, minlength=len(sizes) * SKETCH).reshape(len(sizes), SKETCH)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def geometric_blocks(sketch: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order of the documents of a list, and where its blocks start.

    Every member joins the most similar of evenly spaced members; groups are cut at ``size``.
    """
    size, count = size or BLOCK, len(sketch)
    if count <= size:
        return np.arange(count), np.zeros(1, np.int64)
    leads = sketch[np.arange(0, count, size)]
    nearest = np.concatenate([np.argmax(sketch[low : low + 4096] @ leads.T, axis=1) for low in range(0, count, 4096)])
    order = np.argsort(nearest, kind="stable")
    sizes = np.bincount(nearest, minlength=len(leads))
    within = np.arange(count) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order, np.flatnonzero(within % size == 0)


# --- cells ------------------------------------------------------------------------------

_ARRAYS = ("ids", "starts", "ranks", "impacts", "block_terms", "block_starts", "block_docs", "sum_starts", "sum_ranks", "sum_most")
_INDEX = "cell long, best binary, " + ", ".join(f"{name} binary" for name in _ARRAYS)


@dataclass
class Cell:
    """Documents (ids) with their impacts by rank, the blocks of all lists, and the blocks' summaries."""

    ids: np.ndarray
    starts: np.ndarray
    ranks: np.ndarray
    impacts: np.ndarray
    block_terms: np.ndarray
    block_starts: np.ndarray
    block_docs: np.ndarray
    sum_starts: np.ndarray
    sum_ranks: np.ndarray
    sum_most: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Cell:
        return cls(*(np.frombuffer(row[name], np.int64 if name in ("ids", "impacts", "sum_most") else np.int32) for name in _ARRAYS))

    def columns(self) -> list[bytes]:
        return [getattr(self, name).astype(np.int64 if name in ("ids", "impacts", "sum_most") else np.int32).tobytes() for name in _ARRAYS]


def build_cell(ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, impacts: np.ndarray, beside: list[np.ndarray], weights: np.ndarray) -> Cell:
    """The index of some documents; ``ranks`` and ``impacts`` are theirs one after the other, any order within one."""
    docs = np.repeat(np.arange(len(ids)), sizes)
    order = np.lexsort((ranks, docs))
    ranks, impacts = ranks[order], impacts[order]
    starts = np.r_[0, np.cumsum(sizes)]
    sketch = sketches(ranks, sizes, weights)
    by_term = np.argsort(ranks, kind="stable")
    list_terms, list_starts = np.unique(ranks[by_term], return_index=True)
    list_ends = np.r_[list_starts[1:], len(by_term)]
    allowed = np.zeros(len(beside), bool)
    block_terms, block_sizes, block_docs, sum_sizes, sum_ranks, sum_most = [], [], [], [], [], []
    for term, low, high in zip(list_terms.tolist(), list_starts.tolist(), list_ends.tolist(), strict=True):
        place = by_term[low:high]  # of the postings; what follows one in its document has a later rank
        arranged, cuts = geometric_blocks(sketch[docs[place]])
        place = place[arranged]
        counts = np.diff(np.r_[cuts, len(place)])
        block = np.repeat(np.arange(len(cuts)), counts)
        block_terms.append(np.full(len(cuts), term))
        block_sizes.append(counts)
        block_docs.append(docs[place])
        rest = starts[docs[place] + 1] - place
        allowed[beside[term]] = True
        keys, values = [], []
        ends = np.cumsum(rest)
        at = 0
        while at < len(place):  # some documents at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            entries = ranges(place[at:to], rest[at:to])
            owner = np.repeat(block[at:to], rest[at:to])
            good = allowed[ranks[entries]]
            keys.append(owner[good] * len(beside) + ranks[entries[good]])
            values.append(impacts[entries[good]])
            at = to
        allowed[beside[term]] = False
        key, value = np.concatenate(keys), np.concatenate(values)
        sorting = np.argsort(key, kind="stable")
        key, value = key[sorting], value[sorting]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sum_most.append(np.maximum.reduceat(value, first))
        sum_ranks.append(key[first] % len(beside))
        sum_sizes.append(np.bincount(key[first] // len(beside), minlength=len(cuts)))
    whole = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return Cell(
        ids, starts, ranks, impacts, whole(block_terms), np.r_[0, np.cumsum(whole(block_sizes))], whole(block_docs),
        np.r_[0, np.cumsum(whole(sum_sizes))], whole(sum_ranks), whole(sum_most),
    )


def block_bounds(cell: Cell, ranks: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a query's lists and the most a document can score whose first term is the block's."""
    low, high = np.searchsorted(cell.block_terms, ranks), np.searchsorted(cell.block_terms, ranks, "right")
    blocks = ranges(low, high - low)
    if not len(blocks):
        return blocks, blocks
    sizes = cell.sum_starts[blocks + 1] - cell.sum_starts[blocks]
    entries = ranges(cell.sum_starts[blocks].astype(np.int64), sizes)
    at = np.minimum(np.searchsorted(ranks, cell.sum_ranks[entries]), len(ranks) - 1)
    gain = np.where(ranks[at] == cell.sum_ranks[entries], times[at] * cell.sum_most[entries], 0)
    return blocks, np.add.reduceat(gain, np.cumsum(sizes) - sizes)


def search_cell(cell: Cell, ranks: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores (at least ``floor``, above 0) of the k best documents, and how many were scored."""
    blocks, bounds = block_bounds(cell, ranks, times)
    good = bounds >= max(1, floor)
    blocks, bounds = blocks[good], bounds[good]
    order = np.argsort(-bounds, kind="stable")
    blocks, bounds = blocks[order], bounds[order]
    seen, scored = np.zeros(len(cell.ids), bool), 0
    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = cell.block_starts[blocks + 1] - cell.block_starts[blocks]
    ends, at = np.cumsum(sizes), 0
    while at < len(blocks) and bounds[at] >= floor:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        to = min(to, at + int(np.count_nonzero(bounds[at:to] >= floor)))
        met = np.zeros(len(cell.ids), bool)
        met[cell.block_docs[ranges(cell.block_starts[blocks[at:to]].astype(np.int64), sizes[at:to])]] = True
        docs = np.flatnonzero(met & ~seen)
        seen[docs] = True
        at = to
        if not len(docs):
            continue
        scored += len(docs)
        lengths = cell.starts[docs + 1] - cell.starts[docs]
        entries = ranges(cell.starts[docs].astype(np.int64), lengths)
        place = np.minimum(np.searchsorted(ranks, cell.ranks[entries]), len(ranks) - 1)
        gain = np.where(ranks[place] == cell.ranks[entries], times[place] * cell.impacts[entries], 0)
        value = np.add.reduceat(gain, np.cumsum(lengths) - lengths)
        high = (value >= floor) & (value > 0)
        ids, scores = np.r_[ids, cell.ids[docs[high]]], np.r_[scores, value[high]]
        top = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[top], scores[top]
        if len(ids) == k:
            floor = max(floor, int(scores[-1]))
    return ids, scores, scored


# --- the job ----------------------------------------------------------------------------


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs queries (id, text) into rows of at most TERMS words, or of one query."""
    place, made, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([f"{place}-{made}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["block", "ids", "texts"])

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = terms_of(text)
            if not words:
                continue
            if ids and held + len(words) > TERMS:
                yield row()
                made, ids, texts, held = made + 1, [], [], 0
            ids.append(name)
            texts.append(text)
            held += len(words)
    if ids:
        yield row()


def _cell_rows(terms_order, impacts_of, beside, weights, queries: Queries):
    """Packs placed forward rows (doc_id, length, terms, times) into cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId(), 0
        held: list[list[np.ndarray]] = [[], [], [], []]
        docs = postings = 0

        def row() -> pa.RecordBatch:
            nonlocal made, held, docs, postings
            ids, sizes, ranks, impacts = map(np.concatenate, held)
            cell = build_cell(ids, sizes, ranks, impacts, beside.value, weights.value)
            most = [int(block_bounds(cell, r, t)[1].max(initial=0)) for r, t in zip(queries.value.terms, queries.value.times, strict=True)]
            number, made = (partition << 32) + made, made + 1
            held, docs, postings = [[], [], [], []], 0, 0
            values = [[number], [np.array(most, np.int64).tobytes()], *([c] for c in cell.columns())]
            return pa.RecordBatch.from_arrays(list(map(pa.array, values)), names=["cell", "best", *_ARRAYS])

        for batch in batches:
            ids, lengths = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            places, sizes = _flat(batch.column(2))
            times = _flat(batch.column(3))[0].astype(np.int64)
            ranks, impacts = terms_order.value[places], impacts_of(places, times, np.repeat(lengths, sizes))
            ends, low = np.cumsum(sizes), 0
            while low < len(ids):
                start = int(ends[low - 1]) if low else 0
                high = min(len(ids), low + CELL - docs, max(low + 1, int(np.searchsorted(ends, start + POSTINGS - postings, "right"))))
                part = slice(start, int(ends[high - 1]))
                for kept, values in zip(held, (ids[low:high], sizes[low:high], ranks[part], impacts[part]), strict=True):
                    kept.append(values)
                docs, postings, low = docs + high - low, postings + part.stop - part.start, high
                if docs >= CELL or postings >= POSTINGS:
                    yield row()
        if docs:
            yield row()

    return run


def rank_documents(
    docs: DataFrame, queries: DataFrame, k: int = 10, b: int = 75, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text",
) -> DataFrame:
    """The query's id, rank, doc_id and score: the k documents with the highest scores above 0.

    N documents have a term, n is a document's length and L the sum of lengths. A term in df documents
    weighs w = floor(1000 ln((2N + 2) / (2df + 1))); tf occurrences in a document score
    w * (10**9 tf div (1000 tf + 8m)) with m = 100 - b + (b n N div L).
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    asked = queries.filter(F.col(query_id).isNotNull()).groupBy(F.col(query_id).cast("long").alias("id")).agg(F.min(as_bytes(query_text)).alias("text"))
    asked = stored(asked)
    held = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    few = asked.coalesce(max(1, -(-held // (4 * TERMS))))  # so that blocks are full, however the queries lie
    blocks = stored(few.mapInArrow(_query_blocks, "block string, ids array<long>, texts array<binary>"))
    found = None
    for name in [r["block"] for r in blocks.select("block").collect()]:
        one = blocks.filter(F.col("block") == name).first()
        part = _search_block(spark, docs, one["ids"], [bytes(t) for t in one["texts"]], k, b, doc_id, text)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    return best(found, k, F.col("score").desc()).select(F.col("query_id").alias(query_id), "rank", F.col("vec_id").alias("doc_id"), "score")


def _search_block(spark, docs: DataFrame, ids: list[int], texts: list[bytes], k: int, b: int, doc_id: str, text: str) -> DataFrame:
    words = [Counter(terms_of(t)) for t in texts]
    places = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    size = len(places)
    send = spark.sparkContext.broadcast

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("text"))
    forward = stored(read.mapInArrow(_forward(send(places)), "doc_id long, length long, terms binary, times binary"))
    totals = forward.agg(F.count_if(F.col("length") > 0).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l"), F.count_if(F.length("terms") > 0).alias("holding")).first()
    many, length = totals["n"], max(1, totals["l"])
    df = document_frequencies(forward, size)
    counted = spark.createDataFrame(list(enumerate(df.tolist())), "place long, df long")
    weigh = counted.select("place", F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * many) + 2.0) / (2.0 * F.col("df") + 1.0))).alias("w"))
    weights = np.zeros(size, np.int64)
    for row in weigh.collect():
        weights[row["place"]] = row["w"]

    rarest = np.lexsort((np.arange(size), df))  # the place of each rank
    rank = np.empty(size, np.int64)
    rank[rarest] = np.arange(size)
    terms, times = [], []
    for counts in words:
        own = np.array([rank[places[w]] for w in counts], np.int64)
        order = np.argsort(own)
        terms.append(own[order])
        times.append(np.array(list(counts.values()), np.int64)[order])
    block = Queries(ids, terms, times, size)
    block_sent, order_sent, weight_sent = send(block), send(rank), send(weights)
    similar = send(weights[rarest].astype(np.float64) ** 2)

    def impacts_of(place: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - b + b * n * many // length
        return weight_sent.value[place] * (1_000_000_000 * tf // (1000 * tf + 8 * m))

    # Representatives: of a bounded sample of different documents, in the order of their hashes.
    usable = forward.filter("length(terms) > 0 AND doc_id IS NOT NULL")
    hashed = F.xxhash64("terms", "times")
    share = max(1, totals["holding"] // (8 * SAMPLE))
    sample = usable.filter(F.pmod(hashed, F.lit(share)) == 0).select(hashed.alias("hash"), "terms").groupBy("hash").agg(F.min("terms").alias("terms")).orderBy("hash").limit(SAMPLE)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = _flat(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sketches(order_sent.value[found], sizes, similar.value)], pa.binary())], names=["sketch"])

    drawn = [r["sketch"] for r in sample.select("terms").mapInArrow(sketched, "sketch binary").collect()]
    drawn = drawn[:: max(1, len(drawn) // REPRESENTATIVES)][:REPRESENTATIVES]
    leads = send(np.frombuffer(b"".join(drawn) or bytes(4 * SKETCH), np.float32).reshape(-1, SKETCH))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = _flat(batch.column(2))
            nearest = np.argmax(sketches(order_sent.value[found], sizes, similar.value) @ leads.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int64())], names=[*batch.schema.names, "near"])

    cells = max(1, -(-totals["holding"] // CELL))
    near = usable.mapInArrow(placed, "doc_id long, length long, terms binary, times binary, near long")
    dealt = near.repartitionByRange(cells, "near", F.xxhash64("doc_id")).sortWithinPartitions("near", "doc_id", "terms", "times").drop("near")
    dealt = dealt.coalesce(cells)  # neighbouring ranges share a cell where there are more of them than asked for
    index = stored(dealt.mapInArrow(_cell_rows(order_sent, impacts_of, send(block.beside()), similar, block_sent), _INDEX))

    def richest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, where = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            for cell, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bound = np.frombuffer(row, np.int64)
                better = (bound > most) | ((bound == most) & (cell < where))
                most, where = np.where(better, bound, most), np.where(better, cell, where)
        held = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(most[held], pa.int64()), pa.array(where[held], pa.int64())], names=["query", "bound", "cell"])

    first = index.select("cell", "best").mapInArrow(richest, "query long, bound long, cell long").groupBy("query").agg(F.max_by("cell", F.struct("bound", -F.col("cell"))).alias("cell"))
    homes: dict[int, list[int]] = {}
    for row in first.collect():
        homes.setdefault(row["cell"], []).append(row["query"])

    def searched(chosen, floors):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, floor = block_sent.value, floors.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    bound, cell = np.frombuffer(row["best"], np.int64), Cell.of(row)
                    asking = np.array(chosen.value.get(row["cell"], []), np.int64) if chosen else np.flatnonzero(bound >= np.maximum(1, floor))
                    out = []
                    for q in asking.tolist():
                        names, scores, _ = search_cell(cell, own.terms[q], own.times[q], k, int(floor[q]))
                        out += [(own.ids[q], q, n, s) for n, s in zip(names.tolist(), scores.tolist(), strict=True)]
                    columns = zip(*out, strict=True) if out else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query", "vec_id", "score"])

        return run

    found_at = "query_id long, query long, vec_id long, score long"
    floors = np.zeros(len(ids), np.int64)
    at_home = index.mapInArrow(searched(send(homes), send(floors)), found_at).groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("score"))
    for row in at_home.filter(F.col("found") >= k).collect():
        floors[row["query"]] = row["score"]
    return index.mapInArrow(searched(None, send(floors)), found_at).drop("query")
