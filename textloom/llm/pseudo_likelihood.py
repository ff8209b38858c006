"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Words (A-Z lower-cased, split at ASCII white space) belong to classes: each of the most frequent
words of the corpus is a class of its own, every other word falls by a hash into one of some shared
classes. All words of all documents are counted for this. The network predicts the class of a word
from the classes of WINDOW words on each side: their embeddings, one table for each place, are
added, pass a tanh and a softmax over the classes. The probability of a word is that of its class
times its share of the class, from the counts of all words of the corpus: smoothed by SMOOTH, with
one place in each shared class for all words that were never counted. A document's score is the sum
of the log probabilities of all its words, each masked in turn.

Texts are cut into words once and laid out in stored blocks: the distinct words of a block with their
counts, and the number of its word for each position. Counting, training and scoring read the blocks.
Counts of words stay distributed: the words of the blocks go to slots by a hash, once for each block,
are added up there and later send their classes and shares back.

Training is data-parallel: in a round every task starts from the same weights, takes Adagrad steps
over positions of every text of its blocks and sends its weights; the rounds take turns over the positions
of a text, each every STRIDE-th one, so that together they visit them all. Slices of the weights are averaged by grouped aggregations in two levels, weighed by positions. The network, of
fixed size, is broadcast for the next round and for scoring.

* null, empty and blank texts: n_tokens 0, log_likelihood 0, mean_log_likelihood null; a text of one
  word is predicted from edges alone;
* very long texts: all words are scored;
* repeated rows: each is scored; empty table: empty result;
* other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from textloom.llm.byte_bpe import BLOCK, SLOT_BYTES, packed, unpacked
from textloom.llm.common import as_bytes, binary_values, bytes_of, scored
from textloom.session import stored

#: Words that are a class of their own, and classes the others share.
OWN, SHARED = 192, 64
CLASSES = OWN + SHARED
WINDOW, HIDDEN = 2, 24
ROUNDS, BATCH, RATE = 2, 256, 0.1
#: Every position is a training target in one of the rounds.
STRIDE = ROUNDS
#: Added to the count of a word within its class.
SMOOTH = 0.5
#: Words that a task counts before it passes its counts on.
COUNTED = 200_000
#: The columns that scoring adds.
RESULTS = ["n_tokens", "log_likelihood", "mean_log_likelihood"]
#: Positions gathered before they are learned or scored, and those whose probabilities are held at once.
CHUNK, CACHED = 16_384, 512

OFFSETS = [k for k in range(-WINDOW, WINDOW + 1) if k]
#: Embeddings by place and class, one class more for beyond the edge; the bias of the hidden layer; output weights, the last one for its bias.
SHAPES = [(len(OFFSETS), CLASSES + 1, HIDDEN), (HIDDEN,), (CLASSES, HIDDEN + 1)]
SIZES = [int(np.prod(s)) for s in SHAPES]
#: The row of the embeddings where those of a place begin, and the cells of each row of one place.
_FIRST = np.arange(len(OFFSETS))[:, None] * (CLASSES + 1)
_CELLS = np.arange((CLASSES + 1) * HIDDEN).reshape(-1, HIDDEN)
_ONES = np.ones(CLASSES, np.float32)
#: Sums of exp(logit) up to this, or down to its inverse, are exact enough in single precision.
WIDE = 1e30
#: ASCII white space among the bytes.
_GAPS = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


class _Classes(dict):
    """The class of each word met so far; other words get theirs by their hash and are kept."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = OWN + xxhash.xxh3_64_intdigest(word) % SHARED
        return found


class Vocabulary:
    def __init__(self, words: list[bytes]):
        self.place = {w: i for i, w in enumerate(words)}
        self.known = _Classes(self.place)

    def classes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self.known) > COUNTED:  # what a task keeps is bounded; the classes stay the same
            self.known = _Classes(self.place)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """The classes of distinct words."""
        place = self.place
        return np.fromiter((place[w] if w in place else OWN + hash_of(w) % SHARED for w in words), np.int64, len(words))

    def of_block(self, row: dict) -> np.ndarray:
        """The class of each word of all texts of a block."""
        names = pa.concat_arrays([pa.array([], pa.binary()), *(words_array(piece["words"]) for piece in row["words"])])
        told = pc.index_in(names, value_set=pa.array(list(self.place), pa.binary()))
        own = told.fill_null(-1).to_numpy()
        classes = np.empty(len(names), np.int64)
        classes[unpacked(row["order"])] = np.where(own >= 0, own, OWN + np.frombuffer(row["shares"], np.uint8).astype(np.int64))
        return classes[unpacked(row["places"])]


class Network:
    """``weights`` in one array; ``parts``, views of it: embeddings by place and class, bias, output, output bias."""

    def __init__(self, flat: np.ndarray):
        self.weights = np.array(flat, np.float32)
        embed, self.bias, self.top = (p.reshape(s) for p, s in zip(np.split(self.weights, np.cumsum(SIZES)[:-1]), SHAPES, strict=True))
        self.rows = embed.reshape(-1, HIDDEN)
        self.parts = [embed, self.bias, self.top[:, :HIDDEN], self.top[:, HIDDEN]]
        self.rooms, self.cells = [np.empty(0)], np.empty(0)
        self.slope = np.zeros(len(self.weights), np.float32)
        embed, bias, top = np.split(self.slope, np.cumsum(SIZES)[:-1])
        self.slopes = embed.reshape(SHAPES[0][0], -1), bias, top.reshape(SHAPES[2])

    @staticmethod
    def start(seed: int = 3) -> np.ndarray:
        rng = np.random.default_rng(seed)
        net = Network(np.zeros(sum(SIZES)))
        for part in net.parts[0], net.parts[2]:
            part[:] = rng.normal(0, 0.1, part.shape)
        return net.weights

    def room(self, size: int) -> list[np.ndarray]:
        """Arrays that the steps write to, made once: a batch after the other takes the same memory."""
        if len(self.rooms[0]) < size:
            shapes = [(size, CLASSES), (size, HIDDEN + 1), (size, HIDDEN), (size, HIDDEN)]
            self.rooms = [np.ones(shape, np.float32) for shape in shapes]
        return [r[:size] for r in self.rooms]

    def hidden(self, row: np.ndarray) -> np.ndarray:
        """The hidden layer and a column of ones, from the rows of the embeddings of each place."""
        _, out, total, near = self.room(row.shape[1])
        self.rows.take(row[0], axis=0, out=total, mode="clip")  # any other mode copies ``out``
        for k in range(1, len(OFFSETS)):
            total += self.rows.take(row[k], axis=0, out=near, mode="clip")
        total += self.bias
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def odds(self, hidden: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each position exp(logit) of every class, their sum, and the logit of the target, shifted alike."""
        logits, at = self.room(len(target))[0], np.arange(len(target))
        np.matmul(hidden, self.top.T, out=logits)
        own = logits[at, target]
        with np.errstate(over="ignore"):
            np.exp(logits, out=logits)
            total = logits @ _ONES
        if len(total) and not (total.min() > 1 / WIDE and total.max() < WIDE):  # too steep for exp as they are
            np.matmul(hidden, self.top.T, out=logits)
            logits -= logits.max(axis=1, keepdims=True)
            own = logits[at, target]
            np.exp(logits, out=logits)
            total = logits @ _ONES
        return logits, total, own

    def of_targets(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log probability of each target class."""
        found, total = np.empty(len(target)), np.empty(len(target))
        row = around + _FIRST
        for low in range(0, len(target), CACHED):
            part = slice(low, low + CACHED)
            _, total[part], found[part] = self.odds(self.hidden(row[:, part]), target[part])
        return found - np.log(total)

    def gradient(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean loss by all ``weights``; the array is written to again by the next call."""
        row = around + _FIRST
        h = self.hidden(row)
        error, total, _ = self.odds(h, target)
        # The error is scaled where it has met the narrow sides.
        error[np.arange(len(target)), target] -= total
        scale = (1 / (total * len(target)))[:, None]
        _, _, back, slope = self.room(len(target))
        np.matmul(error, self.parts[2], out=back)
        back *= scale
        np.multiply(h[:, :HIDDEN], h[:, :HIDDEN], out=slope)
        np.subtract(1, slope, out=slope)
        back *= slope
        embed, bias, top = self.slopes
        exact = back.ravel().astype(np.float64)
        if self.cells.size != exact.size:
            self.cells = np.empty(back.shape, _CELLS.dtype)
        for k, classes in enumerate(around):  # place by place, which stays within the cache
            at = _CELLS.take(classes, axis=0, out=self.cells, mode="clip").ravel()
            embed[k] = np.bincount(at, exact, minlength=_CELLS.size)
        back.sum(axis=0, out=bias)
        np.matmul(error.T, h * scale, out=top)
        return self.slope

    def gradients(self, around: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """``gradient`` by ``parts``."""
        found = Network(self.gradient(around, target))
        return found.parts


def edged(own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all words of several texts with edges (CLASSES) around each text, and where the words are."""
    at = np.arange(len(own)) + WINDOW * (1 + np.repeat(np.arange(len(lengths)), lengths))
    flat = np.full(len(own) + WINDOW * (len(lengths) + 1), CLASSES)
    flat[at] = own
    return flat, at


def neighbours(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the words at these places of ``edged`` texts: the classes around each, and its own."""
    return np.stack([flat[at + k] for k in OFFSETS]), flat[at]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(counts):
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for one in batch.column(0).to_pylist():
                counts.update(one.lower().split())
                if len(counts) > COUNTED:
                    yield told(counts)
                    counts = Counter()
        if counts:
            yield told(counts)

    return docs.select(as_bytes(text).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame) -> Vocabulary:
    """The most frequent words, ties by the word."""
    return Vocabulary([bytes(r["word"]) for r in counted.orderBy(F.col("n").desc(), "word").limit(OWN).collect()])


def turn(text: bytes) -> int:
    """Where the rounds over a text begin."""
    return xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF


def visited(text: bytes, length: int, number: int) -> slice:
    """The positions of a text of so many words that round ``number`` learns."""
    return slice((turn(text) + number * (STRIDE // ROUNDS)) % min(STRIDE, length), None, STRIDE)


def all_visited(turns: np.ndarray, lengths: np.ndarray, number: int) -> np.ndarray:
    """The same of several texts that lie one after the other."""
    first = (turns.astype(np.int64) + number * (STRIDE // ROUNDS)) % np.clip(lengths, 1, STRIDE)
    many = np.maximum(0, -(-(lengths - first) // STRIDE))
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.cumsum(lengths) - lengths + first, many) + STRIDE * place


def _trained(blocks: DataFrame, words: Vocabulary, weights: np.ndarray, number: int) -> np.ndarray:
    """The weights after a round over all texts."""
    shared = blocks.sparkSession.sparkContext.broadcast((words, weights))
    slices, groups = 16, 64

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shared.value
        net, seen = Network(weights), 0
        square, root = np.full(len(net.weights), 1e-6, np.float32), np.empty(len(net.weights), np.float32)

        def step(around, target):
            for low in range(0, len(target), BATCH):
                part = slice(low, low + BATCH)
                g = net.gradient(around[:, part], target[part])
                np.multiply(g, g, out=root)
                np.add(square, root, out=square)
                g /= np.sqrt(square, out=root)
                g *= RATE
                net.weights -= g

        for batch in batches:
            for block in range(batch.num_rows):
                row = batch.slice(block, 1).to_pylist()[0]
                lengths = unpacked(row["sizes"]).astype(np.int64)
                flat, at = edged(words.of_block(row), lengths)
                at = at[all_visited(unpacked(row["turns"]), lengths, number)]
                for low in range(0, len(at), 4 * CHUNK):
                    step(*neighbours(flat, at[low : low + 4 * CHUNK]))
                seen += len(at)
        if seen:
            pieces = np.array_split(net.weights.astype(np.float64) * seen, slices)
            group = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slices)), pa.array([group] * slices), pa.array([seen] * slices), pa.array([p.tobytes() for p in pieces], pa.binary())],
                names=["slice", "group", "n", "weights"],
            )

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w.as_buffer(), np.float64) for w in part.column("weights"))
        return pa.table({"slice": part.column("slice")[:1], "n": [sum(part.column("n").to_pylist())], "weights": pa.array([total.tobytes()], pa.binary())})

    sent = blocks.select("sizes", "turns", "places", "order", "shares", "words").mapInArrow(learn, "slice long, group long, n long, weights binary")
    summed = sent.groupBy("slice", "group").applyInArrow(add, "slice long, n long, weights binary").groupBy("slice").applyInArrow(add, "slice long, n long, weights binary")
    rows = sorted(summed.collect(), key=lambda r: r["slice"])
    if not rows:
        return weights
    return np.concatenate([np.frombuffer(r["weights"], np.float64) / r["n"] for r in rows]).astype(np.float32)


def trained(blocks: DataFrame, words: Vocabulary) -> np.ndarray:
    """The weights after all rounds."""
    weights = Network.start()
    for number in range(ROUNDS):
        weights = _trained(blocks, words, weights, number)
    return weights


def fit(docs: DataFrame, text: str = "text", counted: DataFrame | None = None) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the weights; ``counted``: the word counts of ``docs``, if they are there already."""
    laid = laid_out(docs, text)
    words = vocabulary(first_words(block_counts(laid)) if counted is None else counted)
    return words, trained(laid.table, words)


def class_scores(net: Network, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The log probability of the classes of each text."""
    flat, at = edged(own, lengths)
    value = np.zeros(len(at) + 1)
    for low in range(0, len(at), 4 * CHUNK):
        part = at[low : low + 4 * CHUNK]
        value[low + 1 : low + 1 + len(part)] = net.of_targets(*neighbours(flat, part))
    return by_text(np.cumsum(value), lengths)


def by_text(running: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sums of each text, from running sums that begin with 0."""
    ends = np.r_[0, np.cumsum(lengths)]
    return running[ends[1:]] - running[ends[:-1]]


def score_documents(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, log_likelihood and mean_log_likelihood of the classes of the words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        words, net = shared.value[0], Network(shared.value[1])

        def run(texts: list[bytes]) -> list[pa.Array]:
            sizes, sums = [], []
            for low in range(0, len(texts), 100):
                rows = [words.classes(one) for one in texts[low : low + 100]]
                lengths = np.array([len(r) for r in rows], np.int64)
                sizes += lengths.tolist()
                sums += class_scores(net, np.concatenate(rows), lengths).tolist()
            return [pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())]

        return run

    return _with_mean(scored(docs, text, "n_tokens long, log_likelihood double", work))


def _with_mean(out: DataFrame) -> DataFrame:
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


# --- blocks of texts ----------------------------------------------------------------------


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def words_of(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ") if data else []


def words_array(data: bytes) -> pa.Array:
    """``words_of`` as an Arrow array."""
    text = np.frombuffer(zstandard.decompress(data) + b" ", np.uint8)
    gap = text == 32
    return binary_values(text[~gap], np.diff(np.flatnonzero(gap), prepend=-1) - 1)


def spaced(words: pa.Array) -> np.ndarray:
    """The bytes of all words, a space after each."""
    sizes = pc.binary_length(words).to_numpy()
    out = np.full(sizes.sum() + len(words), 32, np.uint8)
    kept = np.ones(len(out), bool)
    kept[np.cumsum(sizes + 1, dtype=np.int64) - 1] = False
    out[kept] = bytes_of(words)
    return out


class Blocks(NamedTuple):
    """``table``: (block, rows, sizes, turns, places, order, shares, words), stored; ``kept``: the schema of the other columns."""

    table: DataFrame
    slots: int
    kept: StructType


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of its word for each position, and the words of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    solid = ~_GAPS[data]
    turns = np.flatnonzero(np.diff(np.r_[False, solid, False].view(np.int8)))
    first, ends = turns[::2], np.cumsum(np.array([len(one) + 1 for one in texts], np.int64))
    coded = binary_values(data[solid], turns[1::2] - first).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.diff(np.searchsorted(first, ends), prepend=0)


def laid_out(docs: DataFrame, text: str = "text") -> Blocks:
    """``docs`` in blocks of BLOCK bytes of text, or one longer text.

    ``rows``: the other columns; ``sizes`` and ``turns``: words of each text, and where its rounds begin;
    ``places``: the number of each word; ``words``: (slot, words, counts) of the distinct ones, slot
    by slot; ``order``: their numbers in that order; ``shares``: the class each would share, in the same order.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slots = max(64, size // SLOT_BYTES)
    words_type = pa.list_(pa.struct([("slot", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, zstd = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)

        def block_of(slices: list[pa.RecordBatch], texts: list[bytes]) -> pa.RecordBatch:
            known, places, lengths = cut(texts)
            names = spaced(known).tobytes().split()
            digest = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
            slot = (digest // np.uint64(SHARED) % np.uint64(slots)).astype(np.int64)
            counts, order = np.bincount(places, minlength=len(names)), np.argsort(slot, kind="stable")
            pieces, sizes, words = [], pc.binary_length(known).to_numpy()[order] + 1, spaced(known.take(pa.array(order)))
            first, ends = 0, np.r_[0, np.cumsum(sizes, dtype=np.int64)]
            for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(names) else []:
                text = words[ends[first] : ends[first + len(part)] - 1]
                pieces.append({"slot": int(slot[part[0]]), "words": zstd.compress(text), "counts": packed(counts[part])})
                first += len(part)
            shares = (digest[order] % np.uint64(SHARED)).astype(np.uint8).tobytes()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, slices[0].schema) as out:
                for one in slices:
                    out.write_batch(one)
            columns = [
                pa.array([f"{task}-{number}"]), pa.array([zstd.compress(sink.getvalue())], pa.binary()), pa.array([packed(lengths)]),
                pa.array([packed(np.array([turn(one) for one in texts]))]), pa.array([packed(places)]), pa.array([packed(order)]),
                pa.array([shares], pa.binary()), pa.array([pieces], words_type),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "rows", "sizes", "turns", "places", "order", "shares", "words"])

        slices, texts, held = [], [], 0
        for batch in batches:
            other, first = batch.select(batch.schema.names[:-1]), 0
            for at, one in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                texts.append(one)
                held += len(one)
                if held >= BLOCK:
                    yield block_of([*slices, other.slice(first, at + 1 - first)], texts)
                    slices, texts, held, first, number = [], [], 0, at + 1, number + 1
            if first < batch.num_rows:
                slices.append(other.slice(first))
        if texts:
            yield block_of(slices, texts)

    source = docs.select(*(c for c in docs.columns if c != text), as_bytes(text).alias("__text"))
    binary = ", ".join(f"{c} binary" for c in ("rows", "sizes", "turns", "places", "order", "shares"))
    laid = source.mapInArrow(lay_out, f"block string, {binary}, words array<struct<slot: bigint, words: binary, counts: binary>>")
    return Blocks(stored(laid), slots, docs.drop(text).schema)


# --- counts of words by slot --------------------------------------------------------------

_COUNTS = "slot long, words binary, counts binary"


def _counts_row(slot: int, counts: dict[bytes, int]) -> pa.Table:
    n = np.fromiter(counts.values(), np.int64, len(counts))
    return pa.table({"slot": [slot], "words": pa.array([zstandard.compress(b" ".join(counts), 1)], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})


def block_counts(laid: Blocks) -> DataFrame:
    """(slot, words, counts) of all words of the blocks, stored."""

    def add(pieces: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for data, counts in zip(pieces.column("words").to_pylist(), pieces.column("counts").to_pylist(), strict=True):
            for w, n in zip(words_of(data), unpacked(counts).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        return _counts_row(pieces.column("slot")[0].as_py(), total)

    pieces = laid.table.select(F.explode("words").alias("w")).select("w.slot", "w.words", "w.counts")
    return stored(pieces.groupBy("slot").applyInArrow(add, _COUNTS))


def _by_slot(counted: DataFrame, slots: int) -> DataFrame:
    """(slot, words, counts) of (word, n)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = np.fromiter(map(hash_of, batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            slot = digest // np.uint64(SHARED) % np.uint64(slots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot.astype(np.int64))], names=["word", "n", "slot"])

    def pack(group: pa.Table) -> pa.Table:
        return _counts_row(group.column("slot")[0].as_py(), dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True)))

    return counted.select("word", "n").mapInArrow(add, "word binary, n long, slot long").groupBy("slot").applyInArrow(pack, _COUNTS)


def first_words(counts: DataFrame) -> DataFrame:
    """(word, n) of the OWN most frequent words of each slot, ties by the word."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(zip((-np.frombuffer(counts, np.int64)).tolist(), words_of(data), strict=True))[:OWN]
                yield pa.RecordBatch.from_arrays([pa.array([w for _, w in found], pa.binary()), pa.array([-n for n, _ in found], pa.int64())], names=["word", "n"])

    return counts.select("words", "counts").mapInArrow(top, "word binary, n long")


def share_totals(counts: DataFrame, words: Vocabulary) -> np.ndarray:
    """Words and distinct words of each shared class."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SHARED, 2), np.int64)
        for batch in batches:
            for data, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                share = words.of_words(words_of(data)) - OWN
                other = share >= 0
                np.add.at(total, (share[other], 0), np.frombuffer(counts, np.int64)[other])
                np.add.at(total, (share[other], 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARED)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["share", "n", "words"])

    found = counts.select("words", "counts").mapInArrow(add, "share long, n long, words long")
    out = np.zeros((SHARED, 2))
    for r in found.groupBy("share").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        out[r["share"]] = r["n"], r["words"]
    return out


# --- words within their classes -----------------------------------------------------------


def score_words(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], counted: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the texts, with n_tokens, log_likelihood and mean_log_likelihood of the words themselves.

    ``counted``: (word, n) of the corpus.
    """
    laid = laid_out(docs.drop(*RESULTS), text)
    return score_blocks(laid, model, stored(_by_slot(counted, laid.slots)))


def score_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """``score_words`` by a model that is fitted on ``docs`` and by their counts, laid out once for all three."""
    laid = laid_out(docs.drop(*RESULTS), text)
    counts = block_counts(laid)
    words = vocabulary(first_words(counts))
    return score_blocks(laid, (words, trained(laid.table, words)), counts)


def score_blocks(laid: Blocks, model: tuple[Vocabulary, np.ndarray], counts: DataFrame) -> DataFrame:
    """The rows of the blocks with their scores; ``counts``: (slot, words, counts) of the corpus, a stored table."""
    shared = counts.sparkSession.sparkContext.broadcast(model)
    total = share_totals(counts, model[0])
    whole = total[:, 0] + SMOOTH * (total[:, 1] + 1)

    def share(pieces: pa.Table, counts: pa.Table) -> pa.Table:
        names = [words_array(data) for data in pieces.column("words").to_pylist()]
        coded = pa.concat_arrays([pa.array([], pa.binary()), *names]).dictionary_encode()
        # The class of each word of the slot, and its share of the class.
        classes = shared.value[0].of_words(coded.dictionary.to_pylist())
        n = np.full(len(classes), SMOOTH)
        for row in counts.select(["words", "counts"]).to_pylist():
            at = pc.index_in(coded.dictionary, value_set=words_array(row["words"])).fill_null(-1).to_numpy()
            n[at >= 0] += np.frombuffer(row["counts"], np.int64)[at[at >= 0]]
        other, value = classes >= OWN, np.zeros(len(classes), np.float32)
        value[other] = np.log(n[other] / whole[classes[other] - OWN])
        ends = np.cumsum([len(some) for some in names]).tolist()
        at = [coded.indices.to_numpy()[low:high] for low, high in zip([0, *ends], ends, strict=False)]
        classes = classes.astype(np.uint16)
        told = {"classes": pa.array([classes[i].tobytes() for i in at], pa.binary()), "told": pa.array([value[i].tobytes() for i in at], pa.binary())}
        return pa.table({"block": pieces.column("block"), "slot": pieces.column("slot"), **told})

    pieces = laid.table.select("block", F.explode("words").alias("w")).select("block", "w.slot", "w.words")
    shares = pieces.groupBy("slot").cogroup(counts.groupBy("slot")).applyInArrow(share, "block string, slot long, classes binary, told binary")
    names = [*laid.kept.names, "n_tokens", "log_likelihood"]

    def put_together(block: pa.Table, shares: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        rows = pa.ipc.open_stream(zstandard.decompress(row["rows"])).read_all()
        order, places, lengths = unpacked(row["order"]), unpacked(row["places"]), unpacked(row["sizes"]).astype(np.int64)
        classes, value = np.empty(len(order), np.int64), np.empty(len(order))
        told = shares.select(["slot", "classes", "told"]).sort_by("slot")
        classes[order] = np.frombuffer(b"".join(told.column("classes").to_pylist()), np.uint16)
        value[order] = np.frombuffer(b"".join(told.column("told").to_pylist()), np.float32)
        score = class_scores(Network(shared.value[1]), classes[places], lengths) + by_text(np.r_[0.0, np.cumsum(value[places])], lengths)
        return pa.table([*rows.columns, pa.array(lengths), pa.array(score)], names=names)

    schema = StructType([*laid.kept.fields, StructField("n_tokens", LongType()), StructField("log_likelihood", DoubleType())])
    blocks = laid.table.select("block", "rows", "sizes", "places", "order")
    return _with_mean(blocks.groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(put_together, schema))
