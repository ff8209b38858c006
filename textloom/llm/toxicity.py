"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is lower-cased (A-Z), every other ASCII sign than a letter or digit separates words, and its
features are the words and their stems (first bytes), the pairs of neighbours and the pairs with one
or two words between, hashed into a table of fixed size; a feature counts once for a text, however
often it occurs. Training
runs on Spark: the labelled rows are dealt into shards by a hash, every shard runs FTRL-proximal
over its rows with a learning rate for each coordinate and an L1 penalty that leaves most weights
at zero, and the shards' weights are averaged by coordinate. Each further pass starts from the
average. The weights that are not zero are few (bounded by the size of the table, and far fewer
under the penalty) and are broadcast for scoring, which takes whole texts and needs no shuffle.

* null and empty texts: no features, the score is the model's bias alone;
* very long texts: all words count;
* repeated rows: each is scored; ids repeated in the labels: the larger label counts;
* no labelled row, or labels of one kind only: the score is the share of toxic rows, 0 without any;
* other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, in_few_jobs, scored
from textloom.session import stored

#: Size of the feature table (a power of two).
BITS = 20
#: The classifier is fitted on so many labelled rows at most, taken by the order of a hash of the id.
SAMPLE = 16_000
SHARDS = 8
PASSES = 3
#: A longer word also counts as its first so many bytes, which its inflected forms share.
STEMS = (4, 5, 6)
#: Pairs of words with up to so many words between them.
SKIP = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0
#: Stands for the bias in the weights.
BIAS = -1

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def features(text: bytes) -> np.ndarray:
    """Coordinates of a text's features, in order and with repeats."""
    words = text.translate(_WORD_BYTES).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    parts = [h]
    for size in STEMS:
        stems = {w[:size] for w in words if len(w) > size}
        parts.append(np.fromiter((xxhash.xxh3_64_intdigest(w, size) for w in stems), np.uint64, len(stems)))
    for gap in range(1, SKIP + 2):
        pair = h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(gap)
        parts.append((pair ^ (pair >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:])
    full = np.concatenate(parts)
    return ((full * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """FTRL-proximal state: a learning rate for each coordinate, weights made when they are asked for."""

    def __init__(self, start: np.ndarray):
        self.n = np.zeros(len(start))
        # A state whose weights are those given: |z| exceeds the penalty by what the weight needs.
        self.z = -(np.sign(start) * L1 + start * (BETA / ALPHA + L2))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = float(sigmoid(w.sum())) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train_shard(rows: list[tuple[bytes, int]], start: np.ndarray) -> np.ndarray:
    model, bias = Ftrl(start), len(start) - 1
    for text, label in rows:
        model.learn(np.r_[np.unique(features(text)), bias], label)
    return model.weights(slice(None))


def _trainer(shared, number: int):
    """One pass over a shard from the broadcast weights, in an order of its own."""

    def train(group: pa.Table) -> pa.Table:
        start = np.zeros((1 << BITS) + 1)
        start[shared.value[0]] = shared.value[1]
        columns = (group.column(c).to_pylist() for c in ("id", "text", "label"))
        data = sorted(zip(*columns, strict=True), key=lambda r: (xxhash.xxh3_64_intdigest(f"{number} {r[0]}"), r[1]))
        w = _train_shard([(text, label) for _, text, label in data], start)
        at = np.flatnonzero(w)
        return pa.table({"at": at, "weight": w[at]})

    return train


def fit(rows: DataFrame) -> dict[int, float]:
    """Weights by coordinate from rows of (id, text as bytes, label), as ``labelled`` bounds them."""
    spark = rows.sparkSession
    sample = stored(rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(SHARDS))))
    told = sample.agg(F.count("*"), F.sum("label"), F.countDistinct("shard")).first()
    if not told[0] or told[1] in (0, told[0]):
        share = (told[1] or 0) / max(told[0], 1)
        return {BIAS: float(np.log((share + 1e-9) / (1 - share + 1e-9)))}
    weights = np.zeros((1 << BITS) + 1)
    for number in range(PASSES):
        start = spark.sparkContext.broadcast((np.flatnonzero(weights), weights[weights != 0]))
        learned = sample.select("shard", "id", "text", "label").groupBy("shard").applyInArrow(_trainer(start, number), "at long, weight double")
        weights = np.zeros_like(weights)
        for row in in_few_jobs(learned.groupBy("at").agg((F.sum("weight") / told[2]).alias("weight"))):
            weights[row["at"]] = row["weight"]
    return {(BIAS if at == 1 << BITS else int(at)): float(weights[at]) for at in np.flatnonzero(weights)}


def score_toxicity(docs: DataFrame, weights: dict[int, float], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work():
        table = np.zeros(1 << BITS)
        for at, w in shared.value.items():
            if at != BIAS:
                table[at] = w
        bias = shared.value.get(BIAS, 0.0)

        def run(texts: list[bytes]) -> list[pa.Array]:
            out = []
            for one in texts:
                at = features(one)
                at = np.unique(at[table[at] != 0])
                out.append(float(sigmoid(bias + table[at].sum())))
            return [pa.array(out, pa.float64())]

        return run

    return scored(docs, text, "score double", work).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, text, label) of documents with a label that are not held out, at most SAMPLE.

    The labelled ids are drawn without their texts, by the order of a hash, and sent to all tasks;
    texts are read where they lie. Of repeated rows of an id one is taken.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out)
    known = usable.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("order")), "id").limit(SAMPLE)
    return docs.select(F.col(doc_id).alias("id"), as_bytes(text).alias("text")).join(F.broadcast(drawn), "id").dropDuplicates(["id"])


def in_test_fold(doc_id: str = "doc_id") -> Column:
    """The rows no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted; the model is fitted on the labels first."""
    fold = docs.withColumn("held_out", in_test_fold())
    return score_toxicity(fold, fit(labelled(docs, labels, in_test_fold())), threshold=threshold)
