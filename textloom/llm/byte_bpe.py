"""Byte-level BPE encoding and decoding of whole texts, each distinct pre-token encoded once.

1. Every task lays its texts out in blocks. The pre-tokens of a block are found in all its texts at
   once (by the pattern text by text, if it is not the usual one) and numbered, the most
   frequent first, and a text becomes the list of these numbers in order: its pre-tokens exploded
   with their positions, packed. A block's name is a hash of what it holds and the block's place:
   the number of its task and its own number there. So no two blocks share a name, be their texts
   equal, and what meets for a name is one block.
2. The distinct pre-tokens of each block go to slots by a hash, so equal pre-tokens of all blocks
   meet in one slot, once for each block and not for each occurrence. A slot encodes each of its
   distinct pre-tokens once and sends the ids back to the blocks.
3. Blocks and ids meet by block; every text is put together by position. Decoding looks the ids up
   in the token-byte table, whose size is that of the vocabulary.

The blocks are laid out twice, once for their words and once for their texts, because storing them
would take more disk than it saves time; the input must be one that Spark reads alike both times, as
tables are. If it is not, ids are missing for a block and the job fails.

A block holds at most BLOCK bytes of text, or one longer text. The number of slots follows the size
of the corpus, so the pre-tokens of a slot stay bounded. Blocks and words travel as compressed
arrays, since rows for single pre-tokens would be several times as large as the texts.

* null and empty texts: no ids, decoded to the empty text;
* very long texts and pre-tokens: whole;
* repeated rows: each keeps its row; empty table: empty result;
* the id column may hold anything, repeats included; only it and the text are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, binary_values, bytes_of, pre_token_sizes

#: Bytes of text in a block.
BLOCK = 4_000_000
#: Bytes of text for each slot of the word shuffle.
SLOT_BYTES = 8_000_000


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte: all lowest bytes first. Compresses well where most are small."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.cache
def _coder(path: str) -> tiktoken.Encoding:
    """Once in a worker: a coder that takes a pre-token as it stands."""
    return tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})


@functools.cache
def _token_bytes(path: str) -> pa.Array:
    """Once in a worker: the bytes of each rank, in the order of the ranks."""
    table = {rank: token for token, rank in read_ranks(path).items()}
    return pa.array([table.get(rank, b"") for rank in range(max(table) + 1)], pa.binary())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of so many numbers that lie one after the other in ``values``."""
    return pa.ListArray.from_arrays(pa.array(_bounds(sizes), pa.int32()), pa.array(values, pa.int32()))


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _values(array: pa.Array) -> list[bytes]:
    data, ends = bytes_of(array).tobytes(), _bounds(pc.binary_length(array).to_numpy()).tolist()
    return [data[low:high] for low, high in zip(ends, ends[1:], strict=False)]


def text_blocks(docs: DataFrame, pattern: str, slots: int) -> DataFrame:
    """(block, ids, sizes, places, slot_of, words) of the texts, block by block.

    ``sizes``: pre-tokens of each text; ``places``: their numbers; ``slot_of``: the slot of each
    number; ``words``: (slot, sizes, text) of the pre-tokens in the order of their numbers.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    words_type = pa.list_(pa.struct([("slot", pa.int64()), ("sizes", pa.binary()), ("text", pa.binary())]))

    def block_of(ordinal: int, ids: list, texts: list[bytes], id_arrow) -> pa.RecordBatch:
        data, lengths, sizes = pre_token_sizes(texts, pattern)
        coded = binary_values(data, lengths).dictionary_encode()
        places, words = coded.indices.to_numpy(), coded.dictionary
        order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        words = words.take(pa.array(order))
        names = _values(words)
        slot = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)) % np.uint64(slots)
        by_slot = np.argsort(slot, kind="stable")
        lengths, own = pc.binary_length(words).to_numpy()[by_slot], bytes_of(words.take(pa.array(by_slot)))
        pieces, ends = [], _bounds(lengths)
        firsts = np.flatnonzero(np.diff(slot[by_slot], prepend=np.uint64(slots))).tolist()
        for low, high in zip(firsts, [*firsts[1:], len(names)], strict=False):
            pieces.append({"slot": int(slot[by_slot[low]]), "sizes": packed(lengths[low:high]), "text": zstandard.compress(own[ends[low] : ends[high]], 1)})
        sizes, places = packed(sizes), packed(number[places])
        name = hashlib.sha256(b"".join([sizes, places, b"\0".join(names)])).hexdigest()[:32]
        name = f"{name}-{TaskContext.get().partitionId()}-{ordinal}"
        columns = [pa.array([name]), pa.array([ids], pa.list_(id_arrow)), pa.array([sizes]), pa.array([places]), pa.array([packed(slot)]), pa.array([pieces], words_type)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "places", "slot_of", "words"])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, id_arrow, ordinal = [], [], 0, pa.null(), 0
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= BLOCK:
                    yield block_of(ordinal, ids, texts, id_arrow)
                    ids, texts, held, ordinal = [], [], 0, ordinal + 1
        if ids:
            yield block_of(ordinal, ids, texts, id_arrow)

    pieces = "array<struct<slot: bigint, sizes: binary, text: binary>>"
    return docs.select("doc_id", as_bytes("text")).mapInArrow(lay_out, f"block string, ids array<{id_type}>, sizes binary, places binary, slot_of binary, words {pieces}")


def encoded_words(blocks: DataFrame, ranks: str) -> DataFrame:
    """(block, slot, counts, coded): ids of the pre-tokens of each block and slot, in their order.

    A pre-token is encoded as it stands and not split again.
    """

    def encode(group: pa.Table) -> pa.Table:
        coder, counts, coded = _coder(ranks), [], []
        pieces = zip(group.column("sizes").to_pylist(), group.column("text").to_pylist(), strict=True)
        words = [binary_values(np.frombuffer(zstandard.decompress(text), np.uint8), unpacked(sizes)) for sizes, text in pieces]
        distinct = pa.concat_arrays(words).dictionary_encode()
        known = [coder.encode_ordinary(word.decode()) for word in _values(distinct.dictionary)]
        lists = pa.array(known, pa.list_(pa.int32()))
        for low, some in zip(_bounds([len(w) for w in words]).tolist(), words, strict=False):
            rows = lists.take(distinct.indices.slice(low, len(some)))
            counts.append(packed(pc.list_value_length(rows).to_numpy()))
            coded.append(packed(rows.flatten().to_numpy()))
        return pa.table({"block": group.column("block"), "slot": group.column("slot"), "counts": pa.array(counts, pa.binary()), "coded": pa.array(coded, pa.binary())})

    pieces = blocks.select("block", F.explode("words").alias("w")).select("block", "w.slot", "w.sizes", "w.text")
    return pieces.groupBy("slot").applyInArrow(encode, "block string, slot long, counts binary, coded binary")


def encode_documents(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for every row: the token ids and the bytes they stand for.

    ``ranks``: the path of a tiktoken rank file, the same on every executor; ``pattern``: splits
    texts into pre-tokens.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = text_blocks(docs, pattern, max(64, size // SLOT_BYTES))

    def put_together(blocks: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(ranks)
        pieces = {p["slot"]: p for p in words.select(["slot", "counts", "coded"]).to_pylist()}
        pieces = [pieces[slot] for slot in sorted(pieces)]  # the words lie in the order of slots
        counts = np.concatenate([np.empty(0, np.uint32), *(unpacked(p["counts"]) for p in pieces)])
        coded = _lists(np.concatenate([np.empty(0, np.uint32), *(unpacked(p["coded"]) for p in pieces)]), counts)
        for number, row in enumerate(blocks.select(["sizes", "places", "slot_of"]).to_pylist()):
            ids = blocks.column("ids").slice(number, 1).combine_chunks().flatten()
            slot_of = unpacked(row["slot_of"])
            if len(slot_of) != len(coded):
                raise ValueError("the input was not read alike twice: a block lacks its ids")
            place = np.empty(len(coded), np.int64)
            place[np.argsort(slot_of, kind="stable")] = np.arange(len(coded))
            places, ends = place[unpacked(row["places"])], _bounds(unpacked(row["sizes"]))
            flat = coded.take(pa.array(places)).flatten()
            starts = _bounds(counts[places])[ends]  # of each text among the ids
            plain = table.take(flat)
            sizes = np.diff(_bounds(pc.binary_length(plain).to_numpy())[starts])
            columns = [ids, _lists(flat, np.diff(starts)), binary_values(bytes_of(plain), sizes)]
            yield from pa.table(columns, names=["doc_id", "ids", "decoded"]).to_batches(500)

    def whole(block: pa.Table, words: pa.Table) -> pa.Table:
        if not block.num_rows:
            raise ValueError("the input was not read alike twice: a block lacks its texts")
        return pa.Table.from_batches(put_together(block, words))

    texts = blocks.drop("words").groupBy("block").cogroup(encoded_words(blocks, ranks).groupBy("block"))
    return texts.applyInArrow(whole, f"doc_id {id_type}, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode_documents gives."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
