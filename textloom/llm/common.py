"""Helpers the operators of this package share."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that reach a Python worker at once. Texts can be long, so batches are kept small.
ARROW_ROWS = 1000
#: Bits of a broadcast bitmap (8 MB), whatever the size of the input, as a power of two.
BITMAP_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: a batch is never more than ARROW_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def as_bytes(name: str):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


# --- pre-tokens ------------------------------------------------------------------------


@functools.cache
def pre_token_patterns(pattern: str) -> tuple:
    """The pattern for any text, and the same pattern for texts of ASCII characters only.

    For ASCII the Unicode classes are spelled out, which the faster standard module can match.
    """
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\rA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    plain = plain.replace(r"\S", r"[^ \t-\r]").replace(r"\s", r"[ \t-\r]")
    return regex.compile(pattern), re.compile(plain)


def pre_tokens(text: str, pattern: str) -> list[str]:
    wide, plain = pre_token_patterns(pattern)
    return (plain if text.isascii() else wide).findall(text)


#: The pattern whose pre-tokens are found in many texts at once.
GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE, _QUOTE = ord(" "), ord("'")


@functools.cache
def character_kinds() -> np.ndarray:
    """Of every code point 0 for white space, 1 for letters, 2 for numbers, 3 for others."""
    kinds, every = np.full(0x110000, 3, np.uint8), "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for kind, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            kinds[found.start() : found.end()] = kind
    return kinds


def _starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of GPT2 start in the UTF-8 bytes of texts that begin at ``begins``."""
    kind, high = character_kinds()[data], data >= 128
    if high.any():
        some = data[high]
        leads = np.flatnonzero((some & 0xC0) == 0xC0)
        codes = np.frombuffer(some.tobytes().decode().encode("utf-32-le"), "<u4")
        kind[high] = np.repeat(character_kinds()[codes], np.diff(leads, append=len(some)))
    new = np.zeros(len(data) + 3, bool)
    new[begins] = True
    start = new[: len(data)].copy()
    start[1:] |= (kind[1:] != kind[:-1]) & (data[:-1] != _SPACE)  # one space goes with what follows
    white = kind == 0
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~new[1 : len(data)])
    for _ in range(3):  # to the first byte of the last white space before another character
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    quote = np.flatnonzero(start & (data == _QUOTE))
    one, two = (np.r_[data, np.zeros(3, np.uint8)][quote + k] for k in (1, 2))
    short = np.isin(one, list(b"stmd"))
    long = (np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~new[quote + 2]
    fits = (short | long) & ~new[quote + 1]
    start[quote[fits] + 1] = False
    ends = quote[fits] + np.where(long[fits], 3, 2)
    start[ends[ends < len(data)]] = True
    return np.flatnonzero(start)


def pre_token_sizes(texts: list[bytes], pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pre-tokens of texts, one after the other, the size of each, and how many each text has."""
    if pattern != GPT2:
        found = [[w.encode() for w in pre_tokens(one.decode(), pattern)] for one in texts]
        sizes = np.array([len(w) for words in found for w in words], np.int64)
        return np.frombuffer(bytearray().join(w for words in found for w in words), np.uint8), sizes, np.array([len(words) for words in found], np.int64)
    data = np.frombuffer(bytearray().join(texts), np.uint8)
    bounds = np.r_[0, np.cumsum([len(one) for one in texts], dtype=np.int64)]
    starts = _starts(data, bounds[:-1]) if len(data) else bounds[:0]
    return data, np.diff(starts, append=len(data)), np.diff(np.searchsorted(starts, bounds))


# --- bitmaps ----------------------------------------------------------------------------


def bitmap_of(df: DataFrame, position: str) -> np.ndarray:
    """A bitmap of 2**BITMAP_BITS bits with the given positions (a long column) set.

    Built by a grouped aggregation into pieces of 4 KB; at most 8 MB come to the driver, however
    many rows there are.
    """
    at = F.col(position) + 1  # the SQL functions number values from 1
    pieces = df.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in pieces.collect():
        at = (row["piece"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (bits[position >> 3] >> (position & 7).astype(np.uint8)) & 1 == 1


def in_few_jobs(df: DataFrame) -> Iterator:
    """The rows of a result of bounded size, an eighth at a time: a local iterator runs a job for each partition."""
    return df.coalesce(8).toLocalIterator()


# --- arrow --------------------------------------------------------------------------------


def binary_values(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values of so many bytes that lie one after the other in ``data``."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(values: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary array without nulls, one after the other."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.empty(0, np.uint8)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def scored(df: DataFrame, text: str, added: str, work) -> DataFrame:
    """All rows and columns of ``df`` and the columns ``added`` that ``work`` makes from the texts.

    ``work`` is called once in each task and returns a function from a list of UTF-8 texts to
    one Arrow array for each added column. Added names that ``df`` has already are replaced.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    kept = df.drop(*new.names)
    source = kept.withColumn("__text", as_bytes(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *function(texts)], names=[*batch.schema.names[:-1], *new.names])

    return source.mapInArrow(run, StructType([*kept.schema.fields, *new.fields]))
