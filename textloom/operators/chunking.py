"""Word-budget chunking and character slicing of whole documents.

A document's chunk boundaries depend on everything before them, so the fold runs
inside the document's row and carries integers only: running word count and the
start positions of the chunks. Chunk texts are cut from the unit array
afterwards. No shuffle is needed and documents are independent of each other.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import each, fold, join, let, strip, ws_count
from textloom.functions.text import paragraphs, sentences_chunk, spans, split_long

_BY_PARAGRAPH, _PACK, _BREAK = 0, 1, 2
_SENTENCE_GAP = rf"([.!?]){V.WS}+"


def _units(paras: Column, target: int, maximum: int) -> Column:
    """Smallest pieces the budget is applied to, with the rule for each.

    A paragraph within the maximum is one piece. A larger one becomes sentences,
    and a sentence above the target becomes clauses; both open a new chunk.
    """
    def unit(index, count, rule, text) -> Column:
        return F.struct(
            index.alias("index"), count.alias("words"), F.lit(rule).alias("rule") if isinstance(rule, int)
            else rule.alias("rule"), text.alias("text"),
        )

    def first_breaks(i: Column) -> Column:
        return F.when(i == 0, F.lit(_BREAK)).otherwise(F.lit(_PACK))

    def sentence_units(index: Column, text: Column) -> Column:
        def pieces(s: Column, i: Column) -> Column:
            whole = let(ws_count(s), lambda n: F.when(n <= target, F.array(unit(index, n, first_breaks(i), s))))
            parts = F.transform(split_long(s, target), lambda x, j: unit(index, ws_count(x), first_breaks(j), x))
            return F.coalesce(whole, parts)

        return F.flatten(F.transform(sentences_chunk(text), pieces))

    def paragraph_units(p: Column) -> Column:
        small = let(
            ws_count(p["text"]),
            lambda n: F.when(
                n <= maximum,
                F.array(unit(p["index"], n, _BY_PARAGRAPH, F.regexp_replace(p["text"], _SENTENCE_GAP, "$1 "))),
            ),
        )
        return F.coalesce(small, sentence_units(p["index"], p["text"]))

    return F.flatten(F.transform(paras, paragraph_units))


def _chunk_starts(units: Column, target: int, maximum: int) -> Column:
    substantial = max(1, target // 2)
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts")
    )

    def step(state: Column, u: Column) -> Column:
        total, n = state["total"], u["words"]
        closes = (total > 0) & (
            (u["rule"] == _BREAK)
            | (total + n > maximum)
            | ((u["rule"] == _BY_PARAGRAPH) & (total + n > target) & (total >= substantial))
        )
        opens = closes | (state["at"] == 0)
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(closes, n).otherwise(total + n).alias("total"),
            F.when(opens, F.array_append(state["starts"], state["at"] + 1)).otherwise(state["starts"]).alias("starts"),
        )

    return fold(units, start, step, lambda s: s["starts"])


def chunk_paragraphs(
    df: DataFrame, paras: str, target: int = V.TARGET_WORDS, maximum: int = V.MAX_WORDS, keep: list[str] | None = None
) -> DataFrame:
    """One row per chunk of a row's array<struct(index, text)> of paragraphs.

    Columns: the kept ones, chunk_id, text, word_count, paragraph_indices.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != paras]
    df = df.withColumn("_units", _units(F.col(paras), target, maximum))
    df = df.withColumn("_starts", _chunk_starts(F.col("_units"), target, maximum))
    df = each(df, [*keep, "_units"], spans(F.col("_starts"), F.size("_units")), "chunk_id", "_span")
    df = df.select(*keep, "chunk_id", F.slice("_units", F.col("_span.start"), F.col("_span.length")).alias("_part"))
    return df.select(
        *keep,
        "chunk_id",
        join(F.col("_part.text"), " ").alias("text"),
        fold(F.col("_part.words"), F.lit(0), lambda a, n: a + n).alias("word_count"),
        F.array_distinct(F.col("_part.index")).alias("paragraph_indices"),
    )


def chunk_documents(
    df: DataFrame, text: str = "text", target: int = V.TARGET_WORDS, maximum: int = V.MAX_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Chunk whole texts whose paragraphs are separated by blank lines."""
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    df = df.select(*keep, paragraphs(F.col(text)).alias("_paras"))
    return chunk_paragraphs(df, "_paras", target, maximum, keep)


def block_paragraphs(blocks: Column) -> Column:
    """Paragraph array of a block array: one paragraph per non-blank block, index = position."""
    numbered = F.transform(
        blocks, lambda b, i: F.struct(i.cast("int").alias("index"), strip(b["text"]).alias("text"))
    )
    return F.filter(numbered, lambda p: p["text"] != "")


def _slices(text: str, max_chars: int) -> list[str]:
    """The pieces of one text. Only places in the text are carried from piece to piece."""
    space = "[" + re.escape(V.WS_CHARS) + "]"
    boundaries = [(re.compile(p), shift) for p, shift in ((rf"\n{space}*\n", 0), (rf"[.!?]{space}", 1), (rf"[,;:]{space}", 1), (space, 0))]
    lookback = max(0, max_chars - V.SHIFT_BACK_CHARS)
    text, at, pieces = text.strip(V.WS_CHARS), 0, []
    while at < len(text):
        end = len(text)
        if end - at > max_chars:
            window, end = text[at + lookback : at + max_chars], at + max_chars
            for pattern, shift in boundaries:
                starts = [m.start() for m in pattern.finditer(window)]
                if starts:
                    end = at + lookback + starts[-1] + shift
                    break
        pieces.append(text[at:end].strip(V.WS_CHARS))
        at = end
        while at < len(text) and text[at] in V.WS_CHARS:
            at += 1
    return pieces


def slice_chars(text: Column, max_chars: int) -> Column:
    """Array of pieces of at most ``max_chars``, cut at the best boundary nearby.

    Looks back up to 150 characters for the last paragraph break, else sentence
    end, else clause end, else white space. Where a piece ends depends on where it
    began, so this is a loop over one text, in Arrow batches; its time is linear in the text.
    """

    @F.arrow_udf("array<string>")
    def sliced(texts: pa.Array) -> pa.Array:
        return pa.array([_slices(t, max_chars) if t is not None else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return sliced(text)


def new_chunk_rows(chunks: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Chunk table rows before processing; the key depends only on run and sequence."""
    return chunks.select(
        F.sha2(F.concat_ws("|", F.col(run_id).cast("string"), F.col("chunk_id").cast("string")), 256).alias("chunk_id"),
        F.col(run_id).alias("run_id"),
        F.col("chunk_id").alias("sequence_no"),
        F.col("text").alias("raw_text"),
        F.col("text").alias("clean_text"),
        F.lit(None).cast("string").alias("processed"),
        F.lit(0).alias("iterations"),
    )


def reassemble(pieces: DataFrame, key: str, position: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Ordered pieces back into one text per key, whatever their number.

    Exact copies of a piece collapse before the shuffle. What meets for a key is
    its text, which the result holds as one value anyway.
    """
    entry = F.struct(F.col(position).alias("p"), F.col(text).alias("t"))
    return (
        pieces.groupBy(key)
        .agg(F.array_sort(F.collect_set(entry)).alias("_pieces"))
        .select(key, join(F.col("_pieces.t"), separator).alias(text), F.size("_pieces").alias("n_pieces"))
    )
