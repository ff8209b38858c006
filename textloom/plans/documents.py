"""Whole jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.operators.chunking import block_paragraphs, chunk_documents, chunk_paragraphs, new_chunk_rows, reassemble
from textloom.operators.intake import screen_documents
from textloom.operators.layout import distribute_chunks
from textloom.operators.masking import mask_all, merge_maps, restore_soft, restore_tokens
from textloom.operators.selection import select_candidates
from textloom.session import stored


def prepare_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text",
    target: int = V.TARGET_WORDS, maximum: int = V.MAX_WORDS, store: bool = False, limit: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Admit, mask and chunk texts: (chunks, token maps, rejected).

    Everything up to the chunks happens inside the document's row. The token maps
    stay at one row per document instead of being repeated on every chunk. With
    ``store`` masked texts and chunks become tables in the shared folder, which is
    what a job needs whose candidate texts come back later. Texts of any length are
    taken unless ``limit`` gives the most characters.
    """
    screened = screen_documents(documents.select(key, text), text, limit=limit)
    rejected = screened.filter(F.col("reason").isNotNull()).select(key, "reason")
    masked = masked_documents(screened, key, text)
    if store:
        masked = stored(masked)
    chunks = chunk_documents(masked.select(key, "masked"), "masked", target, maximum, [key])
    return (stored(chunks) if store else chunks), masked.drop("masked"), rejected


def masked_documents(screened: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, name, masked, token_map) of the admitted texts."""
    masked = mask_all(screened.filter(F.col("reason").isNull()), text, "masked")
    return masked.select(
        key, "name", "masked", merge_maps(F.col("citation_map"), F.col("math_map")).alias("token_map")
    )


def prepare_pages(
    blocks: DataFrame, key: str, target: int = V.TARGET_WORDS, maximum: int = V.MAX_WORDS
) -> DataFrame:
    """Chunks of documents given as block arrays; paragraph indices are block positions."""
    paras = blocks.select(key, block_paragraphs(F.col("blocks")).alias("_paras"))
    return chunk_paragraphs(paras, "_paras", target, maximum, [key])


def prepare_page_documents(
    pages: DataFrame, key: str, target: int = V.TARGET_WORDS, maximum: int = V.MAX_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mask and chunk pages given as (key, blocks): (chunks, masked blocks, token maps).

    The text blocks of a page are masked as one text, so a token means the same in all of them, and
    split again at the blank lines between them. A page whose masks run over a blank line keeps
    its blocks unmasked and has no tokens.
    """
    gap = "\n\n"
    texts = pages.select(key, block_paragraphs(F.col("blocks")).alias("_paras"))
    texts = texts.withColumn("_joined", F.array_join(F.transform("_paras", lambda p: F.regexp_replace(p["text"], V.PARAGRAPH_GAP, "\n")), gap))
    masked = mask_all(texts, "_joined", "_shown").withColumn("_parts", F.split("_shown", gap))
    whole = F.size("_parts") == F.size("_paras")
    paras = F.zip_with("_paras", "_parts", lambda p, t: F.struct(p["index"].alias("index"), t.alias("text")))
    token_map = merge_maps(F.col("citation_map"), F.col("math_map"))
    masked = stored(masked.select(
        key, F.when(whole, paras).otherwise(F.col("_paras")).alias("_paras"),
        F.when(whole, token_map).otherwise(F.map_filter(token_map, lambda _, __: F.lit(False))).alias("token_map"),
    ))
    chunks = stored(chunk_paragraphs(masked.select(key, "_paras"), "_paras", target, maximum, [key]))
    blocks = masked.select(key, F.explode("_paras").alias("_p")).select(
        key, F.col("_p.index").alias("original_index"), F.col("_p.index").alias("block_no"), F.col("_p.text").alias("text")
    )
    return chunks, blocks, masked.select(key, "token_map")


def finish_page_documents(chunks: DataFrame, blocks: DataFrame, maps: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """(key, original_index, text, error): the chosen texts laid onto their blocks and restored.

    Chunks without any attempt keep their own text. A block that was cut over several chunks gets
    its pieces in the order of the chunks.
    """
    chosen = select_candidates(attempts, keys=[key, "chunk_id"]).select(key, "chunk_id", "processed")
    final = chunks.join(chosen, [key, "chunk_id"], "left").withColumn("processed", F.coalesce("processed", "text"))
    dealt = distribute_chunks(final, blocks, key).select(key, "original_index", "chunk_id", "rewritten_text")
    pieces = F.array_sort(F.collect_list(F.struct("chunk_id", "rewritten_text")))
    laid = dealt.groupBy(key, "original_index").agg(pieces.alias("_p"))
    laid = laid.select(key, "original_index", F.array_join(F.col("_p.rewritten_text"), " ").alias("text")).join(maps, key)
    restored = laid.withColumn("_r", restore_tokens(F.col("text"), F.col("token_map")))
    return restored.select(
        key, "original_index", F.coalesce("_r.text", restore_soft(F.col("text"), F.col("token_map"))).alias("text"),
        F.col("_r.error").alias("error"),
    )


def chunk_table(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return new_chunk_rows(chunks.withColumnRenamed(key, "run_id"))


def finish_documents(chunks: DataFrame, maps: DataFrame, attempts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Choose a text per chunk, put the documents together and restore the masks.

    Chunks without any attempt keep their own text. A text that still holds tokens
    after the strict restore falls back to the soft one, with the error kept.
    """
    chosen = select_candidates(attempts, keys=[key, "chunk_id"]).select(key, "chunk_id", "processed")
    merged = chunks.join(chosen, [key, "chunk_id"], "left").select(
        key, "chunk_id", F.coalesce("processed", "text").alias("text")
    )
    whole = reassemble(merged, key, "chunk_id", "text").join(maps, key)
    restored = restore_tokens(F.col("text"), F.col("token_map"))
    return whole.withColumn("_r", restored).select(
        key, "name",
        F.coalesce("_r.text", restore_soft(F.col("text"), F.col("token_map"))).alias("text"),
        F.col("_r.error").alias("error"),
    )
