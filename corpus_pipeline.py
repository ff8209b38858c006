"""The corpus pipeline: toxicity, language, near duplicates, source mix, tokens.

``run`` applies STAGES to ``documents``; every stage is written as Parquet to the shared folder and
read again as the next one's documents. All stages but the last return the columns of documents, and
rows of documents, whole. A document the toxicity stage scores at 0.3 or more goes; one the language
stage rejects (no letters, or no language likely enough) goes; of every group of near duplicates the
document with the smallest id stays; the source mix keeps a document as often as it is taken (never,
once or twice), so rows may repeat after it. The last stage returns doc_id, n_tokens, ids_sha256 and
decoded_sha256 for every row.

Null ids: such rows pass every stage but are not told apart by it; the near-duplicate stage keeps
them. Empty tables give empty results in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.byte_bpe import digests, encode_documents
from textloom.llm.common import small_batches, table
from textloom.llm.language_id import identify_languages
from textloom.llm.ngram_join import one_of_each_group
from textloom.llm.queries import LANGUAGES
from textloom.llm.source_mix import mix_sources, word_count
from textloom.llm.toxicity import judge_toxicity
from textloom.session import prepare, stored

#: SQL cannot express trained models and seeded selections; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(prepare(spark))
    judged = judge_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return judged.filter("predicted = 0").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(prepare(spark))
    return identify_languages(docs, LANGUAGES, declared="lang", host="source").filter("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(prepare(spark))
    return one_of_each_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(prepare(spark))
    sized = docs.withColumn("__size", word_count("text")).withColumn("__sources", F.array("source"))
    mixed = mix_sources(sized, "__sources", "__size").filter("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("__size")).cast("int"))
    return mixed.withColumn("__copy", F.explode(times)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(prepare(spark))
    return digests(encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
