"""Admission and naming of texts and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import join, let, strip
from textloom.functions.text import document_name, length_band


#: Files up to this size are opened by Spark's binary source, which loads them whole.
OPENED = 16 << 20


def _text_reason(trimmed: Column, limit: int | None) -> Column:
    reason = F.when(F.coalesce(trimmed, F.lit("")) == "", "empty")
    return reason if limit is None else reason.when(F.length(trimmed) > limit, "too long")


def screen_documents(df: DataFrame, text: str = "text", name: str | None = None, limit: int | None = V.MAX_TEXT_CHARS) -> DataFrame:
    """Trim every text, name it and say why it would be rejected (null = admitted).

    ``limit``: the most characters of a text; None takes texts of any length.
    """
    trimmed = df.withColumn(text, strip(F.col(text)))
    given = F.col(name) if name else F.lit(None).cast("string")
    return trimmed.withColumns(
        {
            "name": document_name(given, F.coalesce(F.col(text), F.lit(""))),
            "band": length_band(F.coalesce(F.col(text), F.lit(""))),
            "reason": _text_reason(F.col(text), limit),
        }
    )


def split_admitted(screened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected with reason)."""
    return screened.filter(F.col("reason").isNull()).drop("reason"), screened.filter(F.col("reason").isNotNull())


def file_reason(
    path: Column, length: Column, head: Column | None, suffix: str = V.FILE_SUFFIX, magic: str = V.FILE_MAGIC, most: int = V.MAX_FILE_BYTES
) -> Column:
    """Why a file is rejected; without ``head`` only what name and size say."""
    named = F.when(~F.endswith(F.lower(F.coalesce(path, F.lit(""))), F.lit(suffix)), "extension").when(length > most, "size")
    return named if head is None else named.when(~F.coalesce(head == magic, F.lit(False)), "signature")


def admit_files(
    spark: SparkSession, path: str, suffix: str = V.FILE_SUFFIX, magic: str = V.FILE_MAGIC, most: int = V.MAX_FILE_BYTES
) -> DataFrame:
    """Manifest of a folder of files with the reason each is rejected (null = admitted).

    Files that name or size reject come from a listing alone. Only the others are opened: the suffix
    is part of their listing's pattern and the size a filter the source applies before it reads. Up to
    OPENED bytes they are read by Spark, many in one task. The binary source can only load files
    whole, so of each larger one (at most one for every OPENED bytes of the folder) the driver reads as
    many bytes as the signature has, through the file system of its path, and no task reads any. Spark's file source passes
    over files without a byte.
    """
    def scan(**options: str) -> DataFrame:
        return spark.read.format("binaryFile").options(recursiveFileLookup="true", **options).load(path)

    rejected = file_reason(F.col("path"), F.col("length"), None, suffix, magic, most)
    listed = scan().select("path", "length", "modificationTime", rejected.alias("reason")).filter(F.col("reason").isNotNull())
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    head = F.decode(F.substring("content", 1, len(magic)), "ISO-8859-1")

    def judged(files: DataFrame, head: Column) -> DataFrame:
        reason = file_reason(F.col("path"), F.col("length"), head, suffix, magic, most)
        return files.select("path", "length", "modificationTime", reason.alias("reason"))

    found = listed.unionByName(judged(scan(pathGlobFilter=pattern).filter(F.col("length") <= min(most, OPENED)), head))
    if most <= OPENED:
        return found
    large = scan(pathGlobFilter=pattern).filter(F.col("length").between(OPENED + 1, most)).select("path", "length", "modificationTime")
    heads = [(r.path, _head(spark, r.path, len(magic))) for r in large.select("path").toLocalIterator()]
    if not heads:
        return found
    return found.unionByName(judged(large.join(spark.createDataFrame(heads, "path string, head string"), "path"), F.col("head")))


def _head(spark: SparkSession, path: str, size: int) -> str:
    """The first bytes of a file, one character for each."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(b for b in (stream.read() for _ in range(size)) if b >= 0).decode("latin-1")
    finally:
        stream.close()


def compare_texts(chunks: DataFrame, raw: str = "raw_text", processed: str = "processed") -> DataFrame:
    """Lengths, equality and opening snippets of a text before and after."""
    a, b = F.coalesce(raw, F.lit("")), F.coalesce(processed, F.lit(""))
    return chunks.withColumns(
        {
            "raw_length": F.length(a),
            "processed_length": F.length(b),
            "unchanged": a == b,
            "raw_snippet": F.substring(a, 1, V.SNIPPET_CHARS),
            "processed_snippet": F.substring(b, 1, V.SNIPPET_CHARS),
        }
    )


#: What parts a text into the pieces that terms are looked up in.
_BETWEEN = " .,;:!?\n\t()\""


def _absent(text: Column, terms: Column) -> Column:
    """The terms that do not occur in the text, each once, with null if it is among them.

    A term that is a piece of the text is found by its hash. The others are searched for: in the
    different pieces, if they hold nothing that parts pieces, since such a term lies within one.
    """
    def searched(text: Column, terms: Column, pieces: Column, joined: Column) -> Column:
        def held(term: Column) -> Column:
            whole = F.translate(term, _BETWEEN, "") == term
            return F.coalesce(F.when(whole, F.contains(joined, term)).otherwise(F.contains(text, term)), F.lit(False))

        return F.filter(F.array_except(terms, pieces), lambda t: ~held(t))

    def by_piece(text: Column, terms: Column) -> Column:
        pieces = F.array_distinct(F.split(F.translate(text, _BETWEEN, " " * len(_BETWEEN)), " "))
        return let(pieces, lambda p: let(join(p, " "), lambda joined: searched(text, terms, p, joined)))

    return let(text, lambda s: let(terms, lambda t: by_piece(s, t)))


def glossary_check(df: DataFrame, source: str, processed: str, glossary: str) -> DataFrame:
    """Terms of the row's own glossary that the source has and the processed text lost.

    A run carries its own short glossary, so this is a filter over the row's array
    and never a join of all texts with all terms.
    """
    def chosen(terms: Column, text: Column, among: bool) -> Column:
        def told(t: Column, absent: Column) -> Column:
            plain = F.array_except(t, absent) if not among else F.filter(absent, lambda x: x.isNotNull())
            each = F.filter(t, lambda x: x.isNotNull() & (F.coalesce(F.array_contains(absent, x), F.lit(False)) == F.lit(among)))
            return F.when(F.size(F.array_distinct(t)) == F.size(t), plain).otherwise(each)  # repeated terms stay repeated

        found = let(terms, lambda t: let(_absent(text, t), lambda absent: told(t, absent)))
        return F.when(text.isNull(), F.filter(terms, lambda _: F.lit(False))).otherwise(found)

    df = df.withColumn("expected_terms", chosen(F.col(glossary), F.col(source), among=False))
    return df.withColumn("lost_terms", chosen(F.col("expected_terms"), F.col(processed), among=True))
