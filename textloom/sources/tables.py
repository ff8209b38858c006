"""Reading and writing of documents and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Documents from a table, or one document per file with its name for ``text``."""
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(
            F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")
        )
    return spark.read.format(fmt).load(path)


def write_results(
    df: DataFrame, path: str, partition: str | list[str] | None = None, fmt: str = "parquet", only_given: bool = False
) -> None:
    """Write all results anew, or with ``only_given`` just the partitions that ``df`` has rows for."""
    writer = df.write.mode("overwrite").format(fmt)
    if only_given and not partition:
        raise ValueError("only tables with partitions can be replaced in part")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic" if only_given else "static")
        writer = writer.partitionBy(*([partition] if isinstance(partition, str) else partition))
    writer.save(path)


def write_texts(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    """Result texts as lines of JSON-free text, partitioned by a hash bucket of the key."""
    bucketed = df.select(F.pmod(F.hash(key), F.lit(64)).alias("bucket"), F.to_json(F.struct(key, text)).alias("value"))
    bucketed.write.mode("overwrite").partitionBy("bucket").text(path)


def to_timestamp(column: Column) -> Column:
    """ISO-8601 text to a timestamp; unreadable text gives null."""
    return F.try_to_timestamp(column)
