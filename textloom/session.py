"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # State of streams lies in RocksDB, off the heap; keyed state with timers needs it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


#: Folders handed out by shared_dir and not released yet.
_folders: list[str] = []


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("textloom")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder every executor can reach, below the one the session names in spark.checkpoint.dir.

    Only a session that runs in this one process may leave that unset and gets a temporary folder.
    ``release`` deletes all folders handed out.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    folder = f"{root.rstrip('/')}/textloom-{uuid.uuid4()}"
    _folders.append(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Delete the folders handed out so far; DataFrames that read them end here."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _folders:
        folder = path(_folders.pop())
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read and return the written table.

    Unlike a cache it survives the loss of executors, and the costly steps before it
    run once.
    """
    folder = shared_dir(df.sparkSession)
    df.write.parquet(f"{folder}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")
