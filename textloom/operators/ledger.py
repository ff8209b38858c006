"""Run, chunk and quota tables: updates, deletions, listings and audits.

Updates produce a new snapshot instead of changing rows in place; ``commit_updates`` and
``commit_deletion`` make it the current version of a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import each
from textloom.functions.text import safe_stem
from textloom.sources.snapshots import commit_snapshot, read_snapshot, versions


def apply_updates(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Chunks with processed text and iteration count replaced where an update exists.

    Of several updates of a chunk the one with the most iterations counts, of equal
    ones the one with the largest text.
    """
    keys = ["run_id", "sequence_no"]
    last = updates.groupBy(*keys).agg(F.max(F.struct("iterations", "processed")).alias("_l"))
    new = last.select(*keys, F.col("_l.processed").alias("_p"), F.col("_l.iterations").alias("_i"), F.lit(True).alias("_u"))
    hit = F.coalesce("_u", F.lit(False))
    return chunks.join(new, keys, "left").withColumns(
        {
            "processed": F.when(hit, F.col("_p")).otherwise(F.col("processed")),
            "iterations": F.when(hit, F.col("_i")).otherwise(F.col("iterations")),
        }
    ).drop("_p", "_i", "_u")


def finish_runs(runs: DataFrame, chunks: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Runs after processing: total_chunks counted, the status set, the summary kept or replaced.

    A run is completed when all of its chunks are processed and failed when it has none or
    some are not. ``summaries``: (run_id, master_summary), one row for a run counts.
    """
    counted = chunks.groupBy("run_id").agg(F.count("*").alias("_n"), F.count("processed").alias("_done"))
    done = F.coalesce(F.col("_n") == F.col("_done"), F.lit(False))
    out = runs.join(counted, "run_id", "left").withColumns(
        {"total_chunks": F.coalesce("_n", F.lit(0)), "status": F.when(done, "completed").otherwise("failed")}
    ).drop("_n", "_done")
    if summaries is None:
        return out
    new = summaries.groupBy("run_id").agg(F.max("master_summary").alias("_s"))
    return out.join(new, "run_id", "left").withColumn("master_summary", F.coalesce("_s", "master_summary")).drop("_s")


def quota_listing(quotas: DataFrame) -> DataFrame:
    """(provider, used_today, daily_limit, rpm_limit) of every quota record, as the table states list them."""
    return quotas.select("provider", "used_today", "daily_limit", "rpm_limit")


def delete_runs(runs: DataFrame, chunks: DataFrame, ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given runs; None deletes all runs."""
    if ids is None:
        return runs.limit(0), chunks.limit(0)
    gone = ids.select("run_id")  # no distinct: Spark can only split a hot run between two plain shuffles
    return runs.join(gone, "run_id", "left_anti"), chunks.join(gone, "run_id", "left_anti")


def runs_with_chunks(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Runs with their chunks; runs without chunks appear once with nulls.

    Written as an inner join plus the childless runs: an inner join lets Spark split
    a run that owns a large share of all chunks, an outer join on that side does not.
    """
    matched = runs.join(chunks, "run_id")
    childless = runs.join(chunks.select("run_id").distinct(), "run_id", "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def latest_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    """The n most recently started runs, run_id breaking ties."""
    return runs.orderBy(F.desc("start_time"), "run_id").limit(n)


def latest_runs_with_chunks(runs: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """All chunks of the n latest runs; n rows are broadcast, the chunk table is not shuffled."""
    latest = latest_runs(runs, n)
    own = chunks.join(F.broadcast(latest.select("run_id")), "run_id", "left_semi")
    return runs_with_chunks(latest, own)


def run_kind(filename: Column) -> Column:
    return F.when(F.endswith(F.lower(F.coalesce(filename, F.lit(""))), F.lit(V.FILE_SUFFIX)), "PDF").otherwise("Text")


def label_runs(runs: DataFrame) -> DataFrame:
    """Add the run's kind and the display label of its status."""
    label = F.coalesce(F.nullif("status", F.lit("")), F.lit("Unknown"))
    for status, text in V.RUN_LABELS.items():
        label = F.when(F.col("status") == status, text).otherwise(label)
    return runs.withColumns({"kind": run_kind(F.col("filename")), "status_label": label})


def audit_runs(runs: DataFrame) -> DataFrame:
    """(run_id, violation): status outside the domain, or a run without a summary."""
    checks = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("status").isin(*V.RUN_STATUSES), F.lit(False)), "status"),
            F.when(F.col("master_summary").isNull(), "summary missing"),
        )
    )
    return each(runs, ["run_id"], checks, "_pos", "violation").drop("_pos")


def orphan_chunks(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks whose run does not exist."""
    return chunks.join(runs.select("run_id"), "run_id", "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def table_states(quotas: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, row_count) of the three tables."""
    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")

    return counted("api_quotas", quotas).unionByName(counted("paper_runs", runs)).unionByName(
        counted("text_chunks", chunks)
    )


def resolve_artifacts(
    runs: DataFrame, manifest: DataFrame, pdf_suffix: str = "_final.pdf", text_suffix: str = "_result.txt",
    name_suffix: str = "_result",
) -> DataFrame:
    """The file to hand out for every run, or an error if it has none.

    A run whose name ends in .pdf gets its PDF if that exists; every other case
    takes the text file.
    """
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    owner = F.regexp_replace(name, rf"(?:\Q{pdf_suffix}\E|\Q{text_suffix}\E)\z", "")
    files = manifest.select(owner.alias("run_id"), "path", name.alias("_name")).groupBy("run_id").agg(
        F.min(F.when(F.endswith("_name", F.lit(pdf_suffix)), F.col("path"))).alias("_pdf"),
        F.min(F.when(F.endswith("_name", F.lit(text_suffix)), F.col("path"))).alias("_txt"),
    )
    filename = F.coalesce(F.nullif("filename", F.lit("")), F.lit("document"))
    use_pdf = (run_kind(filename) == "PDF") & F.col("_pdf").isNotNull()
    path = F.when(use_pdf, F.col("_pdf")).otherwise(F.col("_txt"))
    extension = F.when(use_pdf, F.lit(".pdf")).otherwise(F.lit(".txt"))
    return runs.join(files, "run_id", "left").select(
        "run_id", path.alias("path"),
        F.when(path.isNotNull(), F.concat(safe_stem(filename, name_suffix), extension)).alias("download_name"),
        F.when(path.isNull(), F.lit("result not found")).alias("error"),
    )



def commit_updates(spark: SparkSession, store: str, updates: DataFrame) -> int:
    """Apply updates to the table ``chunks`` of a store; the new version."""
    base = versions(spark, store)[-1]
    chunks = read_snapshot(spark, store, base)["chunks"]
    return commit_snapshot(spark, store, {"chunks": apply_updates(chunks, updates)}, base)


def commit_deletion(spark: SparkSession, store: str, ids: DataFrame | None) -> int:
    """Delete runs and their chunks from the tables ``runs`` and ``chunks`` of a store, both in one version."""
    base = versions(spark, store)[-1]
    tables = read_snapshot(spark, store, base)
    runs, chunks = delete_runs(tables["runs"], tables["chunks"], ids)
    return commit_snapshot(spark, store, {"runs": runs, "chunks": chunks}, base)
