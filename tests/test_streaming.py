import json
import os
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import session
from textloom.operators import selection
from textloom.session import shared_dir
from textloom.streaming import events as S


def as_stream(spark, df, folder, files=4):
    """The rows as several files, one per micro-batch, in row order."""
    order = df.columns[0]
    bounds = df.orderBy(order).collect()
    step = max(1, len(bounds) // files)
    for i in range(0, len(bounds), step):
        spark.createDataFrame(bounds[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def events(spark):
    rows, states = [], ["parsing", "analyzing", "rewriting", "reconstruction", "assembly", "completed"]
    for i in range(60):
        category = "error" if i % 7 == 3 else "info" if i % 11 == 5 else "progress"
        rows.append((i, f"r{i % 3}" if i % 4 else "hot", category, states[(i // 3) % 6], 1_700_000_000 + i * 900))
    df = spark.createDataFrame(rows, "event_id bigint, run_id string, category string, progress_state string, t bigint")
    return df.withColumn("event_time", F.timestamp_seconds("t")).drop("t")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_parsing_separates_invalid_messages(spark):
    good = {"run_id": "r", "timestamp": "2024-01-01T00:00:00", "category": "progress", "progress_state": "parsing",
            "token_updates": {"google": 3, "other": 1}, "more": 1}
    bad = {"category": "progress", "token_updates": {}}
    df = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("not json",)], "json string")
    rows = S.parse_events(df).collect()
    assert (rows[0].run_id, rows[0].token_updates.google, rows[0].token_updates.groq, rows[0].error) == ("r", 3, 0, None)
    assert rows[1].error == "missing: progress_state" and rows[2].raw == "not json"


def test_node_statuses(spark):
    df = spark.createDataFrame(
        [("rewriting", False), ("rewriting", True), ("completed", False), ("completed", True), ("failed", False), (None, False)],
        "s string, f boolean",
    )
    got = [[n.status for n in r[0]] for r in df.select(S.node_statuses(F.col("s"), F.col("f"))).collect()]
    idle = ["idle"] * 6
    assert got == [
        ["success", "success", "processing", "idle", "idle", "idle"],
        ["success", "success", "error", "idle", "idle", "idle"],
        ["success"] * 6, ["success"] * 5 + ["error"], idle, idle,
    ]


def test_states_stream_equals_batch(spark, tmp_path):
    stream = as_stream(spark, events(spark), tmp_path)
    live = S.run_updates(S.current_states(stream, order="event_id"), ["run_id"], str(tmp_path / "out"))
    assert rows_of(live) == rows_of(S.current_states(events(spark), order="event_id"))


def test_error_feed_against_a_plain_walk(spark, tmp_path):
    expected, known = [], {}
    for r in events(spark).orderBy("event_id").collect():
        if r.category == "progress":
            known[r.run_id] = r.progress_state
        elif r.category == "error":
            expected.append((r.run_id, r.event_id, known.get(r.run_id)))
    batch = S.error_feed(events(spark)).select("run_id", "event_id", "state")
    assert sorted(map(tuple, batch.collect()), key=repr) == sorted(expected, key=repr)
    live = S.run_error_feed(as_stream(spark, events(spark), tmp_path), str(tmp_path / "out"))
    assert rows_of(live.select("run_id", "event_id", "state")) == sorted(expected, key=repr)


def test_budget_streams_equal_batch(spark, tmp_path):
    calls = spark.createDataFrame(
        [(i, "google" if i % 3 else "groq", i, 1_700_000_000 + i * 1800) for i in range(100)], "i bigint, provider string, tokens bigint, t bigint"
    ).withColumn("ts", F.timestamp_seconds("t"))
    stream = as_stream(spark, calls, tmp_path)
    days = S.run_updates(S.daily_tokens(stream), ["provider", "day_start"], str(tmp_path / "days"))
    assert rows_of(days) == rows_of(S.daily_tokens(calls))
    minutes = S.run_updates(S.requests_per_minute(stream), ["provider", "minute_start"], str(tmp_path / "minutes"))
    assert rows_of(minutes) == rows_of(S.requests_per_minute(calls))


def test_late_calls_are_dropped_past_the_watermark(spark, tmp_path):
    day = 86_400
    times = [10 * day, 10 * day + 60, 20 * day, 20 * day + 60, 10 * day + 120]
    for n, t in enumerate(times):
        spark.createDataFrame([("google", 1, t)], "provider string, tokens bigint, t bigint").withColumn(
            "ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    schema = T.StructType([T.StructField("provider", T.StringType()), T.StructField("tokens", T.LongType()),
                           T.StructField("t", T.LongType()), T.StructField("ts", T.TimestampType())])
    # one folder per trigger: the next run continues from the checkpoint
    for n in range(len(times)):
        (tmp_path / "all").mkdir(exist_ok=True)
        for file in (tmp_path / f"in{n}").glob("*.parquet"):
            file.rename(tmp_path / "all" / f"{n}.parquet")
        got = S.run_updates(S.daily_tokens(spark.readStream.schema(schema).parquet(f"{tmp_path}/all")),
                            ["provider", "day_start"], str(tmp_path / "out"))
    assert sorted(r.tokens for r in got.collect()) == [2, 2]


def test_score_monitor_equals_batch(spark, tmp_path):
    scores = {0: [50.0, 49.0, 48.0, 60.0], 1: [80.0, 40.0, 10.0], 2: [60.0, 75.0]}
    rows = [(i, "r", seq, i, s) for seq, values in scores.items() for i, s in enumerate(values)]
    df = spark.createDataFrame(rows, "o int, run_id string, sequence_no bigint, iteration int, score double")
    live = S.run_append(S.score_monitor(as_stream(spark, df, tmp_path).drop("o")), str(tmp_path / "out")).collect()
    told = {(r.sequence_no, r.iteration): (r.previous_score, r.stall_count, r.best_score, r.stop_reason) for r in live}
    assert told == {
        (0, 1): (50.0, 1, 49.0, None), (0, 2): (49.0, 2, 48.0, "stalled twice"),
        (1, 1): (80.0, 0, 40.0, None), (1, 2): (40.0, 0, 10.0, "exit score"), (2, 1): (60.0, 0, 60.0, "degraded"),
    }
    batch = selection.convergence_flags(df.withColumns({"text": F.lit("t"), "from_fallback": F.lit(False)}))
    flags = {(r.sequence_no, r.iteration): (r.degraded, r.stalled, r.stall_count, r.delta) for r in batch.collect()}
    assert all(flags[r.sequence_no, r.iteration] == (r.degraded, r.stalled, r.stall_count, r.delta) for r in live)
    chosen = {r.sequence_no: r.stop_reason for r in selection.select_candidates(df.withColumns({"text": F.lit("t"), "from_fallback": F.lit(False)})).collect()}
    assert chosen == {r.sequence_no: r.stop_reason for r in live if r.stop_reason}


def test_score_monitor_passes_over_lost_masks_and_low_baselines(spark, tmp_path):
    rows = [(0, "r", 0, 0, 60.0, True), (1, "r", 0, 1, 1.0, False), (2, "r", 0, 2, 50.0, True), (3, "r", 1, 0, 10.0, True), (4, "r", 1, 1, 5.0, True)]
    df = spark.createDataFrame(rows, "o int, run_id string, sequence_no bigint, iteration int, score double, accepted boolean")
    live = S.run_append(S.score_monitor(as_stream(spark, df, tmp_path).drop("o")), str(tmp_path / "out"))
    assert [(r.sequence_no, r.iteration, r.score) for r in live.collect()] == [(0, 2, 50.0)]


def test_intake_stream_equals_batch(spark, tmp_path):
    from textloom.plans.documents import prepare_documents

    docs = spark.createDataFrame([(i, f"Text {i} [1].\n\n" + "word " * 300) for i in range(6)], "doc_id bigint, text string")
    live = S.run_append(S.intake_stream(as_stream(spark, docs, tmp_path)), str(tmp_path / "out"))
    assert rows_of(live.withColumn("paragraph_indices", F.col("paragraph_indices").cast("string"))) == rows_of(
        prepare_documents(docs)[0].withColumn("paragraph_indices", F.col("paragraph_indices").cast("string")))


def test_shared_folder_setting_is_read(spark, tmp_path):
    def made(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get("folder", default)), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(made("spark://host:7077", folder=str(tmp_path))).startswith(f"{tmp_path}/textloom-")
    assert "textloom-" in shared_dir(made("local[4]"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(made("yarn"))


def test_release_deletes_what_was_written(spark):
    folder = shared_dir(spark)
    spark.range(3).write.parquet(f"{folder}/table")
    assert os.path.exists(folder)
    session.release(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("name", ["parsed_status_events", "run_states_stream", "error_feed_stream", "score_monitor_stream", "daily_tokens_stream", "requests_per_minute_stream", "intake_stream"])
def test_streams_read_tables_in_parts(spark, tmp_path, name):
    from textloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    for table in ("events", "documents"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    assert rows_of(QUERIES[name](spark, str(tmp_path))) == rows_of(QUERIES[name](spark, sf)) != []


def test_late_progress_counts_where_it_belongs(spark, tmp_path):
    at = [datetime(2024, 1, 1, h) for h in range(5)]
    schema = "o int, run_id string, event_id bigint, event_time timestamp, category string, progress_state string"
    rows = [(0, "r", 3, at[3], "progress", "assembly"), (1, "r", 4, at[4], "error", None), (2, "r", 1, at[1], "progress", "parsing"), (3, "r", 2, at[2], "error", None)]
    df = spark.createDataFrame(rows, schema)
    live = S.run_error_feed(as_stream(spark, df, tmp_path).drop("o"), str(tmp_path / "out"))
    assert {(r.event_id, r.state) for r in live.collect()} == {(4, "assembly"), (2, "parsing")}


def test_intake_keeps_maps_and_rejected_rows(spark, tmp_path):
    docs = spark.createDataFrame([(0, "Text [1]. " + "word " * 20), (1, "  "), (2, "x" * 200_000)], "doc_id bigint, text string")
    chunks, maps, rejected = S.run_intake(as_stream(spark, docs, tmp_path), folder=str(tmp_path / "out"))
    assert {r.doc_id for r in chunks.collect()} == {0, 2} == {r.doc_id for r in maps.collect()}
    assert [tuple(r) for r in rejected.collect()] == [(1, "empty")]


def test_a_batch_of_one_file_is_dealt_over_the_cores(spark, tmp_path):
    spark.range(64).select(F.col("id").alias("doc_id"), F.lit("One two. Three.").alias("text")).coalesce(1).write.parquet(str(tmp_path / "docs"))
    chunks, _, _ = S.run_intake(S.read_stream(spark, str(tmp_path / "docs")), folder=str(tmp_path / "out"))
    assert chunks.count() == 64 and len([f for f in chunks.inputFiles() if "epoch=0" in f]) > 1
