"""Versioned stores, the scan of files, and the state that streams keep."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_streaming import as_stream, rows_of
from textloom.operators import intake, ledger
from textloom.sources import snapshots, tables
from textloom.streaming import events as S

# --- stores -----------------------------------------------------------------------------------


def store_of(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, status string")
    chunks = spark.createDataFrame([(1, 0, None, 0), (1, 1, None, 0), (2, 0, None, 0)], "run_id long, sequence_no long, processed string, iterations int")
    path = str(tmp_path / "store")
    assert snapshots.versions(spark, path) == []
    assert snapshots.commit_snapshot(spark, path, {"runs": runs, "chunks": chunks}) == 1
    return path


def test_updates_and_deletions_are_versions(spark, tmp_path):
    path = store_of(spark, tmp_path)
    updates = spark.createDataFrame([(1, 1, "new", 2)], "run_id long, sequence_no long, processed string, iterations int")
    assert ledger.commit_updates(spark, path, updates) == 2
    assert ledger.commit_deletion(spark, path, spark.createDataFrame([(2,)], "run_id long")) == 3
    processed = [{(r.run_id, r.sequence_no, r.processed) for r in snapshots.read_snapshot(spark, path, v)["chunks"].collect()} for v in (1, 2, 3)]
    assert processed == [{(1, 0, None), (1, 1, None), (2, 0, None)}, {(1, 0, None), (1, 1, "new"), (2, 0, None)}, {(1, 0, None), (1, 1, "new")}]
    now = snapshots.read_snapshot(spark, path)
    assert [r.run_id for r in now["runs"].collect()] == [1] and snapshots.read_snapshot(spark, path, 1)["runs"].count() == 2
    assert ledger.commit_deletion(spark, path, None) == 4
    assert {n: df.count() for n, df in snapshots.read_snapshot(spark, path).items()} == {"runs": 0, "chunks": 0}
    snapshots.drop_versions(spark, path, keep=2)
    assert snapshots.versions(spark, path) == [3, 4] and snapshots.read_snapshot(spark, path, 3)["chunks"].count() == 2
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path, 1)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = store_of(spark, tmp_path)
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("string").alias("run_id"))
    with pytest.raises(Exception, match="stop"):
        snapshots.commit_snapshot(spark, path, {"runs": broken})
    assert snapshots.versions(spark, path) == [1] and snapshots.read_snapshot(spark, path)["runs"].count() == 2


def test_of_two_commits_on_one_version_the_second_fails(spark, tmp_path):
    path = store_of(spark, tmp_path)
    runs = spark.createDataFrame([(9, "x")], "run_id long, status string")
    assert snapshots.commit_snapshot(spark, path, {"runs": runs}, base=1) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.commit_snapshot(spark, path, {"runs": runs}, base=1)
    (tmp_path / "store" / "versions" / "000000000003").touch()  # begun by another writer and not yet written
    assert snapshots.versions(spark, path) == [1, 2]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit_snapshot(spark, path, {"runs": runs})
    assert snapshots.read_snapshot(spark, path)["runs"].first().run_id == 9


def test_only_given_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.write_results(spark.createDataFrame([(1, "a"), (2, "b")], "id int, lang string"), path, "lang")
    tables.write_results(spark.createDataFrame([(3, "b")], "id int, lang string"), path, "lang", only_given=True)
    assert {(r.id, r.lang) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}
    with pytest.raises(ValueError):
        tables.write_results(spark.range(1), path, only_given=True)


# --- files ------------------------------------------------------------------------------------


def test_files_are_judged_from_the_listing_first(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    made = {"a.pdf": b"%PDF-1.7 x", "b.PDF": b"%PDF", "c.pdf": b"nope", "d.txt": b"%PDF", "sub/e.pdf": b"\n", "f.pdf": b"%PDF" + b"x" * 100}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    judged = intake.admit_files(spark, str(tmp_path), most=100)
    got = {r.path.split(f"{tmp_path}/")[1]: r.reason for r in judged.collect()}
    assert got == {"a.pdf": None, "b.PDF": None, "c.pdf": "signature", "d.txt": "extension", "sub/e.pdf": "signature", "f.pdf": "size"}
    scans = [line for line in judged._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan binaryFile" in line]
    listing, opened = sorted(scans, key=lambda line: "content" in line.split("]")[0])
    assert "content" not in listing.split("]")[0] and "LessThanOrEqual(length,100)" in opened


# --- state of streams ---------------------------------------------------------------------------


def state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{checkpoint}/checkpoint").count()


def test_state_of_silent_and_stopped_chunks_is_evicted(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(0, 0, 0, 80.0, 0), (1, 0, 1, 10.0, 1), (2, 1, 0, 50.0, 1), (3, 0, 2, 5.0, 2), (4, 2, 0, 70.0, 200), (5, 2, 1, 60.0, 201), (6, 0, 1, 40.0, 201), (7, 0, 2, 30.0, 202)]
    timed = [(o, "r", s, i, score, start + timedelta(hours=h)) for o, s, i, score, h in rows]
    df = spark.createDataFrame(timed, "o int, run_id string, sequence_no bigint, iteration int, score double, ts timestamp")
    stream = as_stream(spark, df, tmp_path, files=8).drop("o")
    told = S.run_append(S.score_monitor(stream, time="ts", delay="1 hour", expire_seconds=86_400), str(tmp_path / "out"))
    # Chunk 0 stops and stays silent at its repeat; forgotten a day later, it begins anew. Chunk 1 falls silent.
    assert sorted((r.sequence_no, r.iteration, r.stop_reason) for r in told.collect()) == [(0, 1, "exit score"), (0, 2, None), (2, 1, None)]
    assert state_rows(spark, tmp_path / "out", "chunk") == 2  # chunks 0 and 2, as they began after the gap


def test_live_feed_equals_the_batch_feed_and_forgets(spark, tmp_path):
    rnd, start, rows = random.Random(4), datetime(2024, 1, 1), []
    for i in range(240):
        late = rnd.random() * 5 if i % 3 else 0  # hours
        kind = rnd.choice(["progress", "progress", "error", "info"])
        rows.append((i, f"r{i % 3}" if i % 4 else "hot", i, start + timedelta(hours=i / 4 - late, microseconds=i), kind, rnd.choice(["parsing", "rewriting", None])))
    df = spark.createDataFrame(rows, "o int, run_id string, event_id bigint, event_time timestamp, category string, progress_state string")
    live = S.run_error_feed(as_stream(spark, df, tmp_path, files=8).drop("o"), str(tmp_path / "out"), delay="6 hours")
    assert rows_of(live.select("run_id", "event_id", "state")) == rows_of(S.error_feed(df.drop("o")).select("run_id", "event_id", "state"))
    kept = state_rows(spark, tmp_path / "out", "recent")
    assert 0 < kept < 120  # events of the last hours, not the history
    written = spark.read.parquet(f"{tmp_path}/out/rows").filter("epoch >= 0")
    assert written.count() < 2 * live.count()  # a batch tells its own errors and few corrections


def test_large_files_are_judged_by_their_head_alone(spark, tmp_path):
    """A file above the 2 GB that the binary source can load (without blocks of its own here) is no error."""
    for name, head in (("a b.parquet", b"PAR1"), ("c.parquet", b"PARX"), ("d.parquet", b"PA")):
        with open(tmp_path / name, "wb") as f:
            f.write(head)
            f.truncate(len(head) if name == "d.parquet" else 3 << 30)
    rows = intake.admit_files(spark, str(tmp_path), ".parquet", "PAR1", 1 << 50).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length, r.reason) for r in rows) == [("a b.parquet", 3 << 30, None), ("c.parquet", 3 << 30, "signature"), ("d.parquet", 2, "signature")]


def test_neighbouring_chunks_share_one_list_of_states(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i // 64, "r", i % 64, i // 64, 80.0 - i // 64, start) for i in range(128)]
    df = spark.createDataFrame(rows, "o int, run_id string, sequence_no bigint, iteration int, score double, ts timestamp")
    told = S.run_append(S.score_monitor(as_stream(spark, df, tmp_path, files=2).drop("o"), time="ts"), str(tmp_path / "out"))
    assert sorted((r.sequence_no, r.delta) for r in told.collect()) == [(i, -1.0) for i in range(64)]
    kept = spark.read.format("statestore").option("stateVarName", "chunk").option("flattenCollectionTypes", "false").load(f"{tmp_path}/out/checkpoint")
    assert kept.count() == 1
