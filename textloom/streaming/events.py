"""Structured Streaming over status events, calls, scores and incoming documents."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom import fixed_values as V
from textloom.session import shared_dir

EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("progress_state", T.StringType()),
        T.StructField(
            "token_updates",
            T.StructType([T.StructField(p, T.LongType()) for p in ("google", "groq", "deepseek")]),
        ),
    ]
)


# --- parsing ---------------------------------------------------------------------


def parse_events(df: DataFrame, json: str = "json") -> DataFrame:
    """Typed events with an ``error`` for rows that miss a required field.

    Fields outside the schema are dropped; token counts default to zero and a
    missing timestamp stays null for the caller to fill at ingest.
    """
    e = F.col("_e")
    missing = F.array_compact(
        F.array(
            F.when(e["category"].isNull(), "category"),
            F.when(e["progress_state"].isNull(), "progress_state"),
            F.when(e["token_updates"].isNull(), "token_updates"),
        )
    )
    tokens = F.struct(
        *[F.coalesce(e["token_updates"][p], F.lit(0)).alias(p) for p in ("google", "groq", "deepseek")]
    )
    parsed = df.withColumn("_e", F.from_json(json, EVENT)).withColumn("_missing", missing)
    bad = F.size("_missing") > 0
    return parsed.select(
        *[c for c in df.columns if c != json],
        e["run_id"].alias("run_id"),
        F.try_to_timestamp(e["timestamp"]).alias("event_time"),
        e["category"].alias("category"),
        e["progress_state"].alias("progress_state"),
        F.when(~bad, tokens).alias("token_updates"),
        F.when(bad, F.concat(F.lit("missing: "), F.array_join("_missing", ", "))).alias("error"),
        F.when(bad, F.col(json)).alias("raw"),
    )


# --- state per run -----------------------------------------------------------------


def current_states(events: DataFrame, run: str = "run_id", time: str = "event_time", order: str | None = None) -> DataFrame:
    """Latest state per run and whether the newest event is an error.

    An error keeps the last progress state and marks it. Works on streams (update
    mode) and on tables; max_by combines before the shuffle.
    """
    at = F.struct(F.col(time), F.col(order)) if order else F.struct(F.col(time))
    is_progress = F.col("category") == "progress"
    done = F.col("category") == "text_completed"
    state = F.when(is_progress, F.col("progress_state")).when(done, F.lit("completed"))
    return (
        events.filter(is_progress | done | (F.col("category") == "error"))
        .groupBy(run)
        .agg(
            F.max(F.when(state.isNotNull(), F.struct(at.alias("at"), state.alias("state")))).alias("_s"),
            F.max(F.when(F.col("category") == "error", at)).alias("_error_at"),
        )
        .select(
            run, F.col("_s.state").alias("progress_state"),
            F.coalesce(F.col("_error_at") > F.col("_s.at"), F.lit(False)).alias("failed"),
        )
    )


def node_statuses(state: Column, failed: Column) -> Column:
    """array<struct(node, status)>: success before the active node, idle after it."""
    names = [n for n, _ in V.PROGRESS_NODES]
    states = [s for _, s in V.PROGRESS_NODES]
    active = F.array_position(F.array(*[F.lit(s) for s in states]), F.coalesce(state, F.lit("")))
    complete = (state == states[-1]) & ~failed
    return F.transform(
        F.array(*[F.lit(n) for n in names]),
        lambda node, i: F.struct(
            node.alias("node"),
            F.when(complete, "success")
            .when(i + 1 < active, "success")
            .when(i + 1 == active, F.when(failed, "error").otherwise("processing"))
            .otherwise("idle")
            .alias("status"),
        ),
    )


# --- budgets -------------------------------------------------------------------------


def daily_tokens(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tokens per provider and day. The watermark closes a day ``delay`` after its end."""
    stream = calls.withWatermark("ts", delay) if calls.isStreaming else calls
    day = F.window("ts", "1 day")
    return stream.groupBy("provider", day.alias("day")).agg(F.sum("tokens").alias("tokens")).select(
        "provider", F.col("day.start").alias("day_start"), "tokens"
    )


def against_daily_limit(totals: DataFrame, quotas: DataFrame) -> DataFrame:
    """Daily totals with the provider's limit; the listed providers are at most four rows."""
    limits = quotas.filter(F.col("provider").isin(*sorted(set(V.FAILOVER_SEQUENCE)))).groupBy("provider").agg(
        F.max("daily_limit").alias("daily_limit")
    )
    return totals.join(F.broadcast(limits), "provider", "left").withColumn(
        "over_limit", F.coalesce(F.col("tokens") >= F.col("daily_limit"), F.lit(False))
    )


def requests_per_minute(calls: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Requests per provider and minute."""
    stream = calls.withWatermark("ts", delay) if calls.isStreaming else calls
    return stream.groupBy("provider", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("requests")).select(
        "provider", F.col("w.start").alias("minute_start"), "requests"
    )


def against_rpm_limit(counts: DataFrame, quotas: DataFrame) -> DataFrame:
    limits = quotas.filter(F.col("provider").isin(*sorted(set(V.FAILOVER_SEQUENCE)))).groupBy("provider").agg(
        F.max("rpm_limit").alias("rpm_limit")
    )
    return counts.join(F.broadcast(limits), "provider", "left").withColumn(
        "over_limit", F.coalesce(F.col("requests") > F.col("rpm_limit"), F.lit(False))
    )


# --- errors with the state they happened in --------------------------------------------


def error_feed(
    events: DataFrame, carried: DataFrame | None = None, run: str = "run_id", time: str = "event_time",
    order: str = "event_id", bucket: str = "hour",
) -> DataFrame:
    """(run, order, time, state) of error events with the last progress state before each.

    A window over a whole run would put a busy run into one task. Instead every
    (run, time bucket) is one small window, and what a bucket starts with comes from
    a second window over one row per bucket. ``carried`` holds (run, state) known
    before these events.
    """
    is_progress = (F.col("category") == "progress") & F.col("progress_state").isNotNull()
    rows = events.filter(is_progress | (F.col("category") == "error")).select(
        run, order, time, "category",
        F.when(is_progress, F.col("progress_state")).alias("_state"),
        F.date_trunc(bucket, F.col(time)).alias("_bucket"),
    )
    last_in_bucket = (
        rows.filter(is_progress)
        .groupBy(run, "_bucket")
        .agg(F.max(F.struct(F.col(time), F.col(order), F.col("_state"))).alias("_last"))
    )
    ends = last_in_bucket.select(run, "_bucket", F.col("_last._state").alias("_end"))
    # One row per bucket; its _end is null where only errors happened.
    per_bucket = (
        rows.select(run, "_bucket", F.lit(None).cast("string").alias("_end")).unionByName(ends)
        .groupBy(run, "_bucket").agg(F.max("_end").alias("_end"))
    )
    if carried is not None:
        earliest = F.lit("0001-01-01").cast(rows.schema["_bucket"].dataType)
        per_bucket = per_bucket.unionByName(
            carried.select(run, earliest.alias("_bucket"), F.col("state").alias("_end"))
        )
    over_buckets = Window.partitionBy(run).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select(
        run, "_bucket", F.last("_end", ignorenulls=True).over(over_buckets).alias("_before")
    )
    inside = Window.partitionBy(run, "_bucket").orderBy(time, order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_inside", F.last("_state", ignorenulls=True).over(inside))
    return (
        seen.filter(F.col("category") == "error")
        .join(before, [run, "_bucket"], "left")
        .select(run, order, time, F.coalesce("_inside", "_before").alias("state"))
    )


# --- score monitor -----------------------------------------------------------------------

MONITOR_OUT = (
    "run_id string, sequence_no bigint, iteration int, previous_score double, score double, delta double, "
    "degraded boolean, stalled boolean, stall_count int, stops boolean, best_score double, stop_reason string"
)
MONITOR_STATE = "sequence_no bigint, previous double, stalls int, best double, stopped boolean, expires bigint"
#: Chunks of a run that share a call and a list of states; a call for each chunk took most of the time.
MONITOR_PART = 64
#: Seconds after its newest row at which what is known of a chunk, or of a run, is forgotten.
EXPIRE_SECONDS = 7 * 86_400


class _Expiring(StatefulProcessor):
    """Keyed state with one timer: ``expires`` (ms of event time) moves on with the rows of the key.

    A timer that fires early, because rows came after it was set, is set again; else ``forget`` runs.
    It also runs before rows that come once the watermark has passed ``expires``.
    """

    def expires(self) -> int:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.forgotten(timerValues) and self.expires():
            self.handle.registerTimer(self.expires())
        return iter(())

    def forgotten(self, timerValues) -> bool:  # noqa: N803
        """Forget what has expired; its timers find nothing any more."""
        over = 0 < self.expires() <= timerValues.getCurrentWatermarkInMs()
        if over:
            self.forget()
        return over

    def close(self) -> None:
        pass


class _Monitor(_Expiring):
    """Chunks of a run that lie in one part of its sequence: a list of states, read and written once for all of them.

    While there is a list one timer is waiting, at the latest when the first of its chunks expires.
    """

    def __init__(self, rule: tuple, expire_ms: int):
        self.rule, self.expire_ms = rule, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunk", MONITOR_STATE)

    def living(self, timerValues) -> dict:  # noqa: N803
        """(previous, stalls, best, stopped, expires) by sequence_no of the chunks that have not expired."""
        now = timerValues.getCurrentWatermarkInMs()
        return {c[0]: tuple(c[1:]) for c in self.chunks.get() if not 0 < c[5] <= now} if self.chunks.exists() else {}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        left = self.living(timerValues)
        if left:
            self.chunks.put([(n, *c) for n, c in left.items()])
            self.handle.registerTimer(min(c[4] for c in left.values()))
        else:
            self.chunks.clear()
        return iter(())

    def judged(self, key: tuple, found: list[tuple], state: tuple) -> tuple[tuple, list[tuple]]:
        """The state of a chunk after its scores in order, and what is told of them."""
        tolerance, stall_below, exit_score, max_iterations = self.rule
        previous, stalls, best, stopped, _ = state
        out = []
        for iteration, score in sorted(found):
            if stopped:
                break
            if previous is None:
                stopped = score < exit_score
            else:
                checked = iteration < max_iterations
                degraded = checked and score > previous + tolerance
                stalled = checked and not degraded and previous - score < stall_below
                stalls += int(stalled)
                best = min(best, score)
                twice = stalled and stalls >= 2
                reason = "exit score" if score < exit_score else "degraded" if degraded else "stalled twice" if twice else None
                stopped = reason is not None
                out.append((*key, iteration, previous, score, score - previous, degraded, stalled, stalls, stopped, best, reason))
            previous, best = score, score if best is None else best
        return (previous, stalls, best, stopped), out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = self.chunks.exists()
        chunks, fresh = self.living(timerValues), {}
        for batch in rows:
            columns = (batch["sequence_no"].tolist(), batch["iteration"].tolist(), batch["score"].tolist(), batch["at"].tolist())
            for number, iteration, score, at in zip(*columns, strict=True):
                fresh.setdefault(None if pd.isna(number) else int(number), []).append((int(iteration), float(score), int(at)))
        out = []
        for number, found in fresh.items():
            state = chunks.get(number, (None, 0, None, False, 0))
            latest = max(state[4], max(at for _, _, at in found) + self.expire_ms)
            after, told = self.judged((key[0], number), [(i, s) for i, s, _ in found], state)
            chunks[number] = (*after, latest)
            out += told
        self.chunks.put([(n, *c) for n, c in chunks.items()])
        if not waiting:
            self.handle.registerTimer(min(c[4] for c in chunks.values()))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MONITOR_OUT.split(", ")])


def score_monitor(
    scores: DataFrame, tolerance: float = V.DEGRADATION_TOLERANCE, stall_below: float = V.STALL_THRESHOLD,
    exit_score: float = V.EXIT_SCORE, max_iterations: int = V.MAX_ITERATIONS,
    time: str | None = None, delay: str = "1 hour", expire_seconds: int = EXPIRE_SECONDS,
) -> DataFrame:
    """Verdict of every score as it arrives, per (run_id, sequence_no), until the chunk stops.

    Input columns: run_id, sequence_no, iteration, score, and optionally accepted; attempts not
    accepted (a placeholder was lost) are passed over. A chunk stops at a score under the exit
    score, the baseline's included, when its scores get worse, or at its second stall; scores are
    compared with the one before up to the last but one iteration. Nothing is told after a stop.

    The state of a chunk is five values, and MONITOR_PART neighbouring chunks of a run lie in one list. It is kept for ``expire_seconds`` after the chunk's newest
    row, so that repeats stay silent after a stop, and then evicted, whether the chunk has stopped
    or fallen silent: by the scores' own time if they have a column ``time`` (rows later than ``delay``
    are dropped), else by the time they arrive.
    """
    if "accepted" in scores.columns:
        scores = scores.filter(F.coalesce("accepted", F.lit(True))).drop("accepted")
    rows = scores.filter(F.col("iteration").isNotNull() & F.col("score").isNotNull())
    if time:
        rows = rows.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    else:
        time = "arrived"
        rows = rows.withColumn(time, F.current_timestamp()).withWatermark(time, "0 seconds")
    rows = rows.select("run_id", "sequence_no", "iteration", "score", time, F.unix_millis(F.col(time).cast("timestamp")).alias("at"))
    monitor = _Monitor((tolerance, stall_below, exit_score, max_iterations), expire_seconds * 1000)
    parts = rows.withColumn("part", F.floor(F.col("sequence_no") / MONITOR_PART))
    return parts.groupBy("run_id", "part").transformWithStateInPandas(monitor, MONITOR_OUT, "Append", "EventTime")


# --- errors with their state, as a stream ------------------------------------------------------

FEED_OUT = "run_id string, event_id bigint, event_time timestamp, state string"


class _Feed(_Expiring):
    """Events of a run that late progress can still precede, and the last progress before them."""

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at bigint, event_id bigint, is_error boolean, state string")
        self.last = handle.getValueState("last", "at bigint, event_id bigint, state string")
        self.until = handle.getValueState("until", "expires bigint")

    def expires(self) -> int:
        return self.until.get()[0] if self.until.exists() else 0

    def forget(self) -> None:
        for state in (self.recent, self.last, self.until):
            state.clear()

    @staticmethod
    def states(before: str | None, events: list[tuple]) -> dict[tuple, str | None]:
        """The state each error of ordered events happened in."""
        out = {}
        for at, event_id, is_error, state in events:
            if is_error:
                out[at, event_id] = before
            else:
                before = state
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forgotten(timerValues)
        last = self.last.get() if self.last.exists() else None
        before = last[2] if last else None
        held = [tuple(e) for e in self.recent.get()] if self.recent.exists() else []
        fresh = []
        for batch in rows:
            columns = (batch["at"].tolist(), batch["event_id"].tolist(), (batch["category"] == "error").tolist(), batch["progress_state"].tolist())
            fresh += [(int(at), int(i), e, None if pd.isna(s) else s) for at, i, e, s in zip(*columns, strict=True)]
        order = lambda e: (e[0], e[1])
        told = self.states(before, sorted(held, key=order))
        events = sorted(held + fresh, key=order)
        now = self.states(before, events)
        new = [(*key, i, pd.Timestamp(at, unit="us"), state) for (at, i), state in now.items() if (at, i) not in told or told[at, i] != state]

        closed = timerValues.getCurrentWatermarkInMs() * 1000  # nothing earlier arrives any more
        past = [e for e in events if e[0] < closed and not e[2]]
        if past and (last is None or order(past[-1]) > (last[0], last[1])):
            self.last.update((past[-1][0], past[-1][1], past[-1][3]))
        self.recent.put([e for e in events if e[0] >= closed])
        known = self.until.exists()
        latest = max(self.expires(), events[-1][0] // 1000 + self.expire_ms)
        self.until.update((latest,))
        if not known:
            self.handle.registerTimer(latest)
        if new:
            yield pd.DataFrame(new, columns=["run_id", "event_id", "event_time", "state"])


def live_error_feed(events: DataFrame, delay: str = "1 day", expire_seconds: int = EXPIRE_SECONDS) -> DataFrame:
    """(run_id, event_id, event_time, state) of the errors of a stream, in update mode.

    A batch tells its own errors and those of the last ``delay`` whose state late progress changes;
    what a run keeps are its events since the watermark and the last progress before, and nothing
    once it is silent for ``expire_seconds``. Events later than ``delay``, without time or without run are
    left out. The rows of a run that come in one batch meet in one task, so the size of a batch (files
    per trigger) bounds a task whatever the run's share of all events.
    """
    told = (F.col("category") == "error") | ((F.col("category") == "progress") & F.col("progress_state").isNotNull())
    kinds = events.filter(told & F.col("run_id").isNotNull() & F.col("event_time").isNotNull())
    rows = kinds.select(
        "run_id", F.col("event_id").cast("bigint").alias("event_id"), F.col("event_time").cast("timestamp").alias("event_time"), "category", "progress_state"
    ).withWatermark("event_time", delay)
    timed = rows.withColumn("at", F.unix_micros("event_time"))
    return timed.groupBy("run_id").transformWithStateInPandas(_Feed(expire_seconds * 1000), FEED_OUT, "Update", "EventTime")


# --- running streams to the end of what is available ------------------------------------------


def _empty_rows(stream: DataFrame, path: str) -> None:
    """A table without rows, so that a stream without a batch ends in one."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in no more parts than twice the cores.

    The number is fixed for the life of a stream, and every part costs each batch a state store and a
    worker, however few rows there are.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_append(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table and return the table."""
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    _empty_rows(stream, f"{folder}/rows")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_updates(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Process an aggregation in update mode and return the latest row per key.

    Every micro-batch writes its changed rows to a folder of its own number, so a
    repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    _empty_rows(stream, f"{folder}/rows/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType(stream.schema.fields + [T.StructField("epoch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), "epoch").alias("_n")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_n.*")


def run_error_feed(events: DataFrame, folder: str | None = None, delay: str = "1 day", expire_seconds: int = EXPIRE_SECONDS) -> DataFrame:
    """The error feed of an event stream, run to the end of what is available: the newest row of each error."""
    return run_updates(live_error_feed(events, delay, expire_seconds), ["run_id", "event_id"], folder)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream: a folder of part files, or one file.

    The stream source takes folders only, so a file is read from its parent with a filter on its name.
    """
    table = spark.read.parquet(path)
    parent, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)


def intake_stream(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Continuous intake: admit, mask and chunk arriving texts; stateless."""
    from textloom.plans.documents import prepare_documents

    return prepare_documents(documents, key, text)[0]


def run_intake(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Continuous intake with all it makes: (chunks, token maps, rejected).

    Each batch writes its three tables under its own number; masks can be restored with the maps.
    """
    from textloom.plans.documents import prepare_documents

    spark = documents.sparkSession
    folder = folder or shared_dir(spark)
    names = ("chunks", "maps", "rejected")
    empty = prepare_documents(spark.createDataFrame([], documents.schema), key, text)
    for name, part in zip(names, empty, strict=True):
        _empty_rows(part, f"{folder}/{name}/epoch=-1")

    cores = spark.sparkContext.defaultParallelism

    def write(batch: DataFrame, epoch: int) -> None:
        # A batch of few files is dealt over the cores.
        batch = (batch if batch.rdd.getNumPartitions() >= cores else batch.repartition(cores)).persist()
        for name, part in zip(names, prepare_documents(batch, key, text), strict=True):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")
        batch.unpersist()

    query = (
        documents.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return tuple(spark.read.schema(p.schema).parquet(f"{folder}/{n}").drop("epoch") for n, p in zip(names, empty, strict=True))
