"""Choosing among scored candidate versions of a chunk.

Attempts are a long table (run_id, sequence_no, iteration, text, score,
from_fallback) whose iteration 0 is the unchanged chunk. One aggregation turns the
few iterations of a chunk into columns; it combines on the map side, so repeated
deliveries of one chunk collapse before the shuffle and no window over a hot key
is needed. The rules then run inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import each, fold
from textloom.operators.masking import masks_preserved

KEYS = ["run_id", "sequence_no"]


def gather_attempts(attempts: DataFrame, max_iterations: int = V.MAX_ITERATIONS, keys: list[str] | None = None) -> DataFrame:
    """One row per chunk: ``base`` and the scored, mask-preserving attempts in order.

    An attempt without text or score is a failed call. It is skipped like one that
    lost a placeholder.
    """
    keys = keys or KEYS
    def at(i: int) -> Column:
        record = F.struct(
            F.col("iteration"), F.col("score").cast("double").alias("score"), F.col("text"),
            F.coalesce("from_fallback", F.lit(False)).alias("from_fallback"),
        )
        usable = (F.col("iteration") == i) & F.col("score").isNotNull() & F.col("text").isNotNull()
        return F.min(F.when(usable, record)).alias(f"_a{i}")

    gathered = attempts.groupBy(*keys).agg(*[at(i) for i in range(max_iterations + 1)])
    tried = F.array(*[F.col(f"_a{i}") for i in range(1, max_iterations + 1)])
    return gathered.select(
        *keys,
        F.col("_a0").alias("base"),
        F.filter(tried, lambda a: a.isNotNull() & masks_preserved(F.col("_a0.text"), a["text"])).alias("accepted"),
    )


def unusable_attempts(attempts: DataFrame, max_iterations: int = V.MAX_ITERATIONS, keys: list[str] | None = None) -> DataFrame:
    """(keys, iteration, reason) of the attempts that take no part in a choice and why.

    Attempts beyond the last iteration, failed calls, and all attempts of a chunk without a
    usable iteration 0.
    """
    keys = keys or KEYS
    failed = F.col("score").isNull() | F.col("text").isNull()
    based = attempts.filter((F.col("iteration") == 0) & ~failed).select(*keys).distinct().withColumn("_based", F.lit(True))
    reason = (
        F.when(F.col("iteration") > max_iterations, "beyond the last iteration").when(failed, "no text or score")
        .when(F.col("_based").isNull(), "no baseline")
    )
    return attempts.join(based, keys, "left").select(*keys, "iteration", reason.alias("reason")).filter("reason is not null")


def _history(base: Column, accepted: Column) -> Column:
    return F.concat(F.array(base["score"]), accepted["score"])


def convergence_flags(
    attempts: DataFrame, max_iterations: int = V.MAX_ITERATIONS, tolerance: float = V.DEGRADATION_TOLERANCE,
    stall_below: float = V.STALL_THRESHOLD, keys: list[str] | None = None,
) -> DataFrame:
    """Every accepted attempt with its previous score and the convergence verdicts.

    degraded: worse than the previous score by more than the tolerance.
    stalled: not degraded, but improved by less than the threshold.
    stops: degraded, or the second stall of the chunk.
    """
    keys = keys or KEYS
    gathered = gather_attempts(attempts, max_iterations, keys).withColumn(
        "_h", _history(F.col("base"), F.col("accepted"))
    )
    rows = each(gathered, [*keys, "_h"], "accepted", "_i", "_a")

    def degraded_at(i: Column) -> Column:
        return F.get(F.col("_h"), i + 1) > F.get(F.col("_h"), i) + tolerance

    def stalled_at(i: Column) -> Column:
        return ~degraded_at(i) & (F.get(F.col("_h"), i) - F.get(F.col("_h"), i + 1) < stall_below)

    stalls = F.size(F.filter(F.sequence(F.lit(0), F.col("_i")), stalled_at))
    return rows.select(
        *keys,
        F.col("_a.iteration").alias("iteration"),
        F.get("_h", F.col("_i")).alias("previous_score"),
        F.col("_a.score").alias("score"),
        (F.col("_a.score") - F.get("_h", F.col("_i"))).alias("delta"),
        degraded_at(F.col("_i")).alias("degraded"),
        stalled_at(F.col("_i")).alias("stalled"),
        stalls.alias("stall_count"),
    ).withColumn("stops", F.col("degraded") | (F.col("stalled") & (F.col("stall_count") >= 2)))


def select_candidates(
    attempts: DataFrame, max_iterations: int = V.MAX_ITERATIONS, exit_score: float = V.EXIT_SCORE,
    tolerance: float = V.DEGRADATION_TOLERANCE, stall_below: float = V.STALL_THRESHOLD, keys: list[str] | None = None,
) -> DataFrame:
    """The chosen text per chunk.

    Walks the attempts until a score is under the exit score, the scores get worse
    or stall twice. The lowest score so far wins, the earliest on ties; when the
    last score came from the fallback and no attempt beat the chunk itself, the
    best attempt is taken instead.
    """
    keys = keys or KEYS
    gathered = gather_attempts(attempts, max_iterations, keys)
    base = F.col("base")
    skips = (base["score"] < exit_score) & ~base["from_fallback"]
    no_text = F.lit(None).cast("string")
    start = F.struct(
        skips.alias("stopped"), F.lit(0).alias("stalls"), base["score"].alias("last"),
        base["from_fallback"].alias("fallback"), F.array(base["score"]).alias("history"),
        base["score"].alias("best"), base["text"].alias("best_text"),
        F.lit(999.0).alias("tried"), no_text.alias("tried_text"),
        F.when(skips, F.lit("baseline")).otherwise(no_text).alias("reason"),
    )

    def step(s: Column, a: Column) -> Column:
        score = a["score"]
        checked = a["iteration"] < max_iterations
        degraded = checked & (score > s["last"] + tolerance)
        stalled = checked & ~degraded & (s["last"] - score < stall_below)
        under = score < exit_score
        stop = under | degraded | (stalled & (s["stalls"] >= 1))
        reason = (
            F.when(under, "exit score").when(degraded, "degraded").when(stop, "stalled twice").otherwise(no_text)
        )
        moved = F.struct(
            stop.alias("stopped"), (s["stalls"] + stalled.cast("int")).alias("stalls"), score.alias("last"),
            a["from_fallback"].alias("fallback"), F.array_append(s["history"], score).alias("history"),
            F.least(s["best"], score).alias("best"),
            F.when(score < s["best"], a["text"]).otherwise(s["best_text"]).alias("best_text"),
            F.least(s["tried"], score).alias("tried"),
            F.when(score < s["tried"], a["text"]).otherwise(s["tried_text"]).alias("tried_text"),
            reason.alias("reason"),
        )
        return F.when(s["stopped"], s).otherwise(moved)

    walked = gathered.withColumn("_s", fold(F.col("accepted"), start, step))
    s = F.col("_s")
    use_attempt = s["fallback"] & s["tried_text"].isNotNull() & (s["best_text"] == base["text"])
    return walked.select(
        *keys,
        base["score"].alias("baseline_score"),
        F.when(use_attempt, s["tried_text"]).otherwise(s["best_text"]).alias("processed"),
        F.when(use_attempt, s["tried"]).otherwise(s["best"]).alias("best_score"),
        (F.size(s["history"]) - 1).alias("iterations"),
        s["history"].alias("scores_history"),
        F.when(base.isNull(), "no baseline").otherwise(F.coalesce(s["reason"], F.lit("iterations used up"))).alias("stop_reason"),
    )


def batch_summary(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Outcome counts per run; a result without ``success`` counts as succeeded."""
    ok = F.coalesce(F.col("success"), F.lit(True)) if "success" in results.columns else F.lit(True)
    return results.groupBy(run).agg(
        F.count("*").alias("chunks"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.avg("best_score").alias("mean_best_score"),
        F.sum("iterations").alias("total_iterations"),
    )


# --- user-supplied text functions ---------------------------------------------------


def transform_texts(df: DataFrame, text: str, out: str, function: Callable[[Column], Column]) -> DataFrame:
    """Apply a user's Column function; it stays in the JVM."""
    return df.withColumn(out, function(F.col(text)))


def map_texts_isolated(df: DataFrame, text: str, function: Callable[[str], str]) -> DataFrame:
    """Apply a user's Python function to every text; a failing row does not stop the others.

    Adds success, processed (the original text on failure), best_score, iterations
    and error. Batches stream through Arrow, one at a time per task.
    """
    extra = "success boolean, processed string, best_score double, iterations int, error string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra

    def attempt(value: str) -> tuple[bool, str, float | None, int | None, str | None]:
        try:
            return True, function(value), None, None, None
        except Exception as exc:  # the user's function may raise anything
            return False, value, V.FAILED_SCORE, 0, str(exc)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["success", "processed", "best_score", "iterations", "error"]
        for batch in batches:
            done = pd.DataFrame([attempt(v) for v in batch[text]], columns=names, index=batch.index)
            done["iterations"] = done["iterations"].astype("Int32")
            done["best_score"] = done["best_score"].astype("Float64")
            yield pd.concat([batch, done], axis=1)

    return df.mapInPandas(run, schema)
