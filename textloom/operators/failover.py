"""Ordered failover among providers and the token budgets behind it.

Calls are a long table (request_id, priority, provider, status, text, tokens, ts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import py_round
from textloom.session import stored


def default_quotas(spark) -> DataFrame:
    return spark.createDataFrame(
        V.DEFAULT_QUOTAS, "provider string, daily_limit bigint, used_today bigint, rpm_limit bigint"
    )


def _quota_states(quotas: DataFrame) -> DataFrame:
    """Exhausted flag of the known providers: at most one row per name on the list."""
    names = sorted(set(V.FAILOVER_SEQUENCE))
    return (
        quotas.filter(F.col("provider").isin(*names))
        .groupBy("provider")
        .agg(F.bool_or(F.col("used_today") >= F.col("daily_limit")).alias("exhausted"))
    )


def _made(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """The calls to providers that were not exhausted, with ``ok`` for those that answered."""
    states = F.broadcast(_quota_states(quotas))  # bounded by the provider list
    made = calls.join(states, "provider", "left").filter(~F.coalesce("exhausted", F.lit(False)))
    return made.drop("exhausted").withColumn("ok", _answered(F.col("status"), F.col("text")))


def _won(made: DataFrame) -> DataFrame:
    """(request_id, won): the first priority that answered."""
    return made.filter("ok").groupBy("request_id").agg(F.min("priority").alias("won"))


def _answered(status: Column, text: Column) -> Column:
    return F.coalesce((status == 200) & text.isNotNull(), F.lit(False))


def resolve_failover(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """The first provider in order that has budget left and answered; null if all failed.

    One aggregate per request decides, and carries the answer that is best so far in each task. Of
    several answers at the winning priority the one with the least hash counts.
    """
    states = F.broadcast(_quota_states(quotas))  # bounded by the provider list
    usable = _answered(F.col("status"), F.col("text")) & ~F.coalesce("exhausted", F.lit(False))
    return _first_answer(calls.join(states, "provider", "left"), usable)


def _first_answer(calls: DataFrame, usable: Column) -> DataFrame:
    place = F.when(usable, F.struct("priority", F.xxhash64("provider", "text")))
    best = F.min_by(F.struct("priority", "provider", "text"), place)
    return calls.groupBy("request_id").agg(best.alias("_best")).select(
        "request_id", "_best.priority", "_best.provider", "_best.text", F.col("_best").isNull().alias("all_failed")
    )


# --- budgets that run out during the day ---------------------------------------------------

#: Calls of a block of the running budget, about.
BLOCK_CALLS = 1_000_000


def running_usage(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """Every call with used_before, what its provider had used of its day before it, and exhausted_at_call.

    A budget is looked at before each call and charged after it; a throttled call uses it up for the
    rest of the day. ``used_today`` of a quota is what the first day of the provider's calls begins
    with, other days begin at 0. Calls are charged as they were made, those the provider should have
    refused (exhausted_at_call) included, which changes nothing: a day that has run out stays so. A
    provider without a quota, or a call without a time, has used_before null and is never exhausted.
    Calls of one time go by request and priority; missing and negative token counts charge nothing.

    Few providers and many calls: the sums go in two levels. Calls are dealt by (provider, time) into
    ranges of about BLOCK_CALLS, a window over one row per range gives what each begins with, and
    only windows inside a range of one provider and day see single calls.
    """
    limits = _one_each(quotas.filter(F.col("provider").isin(*sorted(set(V.FAILOVER_SEQUENCE)))))
    limits = F.broadcast(limits.select("provider", "daily_limit", "used_today"))  # bounded by the provider list
    marked = calls.withColumns(
        {
            "_day": F.to_date("ts"), "_charge": F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint"),
            "_throttled": F.coalesce(F.col("status").isin(*V.THROTTLED_STATUSES), F.lit(False)),
        }
    )
    judged = marked.filter(F.col("ts").isNotNull()).join(limits.select("provider"), "provider", "left_semi")
    free = marked.filter(F.col("ts").isNull()).unionByName(
        marked.filter(F.col("ts").isNotNull()).join(limits.select("provider"), "provider", "left_anti")
    )
    order = ["ts", "request_id", "priority"]
    blocks = max(1, -(-judged.count() // BLOCK_CALLS))
    dealt = stored(judged.repartitionByRange(blocks, "provider", *order).withColumn("_block", F.spark_partition_id()))

    totals = dealt.groupBy("provider", "_day", "_block").agg(F.sum("_charge").alias("_sum"), F.max("_throttled").alias("_any"))
    earlier = Window.partitionBy("provider", "_day").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(
        "provider", "_day", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_begin"),
        F.coalesce(F.max("_any").over(earlier), F.lit(False)).alias("_spent"),
    )
    first = totals.groupBy("provider").agg(F.min("_day").alias("_first"))
    inside = Window.partitionBy("provider", "_day", "_block").orderBy(*order, "_charge", "status", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    tied = dealt.withColumn("_tie", F.xxhash64(*[c for c in calls.columns if c not in order]))
    within = tied.withColumns({"_inside": F.coalesce(F.sum("_charge").over(inside), F.lit(0)), "_hit": F.coalesce(F.max("_throttled").over(inside), F.lit(False))})
    known = within.join(begins, ["provider", "_day", "_block"]).join(F.broadcast(first), "provider").join(limits, "provider")
    start = F.when(F.col("_day") == F.col("_first"), F.coalesce("used_today", F.lit(0))).otherwise(0)
    used = F.when(F.col("_hit") | F.col("_spent"), F.col("daily_limit")).otherwise(start + F.col("_begin") + F.col("_inside"))
    ended = F.coalesce(F.col("used_before") >= F.col("daily_limit"), F.lit(False))
    out = known.withColumn("used_before", used).withColumn("exhausted_at_call", ended)
    rest = free.withColumns({"used_before": F.lit(None).cast("bigint"), "exhausted_at_call": F.lit(False)})
    names = [*calls.columns, "used_before", "exhausted_at_call"]
    return out.select(*names).unionByName(rest.select(*names))


def resolve_running_failover(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """The first provider in order that had budget left when it was called, and answered."""
    usable = _answered(F.col("status"), F.col("text")) & ~F.col("exhausted_at_call")
    return _first_answer(running_usage(calls, quotas), usable)


def failover_errors(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """Every failed call that was made before the successful one, whatever its priority or number."""
    made = _made(calls, quotas)
    failed = made.filter("not ok").join(_won(made), "request_id", "left")
    before = F.col("won").isNull() | (F.col("priority") < F.col("won"))
    return failed.filter(before).select("request_id", "priority", "provider", "status")


def usage_by_day(calls: DataFrame) -> DataFrame:
    """Tokens and throttling per provider and day."""
    return calls.groupBy("provider", F.to_date("ts").alias("day")).agg(
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
        F.bool_or(F.col("status").isin(*V.THROTTLED_STATUSES)).alias("throttled"),
    )


def accumulate_usage(quotas: DataFrame, calls: DataFrame) -> DataFrame:
    """Quotas after the calls: used_today grows by the tokens, or reaches the limit
    where the provider was throttled."""
    used = calls.groupBy("provider").agg(
        F.sum(F.coalesce("tokens", F.lit(0))).alias("_tokens"),
        F.bool_or(F.col("status").isin(*V.THROTTLED_STATUSES)).alias("_throttled"),
    )
    total = F.col("used_today") + F.coalesce("_tokens", F.lit(0))
    return _one_each(quotas).join(used, "provider", "left").select(
        "provider", "daily_limit",
        F.when(F.coalesce("_throttled", F.lit(False)), F.col("daily_limit")).otherwise(total).alias("used_today"),
        "rpm_limit",
    )


def _one_each(quotas: DataFrame) -> DataFrame:
    """One record per provider: of several the one with the most use, then the highest limits."""
    most = F.max(F.struct("used_today", "daily_limit", "rpm_limit")).alias("_q")
    return quotas.groupBy("provider").agg(most).select("provider", "_q.daily_limit", "_q.used_today", "_q.rpm_limit")


def required_quotas(quotas: DataFrame) -> DataFrame:
    """Every provider of the default list, with defaults where its record is missing."""
    defaults = default_quotas(quotas.sparkSession)
    d, q = defaults.alias("d"), _one_each(quotas).alias("q")
    known = F.col("q.provider").isNotNull()
    pick = [F.when(known, F.col(f"q.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in ("daily_limit", "used_today", "rpm_limit")]
    return d.join(q, F.col("d.provider") == F.col("q.provider"), "left").select(F.col("d.provider"), *pick)


def quota_usage(quotas: DataFrame) -> DataFrame:
    """Remaining budget and percentage per required provider."""
    remaining = F.greatest(F.lit(0), F.col("daily_limit") - F.col("used_today"))
    return required_quotas(quotas).select(
        "provider", "daily_limit", "used_today", remaining.alias("remaining"),
        remaining_percentage(remaining, F.col("daily_limit")).alias("remaining_percentage"), "rpm_limit",
    )


def remaining_percentage(remaining: Column, limit: Column) -> Column:
    return F.when(limit > 0, py_round(remaining / limit * 100.0, 2)).otherwise(F.lit(0.0))


def seed_quotas(quotas: DataFrame, defaults: DataFrame, reset_used: bool = True) -> DataFrame:
    """Insert absent defaults and bring existing records to the default limit.

    ``reset_used`` also sets used_today of those records to zero, as every restart
    of the service does.
    """
    new = defaults.alias("d").select(
        "provider", F.col("daily_limit").alias("_limit"), F.col("used_today").alias("_used"), F.col("rpm_limit").alias("_rpm")
    )
    listed = F.col("_limit").isNotNull()
    absent = F.col("daily_limit").isNull()
    used = F.when(absent, F.col("_used")).when(listed & F.lit(reset_used), F.lit(0)).otherwise(F.col("used_today"))
    return quotas.join(new, "provider", "full_outer").select(
        "provider",
        F.coalesce("_limit", "daily_limit").alias("daily_limit"),
        used.alias("used_today"),
        F.coalesce("rpm_limit", "_rpm").alias("rpm_limit"),
        absent.alias("inserted"),
    )
