import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import failover, scoring, selection

COLUMNS = "run_id string, sequence_no bigint, iteration int, text string, score double, from_fallback boolean"


def attempts(spark, scores, fallback=False, texts=None):
    texts = texts or [f"t{i}" for i in range(len(scores))]
    return spark.createDataFrame([("r", 0, i, texts[i], s, fallback) for i, s in enumerate(scores)], COLUMNS)


def chosen(spark, scores, **kwargs):
    return selection.select_candidates(attempts(spark, scores, **kwargs)).first()


@pytest.mark.parametrize(
    ("scores", "text", "best", "iterations", "reason"),
    [
        ([80.0, 40.0, 10.0], "t2", 10.0, 2, "exit score"),
        ([90.0, 80.0, 75.0, 70.0], "t3", 70.0, 3, "iterations used up"),
        ([10.0, 5.0], "t0", 10.0, 0, "baseline"),
        ([60.0, 75.0, 20.0], "t0", 60.0, 1, "degraded"),
        ([50.0, 49.0, 48.0, 20.0], "t2", 48.0, 2, "stalled twice"),
        ([50.0, 49.0, 30.0, 29.0], "t3", 29.0, 3, "iterations used up"),
        ([50.0, 55.0, 20.0, 19.0], "t3", 19.0, 3, "iterations used up"),
        ([50.0, 40.0, 40.0], "t1", 40.0, 2, "iterations used up"),
        ([15.0, 14.9], "t1", 14.9, 1, "exit score"),
    ],
)
def test_selection(spark, scores, text, best, iterations, reason):
    row = chosen(spark, scores)
    assert (row.processed, row.best_score, row.iterations, row.stop_reason) == (text, best, iterations, reason)
    assert row.scores_history == scores[: iterations + 1]


def test_lost_masks_reject_an_attempt_without_counting_it(spark):
    row = chosen(spark, [90.0, 20.0], texts=["a __CITATION_0__", "a"])
    assert (row.processed, row.best_score, row.iterations) == ("a __CITATION_0__", 90.0, 0)
    row = chosen(spark, [90.0, None, 60.0])
    assert (row.processed, row.iterations) == ("t2", 1)


def test_fallback_scores_prefer_any_attempt_over_the_baseline(spark):
    assert chosen(spark, [40.0, 42.0, 41.0], fallback=True).processed == "t2"
    assert chosen(spark, [40.0, 42.0, 41.0]).processed == "t0"
    assert chosen(spark, [10.0, 12.0], fallback=True).processed == "t1"  # no skip in fallback mode


def loop(scores, fallback):
    """The loop restated for random histories without lost masks."""
    base = scores[0]
    history, best, best_i, tried, tried_i, stalls = [base], base, 0, 999.0, None, 0
    if base < 15 and not fallback:
        return best_i, 0
    for i, s in enumerate(scores[1:], 1):
        history.append(s)
        if s < tried:
            tried, tried_i = s, i
        if s < best:
            best, best_i = s, i
        if s < 15:
            break
        if i < 3:
            if s > history[-2] + 5:
                break
            if history[-2] - s < 2:
                stalls += 1
                if stalls == 2:
                    break
    return (tried_i if fallback and best_i == 0 and tried_i else best_i), len(history) - 1


def test_selection_against_the_loop(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for seq in range(300):
        scores, fallback = [round(rng.uniform(5, 60) / 3) * 1.5 for _ in range(rng.randint(1, 4))], rng.random() < 0.5
        expected[seq] = loop(scores, fallback)
        rows += [("r", seq, i, f"t{i}", s, fallback) for i, s in enumerate(scores)]
    rng.shuffle(rows)
    got = selection.select_candidates(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {r.sequence_no: (int(r.processed[1:]), r.iterations) for r in got} == expected


def test_copies_of_one_chunk_change_nothing(spark):
    df = attempts(spark, [80.0, 40.0, 30.0])
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("copy")
    assert selection.select_candidates(many).collect() == selection.select_candidates(df).collect()


def test_convergence_flags(spark):
    rows = selection.convergence_flags(attempts(spark, [50.0, 49.0, 48.0, 60.0])).orderBy("iteration").collect()
    assert [(r.stalled, r.degraded, r.stall_count, r.stops) for r in rows] == [
        (True, False, 1, False), (True, False, 2, True), (False, True, 2, True)
    ]


def test_isolated_map(spark):
    def function(text):
        if text == "bad":
            raise RuntimeError("boom")
        return text.upper()

    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "c")], "k int, text string")
    rows = selection.map_texts_isolated(df, "text", function).orderBy("k").collect()
    assert [r.success for r in rows] == [True, False, True]
    assert (rows[1].processed, rows[1].best_score, rows[1].iterations, rows[1].error) == ("bad", 100.0, 0, "boom")
    assert [rows[0].processed, rows[2].processed] == ["A", "C"]


def test_batch_summary(spark):
    df = spark.createDataFrame(
        [("r", True, 20.0, 2), ("r", False, 100.0, 0)], "run_id string, success boolean, best_score double, iterations int"
    )
    row = selection.batch_summary(df).first()
    assert (row.chunks, row.succeeded, row.failed, row.mean_best_score, row.total_iterations) == (2, 1, 1, 60.0, 2)


def predictions(spark, value):
    return spark.createDataFrame([(value,)], "p array<struct<label:string,score:double>>")


def test_predictions(spark):
    first = scoring.normalize_prediction(F.col("p"))
    assert predictions(spark, [("FAKE", 0.85)]).select(first).first()[0] == 85.0
    assert predictions(spark, [("REAL", 0.90)]).select(first).first()[0] == 10.0
    assert predictions(spark, []).select(first).first()[0] == 0.0
    fake = scoring.pick_label(F.col("p"))
    assert predictions(spark, [("Real", 0.20), ("Fake", 0.80)]).select(fake).first()[0] == 80.0
    assert predictions(spark, [("Real", 0.20)]).select(fake).first()[0] == 0.0
    assert predictions(spark, None).select(fake).first()[0] is None


def test_score_sources(spark):
    rows = [("one two.", 1.0, 2.0), ("one two.", None, 2.0), ("one two.", None, None), (" ", 7.0, None)]
    df = spark.createDataFrame(rows, "text string, m double, s double")
    got = scoring.resolve_score(df, "text", "m", "s").collect()
    assert [(r.score, r.from_fallback) for r in got] == [(1.0, False), (2.0, False), (65.0, True), (0.0, False)]


CALLS = "request_id bigint, priority int, provider string, status int, text string, tokens bigint, ts timestamp"


def calls(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], CALLS)


def quotas(spark, rows):
    return spark.createDataFrame(rows, "provider string, daily_limit bigint, used_today bigint, rpm_limit bigint")


def test_failover_takes_the_third_provider(spark):
    rows = [
        (1, 0, "openrouter", 500, None, 0), (1, 1, "google", 500, None, 0), (1, 2, "google", 200, "ok", 150),
        (1, 3, "groq", 200, "unused", 9),
        (2, 0, "openrouter", 500, None, 0),
        (3, 0, "openrouter", 200, "first", 5),
    ]
    made, none = calls(spark, rows), quotas(spark, [])
    got = {r.request_id: r for r in failover.resolve_failover(made, none).collect()}
    assert (got[1].text, got[1].priority, got[2].all_failed, got[3].text) == ("ok", 2, True, "first")
    errors = failover.failover_errors(made, none).orderBy("request_id", "priority").collect()
    assert [(r.request_id, r.priority) for r in errors] == [(1, 0), (1, 1), (2, 0)]
    # a provider without budget is skipped without an error; a missing record means there is budget
    spent = quotas(spark, [("google", 10, 10, 1)])
    got = {r.request_id: r for r in failover.resolve_failover(made, spent).collect()}
    assert (got[1].text, got[3].text) == ("unused", "first")
    assert failover.failover_errors(made, spent).count() == 2
    only = calls(spark, [(9, 0, "google", 200, "x", 1)])
    assert failover.resolve_failover(only, spent).first().all_failed


def test_usage(spark):
    made = calls(spark, [(1, 0, "google", 200, "a", 150), (2, 0, "groq", 429, None, 0), (3, 0, "groq", 200, "b", 7)])
    got = failover.accumulate_usage(quotas(spark, [("google", 1000, 50, 1), ("groq", 500, 1, 1), ("x", 5, 1, 1)]), made)
    assert {r.provider: r.used_today for r in got.collect()} == {"google": 200, "groq": 500, "x": 1}


def test_quota_percentages(spark):
    rows = [("google", 1_000_000, 400_000, 15), ("groq", 10_000, 2_500, 30), ("deepseek", 100_000, 100_000, 60),
            ("openrouter", 1_000_000, 100_000, 20)]
    got = {r.provider: r.remaining_percentage for r in failover.quota_usage(quotas(spark, rows)).collect()}
    assert got == {"google": 60.0, "groq": 75.0, "deepseek": 0.0, "openrouter": 90.0}
    default = failover.quota_usage(quotas(spark, [])).collect()
    assert {r.remaining_percentage for r in default} == {100.0} and len(default) == 4
    broken = failover.quota_usage(quotas(spark, [("google", 0, 5, 1)])).filter("provider = 'google'").first()
    assert (broken.remaining, broken.remaining_percentage) == (0, 0.0)


def test_seeding_twice_inserts_nothing(spark):
    defaults = failover.default_quotas(spark)
    first = failover.seed_quotas(quotas(spark, [("google", 5, 4, 99), ("other", 1, 1, 1)]), defaults)
    assert {r.provider: (r.daily_limit, r.used_today, r.rpm_limit, r.inserted) for r in first.collect()} == {
        "google": (1_000_000, 0, 99, False), "other": (1, 1, 1, False), "openrouter": (1_000_000, 0, 20, True),
        "groq": (14_400, 0, 30, True), "deepseek": (500_000, 0, 60, True),
    }
    again = failover.seed_quotas(first.drop("inserted"), defaults, reset_used=False)
    assert again.filter("inserted").count() == 0


def test_no_failed_call_is_lost(spark):
    rows = [(1, p, f"p{p}", 500, None, 0) for p in range(7)] + [(1, 2, "p2", 503, None, 0), (1, 7, "p7", 200, "ok", 1), (1, 8, "p8", 500, None, 0)]
    made = calls(spark, rows + [(1, 7, "p7", 200, "ok", 1)])
    errors = failover.failover_errors(made, quotas(spark, [])).orderBy("priority", "status").collect()
    assert [(r.priority, r.status) for r in errors] == [(0, 500), (1, 500), (2, 500), (2, 503), (3, 500), (4, 500), (5, 500), (6, 500)]
    assert [tuple(r) for r in failover.resolve_failover(made, quotas(spark, [])).collect()] == [(1, 7, "p7", "ok", False)]


def test_quota_records_count_once(spark):
    twice = quotas(spark, [("google", 10, 4, 1), ("google", 10, 6, 1)])
    used = {r.provider: r for r in failover.quota_usage(twice).collect()}
    assert len(used) == 4 and used["google"].remaining == 4
    after = failover.accumulate_usage(twice, calls(spark, [(1, 0, "google", 200, "x", 3)])).collect()
    assert [(r.provider, r.used_today) for r in after] == [("google", 9)]


def test_attempts_that_take_no_part_are_told(spark):
    schema = "run_id string, sequence_no bigint, iteration int, text string, score double, from_fallback boolean"
    rows = [("r", 0, i, f"t{i}", 90.0 - i, False) for i in range(6)] + [("r", 1, 1, "x", 5.0, False), ("r", 2, 0, "b", 50.0, False), ("r", 2, 1, None, 1.0, False)]
    df = spark.createDataFrame(rows, schema)
    told = {(r.sequence_no, r.iteration): r.reason for r in selection.unusable_attempts(df).collect()}
    assert told == {(0, 4): "beyond the last iteration", (0, 5): "beyond the last iteration", (1, 1): "no baseline", (2, 1): "no text or score"}
    chosen = {r.sequence_no: r.stop_reason for r in selection.select_candidates(df).collect()}
    assert chosen[1] == "no baseline"


def test_metric_abbreviations_one_by_one(spark):
    from textloom.functions.text import sentences_metrics

    shorts = ["Dr.", "dr.", "Mr.", "mr.", "Mrs.", "mrs.", "Ms.", "ms.", "Prof.", "prof.", "Col.", "col.", "Gen.", "gen.", "Vs.", "vs.",
              "e.g.", "E.g.", "i.e.", "I.e.", "a.m.", "p.m.", "A.M.", "P.M."]
    df = spark.createDataFrame([(f"One {s} two. Three.", f"One x{s} two.") for s in shorts], "a string, b string")
    rows = df.select(sentences_metrics(F.col("a")).alias("a"), sentences_metrics(F.col("b")).alias("b")).collect()
    for s, row in zip(shorts, rows, strict=True):
        assert row.a == [f"One {s} two.", "Three."] and len(row.b) == 2
