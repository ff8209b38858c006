"""Running budgets and the global glossary against plain Python."""

import datetime as dt
import random
import re

import pytest

from textloom.operators import failover, glossary


def plain_usage(calls, quotas):
    """Calls in order of time, each looked at before it is charged."""
    limits = {p: (limit, used) for p, limit, used, _ in quotas}
    first, used, out = {}, {}, []
    for i, priority, provider, status, _, tokens, ts in sorted(calls, key=lambda c: (c[6] or dt.datetime.min, c[0], c[1])):
        if provider not in limits or ts is None:
            out.append((i, priority, provider, None, False))
            continue
        limit, start = limits[provider]
        day = (provider, ts.date())
        first.setdefault(provider, ts.date())
        before, hit = used.setdefault(day, (start if ts.date() == first[provider] else 0, False))
        before = limit if hit else before
        out.append((i, priority, provider, before, before >= limit))
        used[day] = (before + max(0, tokens or 0), hit or status in (429, 503))
    return out


@pytest.fixture
def calls(spark, monkeypatch):
    monkeypatch.setattr(failover, "BLOCK_CALLS", 40)  # several ranges a provider and day
    rnd = random.Random(5)
    start = dt.datetime(2024, 5, 1)
    rows = []
    for i in range(500):
        ts = start + dt.timedelta(minutes=rnd.randrange(4 * 24 * 60) if i % 3 else 30)  # a third at one time
        rows.append((i // 2, i % 2, rnd.choice(["google", "groq", "groq", "deepseek", "mystery"]), rnd.choice([200] * 12 + [500, 429, None]),
                     None if i % 17 == 0 else f"t{i}", rnd.choice([None, -5, 10, 30]), None if i % 50 == 7 else ts))
    return rows, spark.createDataFrame(rows, "request_id long, priority int, provider string, status int, text string, tokens long, ts timestamp")


def quota_rows(spark, rows):
    return spark.createDataFrame(rows, "provider string, daily_limit long, used_today long, rpm_limit long")


QUOTAS = [("groq", 300, 120, 1), ("google", 900, 0, 1), ("deepseek", 40, 40, 1)]


def test_running_usage_matches_a_plain_walk(spark, calls):
    rows, df = calls
    got = failover.running_usage(df, quota_rows(spark, QUOTAS))
    assert got.columns == [*df.columns, "used_before", "exhausted_at_call"]
    found = sorted((r.request_id, r.priority, r.provider, r.used_before, r.exhausted_at_call) for r in got.collect())
    want = sorted(plain_usage(rows, QUOTAS), key=lambda r: r[:2])
    assert found == want
    share = sum(r[4] for r in want) / len(want)
    assert 0.1 < share < 0.9  # budgets do run out during the day
    assert failover.running_usage(df.limit(0), quota_rows(spark, QUOTAS)).count() == 0
    assert not any(r.exhausted_at_call for r in failover.running_usage(df, quota_rows(spark, [])).collect())


def test_running_failover_skips_calls_that_should_have_been_refused(spark, calls):
    rows, df = calls
    refused = {r[:2] for r in plain_usage(rows, QUOTAS) if r[4]}
    got = {r.request_id: (r.priority, r.text, r.all_failed) for r in failover.resolve_running_failover(df, quota_rows(spark, QUOTAS)).collect()}
    for i in {r[0] for r in rows}:
        good = sorted((r[1], r[4]) for r in rows if r[0] == i and r[3] == 200 and r[4] is not None and r[:2] not in refused)
        assert got[i] == ((*good[0], False) if good else (None, None, True))


def test_a_day_has_few_windowed_rows(spark, calls):
    """No window spans a provider: single calls are windowed within a range of a provider and day."""
    _, df = calls
    plan = failover.running_usage(df, quota_rows(spark, QUOTAS))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and any("_block" in w.split("], [")[1] for w in windows)


# --- glossary ---------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[a-z0-9'-]+", (text or "").lower())


def holds(text, term):
    w, t = words(text), words(term)
    return any(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1))


def test_glossary_matches_term_by_term(spark):
    rnd = random.Random(9)
    vocabulary = ["the", "the", "the", "of", "gradient", "descent", "back-prop", "loss", "net"]
    text = lambda n: rnd.choice([" ", "\n", ", "]).join(rnd.choice(vocabulary) for _ in range(rnd.randrange(n)))
    rows = [(i, text(20).title(), text(20)) for i in range(150)]
    rows += [(3, text(30), "x"), (None, "The Gradient descent", None), (None, None, "net"), (700, "", ""), (701, "the " * 20_000 + "loss net", "loss")]
    terms = [(t,) for t in ["Gradient Descent", "gradient  descent", "the", "the the the", "net loss", "LOSS NET", "nowhere", "the nowhere", "", None, "?!", "descent of the net", "back-prop"]]
    docs = spark.createDataFrame(rows, "id long, source string, processed string").withColumnRenamed("processed", "after")
    got = glossary.global_glossary_losses(docs, spark.createDataFrame(terms, "term string"), "id", "source", "after")
    assert got.columns == ["id", "source", "after", "expected_terms", "lost_terms"]
    known = {" ".join(words(t)) for (t,) in terms if words(t)}
    want = []
    for i, source, after in rows:
        expected = sorted(t for t in known if holds(source, t))
        want.append((i, source, after, expected, [t for t in expected if not holds(after, t)]))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert glossary.global_glossary_losses(docs, spark.createDataFrame([], "term string"), "id", "source", "after").filter("size(expected_terms) > 0").count() == 0
    assert glossary.global_glossary_losses(docs.limit(0), spark.createDataFrame(terms, "term string"), "id", "source", "after").count() == 0


def test_glossary_joins_by_words_only(spark):
    docs = spark.createDataFrame([(1, "a b", "a")], "id long, source string, after string")
    terms = spark.createDataFrame([("a b",)], "term string")
    plan = glossary.global_glossary_losses(docs, terms, "id", "source", "after")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_hold_a_pair_of_the_term(spark):
    """Texts of common words are no candidates for every term of these words, and many terms of a text are all found."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "d c b a"), (3, "a")], "id long, text string")
    terms = glossary.glossary_terms(spark.createDataFrame([("a c",), ("b d",), ("a b",), ("b c d",), ("c a b",)], "term string"))
    got = {r.id: sorted(r.candidates) for r in glossary.candidate_terms(docs, terms, "id", "text").collect()}
    assert got == {1: ["a b", "b c d"]}

    text = " ".join(f"w{i}" for i in range(500))
    many = [(f"w{i} w{i + 1}",) for i in range(0, 499)] + [(f"w{i} w{i + 1} w{i + 2}",) for i in range(0, 20)]
    row = glossary.global_glossary_losses(
        spark.createDataFrame([(1, text, text.replace("w7 ", ""))], "id long, text string, after string"), spark.createDataFrame(many, "term string"), "id", "text", "after"
    ).first()
    assert row.expected_terms == sorted(t for (t,) in many)
    assert row.lost_terms == ["w5 w6 w7", "w6 w7", "w6 w7 w8", "w7 w8", "w7 w8 w9"]
