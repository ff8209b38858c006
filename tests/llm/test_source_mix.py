"""The source mix against plain computations."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import source_mix


def plain_flow(patterns, quotas, repeats):
    """(flow, cost) of a min-cost maximum flow by successive cheapest paths, one token at a time."""
    arcs = []  # from, to, capacity, cost
    start, end = "start", "end"
    for p, (sources, tokens) in enumerate(patterns):
        arcs += [[start, ("p", p), tokens, level] for level in range(repeats)] + [[("p", p), ("s", s), 10**9, 0] for s in sources]
    arcs += [[("s", s), end, quota, 0] for s, quota in enumerate(quotas)]
    flow, cost = 0, 0
    while True:
        best, came = {start: 0}, {}
        changed = True
        while changed:
            changed = False
            for arc in arcs:
                for a, b, free, price, way in ((arc[0], arc[1], arc[2], arc[3], 1), (arc[1], arc[0], arc[4] if len(arc) > 4 else 0, -arc[3], -1)):
                    if free > 0 and a in best and best[a] + price < best.get(b, 10**9):
                        best[b], came[b], changed = best[a] + price, (arc, way, a), True
        if end not in best:
            return flow, cost
        node = end
        while node != start:
            arc, way, before = came[node]
            if len(arc) == 4:
                arc.append(0)
            arc[2], arc[4] = arc[2] - way, arc[4] + way
            node = before
        flow, cost = flow + 1, cost + best[end]


def test_flow_is_maximal_and_cheapest():
    rnd = random.Random(2)
    for _ in range(60):
        sources = rnd.randrange(1, 4)
        patterns = [(sorted(rnd.sample(range(sources), rnd.randrange(1, sources + 1))), rnd.randrange(5)) for _ in range(rnd.randrange(1, 5))]
        quotas = [rnd.randrange(9) for _ in range(sources)]
        taken = source_mix.routed(patterns, quotas, 2)
        assert all(0 <= t <= 2 * tokens for t, (_, tokens) in zip(taken, patterns, strict=True))
        cost = sum(max(0, t - tokens) for t, (_, tokens) in zip(taken, patterns, strict=True))
        assert (sum(taken), cost) == plain_flow(patterns, quotas, 2)


def test_very_many_sources_have_plain_targets(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "MAX_PATTERNS", 50)  # none of them may come to the driver
    monkeypatch.setattr(source_mix, "RANGE", 30_000)
    count = 200_000
    docs = spark.range(count).select(F.col("id").alias("doc_id"), F.array(F.format_string("h%06d", F.col("id"))).alias("sources"), (F.col("id") * F.col("id") % 97).alias("size"))
    mixed = source_mix.mix_sources(docs, "sources", "size")
    sizes = [i * i % 97 for i in range(count)]
    want = source_mix.capped_targets(sizes, [(3, 1, 2)[i % 3] for i in range(count)], 1.5 * sum(sizes), 2)
    got = mixed.select("doc_id", F.col("targets")[0].alias("target"), "taken", "size").toPandas().sort_values("doc_id")
    assert len(got) == count and got["target"].tolist() == pytest.approx(want, rel=1e-9)
    assert (got["taken"] <= 2 * got["size"]).all()


def test_sources_that_overlap_and_that_do_not(spark):
    rnd = random.Random(7)
    names = ["a", "b", "c", "d", None]
    rows = [(i, rnd.choice([["a"], ["b"], ["a", "b"], ["c"], ["d"], [None], ["d", None]]), rnd.randrange(1, 30)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    mixed = source_mix.mix_sources(docs, "sources", "size").collect()
    tokens = collections.Counter()
    for _, sources, size in rows:
        tokens[tuple(sources)] += size
    sizes = [sum(n for p, n in tokens.items() if s in p) for s in names]
    targets = source_mix.capped_targets(sizes, [3, 1, 2, 3, 1], 1.5 * sum(tokens.values()), 2)
    taken = collections.Counter()
    for r in mixed:
        key = sorted(r["sources"], key=lambda s: (s is None, s or ""))
        assert [pytest.approx(targets[names.index(s)]) for s in key] == r["targets"]
        taken[tuple(r["sources"])] += r["taken"]
    flow = sum(source_mix.routed([([names.index(s) for s in p], n) for p, n in sorted(tokens.items(), key=repr)], [round(t) for t in targets], 2))
    assert abs(sum(taken.values()) - flow) <= 0.02 * flow


def test_too_many_overlaps_give_to_one_source_each(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, sorted(rnd.sample("abcdefgh", rnd.randrange(1, 4))), rnd.randrange(1, 50)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    monkeypatch.setattr(source_mix, "MAX_PATTERNS", 5)
    mixed = source_mix.mix_sources(docs, "sources", "size", share=0.6).collect()
    assert len(mixed) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in mixed)
    want = sum({s: t for r in mixed for s, t in zip(sorted(r["sources"]), r["targets"], strict=True)}.values())
    assert abs(sum(r["taken"] for r in mixed) - want) < 0.1 * want


def test_results_do_not_depend_on_the_number_of_patterns(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(0, rnd.sample(names, rnd.randrange(1, 4)), rnd.randrange(1, 50)) for names in ("abcde", "fgh") for _ in range(150)]
    rows += [(0, rnd.choice([["x"], ["x", "y"], ["y"], ["z"], [None, "z"]]), rnd.randrange(1, 50)) for _ in range(150)]
    rows = [(i, sorted(set(s), key=lambda x: (x is None, x or "")), n) for i, (_, s, n) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")

    def taken():
        return {r["doc_id"]: (r["taken"], r["targets"]) for r in source_mix.mix_sources(docs, "sources", "size").collect()}

    whole = taken()
    monkeypatch.setattr(source_mix, "MAX_PATTERNS", 3)
    assert taken() == whole
    sums = collections.Counter()
    for _, sources, n in rows:
        sums[tuple(sources)] += n
    names = sorted({s for p in sums for s in p}, key=lambda s: (s is None, s or ""))
    targets = {s: t for i, sources, _ in rows for s, t in zip(sources, whole[i][1], strict=True)}
    flow = sum(source_mix.routed([([names.index(s) for s in p], n) for p, n in sums.items()], [round(targets[s]) for s in names], 2))
    assert abs(sum(t for t, _ in whole.values()) - flow) <= 0.02 * flow


def test_null_and_repeated_ids(spark):
    rows = [(None, ["a"], 5)] * 6 + [(1, ["a"], 5)] * 6 + [(2, None, 5), (3, [], 5), (4, ["b"], None), (5, ["b"], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long").withColumn("taken", F.lit("x"))
    mixed = source_mix.mix_sources(docs, "sources", "size").collect()
    assert len(mixed) == len(rows)
    assert all(r["taken"] in (None, 0) for r in mixed if r["doc_id"] in (2, 3, 4, 5))
    assert all(r["taken"] in (0, 5, 10) for r in mixed if r["sources"] == ["a"])
