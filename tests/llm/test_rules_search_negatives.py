"""Rule ledger, blocked lexical search and threshold negatives against brute force, and their edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import rule_ledger as rules
from textloom.llm import term_blocks, threshold_negatives
from textloom.llm.vectors import integer_products

# --- rule ledger --------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    """The measurements of one text, word by word."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    upper = [w for w in words if re.search("[A-Z]", w) and not re.search("[a-z]", w)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered), len(upper), len(re.findall("[!?]", text)), sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def some_texts():
    rnd = random.Random(11)
    texts = [None, "", " \n\t", "word", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 9, "é\x85ü\xa0z #$%", "A B\nA B\n\nA B\n c", "日本 語 !!", "a" * 9000, "same\n" * 30]
    texts += [" ".join(rnd.choice("abcde") for _ in range(rnd.randrange(60))) for _ in range(120)]
    return [*texts, "\n".join(" ".join(rnd.choice(["ab", "Cd", "EF!"]) for _ in range(9)) for _ in range(300)), None, "word"]


def test_measurements_match_brute_force(spark, monkeypatch):
    texts = some_texts()
    docs = spark.createDataFrame([(i if i % 7 else None, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, failures string")
    names = [x.split()[0] for x in rules.MEASURES.split(", ")]
    ledger = rules.rule_ledger(docs)
    assert ledger.columns == ["doc_id", "text", *names, "failures"]
    want = collections.Counter()
    for i, t in enumerate(texts):
        values = measured(t)
        bits = sum(1 << n for n, (_, condition) in enumerate(rules.RULES) if eval(condition, {}, dict(zip(names, values, strict=True))))  # noqa: S307
        want[(i if i % 7 else None, t, *values, bits)] += 1
    assert collections.Counter(map(tuple, ledger.collect())) == want
    assert rules.rule_ledger(docs.limit(0)).count() == 0
    monkeypatch.setattr(rules, "WORDS", 10)  # texts in many parts
    assert [tuple(r) for r in rules.measure([(t or "").encode() for t in texts]).tolist()] == [measured(t) for t in texts]


def test_policies_and_ablations_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(1 << len(rules.RULES)) & rnd.randrange(1 << len(rules.RULES)), rnd.randrange(50), i % 3) for i in range(400)]
    ledger = spark.createDataFrame(rows, "doc_id long, failures long, n_words long, part int")
    policy = rules.Policy(9, ("few_words", "symbols"), ("long_words", "repeated_lines", "upper_case"), 1)
    names = [n for n, _ in rules.RULES]

    def keeps(bits, without=None):
        failed = {n for i, n in enumerate(names) if bits >> i & 1} - {without}
        return not failed & set(policy.hard) and len(failed & set(policy.soft)) <= policy.tolerated

    assert {(r["doc_id"], r["kept"]) for r in rules.apply_policy(ledger, policy).collect()} == {(i, keeps(bits)) for i, bits, _, _ in rows}
    got = {r["rule"]: tuple(r)[1:] for r in rules.ablations(ledger, policy).collect()}
    for name in (*policy.hard, *policy.soft):
        bit = 1 << names.index(name)
        decisive = [n for _, b, n, _ in rows if not keeps(b) and keeps(b, name)]
        failing = sum(b & bit > 0 for _, b, _, _ in rows)
        assert got[name] == (failing, failing if name in policy.hard else 0, len(decisive), sum(decisive))
    gone = [n for _, b, n, _ in rows if not keeps(b)]
    assert got[None] == (sum(b > 0 for _, b, _, _ in rows), len(gone), len(gone), sum(gone))
    for row in rules.summary(ledger, "part").collect():
        own = [b for _, b, _, p in rows if p == row["part"]]
        assert (row["n_docs"], row["any_fails"], row["all_fail"]) == (len(own), np.bitwise_or.reduce(own), np.bitwise_and.reduce(own))
    assert rules.ablations(ledger.limit(0), policy).count() == 0
    with pytest.raises(ValueError):
        rules.rule_ledger(ledger, rules=[])


def test_ledger_is_judged_again_without_texts(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30), (2, "Zu wenig"), (3, "One two three four five six seven eight nine ten " + " ".join(map(str, range(40))))], "doc_id long, text string")
    ledger = rules.rule_ledger(docs).drop("text")
    kept = {v: {r["doc_id"] for r in rules.apply_policy(ledger, p).filter("kept").collect()} for v, p in rules.POLICIES.items()}
    assert kept == {1: {3}, 2: {3}}


# --- lexical search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    split = [(i, terms(t)) for i, t in docs]
    many, whole = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = collections.Counter(w for _, t in split for w in set(t))
    out = set()
    for item, text in items:
        if item is None:
            continue
        scores = []
        for place, (i, t) in enumerate(split):
            if i is None:
                continue
            m, tf = 100 - 75 + (75 * len(t) * many) // max(1, whole), collections.Counter(t)
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in terms(text) if w in tf)
            if score > 0:
                scores.append((-score, i, place))
        out |= {(item, r + 1, i, -s) for r, (s, i, _) in enumerate(sorted(scores)[:k])}
    return out


def corpus(count, seed, words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(words * rnd.random() ** 2)}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 40)))) for i in range(count)]
    return docs, [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 12)))) for i in range(12)]


def test_ranking_matches_brute_force_with_pruning(spark, monkeypatch):
    for name, value in {"CELL": 50, "BLOCK": 4, "STEP": 4, "REPRESENTATIVES": 8, "CHUNK": 30}.items():
        monkeypatch.setattr(term_blocks, name, value)
    docs, items = corpus(600, 1)
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(5, docs[5][1])] * 3  # ties, one id several times
    found = term_blocks.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in found.collect()} == ranked(docs, items)
    monkeypatch.setattr(term_blocks, "TERMS", 10)  # queries in several blocks
    found = term_blocks.rank_documents(spark.createDataFrame(docs[:80], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in found.collect()} == ranked(docs[:80], items)


def test_blocks_are_skipped_and_bounds_hold(monkeypatch):
    monkeypatch.setattr(term_blocks, "BLOCK", 8)
    monkeypatch.setattr(term_blocks, "STEP", 16)
    rng = np.random.default_rng(5)
    size, count = 40, 500
    sizes = rng.integers(1, 12, count)
    ranks = np.concatenate([rng.choice(size, n, replace=False) for n in sizes])
    impacts = rng.integers(1, 1000, len(ranks)) * (size - ranks) ** 2  # rare terms matter most
    owner = np.repeat(np.arange(count), sizes)
    queries = [np.sort(rng.choice(size, 5, replace=False)) for _ in range(30)]
    asked = term_blocks.Queries(list(range(30)), queries, [np.ones(5, np.int64)] * 30, size)
    cell = term_blocks.build_cell(np.arange(count), sizes, ranks, impacts, asked.beside(), np.ones(size))
    assert sorted(zip(np.repeat(cell.block_terms, np.diff(cell.block_starts)), cell.block_docs, strict=True)) == sorted(zip(ranks, owner, strict=True))
    assert np.diff(cell.block_starts).max() <= 8
    scored = 0
    for q in queries:
        times = rng.integers(1, 3, 5)
        value = np.zeros(count, np.int64)
        for r, n in zip(q, times, strict=True):
            value[owner[ranks == r]] += n * impacts[ranks == r]
        blocks, bounds = term_blocks.block_bounds(cell, q, times)
        for block, bound in zip(blocks, bounds, strict=True):  # no document is above the bound of its first term's block
            own = [d for d in cell.block_docs[cell.block_starts[block] : cell.block_starts[block + 1]] if not set(q[q < cell.block_terms[block]]) & set(ranks[owner == d])]
            assert all(value[d] <= bound for d in own)
        ids, scores, n = term_blocks.search_cell(cell, q, times, 10, 0)
        want = sorted((-v, i) for i, v in enumerate(value) if v > 0)[:10]
        assert list(zip(ids, scores, strict=True)) == [(i, -v) for v, i in want]
        again = term_blocks.search_cell(cell, q, times, 10, int(scores[-1]))
        assert list(again[0]) == list(ids) and again[2] <= n
        scored += n
    assert scored < 0.6 * 30 * count  # most documents are never scored


def test_ranking_edges(spark):
    docs = [(1, None), (2, ""), (3, "--- ?!"), (4, "Ünïcode ÜNÏCODE a_b"), (None, "alpha beta"), (5, "ALPHA " * 5000 + "beta"), (6, "alpha"), (6, "alpha"), (7, "日本 x")]
    items = [(1, "alpha BETA alpha"), (2, None), (3, " . "), (None, "alpha"), (4, "nowhere"), (5, "ünïcode a b"), (6, "日本"), (7, "zeta"), (7, "alpha")]
    frame = spark.createDataFrame([(i, t, 3, "r") for i, t in docs], "doc_id long, text string, score int, rank string")
    asked = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    want = ranked(docs, [(i, t) for i, t in items if (i, t) != (7, "zeta")])
    got = [tuple(r) for r in term_blocks.rank_documents(frame, asked).collect()]
    assert set(got) == want and len(got) == len(want) and any(r[0] == 7 for r in got)
    assert term_blocks.rank_documents(frame.limit(0), asked).count() == 0
    assert term_blocks.rank_documents(frame, asked.limit(0)).count() == 0
    assert term_blocks.rank_documents(frame.filter("doc_id < 4"), asked).count() == 0


# --- hard negatives ---------------------------------------------------------------------------


def mined(rows, is_anchor, positives=5, negatives=10, scale=256):
    """Brute force in Python's integers; rows (id, label, vector)."""
    good = [(i, y, [math.floor(scale * float(x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in good), default=0)
    good = [(i, y, v + [0] * (width - len(v))) for i, y, v in good]
    out = collections.Counter()
    for anchor in sorted({i for i, _, _ in good if is_anchor(i)}):
        _, label, a = min((r for r in good if r[0] == anchor), key=lambda r: (r[1], r[2]))
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, a, v)))), i, y) for i, y, v in good if i != anchor)
        for place, (p, positive, _) in enumerate([s for s in scores if s[2] == label][:positives]):
            window = [(-s, i) for s, i, y in scores if y != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            for rank, (s, i) in enumerate(window):
                out[(anchor, positive, rank + 1, i, -p, s, place + 1)] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, y, v, "x", 1) for i, y, v in rows], "vec_id long, label int, embedding array<float>, rank string, score int")


def test_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(threshold_negatives, "CELL", 40)
    monkeypatch.setattr(threshold_negatives, "ANCHORS", 3)
    monkeypatch.setattr(threshold_negatives, "STEP", 2)
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(4), [rnd.choice([-1.0, -0.25, 0.0, 0.5, 1.0, rnd.random()]) for _ in range(6)]) for i in range(300)]
    rows += [(i, y, v) for i, y, v in rows[:40]] + [(500, 1, rows[0][2])] * 30 + [(20, 3, [0.0] * 6), (40, None, [1.0] * 6), (None, 1, [1.0] * 6), (60, 1, None), (80, 1, [1.0, None]), (90, 1, [float("nan")] * 6), (91, 1, [1.0, 0.5]), (92, 2, [])]
    found = threshold_negatives.hard_negatives(frame(spark, rows).repartition(4), F.col("vec_id") % 20 == 0)
    assert found.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined([(i, y, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows], lambda i: i % 20 == 0)
    assert collections.Counter(map(tuple, found.collect())) == want and sum(want.values()) > 100
    assert threshold_negatives.hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert threshold_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") < 0).count() == 0
    assert threshold_negatives.hard_negatives(frame(spark, rows).withColumn("label", F.lit(1)), F.col("vec_id") % 20 == 0).count() == 0


def broadcast_columns(spark, work):
    """The names of all columns that any job of ``work`` broadcast."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [store.executionsList(n, 1).head().physicalPlanDescription() for n in range(before, store.executionsCount())]
    return {re.sub("#.*", "", c) for plan in plans for found in re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan) for c in found.split(", ")}


def test_vectors_are_not_broadcast_to_cells(spark, monkeypatch):
    monkeypatch.setattr(threshold_negatives, "CELL", 20)
    rng = np.random.default_rng(4)
    rows = [(i, i % 5, v) for i, v in enumerate(rng.uniform(-1, 1, (600, 64)).tolist())]
    found = []
    names = broadcast_columns(spark, lambda: found.extend(threshold_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    assert collections.Counter(map(tuple, found)) == mined([(i, y, [float(np.float32(x)) for x in v]) for i, y, v in rows], lambda i: i % 10 == 0)
    assert names == {"part", "least", "most", "block", "first", "last"}


def test_negatives_of_many_cells_in_a_partition(spark, monkeypatch):
    for name, value in {"CELL": 16, "ANCHORS": 4, "PLACES": 2}.items():
        monkeypatch.setattr(threshold_negatives, name, value)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([-7, 1, 1, 2, 90]), [rnd.uniform(-200, 200) for _ in range(5)]) for i in range(240)]
    got = threshold_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    want = mined([(i, y, [float(np.float32(x)) for x in v]) for i, y, v in rows], lambda i: i % 10 == 0)
    assert collections.Counter(map(tuple, got.collect())) == want and sum(want.values()) > 100


def test_negatives_of_large_components(spark):
    rnd = random.Random(2)
    rows = [(i, i % 2, [rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(0, 30) for _ in range(4)]) for i in range(60)]
    got = threshold_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    want = mined([(i, y, [float(np.float32(x)) for x in v]) for i, y, v in rows], lambda i: i % 10 == 0)
    assert collections.Counter(map(tuple, got.collect())) == want


def test_threshold_stops_early_and_keeps_ties(monkeypatch):
    monkeypatch.setattr(threshold_negatives, "STEP", 4)
    rng = np.random.default_rng(1)
    x = np.floor(100 * rng.standard_normal((2000, 4)))
    x[1500:1600] = x[np.argmax(x @ np.array([300.0, -5, 0, 2]))]  # many ties at the top
    order, ids = np.argsort(x, axis=0, kind="stable").T.astype(np.int32), rng.permutation(2000)
    anchor = np.array([300.0, -5, 0, 2])
    best = threshold_negatives.Best(10, -(1 << 63), (1 << 63) - 1)
    scored = threshold_negatives.threshold_search(anchor, x, order, ids, np.ones(2000, bool), [best])
    want = sorted(zip((-(x @ anchor)).astype(int), ids, strict=True))[:10]
    assert list(zip(-best.scores, best.ids, strict=True)) == want and scored < 1000
    nothing = threshold_negatives.Best(3, 0, 0)
    threshold_negatives.threshold_search(np.zeros(4), x, order, ids, np.ones(2000, bool), [nothing])
    assert list(nothing.ids) == [0, 1, 2]


def test_integer_products_are_exact_at_every_size():
    for power in (3, 20, 30, 40):
        q, x = (np.floor(np.random.default_rng(power + i).uniform(-1, 1, (3, 5)) * 2.0**power) for i in range(2))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for v in x] for u in q]
        assert integer_products(q, x).tolist() == want
    assert integer_products(np.zeros((0, 3)), np.zeros((2, 3))).shape == (0, 2)
