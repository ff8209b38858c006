"""Searches, components and URL rules against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_topk, posting_lists
from textloom.llm.exact_topk import exact_top_k
from textloom.llm.graph import connected_components
from textloom.llm.posting_lists import nearest_neighbours
from textloom.llm.queries import URL_RULES
from textloom.llm.url_filter import judge_urls

VECTORS = "vec_id long, embedding array<float>, rank string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, seed, n, dim=12, hot=0):
    rnd = np.random.default_rng(seed)
    rows = rnd.normal(size=(n, dim)) * rnd.choice([0.1, 1.0, 3.0], size=(n, 1))
    rows[:hot] = rows[0]  # one vector many times
    data = [(i, [float(np.float32(x)) for x in row], "x") for i, row in enumerate(rows)]
    data += [(1000 + n, None, "x"), (1001 + n, [1.0, None], "x"), (1002 + n, [NAN] * dim, "x"), (1100 + n - n % 100, [INF] * dim, "x"), (1003 + n, [0.0] * dim, "x"), (1004 + n, [2.0], "x"), (None, [1.0] * dim, "x")]
    return spark.createDataFrame(data, VECTORS), [(i, np.array(list(v) + [0.0] * (dim - len(v)))) for i, v, _ in data if i is not None and v and None not in v and np.isfinite(v).all()]


@pytest.mark.parametrize(("n", "cell", "hot"), [(30, 8192, 0), (900, 128, 300), (5, 8192, 5)])
def test_exact_top_k(spark, monkeypatch, n, cell, hot):
    monkeypatch.setattr(exact_topk, "CELL", cell)
    monkeypatch.setattr(exact_topk, "STEP", 32)
    df, rows = vectors(spark, n, n, hot=hot)
    whole = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 10 == 0:
            best = sorted((-int(v @ x), i) for i, x in whole if i != q)[:10]
            want += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(best)]
    got = exact_top_k(df, F.col("vec_id") % 10 == 0, k=10)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_top_k_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert exact_top_k(empty, F.col("vec_id") % 10 == 0, k=3).count() == 0
    rnd = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rnd.choice([-1, 1], 3) * 10.0 ** rnd.integers(0, 30, 3)], "x") for i in range(60)]
    want = []
    for q, v, _ in rows[::10]:
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, x, strict=True)))), i) for i, x, _ in rows if i != q)
        want += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scores[:3])]
    huge = spark.createDataFrame(rows, VECTORS)
    assert sorted(map(tuple, exact_top_k(huge, F.col("vec_id") % 10 == 0, k=3).collect())) == sorted(want)


def brute_near(rows, step):
    out = {}
    for q, v in rows:
        if q % step == 0:
            out[q] = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in rows if i != q and x.any())[:10]
    return {q: best for q, best in out.items() if dict(rows)[q].any()}


def test_single_list_is_exact(spark):
    df, rows = vectors(spark, 3, 200, hot=50)
    got = collections.defaultdict(list)
    for r in sorted(nearest_neighbours(df, F.col("vec_id") % 10 == 0, k=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert dict(got) == brute_near(rows, 10)


def test_recall_and_parts(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "PART", 64)
    monkeypatch.setattr(posting_lists, "QUERY_PART", 16)
    df, rows = vectors(spark, 8, 4000, dim=16, hot=900)
    found = nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=10).collect()
    want, by = brute_near(rows, 20), collections.defaultdict(list)
    for r in found:
        by[r["query_id"]].append(r["score"])
    # Equal vectors tie, so recall is taken by distance.
    hits = sum(sum(s <= want[q][-1][0] for s in scores) for q, scores in by.items())
    assert hits / sum(map(len, want.values())) >= 0.9 and max(map(len, by.values())) == 10
    assert len({(r["query_id"], r["vec_id"]) for r in found}) == len(found)
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0, k=10).count() == 0


@pytest.mark.parametrize("dim", [8, 32])
def test_recall_where_lists_are_pruned(spark, monkeypatch, dim):
    monkeypatch.setattr(posting_lists, "LIST", 16)
    monkeypatch.setattr(posting_lists, "SMALL", 64)
    df, rows = vectors(spark, dim, 6000, dim=dim)
    read = []
    placed = posting_lists._placed

    def counted(graph, dim, ratio, least, most):
        if least > 1:  # the lists of queries
            read.append(len(graph.value[0]) if isinstance(graph.value, tuple) else len(graph.value.centre))
        return placed(graph, dim, ratio, least, most)

    monkeypatch.setattr(posting_lists, "_placed", counted)
    found = nearest_neighbours(df, F.col("vec_id") % 40 == 0, k=10, probe=1.3).collect()  # short lists miss more at the same ratio
    want, by = brute_near(rows, 40), collections.defaultdict(list)
    for r in found:
        by[r["query_id"]].append(r["score"])
    hits = sum(sum(s <= want[q][-1][0] for s in scores) for q, scores in by.items())
    assert read and read[0] > 300, read
    assert hits / sum(map(len, want.values())) >= 0.9


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(rnd.randrange(500, 900), rnd.randrange(500, 900)) for _ in range(250)] + [(7, 7), (None, 3), (50, 51), (51, 50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {tuple(r) for r in got} == {(x, find(x)) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_url_rules_and_aliases(spark):
    canonical = '<html><head><LINK href="{}" rel=canonical></head>'
    refresh = "<meta http-equiv='Refresh' content='0; url={}'>"
    pages = [
        (1, "http://Sub.Example.ORG/es/x?q", None), (2, "https://example.org/en/12", ""), (3, "http://a.com/fr/1#f", ""),
        (4, "http://a.com/de/1", ""), (5, "http://xcom/de/", ""), (6, None, None), (7, "no url", ""), (8, "http://b.net", refresh.format("//c.net/go")),
        (9, "http://c.net/go", canonical.format("http://a.com/de/1")), (10, "http://d.net/p/q", canonical.format("../x") + refresh.format("/r")),
        (11, "http://e.org/x", canonical.format("http://b.net")), (12, "http://f.net/1", canonical.format("http://example.org/es/only-named")),
        (13, "http://com/de/", ""), (14, "http://d.net/r", ""), (4, "http://a.com/de/1", ""), (15, "http://b.net", None), (16, "s://h://x/y", ""),
    ]
    df = spark.createDataFrame([(*p, "allow") for p in pages], "page_id long, url string, html string, verdict string")
    rows = judge_urls(df, URL_RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("sub.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("a.com", "/fr/1", "com/fr/", "allow") and got[4] == ("a.com", "/de/1", "com/de/", "block")
    assert got[5] == ("xcom", "/de/", None, "allow") and got[6] == got[7] == ("", "", None, "allow") and got[13][2] == "com/de/"
    assert got[8][3] == got[9][3] == got[12][3] == got[15][3] == "block"  # through their aliases
    assert got[11] == ("e.org", "/x", "org/", "allow")  # an express allow stands
    assert got[10][3] == got[14][3] == "allow" and got[16][:2] == ("h:", "//x/y")
    assert judge_urls(df.limit(0), URL_RULES).count() == 0
