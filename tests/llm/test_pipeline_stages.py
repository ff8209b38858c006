"""Every stage of the pipeline on a small table with odd rows, against plain Python."""

import collections
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from test_text_operators import language_by_hand
from textloom.llm import source_mix, toxicity
from textloom.llm.byte_bpe import read_ranks
from textloom.llm.queries import LANGUAGES

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 3000").orderBy("doc_id").limit(70).collect()]
    text = next(r[1] for r in rows if len(r[1].split()) > 60)
    words = text.split()
    near = " ".join(["other", *words[1:]])
    rows += [(None, text, "en", "src1", 1), (None, None, None, None, None), (9001, "", "en", None, 0), (9002, None, "en", "src1", None), (9003, "12 34 € !", "en", "src1", 9)]
    rows += [(9004, near, "en", "src2", 7), rows[3], rows[3], (9005, "the thing " * 30_000, "en", "src1", 300_000), (9006, text, "en", "src3", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def kept(spark, docs, stage):
    out = STAGE[stage](spark, docs, SF)
    assert out.columns == docs.columns
    return collections.Counter(map(tuple, out.collect()))


def rows_of(docs):
    return collections.Counter(map(tuple, docs.collect()))


def test_toxicity_stage(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    judged = collections.Counter()
    for r in toxicity.judge_toxicity(docs, labels).collect():
        if r["score"] < 0.3:
            judged[tuple(r[c] for c in docs.columns)] += 1
    assert kept(spark, docs, "toxicity") == judged
    assert set(judged) <= set(rows_of(docs))


def test_language_stage(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    want = language_by_hand([(r[1], r[2], r[3]) for r in rows], LANGUAGES)
    assert kept(spark, docs, "language_id") == collections.Counter(r for r, (_, _, rejected) in zip(rows, want, strict=True) if not rejected)


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicate_stage(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    sets = {r: shingles(r[1]) for r in rows}
    group = {r: r for r in sets if r[0] is not None}

    def top(r):
        while group[r] != r:
            r = group[r]
        return r

    for a in group:
        for b in group:
            if a[0] < b[0] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)), key=lambda r: r[0])
                group[high] = low
    assert len({top(r) for r in group}) < len(group)
    got = kept(spark, docs, "ngram_jaccard_join")
    assert {r for r in got if r[0] is not None} == {top(r) for r in group}
    assert all(got[top(r)] == 1 for r in group)
    assert sum(n for r, n in got.items() if r[0] is None) == sum(r[0] is None for r in rows)


def test_mixing_stage(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    size = {r: len((r[1] or "").encode().split()) for r in rows}
    got = kept(spark, docs, "source_mix")
    times = collections.Counter(rows)
    assert set(got) <= set(times) and all(got[r] <= 2 * times[r] for r in times) and all(size[r] for r in got)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n * size[r] for r, n in times.items() if r[3] == s) for s in sources]
    targets = source_mix.capped_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5 * sum(sizes), 2)
    for s, whole, target in zip(sources, sizes, targets, strict=True):
        taken = sum(n * size[r] for r, n in got.items() if r[3] == s)
        largest = max(size[r] for r in rows if r[3] == s)
        assert abs(taken - target) <= largest and taken <= 2 * whole


def test_token_stage(spark, docs):
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = STAGE["byte_bpe"](spark, docs, SF)
    want = collections.Counter()
    for r in docs.collect():
        ids = coder.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, docs, stage):
    assert STAGE[stage](spark, docs.limit(0), SF).count() == 0
