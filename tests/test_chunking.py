import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import chunking as C
from textloom.sources.blocks import html_blocks


def chunks(spark, text, target, maximum):
    df = C.chunk_documents(spark.createDataFrame([(0, text)], "doc_id int, text string"), "text", target, maximum)
    return df.orderBy("chunk_id").collect()


def test_paragraph_boundaries(spark):
    got = chunks(spark, "one two three four five six seven.\n\na b c d e f g.", 10, 15)
    assert [c.paragraph_indices for c in got] == [[0], [1]]
    assert [c.word_count for c in got] == [7, 7]


def test_sentence_boundaries(spark):
    got = chunks(spark, "one two three four. a b c d. v w x y z.", 5, 7)
    assert [c.word_count for c in got] == [4, 4, 5]


def test_clauses_and_words(spark):
    got = chunks(spark, "one two three, four five six; seven eight nine ten eleven twelve thirteen", 5, 7)
    assert [c.text for c in got] == [
        "one two three, four five six;", "seven eight nine ten eleven twelve thirteen"
    ]


def test_small_blocks_share_a_chunk(spark):
    df = spark.createDataFrame([(0, "<p>one two three</p><p> </p><p>a b c d e</p>")], "k int, html string")
    paras = df.select("k", C.block_paragraphs(html_blocks(F.col("html"))).alias("p"))
    got = C.chunk_paragraphs(paras, "p", 10, 15).collect()
    assert [(c.text, c.paragraph_indices) for c in got] == [("one two three a b c d e", [0, 2])]


@pytest.mark.parametrize("text", ["", None, "  \n\n "])
def test_nothing_to_chunk(spark, text):
    assert chunks(spark, text, 10, 15) == []


def brute_force(units, target, maximum):
    """Word counts of chunks for (words, rule) units, restated step by step."""
    out, count = [], 0
    for words, rule in units:
        close = rule == 2
        if rule == 0 and count + words > target and count >= max(1, target // 2):
            close = True
        if count + words > maximum:
            close = True
        if close and count:
            out.append(count)
            count = 0
        count += words
    return out + ([count] if count else [])


def test_budget_against_brute_force(spark):
    rng = random.Random(7)
    docs, expected = [], {}
    for doc in range(40):
        units, paras = [], []
        for _ in range(rng.randint(1, 12)):
            sentences = [rng.randint(1, 9) for _ in range(rng.randint(1, 6))]
            paras.append(" ".join(" ".join(["w"] * (n - 1) + ["w."]) for n in sentences))
            if sum(sentences) <= 14:
                units.append((sum(sentences), 0))
            else:
                units += [(n, 2 if i == 0 else 1) for i, n in enumerate(sentences)]
        docs.append((doc, "\n\n".join(paras)))
        expected[doc] = brute_force(units, 9, 14)
    df = C.chunk_documents(spark.createDataFrame(docs, "doc_id int, text string"), "text", 9, 14)
    got = {}
    for row in df.orderBy("doc_id", "chunk_id").collect():
        got.setdefault(row.doc_id, []).append(row.word_count)
    assert got == expected


def test_chunks_lose_no_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    pieces = C.chunk_documents(docs)
    assert pieces.filter("word_count > 400").count() == 0
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    whole = C.reassemble(pieces, "doc_id", "chunk_id", "text", "").select("doc_id", squeeze("text").alias("a"))
    assert whole.join(docs, "doc_id").filter(squeeze("text") != F.col("a")).count() == 0
    dense = pieces.groupBy("doc_id").agg((F.max("chunk_id") + 1 == F.count("*")).alias("ok"))
    assert dense.filter("not ok").count() == 0


def test_slicer_steps_back_to_the_best_boundary(spark):
    def pieces(text, n):
        return spark.createDataFrame([(text,)], "t string").select(C.slice_chars(F.col("t"), n)).first()[0]

    text = "Hello world, this is a long sentence. We want to test the shiftback."
    assert pieces(text, 30)[0] == "Hello world,"
    assert pieces("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    assert pieces("one two\n\nthree four", 12) == ["one two", "three four"]
    assert pieces(None, 5) == [] and pieces("  ", 5) == []
    assert pieces("x" * 2000, 900) == ["x" * 900, "x" * 900, "x" * 200]


def test_new_rows_have_stable_keys(spark):
    df = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], "run_id string, chunk_id int, text string")
    first, second = C.new_chunk_rows(df).collect(), C.new_chunk_rows(df.repartition(4)).orderBy("sequence_no").collect()
    assert [r.chunk_id for r in first] == [r.chunk_id for r in second]
    assert first[0].processed is None and first[0].iterations == 0


def test_reassembly_collapses_copies_and_knows_no_limit(spark):
    rows = [(1, i, f"t{i}") for i in range(7)] * 3
    df = spark.createDataFrame(rows, "k int, p int, t string")
    assert C.reassemble(df, "k", "p", "t", " ").first()["t"] == "t0 t1 t2 t3 t4 t5 t6"
    many = spark.range(70_003).select(F.lit(1).alias("k"), F.col("id").alias("p"), F.col("id").cast("string").alias("t"))
    whole = C.reassemble(many, "k", "p", "t", " ").collect()
    assert len(whole) == 1 and whole[0]["n_pieces"] == 70_003 and whole[0]["t"].split() == [str(i) for i in range(70_003)]


def test_split_long_never_exceeds_the_limit(spark):
    rng = random.Random(3)
    rows = [(" ".join("w" + rng.choice(["", "", ",", ";"]) for _ in range(rng.randint(1, 90))),) for _ in range(30)]
    df = spark.createDataFrame(rows, "t string").select("t", X.split_long(F.col("t"), 12).alias("p"))
    for row in df.collect():
        assert " ".join(row.p) == row.t
        assert all(len(p.split()) <= 12 for p in row.p)
