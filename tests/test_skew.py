"""One key, word or run holds a third of all rows; results must stay whole."""

import math
from collections import Counter

from pyspark.sql import functions as F

from textloom.operators import chunking, ledger, metrics, selection


def test_perplexity_with_a_word_that_is_a_third_of_the_corpus(spark):
    docs = [(i, "the " * (i % 7 + 1) + " ".join(f"w{(i * k) % 41}" for k in range(1, 9))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    corpus = Counter(w for _, t in docs for w in t.split())
    total = sum(corpus.values())
    assert corpus["the"] > total / 4
    # shares of 1/10 and 1/1000 send different words through the broadcast and the shuffle
    for share in (10, 1000):
        got = {r.doc_id: (r.word_count, r.perplexity) for r in metrics.corpus_perplexity(df, "doc_id", frequent_share=share).collect()}
        for key, text in docs:
            words = text.split()
            expected = math.exp(-sum(math.log(corpus[w] / total) for w in words) / len(words))
            assert got[key][0] == len(words) and math.isclose(got[key][1], expected, rel_tol=1e-9)


def test_statistics_of_a_hot_source(spark):
    rows = [("hot", f"One two {i}. Three four five.") for i in range(200)] + [(f"s{i}", "Alone here.") for i in range(20)]
    got = {r.source: r for r in metrics.corpus_statistics(spark.createDataFrame(rows, "source string, text string"), "source").collect()}
    assert (got["hot"].documents, got["hot"].sentences, got["hot"].words) == (200, 400, 1200)
    assert got["hot"].distinct_words == 205 and got["hot"].mean_sentence_length == 3.0
    assert len(got) == 21


def test_a_hot_run_keeps_all_its_chunks(spark):
    runs = spark.range(50).select(F.col("id").alias("run_id"), F.lit("x").alias("filename"))
    chunks = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("run_id"), F.col("id").alias("sequence_no")
    )
    plain = runs.join(chunks, "run_id", "left").select("run_id", "filename", "sequence_no")
    joined = ledger.runs_with_chunks(runs, chunks).select("run_id", "filename", "sequence_no")
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0


def test_a_hot_conversation_comes_back_whole(spark):
    pieces = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9 + 1).alias("k"), F.col("id").alias("p"),
        F.col("id").cast("string").alias("t"),
    )
    whole = chunking.reassemble(pieces, "k", "p", "t", " ").filter("k = 0").collect()
    assert len(whole) == 1 and whole[0].t.split() == [str(i) for i in range(0, 5000, 3)]


def test_a_chunk_delivered_many_times(spark):
    rows = [("r", 0, i, f"t{i}", s, False) for i, s in enumerate([80.0, 40.0, 10.0])]
    rows += [("r", n, 0, "x", 50.0, False) for n in range(1, 30)]
    df = spark.createDataFrame(rows, "run_id string, sequence_no bigint, iteration int, text string, score double, from_fallback boolean")
    hot = df.unionByName(df.filter("sequence_no = 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("n"))
    order = ["run_id", "sequence_no"]
    assert selection.select_candidates(hot).orderBy(*order).collect() == selection.select_candidates(df).orderBy(*order).collect()
