from pyspark.sql import functions as F

from textloom.operators import intake, ledger
from textloom.plans import documents as jobs
from textloom.sources import tables


def runs(spark):
    rows = [("a", "x.pdf", "2024-01-01 00:00:00", "completed", "s"), ("b", "note", "2024-01-02 00:00:00", "odd", None),
            ("c", "Y.PDF", "2024-01-02 00:00:00", "failed", "s")]
    df = spark.createDataFrame(rows, "run_id string, filename string, start_time string, status string, master_summary string")
    return df.withColumn("start_time", F.to_timestamp("start_time"))


def chunks(spark):
    rows = [("a", 0, "t", None, 0), ("a", 1, "u", None, 0), ("z", 0, "v", None, 0)]
    return spark.createDataFrame(rows, "run_id string, sequence_no int, clean_text string, processed string, iterations int")


def test_latest_runs_break_ties(spark):
    assert [r.run_id for r in ledger.latest_runs(runs(spark), 2).collect()] == ["b", "c"]


def test_runs_with_chunks_keeps_childless_runs(spark):
    rows = ledger.runs_with_chunks(runs(spark), chunks(spark)).collect()
    assert sorted((r.run_id, r.sequence_no) for r in rows if r.sequence_no is not None) == [("a", 0), ("a", 1)]
    assert sorted(r.run_id for r in rows if r.sequence_no is None) == ["b", "c"]
    top = ledger.latest_runs_with_chunks(runs(spark), chunks(spark), 2)
    assert sorted((r.run_id, r.sequence_no) for r in top.collect()) == [("b", None), ("c", None)]


def test_audits(spark):
    assert {(r.run_id, r.violation) for r in ledger.audit_runs(runs(spark)).collect()} == {
        ("b", "status"), ("b", "summary missing")
    }
    assert [r.run_id for r in ledger.orphan_chunks(chunks(spark), runs(spark)).collect()] == ["z"]
    twice = chunks(spark).unionByName(chunks(spark).filter("run_id = 'z'"))
    assert [(r.run_id, r.copies) for r in ledger.duplicate_keys(twice, ["run_id", "sequence_no"]).collect()] == [("z", 2)]
    labels = {r.run_id: (r.kind, r.status_label) for r in ledger.label_runs(runs(spark)).collect()}
    assert labels == {"a": ("PDF", "Completed"), "b": ("Text", "odd"), "c": ("PDF", "Failed")}


def test_updates_and_cascading_delete(spark):
    updates = spark.createDataFrame([("a", 1, "new", 2)], "run_id string, sequence_no int, processed string, iterations int")
    rows = ledger.apply_updates(chunks(spark), updates).filter("run_id = 'a'").orderBy("sequence_no").collect()
    assert [(r.processed, r.iterations) for r in rows] == [(None, 0), ("new", 2)]
    kept_runs, kept_chunks = ledger.delete_runs(runs(spark), chunks(spark), runs(spark).filter("run_id = 'a'"))
    assert kept_runs.count() == 2 and kept_chunks.filter("run_id = 'a'").count() == 0
    assert [d.count() for d in ledger.delete_runs(runs(spark), chunks(spark), None)] == [0, 0]


def test_artifacts(spark):
    files = spark.createDataFrame([("/o/a_final.pdf",), ("/o/a_result.txt",), ("/o/c_result.txt",)], "path string")
    rows = {r.run_id: r for r in ledger.resolve_artifacts(runs(spark), files).collect()}
    assert (rows["a"].path, rows["a"].download_name) == ("/o/a_final.pdf", "x_result.pdf")
    assert (rows["c"].path, rows["c"].download_name) == ("/o/c_result.txt", "Y_result.txt")
    assert rows["b"].path is None and rows["b"].error


def test_screening(spark):
    rows = [(0, "  hello  "), (1, " \n "), (2, None), (3, "x" * 60_001), (4, "y" * 60_000)]
    screened = intake.screen_documents(spark.createDataFrame(rows, "doc_id int, text string"))
    assert [r.reason for r in screened.orderBy("doc_id").collect()] == [None, "empty", "empty", "too long", None]
    admitted, rejected = intake.split_admitted(screened)
    assert admitted.count() == 2 and rejected.count() == 3


def test_file_admission(spark, tmp_path):
    big = b"%PDF" + b"0" * (10 * 1024 * 1024)
    for name, content in [("ok.pdf", b"%PDF-1.4"), ("OK2.PDF", b"%PDF"), ("bad.pdf", b"PK"), ("a.txt", b"%PDF"), ("big.pdf", big)]:
        (tmp_path / name).write_bytes(content)
    rows = intake.admit_files(spark, str(tmp_path)).collect()
    assert {r.path.split("/")[-1]: r.reason for r in rows} == {
        "ok.pdf": None, "OK2.PDF": None, "bad.pdf": "signature", "a.txt": "extension", "big.pdf": "size"
    }


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("a\n\nb")
    df = tables.read_documents(spark, str(tmp_path / "in"), "text")
    assert [(r.name, r.text) for r in df.collect()] == [("one.txt", "a\n\nb")]
    tables.write_results(df, str(tmp_path / "out"), "name")
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "a\n\nb"
    tables.write_texts(df, str(tmp_path / "lines"), "name")
    assert spark.read.text(str(tmp_path / "lines")).count() == 1


def test_glossary(spark):
    df = spark.createDataFrame([("a Chunker here", "chunker", ["Chunker", "absent"])], "s string, p string, g array<string>")
    row = intake.glossary_check(df, "s", "p", "g").first()
    assert (row.expected_terms, row.lost_terms) == (["Chunker"], ["Chunker"])


PAPER = (
    "Deep models [1] have changed the field [3, 4], as (Vaswani et al., 2017) showed.\n\n"
    "The loss $$L = -\\sum_t \\log p$$ is minimised with $\\alpha = 0.1$ over epochs [5-8].\n\n"
    "\\begin{equation}\nB = \\frac{a}{b}\n\\end{equation}\n\nResults follow, see [1] and $\\alpha = 0.1$."
)


def test_document_job_end_to_end(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, ""), (3, "Plain text.")], "doc_id int, text string")
    pieces, maps, rejected = jobs.prepare_documents(docs, target=12, maximum=20)
    assert [(r.doc_id, r.reason) for r in rejected.collect()] == [(2, "empty")]
    attempts = pieces.select(
        "doc_id", "chunk_id", F.lit(0).alias("iteration"), "text", F.lit(80.0).alias("score"), F.lit(False).alias("from_fallback")
    )
    better = attempts.withColumns({"iteration": F.lit(1), "text": F.concat(F.lit("so "), "text"), "score": F.lit(12.0)})
    done = {r.doc_id: r for r in jobs.finish_documents(pieces, maps, attempts.unionByName(better)).collect()}
    assert done[3].text == "so Plain text." and done[3].error is None
    squeeze = lambda t: "".join(t.split())
    assert squeeze(done[1].text.replace("so ", "")) == squeeze(PAPER)
    assert "__" not in done[1].text


def test_one_update_counts_for_a_chunk(spark):
    updates = spark.createDataFrame([("a", 0, "first", 1), ("a", 0, "second", 2), ("a", 0, "second", 2)], "run_id string, sequence_no int, processed string, iterations int")
    got = {(r.run_id, r.sequence_no): (r.processed, r.iterations) for r in ledger.apply_updates(chunks(spark), updates).collect()}
    assert got == {("a", 0): ("second", 2), ("a", 1): (None, 0), ("z", 0): (None, 0)} and ledger.apply_updates(chunks(spark), updates).count() == 3


def test_runs_are_finished(spark):
    done = chunks(spark).withColumn("processed", F.when(F.col("run_id") == "a", "p"))
    summaries = spark.createDataFrame([("b", "new")], "run_id string, master_summary string")
    got = {r.run_id: (r.total_chunks, r.status, r.master_summary) for r in ledger.finish_runs(runs(spark), done, summaries).collect()}
    assert got == {"a": (2, "completed", "s"), "b": (0, "failed", "new"), "c": (0, "failed", "s")}


def test_long_documents_pass_the_job(spark):
    docs = spark.createDataFrame([(0, "word " * 40_000), (1, "")], "doc_id bigint, text string")
    pieces, _, rejected = jobs.prepare_documents(docs)
    assert pieces.agg(F.sum("word_count")).first()[0] == 40_000
    assert [tuple(r) for r in rejected.collect()] == [(1, "empty")]
    assert [r.doc_id for r in jobs.prepare_documents(docs, limit=60_000)[2].collect()] == [0, 1]
