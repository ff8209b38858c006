"""Named queries over the given tables, one or more per operator.

Where the tables lack the structure an operator works on (citations, provider
calls, attempts, geometry), it is derived from their columns, for every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions import text as X
from textloom.functions.core import collapse_ws, each, strip, ws_count
from textloom.operators import chunking, failover, glossary, intake, layout, ledger, markdown, masking, metrics, scoring, selection
from textloom.plans import documents as jobs
from textloom.session import prepare, shared_dir, stored
from textloom.sources import snapshots, tables
from textloom.sources import blocks as B
from textloom.streaming import events as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer files than cores over the cores.

    A file of one row group is one task whatever the read settings. Large files are dealt into more
    parts than cores, four for each that Spark would read at once, so a part doesn't grow with the
    table. Tables of many files are read as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= cores:  # the names stay in the JVM
        return df
    return df.repartition(max(cores, 4 * df.rdd.getNumPartitions()))


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text"))))


def _big(*columns: str | Column) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).cast("bigint") for c in columns]


def _rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


# --- intake and names ----------------------------------------------------------------


@query
def document_intake(spark, sf):
    screened = intake.screen_documents(texts(spark, sf))
    return screened.select(
        "doc_id", "name", "band", F.length("text").cast("bigint").alias("n_chars"),
        F.coalesce("reason", F.lit("admitted")).alias("verdict"),
        F.length(X.context_head(F.col("text"))).cast("bigint").alias("context_chars"),
    )


@query
def supplied_names(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.document_name(F.col("url"), F.col("url")).alias("name"),
        X.safe_stem(F.col("url"), "_result").alias("stem"),
    )


@query
def file_admission(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.when(F.col("url").contains("page="), F.concat("url", F.lit(".PDF"))).otherwise(F.col("url")).alias("path"),
        (F.length("html") * F.lit(1000)).alias("length"),
        F.when(F.col("url").contains("www"), F.lit("%PDF")).otherwise(F.substring("html", 1, 4)).alias("head"),
    )
    reason = intake.file_reason(F.col("path"), F.col("length"), F.col("head"))
    return pages.select("page_id", F.coalesce(reason, F.lit("admitted")).alias("verdict"))


@query
def admitted_files(spark, sf):
    """The files of the given tables, by the upload rule and by three rules of their own format."""
    rules = {"upload": {}, "parquet": {"most": 1 << 50}, "signature": {"magic": "PAR2", "most": 1 << 50}, "size": {"most": 1000}}
    found = [
        intake.admit_files(spark, sf, **({"suffix": ".parquet", "magic": "PAR1"} | rule if name != "upload" else {})).withColumn("rule", F.lit(name))
        for name, rule in rules.items()
    ]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    table_name = F.regexp_extract("path", r"([^/]*)\.parquet(?:/[^/]*)?$", 1)
    return every.groupBy("rule", table_name.alias("table_name")).agg(F.min(F.coalesce("reason", F.lit("admitted"))).alias("verdict"))


@query
def answer_cleanup(spark, sf):
    said = table(spark, sf, "conversations")
    raw = F.concat(F.lit("<think>draft\n"), "role", F.lit("</think>```markdown\n"), "text", F.lit("\n```"))
    clean = said.withColumn("clean", X.strip_fence(X.strip_think(raw)))
    reported = F.when(F.col("role") == "user", F.col("turn"))
    both = X.estimate_tokens(F.col("text"), F.col("clean"), reported, F.lit(7))
    each = X.estimate_tokens(F.col("text"), F.col("clean"), reported, F.lit(7), per_field=True)
    return clean.select(
        "conv_id", "turn", "clean",
        both["total_tokens"].cast("bigint").alias("tokens"), each["total_tokens"].cast("bigint").alias("tokens_per_field"),
    )


@query
def summary_records(spark, sf):
    docs = texts(spark, sf).withColumn("words", X.words(F.col("text")))
    words = F.col("words")
    half = F.floor(F.size(words) / 2).cast("int")
    good = F.concat(
        F.lit("Thesis:\n"), F.concat_ws(" ", F.slice(words, 1, half)), F.lit("\n\nMETHODOLOGY: "),
        F.concat_ws(" ", F.slice(words, half + 1, F.size(words))), F.lit("\nGLOSSARY:\n1. "),
        F.concat_ws(",", F.slice(words, 1, 5)), F.lit("\n- "), F.concat_ws(".,", F.slice(words, 6, 5)), F.lit("."),
    )
    rows = docs.select("doc_id", "text", good.alias("summary")).withColumn("s", X.parse_summary(F.col("summary")))
    # The summary is parsed already.
    chosen = F.coalesce(X.resolve_summary([F.col("text")], F.when(F.col("s.valid"), F.col("summary"))), F.lit("default"))
    return rows.select(
        "doc_id", F.col("s.valid").alias("valid"), F.length("s.thesis").cast("bigint").alias("thesis_chars"),
        F.length("s.methodology").cast("bigint").alias("methodology_chars"),
        F.size("s.glossary").cast("bigint").alias("terms"), F.col("s.word_count").cast("bigint").alias("word_count"),
        F.sha2(chosen, 256).alias("chosen"),
    )


# --- text statistics ----------------------------------------------------------------


@query
def document_metrics(spark, sf):
    return metrics.document_metrics(texts(spark, sf)).select(
        "doc_id", *[c.alias(n) for c, n in zip(
            _big("sentence_count", "word_count", "distinct_words"),
            ("sentence_count", "word_count", "distinct_words"), strict=True)],
        F.array_join(F.transform("sentence_lengths", lambda n: n.cast("string")), ",").alias("sentence_lengths"),
        "sentence_length_mean", "sentence_length_std", "type_token_ratio", _rounded("burstiness"),
    )


@query
def text_metrics_by_source(spark, sf):
    rolled = metrics.corpus_statistics(texts(spark, sf, "source", "text"), "source")
    return rolled.select(
        "source", *[F.col(c).cast("bigint").alias(c) for c in ("documents", "sentences", "words", "distinct_words")],
        *[_rounded(c) for c in ("mean_sentence_length", "std_sentence_length", "type_token_ratio", "burstiness")],
    )


@query
def document_word_frequency(spark, sf):
    return metrics.document_word_frequency(texts(spark, sf), "doc_id")


@query
def word_frequency(spark, sf):
    return metrics.word_frequency(texts(spark, sf))


@query
def vocabulary_by_language(spark, sf):
    counts = metrics.group_word_frequency(texts(spark, sf, "lang", "text"), "lang")
    return metrics.type_token_ratio(counts, ["lang"]).select(
        "lang", "distinct_words", "total_words", _rounded("type_token_ratio")
    )


@query
def document_perplexity(spark, sf):
    return metrics.corpus_perplexity(texts(spark, sf), "doc_id").select("doc_id", "word_count", _rounded("perplexity", 4))


@query
def source_perplexity(spark, sf):
    docs = texts(spark, sf, "source", "text")
    return metrics.corpus_perplexity(docs, "source").select("source", "word_count", _rounded("perplexity", 4))


def _with_buzzwords(docs: DataFrame) -> DataFrame:
    """Every document gets as many listed words as the last digit of its length."""
    listed = F.array(*[F.lit(w) for w in V.BUZZWORDS])
    added = F.concat_ws(", ", F.slice(listed, F.lit(1), (F.length("text") % 10).cast("int")))
    return docs.withColumn("text", F.concat("text", F.lit("\n"), F.initcap(added), F.lit("!")))


@query
def uniformity_score(spark, sf):
    return _with_buzzwords(texts(spark, sf)).select("doc_id", metrics.uniformity_score(F.col("text")).alias("score"))


@query
def buzzword_hits(spark, sf):
    return metrics.buzzword_hits(_with_buzzwords(texts(spark, sf)), "doc_id")


@query
def sentence_splits(spark, sf):
    t = F.col("text")
    split = texts(spark, sf).select(
        "doc_id", X.sentences_chunk(t).alias("a"), X.sentences_metrics(t).alias("b"), X.sentences_naive(t).alias("c")
    )
    return split.select(
        "doc_id", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in "abc"],
        *[F.sha2(F.array_join(c, "|"), 256).alias(f"sha_{c}") for c in "abc"],
    )


def _paragraphed(docs: DataFrame) -> DataFrame:
    """Every line becomes a paragraph."""
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))


@query
def paragraph_table(spark, sf):
    rows = each(_paragraphed(texts(spark, sf)), ["doc_id"], X.paragraphs(F.col("text")), "pos", "p")
    return rows.select("doc_id", "p.*").select(
        "doc_id", F.col("index").cast("bigint").alias("paragraph"), ws_count(F.col("text")).cast("bigint").alias("words"),
        X.fingerprint(F.col("text")).alias("fingerprint"),
    )


@query
def clause_pieces(spark, sf):
    rows = each(texts(spark, sf), ["doc_id"], X.split_long(strip(F.col("text")), 40), "piece", "text")
    return rows.select("doc_id", F.col("piece").cast("bigint").alias("piece"), ws_count(F.col("text")).cast("bigint").alias("words"),
                       F.sha2(F.regexp_replace("text", f"{V.WS}+", " "), 256).alias("sha"))


@query
def text_fingerprints(spark, sf):
    return texts(spark, sf).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


# --- masking ---------------------------------------------------------------------------


def _cited(docs: DataFrame) -> DataFrame:
    """Append citations of every kind, one of them twice."""
    n = F.col("doc_id").cast("string")
    year = (F.lit(1950) + F.col("doc_id") % 70).cast("string")
    return docs.withColumn(
        "text",
        F.concat("text", F.lit("\nSee ["), n, F.lit("] and (Smith & Jones, "), year, F.lit("a), again ["), n,
                 F.lit("], [Lee et al. "), year, F.lit("], x"), F.lit("²⁵"), F.lit(" [iv] [1, 2, "), n, F.lit("].")),
    )


def _formulas(docs: DataFrame) -> DataFrame:
    n = F.col("doc_id").cast("string")
    return docs.withColumn(
        "text",
        F.concat("text", F.lit("\nLet $x_{"), n, F.lit("}$ and $x_{"), n, F.lit("}$ with \\(y\\).\n\\[z_{"), n,
                 F.lit("}\\]\n\\begin{align}a &= "), n, F.lit("\\end{align}")),
    )


@query
def mask_citations(spark, sf):
    masked = masking.mask_citations(_cited(texts(spark, sf)))
    return masked.select("doc_id", "masked", F.size("citation_map").cast("bigint").alias("citations"))


@query
def mask_math(spark, sf):
    masked = masking.mask_math(_formulas(texts(spark, sf)))
    counts = masking.mask_counts(F.create_map().cast("map<string,string>"), F.col("math_map"))
    return masked.select(
        "doc_id", "masked", counts["math_blocks"].cast("bigint").alias("blocks"),
        counts["math_inlines"].cast("bigint").alias("inlines"),
    )


@query
def mask_tokens(spark, sf):
    masked = masking.mask_citations(_cited(texts(spark, sf)))
    return masking.token_rows(masked, "citation_map", ["doc_id"])


@query
def mask_roundtrip(spark, sf):
    audited = masking.audit_roundtrip(_cited(_formulas(texts(spark, sf))))
    exact = masking.restore_nested(F.col("masked"), F.col("citation_map"), F.col("math_map"))["text"]
    lost = F.replace("masked", F.lit("__CITATION_0__"), F.lit(""))  # every second candidate lacks a mask
    candidate = F.when(F.col("doc_id") % 2 == 1, lost).otherwise(F.col("masked"))
    return audited.select(
        "doc_id", "intact", exact.eqNullSafe(F.col("text")).alias("exact"), F.sha2("restored.text", 256).alias("restored"),
        masking.masks_preserved(F.col("masked"), candidate).alias("preserved"),
    )


@query
def mask_totals(spark, sf):
    """Masks of every kind in texts with citations and formulas."""
    counts = masking.audit_roundtrip(_cited(_formulas(texts(spark, sf)))).select("doc_id", "counts.*")
    return counts.select("doc_id", *_big("citations", "math_blocks", "math_inlines", "total"))


@query
def strict_math_restore(spark, sf):
    """As strict_restore, for formulas; every second document lacks its first inline formula."""
    plain = texts(spark, sf).withColumn("text", F.translate("text", "$\\", ""))  # formulas of its own could nest
    masked = masking.mask_math(_formulas(plain))
    odd = F.col("doc_id") % 2 == 1
    partial = F.map_filter("math_map", lambda k, _: ~odd | (k != F.lit("__MATH_INLINE_0__")))
    full, broken = masking.unmask_math(F.col("masked"), F.col("math_map")), masking.unmask_math(F.col("masked"), partial)
    return masked.select("doc_id", F.sha2(full["text"], 256).alias("restored"), F.coalesce(broken["error"], F.lit("")).alias("error"))


@query
def strict_restore(spark, sf):
    """Restoring with a map that lacks the first token, in every second document, is an error there."""
    masked = masking.mask_citations(_cited(texts(spark, sf)))
    odd = F.col("doc_id") % 2 == 1
    partial = F.map_filter("citation_map", lambda k, _: ~odd | (k != F.lit("__CITATION_0__")))
    full = masking.unmask_citations(F.col("masked"), F.col("citation_map"))
    broken = masking.unmask_citations(F.col("masked"), partial)
    soft = masking.restore_soft(F.col("masked"), partial)
    return masked.select(
        "doc_id", F.sha2(full["text"], 256).alias("restored"), broken["error"].isNotNull().alias("fails"),
        F.contains(soft, F.lit("__CITATION_0__")).alias("left_over"),
    )


# --- chunks -------------------------------------------------------------------------------


@query
def chunk_documents(spark, sf):
    chunks = chunking.chunk_documents(_paragraphed(texts(spark, sf)))
    return chunks.select(
        "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("word_count").cast("bigint").alias("word_count"),
        F.array_join(F.transform("paragraph_indices", lambda i: i.cast("string")), ",").alias("paragraphs"),
        F.sha2(F.regexp_replace("text", f"{V.WS}+", " "), 256).alias("sha"),
    )


@query
def prepared_chunks(spark, sf):
    """Admit, mask and chunk: the document job up to the chunk table."""
    chunks, _, _ = jobs.prepare_documents(_cited(_paragraphed(texts(spark, sf))))
    rows = jobs.chunk_table(chunks)
    return rows.groupBy("run_id").agg(
        F.count("*").alias("chunks"), F.sum(F.size(F.regexp_extract_all("raw_text", F.lit("__CITATION_[0-9]+__"), F.lit(0)))).alias("tokens"),
        F.sum(ws_count(F.col("raw_text"))).alias("words"), F.count("processed").alias("processed"),
    )


@query
def finished_documents(spark, sf):
    """The whole job with a better and a failed candidate per chunk, back to restored documents."""
    chunks, maps, _ = jobs.prepare_documents(
        _cited(texts(spark, sf)), target=V.LIBRARY_TARGET_WORDS, maximum=V.LIBRARY_MAX_WORDS, store=True
    )
    first, second = F.concat(F.lit("Old: "), "text"), F.col("text")  # the better candidate must win
    attempts = chunks.select(
        "doc_id", "chunk_id",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("iteration"), t.alias("text"), F.lit(s).alias("score"), F.lit(False).alias("from_fallback"))
            for i, t, s in ((0, first, 80.0), (1, second, 40.0), (2, F.lit(None).cast("string"), 5.0))
        ])),
    )
    done = jobs.finish_documents(chunks, maps, attempts)
    return done.select(
        "doc_id", F.coalesce("error", F.lit("")).alias("error"),
        F.sha2(F.regexp_replace("text", f"{V.WS}+", ""), 256).alias("sha"),
    )


@query
def slice_text(spark, sf):
    rows = each(texts(spark, sf), ["doc_id"], chunking.slice_chars(F.col("text"), 1000), "piece", "text")
    return rows.select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.length("text").cast("bigint").alias("n_chars"),
                       F.sha2("text", 256).alias("sha"))


@query
def chunk_rows(spark, sf):
    said = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("chunk_id"), "text"
    )
    return chunking.new_chunk_rows(said).select("chunk_id", "run_id", "sequence_no", "clean_text", F.col("iterations").cast("bigint").alias("iterations"))


@query
def chunk_reassembly(spark, sf):
    said = table(spark, sf, "conversations")
    return chunking.reassemble(said, "conv_id", "turn", "text").select(
        "conv_id", "text", F.col("n_pieces").cast("bigint").alias("n_pieces")
    )


@query
def glossary_losses(spark, sf):
    """Does the text without its first line still hold the words of the document?"""
    docs = texts(spark, sf).withColumn("glossary", F.array_distinct(X.words(F.col("text"))))
    docs = docs.withColumn("processed", F.regexp_replace("text", r"\A[^\n]*\n?", ""))
    checked = intake.glossary_check(docs, "text", "processed", "glossary")
    return checked.select("doc_id", F.size("expected_terms").cast("bigint").alias("expected"),
                          F.array_join("lost_terms", ",").alias("lost"))


@query
def global_glossary_losses(spark, sf):
    """Do the texts without their first line still hold the two- and three-word terms of the benchmark?"""
    items = table(spark, sf, "benchmark").select(X.words(F.col("text")).alias("w")).filter(F.size("w") > 2)
    starts = F.sequence(F.lit(1), F.size("w") - 2)
    threes = F.transform(starts, lambda i: F.array_join(F.slice("w", i, 3), " "))
    twos = F.transform(F.array_append(starts, F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))
    terms = items.select(F.explode(F.concat(twos, threes)).alias("term"))
    docs = texts(spark, sf).withColumn("processed", F.regexp_replace("text", r"\A[^\n]*\n?", ""))
    checked = glossary.global_glossary_losses(docs, terms, "doc_id", "text", "processed")
    return checked.select("doc_id", F.size("expected_terms").cast("bigint").alias("expected"), F.array_join("lost_terms", ",").alias("lost"))


@query
def text_comparison(spark, sf):
    docs = texts(spark, sf).withColumn("processed", F.rtrim(F.regexp_replace("text", "  +", " ")))
    return intake.compare_texts(docs, "text", "processed").select(
        "doc_id", F.col("raw_length").cast("bigint").alias("raw_length"),
        F.col("processed_length").cast("bigint").alias("processed_length"), "unchanged", "raw_snippet", "processed_snippet",
    )


@query
def markdown_lines(spark, sf):
    head = F.lit("# Title\n| a | b |\n- item\n1. first\n\n")
    docs = texts(spark, sf).withColumn("text", F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n```\n"))))
    return markdown.segment_markdown(docs, "doc_id").groupBy("doc_id", "label").agg(
        F.count("*").alias("lines"), F.sum("line_no").alias("positions")
    )


# --- scores and candidates -----------------------------------------------------------------


@query
def resolved_scores(spark, sf):
    """Toxicity labels as model scores, quality labels as service scores, else the fallback."""
    labels = table(spark, sf, "labels")
    docs = texts(spark, sf).join(labels, "doc_id", "left")
    docs = docs.withColumn("model", F.when(F.col("toxic") == 1, F.lit(90.0))).withColumn("service", F.col("quality") * 10.0)
    return scoring.resolve_score(docs, "text", "model", "service").select("doc_id", "score", "from_fallback")


@query
def prediction_scores(spark, sf):
    e = table(spark, sf, "events")
    s = F.least(F.lit(1.0), F.col("value") / 100)
    label = F.when(F.col("event_type") == "error", "Fake").when(F.col("event_type") == "view", "FAKE").otherwise("Real")
    preds = F.array(F.struct(label.alias("label"), s.alias("score")), F.struct(F.lit("fake").alias("label"), (F.lit(1.0) - s).alias("score")))
    preds = F.when(F.col("event_type") == "signup", F.slice(preds, 1, 0)).otherwise(preds)
    return e.select(
        "event_id", scoring.normalize_prediction(preds).alias("first_score"), scoring.pick_label(preds).alias("fake_score")
    )


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Four events in a row are a chunk (baseline and three attempts), 250 chunks a run."""
    e = table(spark, sf, "events")
    chunk = F.floor(F.col("event_id") / 4)
    mask = F.when((F.col("event_type") == "error") & (F.col("event_id") % 4 > 0), F.lit("")).otherwise(F.lit(" __CITATION_0__"))
    return e.select(
        F.floor(chunk / 250).cast("string").alias("run_id"), (chunk % 250).cast("bigint").alias("sequence_no"),
        (F.col("event_id") % 4).cast("int").alias("iteration"),
        F.concat(F.lit("v"), F.col("event_id").cast("string"), mask).alias("text"),
        F.col("value").alias("score"), (F.col("event_type") == "signup").alias("from_fallback"),
    )


@query
def unusable_attempts(spark, sf):
    """Attempts with failed calls for errors, baselines included, and a few beyond the last iteration."""
    late = F.when(F.regexp_extract("text", r"\d+", 0).cast("bigint") % 11 == 0, 4).otherwise(0)
    attempts = _attempts(spark, sf).withColumns(
        {"iteration": F.col("iteration") + late, "text": F.when(F.col("score") % 5 >= 1, F.col("text"))}
    )
    return selection.unusable_attempts(attempts).select("run_id", "sequence_no", F.col("iteration").cast("bigint").alias("iteration"), "reason")


@query
def convergence_flags(spark, sf):
    flags = selection.convergence_flags(_attempts(spark, sf))
    return flags.select(
        "run_id", "sequence_no", F.col("iteration").cast("bigint").alias("iteration"), "previous_score", "score",
        _rounded("delta"), "degraded", "stalled", F.col("stall_count").cast("bigint").alias("stall_count"), "stops",
    )


@query
def candidate_selection(spark, sf):
    best = selection.select_candidates(_attempts(spark, sf))
    return best.select(
        "run_id", "sequence_no", "baseline_score", "processed", "best_score",
        F.col("iterations").cast("bigint").alias("iterations"), "stop_reason",
    )


@query
def batch_outcomes(spark, sf):
    best = selection.select_candidates(_attempts(spark, sf))
    return selection.batch_summary(best).select(
        "run_id", "chunks", "succeeded", "failed", _rounded("mean_best_score"), "total_iterations"
    )


@query
def batch_failures(spark, sf):
    """Conversations as batches, their turns as chunks of which the users' failed."""
    said = table(spark, sf, "conversations")
    results = said.select(
        F.col("conv_id").alias("run_id"), (F.col("role") != "user").alias("success"), F.length("text").cast("double").alias("best_score"), F.col("turn").alias("iterations")
    )
    return selection.batch_summary(results).select(
        "run_id", "chunks", "succeeded", "failed", _rounded("mean_best_score"), F.col("total_iterations").cast("bigint").alias("total_iterations")
    )


@query
def isolated_map(spark, sf):
    """A user function that raises on some texts; the other rows are unaffected."""
    def rewrite(value: str) -> str:
        if value.startswith("user"):
            raise ValueError("refused")
        return value.replace("e", "3")

    said = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), "text").alias("text"))
    hooked = selection.transform_texts(said, "text", "text", lambda c: F.concat(c, F.lit("!")))
    done = selection.map_texts_isolated(hooked, "text", rewrite)
    return done.select(
        "conv_id", "turn", "success", "processed", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("best_score", F.lit(-1.0)).alias("best_score"),
    )


# --- providers and budgets -------------------------------------------------------------------


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Five events in a row are one request; each event is the call at one priority."""
    e = table(spark, sf, "events")
    priority = (F.col("event_id") % 5).cast("int")
    provider = F.element_at(F.array(*[F.lit(p) for p in V.FAILOVER_SEQUENCE]), priority + 1)
    status = (
        F.when(F.col("event_type").isin("error", "view", "click"), F.lit(500))
        .when((F.col("event_type") == "signup") & (F.col("value") > 200), F.lit(429)).otherwise(F.lit(200))
    )
    return e.select(
        F.floor(F.col("event_id") / 5).cast("bigint").alias("request_id"), priority.alias("priority"), provider.alias("provider"),
        status.alias("status"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"),
        F.floor("value").cast("bigint").alias("tokens"), "ts",
    )


def _quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Quota records with the event counts and values as use; the google record is missing."""
    calls = _calls(spark, sf)
    used = calls.groupBy("provider").agg(F.sum("tokens").alias("used_today"))
    return used.filter("provider <> 'google'").select(
        "provider", F.when(F.col("provider") == "groq", F.lit(14400)).otherwise(F.lit(50_000_000)).cast("bigint").alias("daily_limit"),
        "used_today", F.lit(30).cast("bigint").alias("rpm_limit"),
    )


@query
def failover_resolution(spark, sf):
    resolved = failover.resolve_failover(_calls(spark, sf), _quotas(spark, sf))
    return resolved.withColumn("priority", F.col("priority").cast("bigint"))


def _day_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Limits of half of a provider's mean day, of which a tenth is used; the google record is missing."""
    calls = _calls(spark, sf).filter("provider <> 'google'")
    used = calls.groupBy("provider").agg(F.floor(F.sum("tokens") / (F.countDistinct(F.to_date("ts")) * 2)).alias("daily_limit"))
    return used.select("provider", "daily_limit", F.floor(F.col("daily_limit") / 10).alias("used_today"), F.lit(30).cast("bigint").alias("rpm_limit"))


@query
def exhausted_at_call(spark, sf):
    judged = failover.running_usage(_calls(spark, sf), _day_quotas(spark, sf))
    return judged.select("request_id", F.col("priority").cast("bigint").alias("priority"), "provider", "used_before", "exhausted_at_call")


@query
def running_failover(spark, sf):
    resolved = failover.resolve_running_failover(_calls(spark, sf), _day_quotas(spark, sf))
    return resolved.withColumn("priority", F.col("priority").cast("bigint"))


@query
def failover_errors(spark, sf):
    errors = failover.failover_errors(_calls(spark, sf), _quotas(spark, sf))
    return errors.select("request_id", F.col("priority").cast("bigint").alias("priority"), "provider", F.col("status").cast("bigint").alias("status"))


@query
def usage_by_day(spark, sf):
    return failover.usage_by_day(_calls(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def quotas_after_calls(spark, sf):
    return failover.accumulate_usage(_quotas(spark, sf), _calls(spark, sf))


@query
def quota_listing(spark, sf):
    return ledger.quota_listing(_quotas(spark, sf))


@query
def quota_usage(spark, sf):
    return failover.quota_usage(_quotas(spark, sf))


@query
def seeded_quotas(spark, sf):
    return failover.seed_quotas(_quotas(spark, sf), failover.default_quotas(spark))


@query
def daily_tokens(spark, sf):
    totals = S.against_daily_limit(S.daily_tokens(_calls(spark, sf)), _quotas(spark, sf))
    return totals.select("provider", F.date_format("day_start", "yyyy-MM-dd").alias("day"), "tokens", "daily_limit", "over_limit")


@query
def requests_per_minute(spark, sf):
    counts = S.against_rpm_limit(S.requests_per_minute(_calls(spark, sf)), _quotas(spark, sf))
    return counts.select("provider", F.date_format("minute_start", "yyyy-MM-dd HH:mm").alias("minute"), "requests", "rpm_limit", "over_limit")


# --- page blocks -------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages").select("page_id", "html"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.explode_blocks(_pages(spark, sf))


@query
def page_block_table(spark, sf):
    return B.text_blocks(_blocks(spark, sf)).select(
        "page_id", F.col("block_no").cast("bigint").alias("block_no"), "tag", "text", F.col("word_count").cast("bigint").alias("word_count"),
        layout.is_heading(F.col("text")).alias("heading"),
    )


@query
def block_summary(spark, sf):
    """Sites as documents, pages as their pages."""
    blocks = B.explode_blocks(spread(table(spark, sf, "pages").select(
        F.struct("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("site")).alias("k"), "html")), "k")
    summary = layout.block_summary(blocks.select("k.*", "text", "word_count", "block_type"), "site", "page_id")
    return summary.select("site", "total_blocks", "text_blocks", "image_blocks", "total_words", "parse_errors", "pages")


@query
def block_errors(spark, sf):
    """Counts per page with the blocks of more than 30 words as ones that could not be parsed."""
    blocks = B.explode_blocks(spread(table(spark, sf, "pages").select("page_id", "html")), "page_id")
    marked = blocks.withColumn("error", F.when(F.col("word_count") > 30, "too long"))
    return layout.block_summary(marked, "page_id", error="error").select("page_id", "total_blocks", "parse_errors")


@query
def page_texts(spark, sf):
    pages = B.page_blocks(_pages(spark, sf))
    return pages.select("page_id", layout.assemble_text(F.col("blocks")).alias("text"))


@query
def blocks_by_page(spark, sf):
    """Ordered blocks of each page, ranges of positions bounding the groups."""
    blocks = B.text_blocks(_blocks(spark, sf)).withColumn("text", X.fingerprint(F.col("text")))
    return chunking.reassemble(blocks, "page_id", "block_no", "text", " ").select("page_id", F.col("n_pieces").cast("bigint").alias("n_blocks"), F.col("text").alias("fingerprints"))


@query
def page_chunks(spark, sf):
    chunks = jobs.prepare_pages(B.page_blocks(_pages(spark, sf)), "page_id")
    return chunks.groupBy("page_id").agg(
        F.count("*").alias("chunks"), F.sum("word_count").alias("words"), F.max("word_count").cast("bigint").alias("longest"),
        F.sum(F.size("paragraph_indices")).alias("block_refs"),
    )


def _boxes(blocks: DataFrame) -> DataFrame:
    """Geometry from position and length; some corners swapped, implausible or unreadable."""
    n, w = F.col("block_no"), F.col("word_count")
    return blocks.withColumns(
        {
            "x0": F.when(w % 7 == 0, F.lit("x")).otherwise((n % 50).cast("string")),
            "y0": (n * 12).cast("string"),
            "x1": F.when(w % 5 == 0, F.lit("-20000")).otherwise((w * 3).cast("string")),
            "y1": F.when(w % 11 == 0, F.lit("NaN")).otherwise((n * 12 + 10).cast("string")),
        }
    )


@query
def block_geometry(spark, sf):
    blocks = _boxes(_blocks(spark, sf))
    pages = table(spark, sf, "pages").filter(F.col("url").contains("/en/")).select(
        "page_id", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    sized = layout.with_page_size(blocks, pages, ["page_id"])
    clean = layout.clean_coordinates(sized)
    clean = clean.withColumn("baseline", layout.flip_y(F.col("page_h"), F.col("y0"), F.lit(V.BODY_FONT_SIZE)))
    wide = layout.expand_bbox(clean)
    return wide.select("page_id", F.col("block_no").cast("bigint").alias("block_no"), "x0", "y0", "x1", "y1", "width", "height", "baseline")


@query
def block_json(spark, sf):
    """Blocks to JSON and back; every record that was cut short becomes a stub."""
    blocks = layout.normalize_bbox(
        _blocks(spark, sf).withColumns({"x0": F.lit(0.0), "y0": F.col("block_no") * 12.0, "x1": F.col("word_count") * 5.0, "y1": F.col("block_no") * 12.0 + 10})
    ).select("page_id", "block_no", *layout.BOX, "width", "height", "text", "word_count", "block_type")
    written = B.blocks_to_json(blocks.withColumns({"k": F.col("block_no"), "w": F.col("word_count")}), ["page_id", "k", "w"])
    cut = written.withColumn("json", F.when(F.col("w") % 3 == 0, F.expr("left(json, 20)")).otherwise(F.col("json")))
    back = layout.with_stub_blocks(B.blocks_from_json(cut, ["page_id", "k"]))
    return back.groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.count("error").alias("errors"), F.sum("word_count").cast("bigint").alias("words"),
        F.sum("width").alias("width"), F.sum(F.length("text")).alias("n_chars"),
    )


@query
def span_styles(spark, sf):
    """Each block's words as spans of one line, styled by their length."""
    spans = F.transform(
        F.split("text", " "),
        lambda w: F.struct(
            F.lit("Helvetica").alias("font"), F.lit(10.0).alias("font_size"), (F.length(w) % 20).alias("font_flags"),
            F.lit(0).alias("color"), w.alias("text"),
        ),
    )
    lines = F.array(F.struct(F.lit(0).alias("line_no"), spans.alias("spans")))
    blocks = B.text_blocks(_blocks(spark, sf)).select("page_id", "block_no", lines.alias("lines"))
    styled = B.font_style(B.flatten_spans(blocks, ["page_id", "block_no"]))
    return styled.groupBy("page_id").agg(
        F.count("*").alias("spans"), F.count_if("is_bold").alias("bold"), F.count_if("is_italic").alias("italic"),
        F.sum(F.when(F.col("span_no") == 0, F.length("line_text"))).alias("line_chars"),
    )


@query
def page_count_mismatches(spark, sf):
    """Sites whose headed pages and list pages differ in number."""
    blocks = B.explode_blocks(spread(table(spark, sf, "pages").select(
        F.struct("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("site")).alias("k"), "html")), "k").select("k.*", "tag", "word_count")
    return layout.page_count_mismatches(
        blocks.filter("tag = 'h1'"), blocks.filter("tag = 'p' and word_count > 60"), "site", "page_id"
    )


@query
def overflow_report(spark, sf):
    blocks = B.text_blocks(_blocks(spark, sf)).withColumns(
        {"font_size": F.lit(10.0), "width": F.lit(60.0) + F.col("block_no") % 200, "height": F.lit(12.0) + F.col("word_count") % 40}
    )
    return layout.overflow_report(blocks).select(
        "page_id", F.col("block_no").cast("bigint").alias("block_no"), F.col("lines").cast("bigint").alias("lines"), "overflow",
        _rounded("overflow_percentage"), "scale", _rounded("estimated_height"),
    )


@query
def fitted_paragraphs(spark, sf):
    blocks = B.text_blocks(_blocks(spark, sf)).withColumns(
        {"width": F.lit(120.0) + F.col("block_no") % 200, "height": F.lit(24.0) + F.col("word_count") % 60, "bold": layout.is_heading(F.col("text"))}
    )
    fitted = layout.fit_paragraphs(blocks, heading="bold")
    return fitted.select(
        "page_id", F.col("block_no").cast("bigint").alias("block_no"), F.size("lines").cast("bigint").alias("lines"), "font_size", "line_spacing",
        F.length("overflow_text").cast("bigint").alias("overflow_chars"), F.sha2(F.array_join("lines", "|"), 256).alias("sha"),
    )


def _page_chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A page's blocks and one chunk per page that refers to all of them."""
    pages = stored(B.page_blocks(_pages(spark, sf)))
    blocks = B.text_blocks(each(pages, ["page_id"], "blocks", "pos", "b").select("page_id", "b.*")).select(
        "page_id", F.col("block_no").alias("original_index"), "block_no", "text", "word_count"
    )
    used = F.filter("blocks", lambda b: (b["block_type"] == 0) & (strip(b["text"]) != ""))
    joined = pages.select("page_id", used.alias("used")).select(
        "page_id", F.col("used.block_no").alias("paragraph_indices"),
        F.array_join(F.col("used.text"), " ").alias("spaced"), F.array_join(F.col("used.text"), "\n\n").alias("separated"),
    )
    chunks = joined.select(
        "page_id", F.lit(0).alias("chunk_id"), "paragraph_indices",
        F.when(F.length("spaced") % 2 == 0, F.concat(F.lit("Intro words. "), "spaced")).otherwise(F.col("separated")).alias("processed"),
    )
    return chunks, blocks


@query
def distributed_blocks(spark, sf):
    chunks, blocks = _page_chunks(spark, sf)
    mapped = layout.distribute_chunks(chunks.filter(F.size("paragraph_indices") > 0), blocks, "page_id")
    return mapped.select("page_id", F.col("original_index").cast("bigint").alias("original_index"), "rewritten_text",
                         F.length("original_text").cast("bigint").alias("original_chars"))


@query
def page_documents(spark, sf):
    """The whole page job: blocks masked, chunked, chosen, laid onto the blocks and restored.

    Every block ends in a citation and a formula; the better candidate is the chunk itself. A block
    next to another one may get a word of it, so the text of a page is compared.
    """
    mark = F.concat(F.lit(" [7] $x_{"), F.col("page_id").cast("string"), F.lit("}$"))
    marked = F.transform("blocks", lambda b: b.withField("text", F.when(b["text"] != "", F.concat(b["text"], mark)).otherwise(b["text"])))
    pages = B.page_blocks(_pages(spark, sf)).select("page_id", marked.alias("blocks"))
    chunks, blocks, maps = jobs.prepare_page_documents(pages, "page_id")
    tries = ((0, F.concat(F.lit("Old: "), "text"), 80.0), (1, F.col("text"), 40.0), (2, F.when(F.contains("text", F.lit("__MATH")), "masks lost"), 5.0))
    attempts = chunks.select("page_id", "chunk_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("iteration"), t.alias("text"), F.lit(s).alias("score"), F.lit(False).alias("from_fallback")) for i, t, s in tries
    ])))
    done = jobs.finish_page_documents(chunks, blocks, maps, attempts, "page_id")
    ordered = F.array_sort(F.collect_list(F.struct("original_index", "text")))
    whole = done.groupBy("page_id").agg(ordered.alias("b"), F.count("*").alias("blocks"), F.count("error").alias("errors"))
    flat = F.regexp_replace(F.array_join(F.col("b.text"), ""), f"{V.WS}+", "")
    return whole.select("page_id", "blocks", "errors", F.sha2(flat, 256).alias("sha"))


@query
def dangling_references(spark, sf):
    """References to three positions after the last block of each page."""
    chunks, blocks = _page_chunks(spark, sf)
    n = F.size("paragraph_indices")
    more = F.concat("paragraph_indices", F.sequence(n, n + 2))
    return layout.dangling_references(chunks.withColumn("paragraph_indices", more), blocks, "page_id").select(
        "page_id", F.col("paragraph_index").cast("bigint").alias("paragraph_index")
    )


# --- ledgers: orders as runs, line items as chunks -----------------------------------------------


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("paused")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderpriority") == "5-LOW", ".pdf").otherwise("")).alias("filename"),
        F.col("o_orderdate").alias("start_time"), status.alias("status"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("master_summary"),
    )


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("sequence_no"),
        F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"),
    )


@query
def latest_runs(spark, sf):
    runs = ledger.label_runs(ledger.latest_runs(_runs(spark, sf)))
    return runs.select("run_id", "filename", F.date_format("start_time", "yyyy-MM-dd").alias("day"), "kind", "status_label")


@query
def latest_runs_with_chunks(spark, sf):
    rows = ledger.latest_runs_with_chunks(_runs(spark, sf), _chunks(spark, sf))
    return rows.select("run_id", "status", F.col("sequence_no").cast("bigint").alias("sequence_no"), "part", "quantity")


@query
def runs_with_chunks(spark, sf):
    rows = ledger.runs_with_chunks(_runs(spark, sf), _chunks(spark, sf).filter("run_id % 7 <> 3"))
    return rows.select("run_id", "status", F.col("sequence_no").cast("bigint").alias("sequence_no"), "part")


@query
def run_labels(spark, sf):
    return ledger.label_runs(_runs(spark, sf)).groupBy("kind", "status_label").agg(F.count("*").alias("runs"))


@query
def run_violations(spark, sf):
    return ledger.audit_runs(_runs(spark, sf))


@query
def orphan_chunks(spark, sf):
    runs = _runs(spark, sf).filter("status <> 'paused'")
    return ledger.orphan_chunks(_chunks(spark, sf), runs).select("run_id", F.col("sequence_no").cast("bigint").alias("sequence_no"), "part")


@query
def duplicate_chunks(spark, sf):
    return ledger.duplicate_keys(_chunks(spark, sf), ["run_id", "sequence_no"]).select(
        "run_id", F.col("sequence_no").cast("bigint").alias("sequence_no"), "copies")


@query
def sequence_audit(spark, sf):
    """Line numbers of shipped items against those of returned ones."""
    chunks = _chunks(spark, sf)
    return layout.sequence_audit(chunks.filter("flag <> 'R'"), chunks.filter("flag <> 'A'"), "run_id", "sequence_no").select(
        "run_id", F.col("sequence_no").cast("bigint").alias("sequence_no"), "problem")


@query
def deleted_runs(spark, sf):
    runs, chunks = _runs(spark, sf), _chunks(spark, sf)
    kept_runs, kept_chunks = ledger.delete_runs(runs, chunks, runs.filter("status = 'paused'"))
    left = ledger.table_states(failover.default_quotas(spark), kept_runs, kept_chunks)
    return left


@query
def updated_chunks(spark, sf):
    """Conversation turns with the users' turns processed."""
    said = table(spark, sf, "conversations")
    chunks = said.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("sequence_no"), F.col("text").alias("clean_text"),
                         F.lit(None).cast("string").alias("processed"), F.lit(0).alias("iterations"))
    updates = said.filter("role = 'user'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("sequence_no"),
                                                  F.concat("text", F.lit("*")).alias("processed"), F.lit(2).alias("iterations"))
    return ledger.apply_updates(chunks, updates).select("run_id", "sequence_no", "processed", F.col("iterations").cast("bigint").alias("iterations"))


@query
def committed_updates(spark, sf):
    """As updated_chunks, committed to a store and read back."""
    said = table(spark, sf, "conversations")
    key = [F.col("conv_id").alias("run_id"), F.col("turn").alias("sequence_no")]
    chunks = said.select(*key, F.col("text").alias("clean_text"), F.lit(None).cast("string").alias("processed"), F.lit(0).alias("iterations"))
    updates = said.filter("role = 'user'").select(*key, F.concat("text", F.lit("*")).alias("processed"), F.lit(2).alias("iterations"))
    store = shared_dir(spark)
    snapshots.commit_snapshot(spark, store, {"chunks": chunks})
    now = snapshots.read_snapshot(spark, store, ledger.commit_updates(spark, store, updates))["chunks"]
    return now.select("run_id", "sequence_no", "processed", F.col("iterations").cast("bigint").alias("iterations"))


@query
def committed_deletion(spark, sf):
    """Rows of both tables before and after the paused runs are deleted, as two versions of one store."""
    store, runs = shared_dir(spark), _runs(spark, sf)
    before = snapshots.commit_snapshot(spark, store, {"runs": runs, "chunks": _chunks(spark, sf)})
    after = ledger.commit_deletion(spark, store, runs.filter("status = 'paused'"))
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(v).cast("bigint").alias("version"), F.lit(name).alias("table_name"), "row_count")
        for v in (before, after) for name, df in sorted(snapshots.read_snapshot(spark, store, v).items())
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query
def finished_runs(spark, sf):
    """Orders whose items are all priced below a bound as runs with all chunks processed."""
    chunks = _chunks(spark, sf).withColumn("processed", F.when(F.col("quantity") < 45, "done"))
    runs = ledger.finish_runs(_runs(spark, sf), chunks)
    return runs.select("run_id", "total_chunks", "status", F.coalesce("master_summary", F.lit("")).alias("master_summary"))


@query
def written_results(spark, sf):
    """Texts written as a new snapshot by language, read back."""
    folder = shared_dir(spark)
    tables.write_results(texts(spark, sf, "doc_id", "text", "lang"), f"{folder}/results", "lang")
    back = tables.read_documents(spark, f"{folder}/results")
    return back.select("doc_id", F.col("lang").cast("string").alias("lang"), F.sha2("text", 256).alias("sha"))


@query
def run_artifacts(spark, sf):
    """Line items as files of their order: the first its PDF, the second its text, later ones parts of no use."""
    kind = F.when(F.col("sequence_no") == 1, "_final.pdf").when(F.col("sequence_no") == 2, "_result.txt").otherwise("_part.tmp")
    files = _chunks(spark, sf).select(F.concat(F.lit("/out/"), F.col("run_id").cast("string"), kind).alias("path"))
    return ledger.resolve_artifacts(_runs(spark, sf).withColumn("run_id", F.col("run_id").cast("string")), files)


# --- streams over the event table -------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_stream(spark, f"{sf}/events.parquet")


def _status(events: DataFrame) -> DataFrame:
    """Events as status messages: users are runs, event types are categories and states."""
    state = F.element_at(F.array(*[F.lit(s) for _, s in V.PROGRESS_NODES]), (F.col("event_id") % 6 + 1).cast("int"))
    return events.select(
        F.col("user_id").cast("string").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("event_time"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "info").otherwise("progress").alias("category"),
        state.alias("progress_state"),
    )


@query
def parsed_status_events(spark, sf):
    """JSON messages, some without a state, with an unknown field; read as a stream."""
    e = _event_stream(spark, sf)
    message = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("event_type").alias("category"), F.when(F.col("event_type") != "signup", F.lit("rewriting")).alias("progress_state"),
        F.struct(F.floor("value").alias("google"), F.lit("x").alias("unknown")).alias("token_updates"), F.lit(1).alias("extra"),
    ))
    parsed = S.run_append(S.parse_events(e.select("event_id", message.alias("json"))))
    return parsed.select(
        "event_id", "run_id", "category", F.coalesce("progress_state", F.lit("")).alias("progress_state"),
        F.coalesce("token_updates.google", F.lit(-1)).alias("google"), F.coalesce("token_updates.groq", F.lit(-1)).alias("groq"),
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), F.coalesce("error", F.lit("")).alias("error"),
    )


def _state_rows(states: DataFrame) -> DataFrame:
    nodes = S.node_statuses(F.col("progress_state"), F.col("failed"))
    return states.select("run_id", "progress_state", "failed", F.array_join(F.transform(nodes, lambda n: n["status"]), ",").alias("nodes"))


@query
def run_states(spark, sf):
    return _state_rows(S.current_states(_status(table(spark, sf, "events")), order="event_id"))


@query
def run_states_stream(spark, sf):
    stream = S.current_states(_status(_event_stream(spark, sf)), order="event_id")
    with S.state_partitions(spark):
        return _state_rows(S.run_updates(stream, ["run_id"]))


@query
def error_feed(spark, sf):
    feed = S.error_feed(_status(table(spark, sf, "events")))
    return feed.select("run_id", "event_id", F.coalesce("state", F.lit("")).alias("state"))


@query
def error_feed_stream(spark, sf):
    # The parts of a stored table come in any order, so lateness may be as large as its span.
    with S.state_partitions(spark):
        feed = S.run_error_feed(_status(_event_stream(spark, sf)), delay="3650 days")
    return feed.select("run_id", "event_id", F.coalesce("state", F.lit("")).alias("state"))


def _call_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_stream(spark, sf)
    provider = F.element_at(F.array(*[F.lit(p) for p in V.FAILOVER_SEQUENCE]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(provider.alias("provider"), F.floor("value").cast("bigint").alias("tokens"), F.col("ts").cast("timestamp").alias("ts"))


@query
def daily_tokens_stream(spark, sf):
    with S.state_partitions(spark):
        totals = S.run_updates(S.daily_tokens(_call_stream(spark, sf)), ["provider", "day_start"])
    totals = S.against_daily_limit(totals, _quotas(spark, sf))
    return totals.select("provider", F.date_format("day_start", "yyyy-MM-dd").alias("day"), "tokens", "daily_limit", "over_limit")


@query
def requests_per_minute_stream(spark, sf):
    with S.state_partitions(spark):
        counts = S.run_updates(S.requests_per_minute(_call_stream(spark, sf)), ["provider", "minute_start"])
    counts = S.against_rpm_limit(counts, _quotas(spark, sf))
    return counts.select("provider", F.date_format("minute_start", "yyyy-MM-dd HH:mm").alias("minute"), "requests", "rpm_limit", "over_limit")


@query
def score_monitor_stream(spark, sf):
    e = _event_stream(spark, sf)
    chunk = F.floor(F.col("event_id") / 4)
    scores = e.select(
        F.floor(chunk / 250).cast("string").alias("run_id"), (chunk % 250).cast("bigint").alias("sequence_no"),
        (F.col("event_id") % 4).cast("int").alias("iteration"), F.col("value").alias("score"),
    )
    with S.state_partitions(spark):
        told = S.run_append(S.score_monitor(scores))
    return told.select(
        "run_id", "sequence_no", F.col("iteration").cast("bigint").alias("iteration"), "score", _rounded("delta"), "degraded", "stalled",
        F.col("stall_count").cast("bigint").alias("stall_count"), "best_score", F.coalesce("stop_reason", F.lit("")).alias("stop_reason"),
    )


@query
def intake_stream(spark, sf):
    documents = S.read_stream(spark, f"{sf}/documents.parquet")
    chunks = S.run_append(S.intake_stream(documents))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"))


@query
def intake_tables_stream(spark, sf):
    """All that continuous intake makes: rejected rows, and documents restored from chunks and token maps."""
    documents = S.read_stream(spark, f"{sf}/documents.parquet").select("doc_id", "text")
    blank = F.when(F.col("doc_id") % 10 == 3, F.lit(" \n ")).otherwise(F.col("text"))
    chunks, maps, rejected = S.run_intake(_cited(documents).withColumn("text", blank))
    whole = chunking.reassemble(chunks, "doc_id", "chunk_id", "text").join(maps, "doc_id")
    restored = masking.restore_soft(F.col("text"), F.col("token_map"))
    back = whole.select(
        "doc_id", F.size(F.filter(F.map_keys("token_map"), lambda k: F.startswith(k, F.lit("__CITATION_")))).cast("bigint").alias("citations"), F.sha2(collapse_ws(restored, ""), 256).alias("sha"), F.lit("").alias("reason")
    )
    return back.unionByName(rejected.select("doc_id", F.lit(0).cast("bigint").alias("citations"), F.lit("").alias("sha"), "reason"))
