import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.core import py_round, ws_count
from textloom.operators.metrics import buzzword_count, document_metrics, uniformity_score


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("value", [2.675, 0.125, 0.375, 1.005, 2.5, 1e6 + 0.005, 33.333333, 0.0, -2.675, -0.125, 94.995])
def test_rounding_follows_the_binary_value(spark, value):
    got = spark.createDataFrame([(value,)], "v double").select(py_round(F.col("v"), 2)).first()[0]
    assert got == round(value, 2)


@pytest.mark.parametrize(
    ("text", "sentences", "lengths", "mean", "std"),
    [
        ("", 0, [], 0.0, 0.0),
        (None, 0, [], 0.0, 0.0),
        ("This is a single sentence block.", 1, [6], 6.0, 0.0),
        (
            "This is a short sentence. However, this is a much longer sentence containing ten words.",
            2, [5, 10], 7.5, 2.5,
        ),
        ("... !!!", 2, [0, 0], 0.0, 0.0),
    ],
)
def test_document_metrics(spark, text, sentences, lengths, mean, std):
    row = document_metrics(spark.createDataFrame([(text,)], "text string")).first()
    assert row.sentence_count == sentences
    assert row.sentence_lengths == lengths
    assert (row.sentence_length_mean, row.sentence_length_std) == (mean, std)


def test_abbreviations_do_not_end_sentences(spark):
    text = "Dr. Smith went to the lab (i.e. the cleanroom) at 5 p.m. He was very successful."
    assert one(spark, text, lambda T: X.sentences_metrics(T)) == [text]
    assert one(spark, "See Smith et al. for more. Done.", lambda T: X.sentences_chunk(T)) == ["See Smith et al. for more.", "Done."]
    assert one(spark, "A. B! C? d", lambda T: X.sentences_naive(T)) == ["A", "B", "C", "d"]


def test_three_splitters_differ(spark):
    text = "Ask Mrs. Lee. It is vol. 3"
    assert len(one(spark, text, lambda T: X.sentences_chunk(T))) == 3
    assert len(one(spark, text, lambda T: X.sentences_metrics(T))) == 3
    assert len(one(spark, text, lambda T: X.sentences_naive(T))) == 4


def test_words_keep_inner_marks_and_respect_foreign_letters(spark):
    text = "It's l'éonierç fine-tuned! 'quoted' éabc-def a_b x²"
    assert one(spark, text, lambda T: X.words(T)) == ["it's", "l'", "fine-tuned", "quoted", "-def"]


def test_white_space_is_unicode(spark):
    text = "a\u00a0b\u2003c\x1cd\n e"
    assert one(spark, text, lambda T: ws_count(T)) == len(text.split()) == 5


def test_paragraphs_keep_their_position(spark):
    got = one(spark, "one\n\n \n\ntwo\n \nthree", lambda T: X.paragraphs(T))
    assert [(p["index"], p["text"]) for p in got] == [(0, "one"), (1, "two"), (2, "three")]
    got = one(spark, "\n\none", lambda T: X.paragraphs(T))
    assert [(p["index"], p["text"]) for p in got] == [(1, "one")]


def test_long_sentences_split_at_clauses_then_words(spark):
    assert one(spark, "a b, c d; e f g h i j k", lambda T: X.split_long(T, 4)) == ["a b, c d;", "e f g h", "i j k"]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Hello, wide world! It is me again today", "Hello_wide_world_It_is_me"),
        ("-- ?? !!", "pasted_text"),
        ("", "pasted_text"),
        ("x" * 80, "x" * 60),
    ],
)
def test_auto_name(spark, text, name):
    assert one(spark, text, lambda T: X.auto_name(T)) == name


def test_supplied_names_and_stems(spark):
    assert one(spark, " My paper: v2 (final) ", lambda T: X.document_name(T, F.lit("unused"))) == "My_paper_v2_final"
    assert one(spark, "  ", lambda T: X.document_name(T, F.lit("two words"))) == "two_words"
    assert one(spark, "my paper.v2.pdf", lambda T: X.safe_stem(T, "_x")) == "my_paper.v2_x"
    assert one(spark, ".hidden", lambda T: X.safe_stem(T)) == ".hidden"


@pytest.mark.parametrize(("n", "band"), [(50_000, "ok"), (50_001, "warn"), (60_000, "warn"), (60_001, "limit")])
def test_length_band(spark, n, band):
    assert one(spark, "x" * n, lambda T: X.length_band(T)) == band


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("```markdown\nThis is the actual text content.\n```", "This is the actual text content."),
        ("```\nAnother block\n```", "Another block"),
        ("This is clean text.", "This is clean text."),
        (None, ""),
        ("a ```code``` b", "a ```code``` b"),
    ],
)
def test_strip_fence(spark, raw, clean):
    assert one(spark, raw, lambda T: X.strip_fence(T)) == clean


def test_strip_think(spark):
    assert one(spark, "<THINK>a\nb</think> answer <think>c</think>", lambda T: X.strip_think(T)) == "answer"


def test_token_estimates(spark):
    df = spark.createDataFrame([("x" * 10, "y" * 9, 5, None)], "p string, a string, pt int, at int")
    args = [F.col(c) for c in ("p", "a", "pt", "at")]
    assert df.select(X.estimate_tokens(*args)["total_tokens"]).first()[0] == 2 + 2
    assert df.select(X.estimate_tokens(*args, per_field=True)["total_tokens"]).first()[0] == 5 + 2


def test_uniformity_score_bounds(spark):
    assert one(spark, "  ", lambda T: uniformity_score(T)) == 0.0
    assert one(spark, "...", lambda T: uniformity_score(T)) == 50.0
    # even sentences: 15 + 50; four listed words: + 50 (60 capped), clamped to 95
    assert one(spark, "one two. one two.", lambda T: uniformity_score(T)) == 65.0
    assert one(spark, "Moreover, delve. Pivotal beacon!", lambda T: uniformity_score(T)) == 95.0
    # the base of 15 is never undercut, so the exit below 15 cannot fire in fallback mode
    wild = "a. " + "b " * 200 + "."
    assert one(spark, wild, lambda T: uniformity_score(T)) == 15.0
    assert one(spark, "Moreover moreovers (delve) delve?!", lambda T: buzzword_count(T)) == 2


GOOD = (
    "THESIS:\n" + "word " * 80 + "\n\nMETHODOLOGY:\n" + "step " * 70
    + "\n\nGLOSSARY:\n- Alpha, Beta\n1. Gamma.\n* Delta\n• Epsilon, Zeta.\nEta\nTheta\nIota\nKappa."
)


def test_parse_summary(spark):
    got = one(spark, GOOD, lambda T: X.parse_summary(T))
    assert got["valid"]
    assert got["glossary"] == ["Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "Eta", "Theta", "Iota", "Kappa"]
    assert not one(spark, "THESIS: short METHODOLOGY: short GLOSSARY: a, b", lambda T: X.parse_summary(T))["valid"]
    assert not one(spark, "no sections", lambda T: X.parse_summary(T))["valid"]


def test_resolve_summary_takes_the_first_valid(spark):
    df = spark.createDataFrame([("bad", GOOD), ("bad", None)], "a string, b string")
    rows = df.select(X.resolve_summary([F.col("a"), F.col("b")], F.lit("default")).alias("r")).collect()
    assert [r["r"] for r in rows] == [GOOD, "default"]
