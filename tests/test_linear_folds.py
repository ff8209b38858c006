"""Restoring, slicing and fences of large texts: the results of the plain rules, in time that follows the text."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions import text as X
from textloom.functions.core import count_below, let, ws_count, ws_words
from textloom.functions.text import split_long
from textloom.operators import intake, layout, markdown, masking, metrics
from textloom.operators.chunking import slice_chars


def replaced_in_turn(text, tokens):
    """One token after the other, the longest first, then in the order of the map."""
    for key in sorted(tokens, key=lambda k: -len(k)):
        text = text.replace(key, tokens[key])
    return text


def token(rnd, odd):
    kind = rnd.choice(["CITATION", "MATH_BLOCK", "MATH_INLINE"])
    return f"__{kind}_{rnd.choice([rnd.randrange(30), rnd.randrange(30), '007' if odd else 3])}__"


@pytest.mark.parametrize("odd", [False, True])
def test_restoring_equals_replacing_in_turn(spark, odd):
    rnd = random.Random(17 + odd)
    rows = []
    for _ in range(250):
        bits = ["word ", "$x$", " ", "_", "\n", "É", "(a, 2000)"] + (["__", "_7__", "__CITATION_", "CITATION_2__", ""] if odd else [])
        tokens = {}
        for _ in range(rnd.randrange(40)):
            value = "".join(rnd.choice([*bits, token(rnd, odd)] if rnd.random() < 0.3 else bits) for _ in range(rnd.randrange(1, 4)))
            tokens[token(rnd, odd)] = value
        if odd and rnd.random() < 0.2:
            tokens["plain"] = "own format"
        text = "".join(rnd.choice([*bits, "plain", token(rnd, odd), token(rnd, odd)]) for _ in range(rnd.randrange(60)))
        rows.append((text, tokens))
    rows += [(None, rows[0][1]), ("", {}), ("__CITATION_1__", {})]
    df = spark.createDataFrame(rows, "text string, tokens map<string,string>")
    found = df.select("text", "tokens", masking.restore_soft(F.col("text"), F.col("tokens")).alias("got")).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.got == replaced_in_turn(row.text or "", row.tokens)


def test_most_large_maps_are_looked_up(spark):
    """Formulas with citations inside, as the masks make them, do not go token by token."""
    citations = {f"__CITATION_{i}__": f"(Author, {i})" for i in range(50)}
    blocks = {f"__MATH_BLOCK_{i}__": f"$$x_{i} + __CITATION_{i}__$$" for i in range(20)}
    text = " and ".join([*citations, *blocks, "__CITATION_99__"])
    df = spark.createDataFrame([(text, {**citations, **blocks})], "text string, tokens map<string,string>")
    entries = masking._by_length(F.col("tokens"))
    got = df.select(let(entries, lambda e: masking._looked_up(F.col("text"), e)).alias("got")).first().got
    assert got == replaced_in_turn(text, {**citations, **blocks}) and "__CITATION_99__" in got


def test_places_by_binary_search(spark):
    rows = [([], 3), ([5], 5), ([5], 6), ([1, 2, 2, 2, 9], 2), ([1, 2, 2, 2, 9], 3), (list(range(0, 2000, 2)), 1001), ([4], None)]
    df = spark.createDataFrame(rows, "a array<int>, x int")
    got = [r.n for r in df.select(let(F.col("a"), lambda a: count_below(a, F.col("x"))).alias("n")).collect()]
    assert got == [sum(v < x for v in a) if x is not None else got[-1] for a, x in rows]


def plain_slices(text, size):
    rest, pieces = text.strip(V.WS_CHARS), []
    space = "[" + re.escape(V.WS_CHARS) + "]"
    back = max(0, size - V.SHIFT_BACK_CHARS)
    while rest:
        cut = len(rest)
        if len(rest) > size:
            cut, window = size, rest[back:size]
            for pattern, shift in ((rf"\n{space}*\n", 0), (rf"[.!?]{space}", 1), (rf"[,;:]{space}", 1), (space, 0)):
                hits = [m.start() for m in re.finditer(pattern, window)]
                if hits:
                    cut = back + hits[-1] + shift
                    break
        pieces.append(rest[:cut].strip(V.WS_CHARS))
        rest = rest[cut:].strip(V.WS_CHARS)
    return pieces


@pytest.mark.parametrize("size", [20, 151, 400])
def test_slices_match_the_rule(spark, size):
    rnd = random.Random(size)
    parts = ["word", "x", "é", " ", " ", ". ", "! ", ", ", "; ", "\n\n", "\n \n", " "]
    rows = [("".join(rnd.choice(parts) for _ in range(rnd.randrange(400))),) for _ in range(60)] + [("",), (" \n ",), ("a" * 1000,), (None,)]
    df = spark.createDataFrame(rows, "text string")
    for row in df.select("text", slice_chars(F.col("text"), size).alias("got")).collect():
        assert row.got == ([] if row.text is None else plain_slices(row.text, size))


def test_fences_match_a_running_count(spark):
    rnd = random.Random(1)
    texts = ["\n".join(rnd.choice(["```", "~~~ x", "a b", "# h", "", "- i", "| t |"]) for _ in range(rnd.randrange(60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.line_no): r.label for r in markdown.segment_markdown(df, "id").collect()}
    for i, text in enumerate(texts):
        fences = 0
        for n, line in enumerate(text.split("\n")):
            is_fence = bool(re.match(r"[ \t]*(```|~~~)", line))
            fences += is_fence
            assert (got[i, n] == "fence") == is_fence and (got[i, n] == "code") == (not is_fence and fences % 2 == 1)


def test_large_texts_take_time_that_follows_them(spark):
    """Each of these took over 20 s as a fold that copies its text or array at every step."""
    fenced = spark.createDataFrame([(1, "\n".join("```" if i % 2 else "x y" for i in range(100_000)))], "id int, text string")
    long = spark.createDataFrame([("word and, more. " * 400_000,)], "text string")
    many = {f"__CITATION_{i}__": f"(A{i}, 2000)" for i in range(20_000)}
    masked = spark.createDataFrame([(" word ".join(many), many)], "text string, tokens map<string,string>")
    start = time.perf_counter()
    assert markdown.segment_markdown(fenced, "id").filter("label = 'code'").count() == 25_000
    assert long.select(F.size(slice_chars(F.col("text"), 1000)).alias("n")).first().n > 6000
    assert masked.select(F.sha2(masking.restore_soft(F.col("text"), F.col("tokens")), 256).alias("h")).count() == 1
    assert masked.select(masking.restore_soft(F.col("text"), F.col("tokens")).alias("r")).first().r == " word ".join(many.values())
    assert time.perf_counter() - start < 60


def test_clauses_are_packed_in_time_that_follows_them(spark):
    """Packing 40,000 clauses into 4,000 pieces runs the fold over the clauses once, not once for every piece."""
    text = ", ".join(f"a{i} b{i} c{i} d{i}" for i in range(40_000))
    df = spark.createDataFrame([(text,)], "text string")
    begun = time.perf_counter()
    pieces = df.select(split_long(F.col("text"), 40).alias("p")).first().p
    assert time.perf_counter() - begun < 20
    assert len(pieces) == 4000 and " ".join(pieces) == text and all(len(p.split()) == 40 for p in pieces)


def test_own_glossary_against_plain_search(spark):
    rows = [
        (1, "The Re-run don't stop. two words", "no stop", ["re-run", "stop", "on't", "two words", "The", "", "zz", "stop", None]),
        (2, None, "x", ["x"]), (3, "x y", None, ["x", "q"]), (4, "x", "x", None), (5, "", "", ["", "a"]), (6, "a.b (c)", "b", ["a.b", "b (", "c", ".", " ", "ab"]),
    ]
    docs = spark.createDataFrame(rows, "id long, text string, processed string, glossary array<string>")
    got = {r["id"]: (r["expected_terms"], r["lost_terms"]) for r in intake.glossary_check(docs, "text", "processed", "glossary").collect()}
    for i, text, processed, terms in rows:
        if terms is None:
            assert got[i] == (None, None)
            continue
        expected = [t for t in terms if t is not None and text is not None and t in text]
        assert got[i] == (expected, [t for t in expected if processed is not None and t not in processed])


def test_own_glossary_takes_time_that_follows_the_text(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ")
    docs = spark.range(1).select(text.alias("text")).withColumn("glossary", F.split("text", " ")).localCheckpoint()
    began = time.time()
    got = intake.glossary_check(docs, "text", "text", "glossary").select(F.size("expected_terms"), F.size("lost_terms")).first()
    assert tuple(got) == (40_000, 0) and time.time() - began < 8  # a search for every term alone takes several times that


def test_summaries_are_cut_once(spark):
    from textloom.plans.catalog import QUERIES

    plan = QUERIES["summary_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "regexp_extract(" not in plan


def test_summary_sections_against_plain_patterns(spark):
    texts = [
        "THESIS: a b\nMethodology: c\nGLOSSARY:\n1. x, y.\n", "gloſſary: q methodology: m theſis: t METHODOLOGY: n THESIS: u", "thesis: only", None, "",
        "x THESIS: METHODOLOGY: GLOSSARY:", "GLOSSARY: g\nTHESIS: t\r\n\nMETHODOLOGY: m\u2028",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("s", X.parse_summary(F.col("text"))).collect()
    for r in rows:
        cut = [re.search(p, r["text"] or "", re.I | re.S) for p in (r"THESIS:(.*?)(METHODOLOGY:|$)", r"METHODOLOGY:(.*?)(GLOSSARY:|$)", r"GLOSSARY:(.*)$")]
        want = (cut[0][1].strip(), cut[1][1].strip()) if all(cut) else (None, None)
        assert (r["s"]["thesis"], r["s"]["methodology"]) == want and (r["s"]["word_count"] == (len(r["text"].split()) if all(cut) else None))


def test_white_space_words_against_plain_split(spark):
    texts = ["", " \u3000\n", "a", "\x85a\xa0b\u2028 c\x1fd ", None, "a  b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(ws_words(F.col("text")), ws_count(F.col("text"))).collect()
    for t, r in zip(texts, rows, strict=True):
        want = None if t is None else [w for w in re.split(f"[{re.escape(V.WS_CHARS)}]+", t) if w]
        assert r[0] == want and r[1] == (None if t is None else len(want))


def test_hopeless_steps_of_fitting_are_not_wrapped(spark):
    """Eleven wraps of long paragraphs in flat boxes took more than five times one wrap."""
    words = F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.concat(F.lit("w"), (i * 7919 % 100_003).cast("string")))
    blocks = spark.range(64).select(F.array_join(words, " ").alias("text"), F.lit(200.0).alias("width"), F.lit(30.0).alias("height"))

    def seconds(df):
        best = 1e9
        for _ in range(3):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    one = seconds(blocks.select(layout.wrap_lines(F.col("text"), F.lit(9.0), F.col("width"))))
    assert seconds(layout.fit_paragraphs(blocks)) < 5 * one


def test_fitting_with_wide_words_equals_trying_every_step(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("x" * rnd.choice([1, 3, 8, 40, 90]) for _ in range(rnd.randrange(40))), float(rnd.randrange(10, 200)), float(rnd.randrange(5, 150))) for i in range(120)]
    blocks = spark.createDataFrame(rows, "id long, text string, width double, height double")
    steps = [(max(V.MIN_FONT_SIZE, V.BODY_FONT_SIZE * (1 - 0.1 * (k / 10))), V.LINE_SPACING * (1 - 0.1 * (k / 10))) for k in range(11)]
    lines = [layout.wrap_lines(F.col("text"), F.lit(size), F.col("width")).alias(f"l{k}") for k, (size, _) in enumerate(steps)]
    for r in layout.fit_paragraphs(blocks).join(blocks.select("id", *lines), "id").collect():
        fits = [k for k, (size, gap) in enumerate(steps) if len(r[f"l{k}"]) * size * gap <= r["height"]]
        chosen = fits[0] if fits else 10
        assert r["font_size"] == round(steps[chosen][0], 2) and r["lines"] == r[f"l{chosen}"][: len(r["lines"])]
        assert (len(r["lines"]) == len(r[f"l{chosen}"])) or not fits


def test_names_of_long_texts_take_only_their_head(spark):
    texts = ["", " \n", "a", "  One, two　three four five six seven eight nine", "?! ... --", "\x85x y", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(X.auto_name(F.col("text"))).collect()
    for t, r in zip(texts, rows, strict=True):
        head = [re.sub("[^a-zA-Z0-9]", "", w) for w in re.split(f"[{re.escape(V.WS_CHARS)}]+", (t or "").strip(V.WS_CHARS))[:7]]
        assert r[0] == (None if t is None else "_".join([w for w in head if w][:6])[: V.MAX_NAME_CHARS] or V.DEFAULT_NAME)
    plan = spark.range(1).select(F.col("id").cast("string").alias("text")).select(X.auto_name(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert ", 8)" not in plan  # no split of the whole text


def test_ends_of_pieces_against_the_whole_pattern(spark):
    ends = ["et al.", " Dr.", "Dr.", "xdr.", "approx" + "." * 40, " approx" + " ?" * 30, "e.g", "word.", "", " sec.,! \t"]
    rows = spark.createDataFrame([(a + b,) for a in ("", "long words before the end of it ", "a") for b in ends], "text string")
    whole, tail = F.col("text").rlike(X._ENDS_WITH_ABBREVIATION), X._ends_with_abbreviation(F.col("text"))
    assert rows.filter(~whole.eqNullSafe(tail)).count() == 0 and 0 < rows.filter(tail).count() < rows.count()


def test_texts_without_a_sign_meet_no_formula_pattern(spark):
    texts = spark.createDataFrame([("plain",), ("a $x$ b",), (r"\(y\) and $$z$$",), (None,), (r"\begin{align}q\end{align} \[r\]",)], "text string")
    masked = masking.mask_math(texts)
    assert [r["masked"] for r in masked.collect()] == [
        "plain", "a __MATH_INLINE_0__ b", "__MATH_INLINE_0__ and __MATH_BLOCK_0__", "", "__MATH_BLOCK_0__ __MATH_BLOCK_1__",
    ]
    assert masked._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") >= len(V.MATH_BLOCK_SIGNS + V.MATH_INLINE_SIGNS)


def _repeated_keys(spark):
    rows = [(1, "a b a"), (1, "b c"), (2, None), (3, ""), (4, "Don't don't -"), (None, "a")]
    return spark.createDataFrame(rows, "id long, text string")


def test_words_of_documents_meet_in_parts_that_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PART_BYTES", 1)
    counts = metrics.document_word_frequency(_repeated_keys(spark), "id")
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted([(1, "a", 2), (1, "b", 2), (1, "c", 1), (4, "don't", 2), (None, "a", 1)], key=repr)
    assert counts.rdd.getNumPartitions() == sum(len(t) for t in ("a b a", "b c", "Don't don't -", "a"))


def test_perplexity_shuffles_no_counts_of_keys(spark, monkeypatch):
    written = []
    monkeypatch.setattr(metrics, "stored", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    got = {r["id"]: (r["word_count"], r["perplexity"]) for r in metrics.corpus_perplexity(_repeated_keys(spark), "id", frequent_share=4).collect()}
    n = {"a": 3, "b": 2, "c": 1, "don't": 2}
    held = {1: ["a", "b", "a", "b", "c"], 4: ["don't"] * 2, None: ["a"]}
    for key, found in held.items():
        mean = sum(math.log(n[w] / 8) for w in found) / len(found)
        assert got[key] == (len(found), pytest.approx(math.exp(-mean)))
    assert set(got) == set(held) and "Exchange" not in written[0]  # texts are not shuffled, nor their counts before they are written
