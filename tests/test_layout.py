import pytest
from pyspark.sql import functions as F

from textloom.operators import layout as L
from textloom.operators import markdown
from textloom.sources import blocks as B


def test_coordinates(spark):
    df = spark.createDataFrame(
        [("5", "9"), ("x", "1"), ("NaN", "1"), ("-20000", "1"), (None, "1"), ("99999", "1")], "a string, b string"
    )
    got = [r[0] for r in df.select(L.sanitize_coord(F.col("a"), F.lit(7.0))).collect()]
    assert got == [5.0, 7.0, 7.0, 7.0, 7.0, 99999.0]


def test_boxes(spark):
    df = spark.createDataFrame([(9.0, 8.0, 1.0, 2.0)], "x0 double, y0 double, x1 double, y1 double")
    row = L.expand_bbox(L.normalize_bbox(df)).first()
    assert (row.x0, row.y0, row.x1, row.y1, row.width, row.height) == (0.5, 1.5, 9.5, 8.5, 8.0, 6.0)
    assert df.select(L.flip_y(F.lit(842.0), F.lit(100.0), F.lit(10.0))).first()[0] == 732.0


@pytest.mark.parametrize(
    ("text", "heading"), [("INTRO 1", True), ("Intro", False), ("123", False), ("A" * 100, False), (None, False)]
)
def test_headings(spark, text, heading):
    assert spark.createDataFrame([(text,)], "t string").select(L.is_heading(F.col("t"))).first()[0] is heading


HTML = (
    '<html><script>var t="<p>no</p>";</script><!-- <p>no</p> --><h1 class="a">Tom &amp; <b>Ann</b></h1>'
    "<ul><li>one<li>two</li></ul><img src='x'><p>last\n line</p>tail</html>"
)


def test_html_blocks(spark):
    df = spark.createDataFrame([(1, HTML), (2, ""), (3, None)], "page_id int, html string")
    rows = B.explode_blocks(df).filter("page_id = 1").orderBy("block_no").collect()
    assert [(r.tag, r.text, r.word_count, r.block_type) for r in rows] == [
        ("h1", "Tom & Ann", 3, 0), ("li", "one", 1, 0), ("li", "two", 1, 0), ("p", "last line", 2, 0), ("img", "", 0, 1)
    ]
    text = B.page_blocks(df).filter("page_id = 1").select(L.assemble_text(F.col("blocks"))).first()[0]
    assert text == "Tom & Ann\n\none\n\ntwo\n\nlast line"
    summary = L.block_summary(B.explode_blocks(df), "page_id").first()
    assert (summary.total_blocks, summary.text_blocks, summary.image_blocks, summary.total_words) == (5, 4, 1, 7)


def test_json_and_stubs(spark):
    df = spark.createDataFrame([(1, '{"text": "a b", "word_count": 2, "x1": 5.0}'), (2, "{broken"), (3, None)], "k int, json string")
    rows = L.with_stub_blocks(B.blocks_from_json(df, ["k"])).orderBy("k").collect()
    assert (rows[0].text, rows[0].x1, rows[0].error) == ("a b", 5.0, None)
    for row in rows[1:]:
        assert (row.text, row.word_count, row.width, row.height) == ("", 0, 595.0, 842.0) and row.error


def test_spans(spark):
    span = "struct<font:string,font_size:double,font_flags:int,color:int,text:string>"
    df = spark.createDataFrame(
        [(1, [(0, [("F", 9.0, 16, 0, "ab"), ("F", 9.0, 18, 0, "c")])]), (2, [])],
        f"k int, lines array<struct<line_no:int,spans:array<{span}>>>",
    )
    rows = B.font_style(B.flatten_spans(df, ["k"])).orderBy("k", "span_no").collect()
    assert [(r.line_text, r.is_bold, r.is_italic) for r in rows[:2]] == [("abc", True, False), ("abc", True, True)]
    assert len(rows) == 3 and rows[2].text is None


def report(spark, text, size, width, height):
    df = spark.createDataFrame([(text, size, width, height)], "text string, font_size double, width double, height double")
    return L.overflow_report(df).first()


def test_overflow(spark):
    short = report(spark, "Short text.", 12.0, 200.0, 50.0)
    assert not short.overflow and short.scale == 1.0
    long = report(spark, "This text goes on and on and never fits the box " * 6, 12.0, 150.0, 40.0)
    assert long.overflow and long.scale < 1.0
    df = spark.createDataFrame([("This text goes on and on and never fits the box " * 6,)], "t string")
    height = df.select(L.estimate_dimensions(F.col("t"), F.lit(12.0 * long.scale), F.lit(150.0))["height"]).first()[0]
    assert height <= 40.0
    assert not report(spark, "Small overflow test case.", 10.0, 100.0, 42.0).overflow
    assert report(spark, "", 10.0, 100.0, 42.0).lines == 0


def line_count(words, size, width):
    char, lines, used = size * 0.38, 1, 0.0
    for n in words:
        word = n * char
        if word > width:
            if used > 0:
                lines += 1
            lines += -int(-word // width) - 1
            used = word % width
        elif used + word > width:
            lines += 1
            used = word + char
        else:
            used += word + char
    return lines


@pytest.mark.parametrize("width", [20.0, 37.5, 90.0, 400.0])
def test_line_counts_and_scales_against_brute_force(spark, width):
    words = [3, 14, 1, 1, 25, 7, 2, 40, 6, 5, 9, 9, 1, 30, 4]
    row = report(spark, " ".join("x" * n for n in words), 10.0, width, 60.0)
    assert row.lines == line_count(words, 10.0, width)
    if row.overflow:
        fits = [
            s / 100 for s in range(95, 9, -1)
            if line_count(words, 10.0 * (s / 100), width) * (10.0 * (s / 100)) * 1.2 <= 60.0
        ]
        assert row.scale == (fits[0] if fits else 0.1)


LONG = (
    "This is a very long text block designed to completely overflow our small container, "
    "even when we shrink the font size down to the maximum allowed limit of 9.0 points. "
    "The layout must split this text, keeping what fits inside the container and "
    "returning the remaining text as an overflow string so we don't lose any data."
)


def fit(spark, text, size=10.0):
    df = spark.createDataFrame([(text, 200.0, 50.0)], "text string, width double, height double")
    return L.fit_paragraphs(df, font_size=size).first()


def test_fit_paragraphs(spark):
    assert fit(spark, "This is a short paragraph that easily fits.").font_size == 10.0
    medium = fit(
        spark,
        "This is a slightly longer text block that will not fit at standard size 10 inside our small container because "
        "it is way too long, but should fit when scaled down slightly to around 9 points.",
    )
    assert 9.0 <= medium.font_size < 10.0 and not medium.overflow_text
    long = fit(spark, LONG)
    assert long.font_size == 9.0 and long.overflow_text
    assert " ".join([*long.lines, long.overflow_text]) == LONG
    assert fit(spark, LONG + " " + LONG, 7.5).font_size == 7.0


def test_wrapping_gives_over_wide_words_their_own_line(spark):
    df = spark.createDataFrame([("iiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiii a b",)], "t string")
    assert df.select(L.wrap_lines(F.col("t"), F.lit(10.0), F.lit(20.0))).first()[0] == ["i" * 36, "a b"]
    assert df.select(L.text_width(F.lit("Hi \u4e2d"))).first()[0] == 722 + 222 + 278 + 556


def distribute(spark, text, weights):
    df = spark.createDataFrame([(text, weights)], "t string, w array<int>")
    return df.select(L.distribute_text(F.col("t"), F.col("w"))).first()[0]


def test_distribution(spark):
    assert distribute(spark, "one\n\ntwo", [1, 1]) == ["one", "two"]
    assert distribute(spark, "one\ntwo", [1, 1]) == ["one", "two"]
    assert distribute(spark, " whole\n\ntext ", [4]) == ["whole\n\ntext"]
    assert distribute(spark, "a b c d e f g h i j", [6, 3, 1]) == ["a b c d e f", "g h i", "j"]
    assert distribute(spark, "a b", [1, 1, 5]) == ["a", "b", ""]
    assert distribute(spark, "", [1, 1]) == ["", ""]


def block_table(spark):
    rows = [("d", 0, 5, "a b c"), ("d", 1, 6, "d"), ("d", 2, 999, "e f")]
    return spark.createDataFrame(rows, "doc string, original_index int, block_no int, text string")


def test_chunks_back_to_blocks(spark):
    chunks = spark.createDataFrame(
        [("d", 0, [0, 1], "x y z w"), ("d", 1, [999, 2], "v")], "doc string, chunk_id int, paragraph_indices array<int>, processed string"
    )
    rows = L.distribute_chunks(chunks, block_table(spark), "doc").orderBy("original_index").collect()
    assert [(r.chunk_id, r.original_index, r.rewritten_text) for r in rows] == [(0, 0, "x y z"), (0, 1, "w"), (1, 2, "v")]
    bad = chunks.withColumn("paragraph_indices", F.array(F.lit(1), F.lit(77)))
    assert [r.paragraph_index for r in L.dangling_references(bad, block_table(spark), "doc").collect()] == [77, 77]


def test_sequence_audit(spark):
    e = spark.createDataFrame([("r", 0), ("r", 1)], "run string, seq int")
    r = spark.createDataFrame([("r", 0), ("r", 0), ("r", 2)], "run string, seq int")
    got = {(x.seq, x.problem) for x in L.sequence_audit(e, r, "run", "seq").collect()}
    assert got == {(0, "duplicate"), (1, "missing"), (2, "unexpected")}


def test_page_sizes_and_counts(spark):
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0)], "doc string, page int, width double, height double")
    blocks = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    rows = L.with_page_size(blocks, pages, ["doc", "page"]).orderBy("page").collect()
    assert [(r.page_w, r.page_h) for r in rows] == [(612.0, 792.0), (595.0, 842.0)]
    row = L.page_count_mismatches(blocks, pages, "doc", "page").first()
    assert (row.left_pages, row.right_pages) == (2, 1)


def test_markdown(spark):
    text = "# Head\nprose\n```py\n# not a head\n```\n- item\n2) item\n| a |\n\n#tag"
    df = spark.createDataFrame([(0, text), (1, "no fence")], "k int, text string")
    rows = markdown.segment_markdown(df, "k").filter("k = 0").orderBy("line_no").collect()
    assert [r.label for r in rows] == [
        "heading", "prose", "fence", "code", "fence", "list", "list", "table", "blank", "prose"
    ]
