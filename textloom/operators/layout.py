"""Geometry of block tables, layout estimates and the way back from chunks to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import ascii_upper_lower_check, each, fold, join, let, non_blank, py_round, strip, ws_count, ws_words
from textloom.functions.text import spans

BOX = ["x0", "y0", "x1", "y1"]


# --- coordinates -----------------------------------------------------------------


def sanitize_coord(value: Column, fallback: Column) -> Column:
    """The value as a double if it is a plausible coordinate, else the fallback."""
    number = value.try_cast("double")
    return F.when(number.between(V.COORD_MIN, V.COORD_MAX), number).otherwise(fallback.cast("double"))


def normalize_bbox(blocks: DataFrame) -> DataFrame:
    """Order the corners and derive width and height."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    blocks = blocks.withColumns(
        {"x0": F.least(x0, x1), "y0": F.least(y0, y1), "x1": F.greatest(x0, x1), "y1": F.greatest(y0, y1)}
    )
    return blocks.withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")})


def with_page_size(blocks: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Add page_w and page_h, A4 where the page is unknown."""
    sizes = pages.select(*keys, F.col("width").alias("page_w"), F.col("height").alias("page_h"))
    return blocks.join(sizes, keys, "left").withColumns(
        {
            "page_w": F.coalesce("page_w", F.lit(V.PAGE_WIDTH)),
            "page_h": F.coalesce("page_h", F.lit(V.PAGE_HEIGHT)),
        }
    )


def clean_coordinates(blocks: DataFrame) -> DataFrame:
    """Sanitise the corners against the page size, then normalise the box."""
    fallbacks = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("page_w"), "y1": F.col("page_h")}
    return normalize_bbox(blocks.withColumns({c: sanitize_coord(F.col(c), f) for c, f in fallbacks.items()}))


def with_stub_blocks(blocks: DataFrame, error: str = "error") -> DataFrame:
    """Give rows with an error an empty block the size of a page; the error stays."""
    bad = F.col(error).isNotNull()
    stub = {
        "x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(V.PAGE_WIDTH), "y1": F.lit(V.PAGE_HEIGHT),
        "width": F.lit(V.PAGE_WIDTH), "height": F.lit(V.PAGE_HEIGHT), "text": F.lit(""),
        "word_count": F.lit(0), "block_type": F.lit(0),
    }
    return blocks.withColumns(
        {c: F.when(bad, v).otherwise(F.col(c)) for c, v in stub.items() if c in blocks.columns}
    )


def is_heading(text: Column) -> Column:
    """Short text in upper case."""
    return F.coalesce(ascii_upper_lower_check(text) & (F.length(text) < V.HEADING_MAX_CHARS), F.lit(False))


def expand_bbox(blocks: DataFrame, margin: float = V.REDACT_MARGIN) -> DataFrame:
    return blocks.withColumns(
        {c: F.col(c) + (F.lit(-margin) if c in ("x0", "y0") else F.lit(margin)) for c in BOX}
    )


def flip_y(page_h: Column, y0: Column, font_size: Column) -> Column:
    """First baseline measured from the bottom of the page."""
    return page_h - y0 - font_size


# --- summaries over block tables ----------------------------------------------------


def block_summary(blocks: DataFrame, key: str, page: str | None = None, error: str | None = None) -> DataFrame:
    """Counts per document. Everything that is not a non-blank text block counts as image."""
    is_text = (F.col("block_type") == 0) & (strip(F.col("text")) != "")
    pages = F.count_distinct(page) if page else F.lit(1).cast("bigint")
    errors = F.count(error) if error else F.lit(0).cast("bigint")
    return blocks.groupBy(key).agg(
        F.count("*").alias("total_blocks"),
        F.count_if(is_text).alias("text_blocks"),
        F.count_if(~is_text).alias("image_blocks"),
        F.sum(F.when(is_text, F.col("word_count")).otherwise(0)).alias("total_words"),
        errors.alias("parse_errors"),
        pages.alias("pages"),
    )


def assemble_text(blocks: Column) -> Column:
    """Text of a block array: text blocks only, stripped, joined by a blank line."""
    return join(F.transform(F.filter(blocks, lambda b: b["block_type"] == 0), lambda b: strip(b["text"])), "\n\n")


def page_count_mismatches(left: DataFrame, right: DataFrame, key: str, page: str) -> DataFrame:
    """Documents whose two versions differ in their number of pages."""
    a = left.groupBy(key).agg(F.count_distinct(page).alias("left_pages"))
    b = right.groupBy(key).agg(F.count_distinct(page).alias("right_pages"))
    counts = a.join(b, key, "full_outer").select(
        key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_pages", "right_pages")]
    )
    return counts.filter("left_pages <> right_pages")


# --- line estimates -------------------------------------------------------------------


def _line_count(lengths: Column, font_size: Column, width: Column) -> Column:
    """Lines needed when every character has the same width; wide words span lines."""
    start = F.struct(F.lit(1).cast("bigint").alias("lines"), F.lit(0.0).alias("used"))

    def packed(char: Column) -> Column:
        def step(s: Column, n: Column) -> Column:
            def placed(word: Column) -> Column:
                wide = F.struct(
                    (s["lines"] + F.when(s["used"] > 0, 1).otherwise(0) + F.ceil(word / width) - 1).alias("lines"),
                    (word % width).alias("used"),
                )
                wraps = s["used"] + word > width
                narrow = F.struct(
                    (s["lines"] + F.when(wraps, 1).otherwise(0)).alias("lines"),
                    (F.when(wraps, F.lit(0.0)).otherwise(s["used"]) + word + char).alias("used"),
                )
                return F.when(word > width, wide).otherwise(narrow)

            return placed(n * char)

        return fold(lengths, start, step, lambda s: s["lines"])

    return F.when(F.size(lengths) == 0, F.lit(0).cast("bigint")).otherwise(
        let(font_size * V.CHAR_WIDTH_RATIO, packed)
    )


def word_lengths(text: Column) -> Column:
    return F.transform(ws_words(F.coalesce(text, F.lit(""))), lambda w: F.length(w))


def estimate_dimensions(text: Column, font_size: Column, width: Column) -> Column:
    """Struct(height, lines) of a text set in a column of the given width."""
    lines = let(word_lengths(text), lambda n: _line_count(n, font_size, width))
    return let(
        lines, lambda k: F.struct((k * font_size * V.LINE_SPACING).alias("height"), k.alias("lines"))
    )


def overflow_report(
    blocks: DataFrame, text: str = "text", font_size: str = "font_size", width: str = "width", height: str = "height",
    tolerance: float = V.OVERFLOW_TOLERANCE,
) -> DataFrame:
    """Add overflow, estimated height, percentage and the first scale from 0.95 down that fits.

    Packed words never exceed the width of their lines, so a scale at which the
    bare characters alone need more height than there is cannot fit and is skipped
    without packing; the others are tried in order until one fits.
    """
    blocks = blocks.withColumn("_n", word_lengths(F.col(text)))
    blocks = blocks.withColumns(
        {
            "_size": F.col(font_size).cast("double"), "_w": F.col(width).cast("double"),
            "_h": F.col(height).cast("double"),
            "_chars": fold(F.col("_n"), F.lit(0).cast("bigint"), lambda a, n: a + n),
        }
    )
    size, w, h = F.col("_size"), F.col("_w"), F.col("_h")
    blocks = blocks.withColumn("lines", _line_count(F.col("_n"), size, w))
    blocks = blocks.withColumn("estimated_height", F.col("lines") * size * V.LINE_SPACING)
    blocks = blocks.withColumns(
        {
            "overflow": F.col("estimated_height") > h * (1.0 + tolerance),
            "overflow_percentage": F.when(h > 0, (F.col("estimated_height") - h) / h * 100).otherwise(F.lit(0.0)),
        }
    )

    def first_scale(words: Column) -> Column:
        def try_scale(found: Column, percent: Column) -> Column:
            def fits(scaled: Column) -> Column:
                floor = words["chars"] * scaled * V.CHAR_WIDTH_RATIO / w * scaled * V.LINE_SPACING
                return (floor <= h * (1 + 1e-9)) & (
                    _line_count(words["lengths"], scaled, w) * scaled * V.LINE_SPACING <= h
                )

            return F.when(found.isNotNull(), found).when(let(size * (percent / 100.0), fits), percent / 100.0)

        return fold(F.sequence(F.lit(95), F.lit(10), F.lit(-1)), F.lit(None).cast("double"), try_scale)

    # Bound outside the search: a column used once is inlined, here into a loop.
    search = let(F.struct(F.col("_n").alias("lengths"), F.col("_chars").alias("chars")), first_scale)
    blocks = blocks.withColumn(
        "scale", F.when(F.col("overflow"), F.coalesce(search, F.lit(0.1))).otherwise(F.lit(1.0))
    )
    return blocks.withColumn("scaled_font_size", size * F.col("scale")).drop("_n", "_size", "_w", "_h", "_chars")


# --- fitting with glyph widths -----------------------------------------------------------


def _glyph_codes(widths: dict[int, str]) -> tuple[str, str]:
    """Translation that turns every character into the character whose code is its width."""
    source = "".join(widths.values())
    return source, "".join(chr(w) * len(chars) for w, chars in widths.items())


def _coded(text: Column, widths: dict[int, str]) -> Column:
    """Every character but the space replaced by the character whose code is its width."""
    visible = {w: chars.replace(" ", "") for w, chars in widths.items()}
    source, target = _glyph_codes(visible)
    # Unknown characters first, so that translated codes are not mistaken for them.
    known = "".join(f"\\x{{{ord(c):x}}}" for c in source)
    return F.translate(F.regexp_replace(text, f"[^ {known}]", chr(V.DEFAULT_GLYPH_WIDTH)), source, target)


def _code_sum(coded: Column) -> Column:
    return fold(
        F.split(coded, ""), F.lit(0),
        lambda a, c: a + F.when(c == " ", F.lit(V.HELVETICA_SPACE)).otherwise(F.ascii(c)),
    )


def word_widths(words: Column, bold: Column | None = None) -> Column:
    """Width of each word in thousandths of the font size; the text is coded once."""
    def measure(widths: dict[int, str]) -> Column:
        coded = F.split(_coded(join(words, " "), widths), " ")
        return F.transform(coded, lambda w: fold(F.split(w, ""), F.lit(0), lambda a, c: a + F.ascii(c)))

    plain = measure(V.HELVETICA_WIDTHS)
    chosen = plain if bold is None else F.when(bold, measure(V.HELVETICA_BOLD_WIDTHS)).otherwise(plain)
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(chosen)


def text_width(text: Column) -> Column:
    """Width of a text in thousandths of the font size."""
    return _code_sum(_coded(text, V.HELVETICA_WIDTHS))


def _wrap_starts(widths: Column, space: int, font_size: Column, limit: Column) -> Column:
    """1-based positions of the words that start a line."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("starts")
    )

    def step(s: Column, w: Column) -> Column:
        # used = width of the open line, 0 if no line is open
        joined = F.when(s["used"] > 0, s["used"] + space).otherwise(F.lit(0)) + w
        fits = joined * 0.001 * font_size <= limit
        alone = w * 0.001 * font_size <= limit
        # An over-wide word closes the open line and is a line of its own only when
        # no line was open; after an open line it becomes the open line itself.
        opens = (s["used"] == 0) | ~fits
        used = F.when(fits, joined).when((s["used"] == 0) & ~alone, F.lit(0)).otherwise(w)
        return F.struct(
            (s["at"] + 1).alias("at"), used.alias("used"),
            F.when(opens, F.array_append(s["starts"], s["at"] + 1)).otherwise(s["starts"]).alias("starts"),
        )

    return fold(widths, start, step, lambda s: s["starts"])


def wrap_lines(text: Column, font_size: Column, width: Column) -> Column:
    """Array of lines no wider than ``width`` where words allow it."""
    def lines(words: Column) -> Column:
        starts = _wrap_starts(word_widths(words), V.HELVETICA_SPACE, font_size, width)
        return let(
            starts,
            lambda st: F.transform(
                spans(st, F.size(words)), lambda s: join(F.slice(words, s["start"], s["length"]), " ")
            ),
        )

    return let(ws_words(F.coalesce(text, F.lit(""))), lines)


def fit_paragraphs(
    blocks: DataFrame, text: str = "text", font_size: float = V.BODY_FONT_SIZE, spacing: float = V.LINE_SPACING,
    width: str = "width", height: str = "height", heading: str | None = None,
) -> DataFrame:
    """Add lines, font_size, line_spacing and overflow_text of text fitted into its box.

    Font and spacing shrink together in eleven steps down to 90 %, the font not
    below 7 points; the first step that fits wins. If none does, the lines that fit
    (at least one) stay and the rest is handed back. Words are measured once.
    A line holds no more than its width, an over-wide word alone; a step at which that asks
    for more lines than there is height for cannot fit and is skipped without wrapping.
    """
    bold = F.col(heading) if heading else None
    blocks = blocks.withColumns(
        {
            "_words": ws_words(F.coalesce(F.col(text), F.lit(""))),
            "_w": F.greatest(F.lit(1.0), F.col(width).cast("double")),
            "_h": F.greatest(F.lit(1.0), F.col(height).cast("double")),
        }
    )
    blocks = blocks.withColumn("_widths", word_widths(F.col("_words"), bold))

    def room(size: Column) -> Column:
        """The width of the box in thousandths of the font size."""
        return F.col("_w") / (size * 0.001)

    # What the words take at least, a space with each, at every step: rooms only grow from the first on.
    first = F.greatest(F.lit(V.MIN_FONT_SIZE), F.lit(float(font_size)))
    bare = let(room(first), lambda most: fold(F.col("_widths"), F.lit(0.0), lambda a, w: a + F.least(w.cast("double"), most) + float(V.HELVETICA_SPACE)))
    blocks = blocks.withColumn("_bare", bare)

    def layout(best: Column, step: Column, widths: Column) -> Column:
        factor = F.lit(1.0) - F.lit(0.1) * (step / F.lit(float(V.FIT_STEPS)))
        scale = F.struct(
            F.greatest(F.lit(V.MIN_FONT_SIZE), F.lit(font_size) * factor).alias("size"),
            (F.lit(spacing) * factor).alias("gap"),
        )

        def sized(s: Column) -> Column:
            least = F.col("_bare") / (room(s["size"]) + float(V.HELVETICA_SPACE)) * (1 - 1e-9)
            hopeless = F.ceil(least) * s["size"] * s["gap"] > F.col("_h") * (1 + 1e-9)
            return F.when(hopeless & (step < V.FIT_STEPS), best).otherwise(wrapped(s))

        def wrapped(s: Column) -> Column:
            starts = _wrap_starts(widths, V.HELVETICA_SPACE, s["size"], F.col("_w"))
            return let(
                starts,
                lambda st: F.struct(
                    st.alias("starts"), s["size"].alias("size"), s["gap"].alias("gap"),
                    (F.size(st) * s["size"] * s["gap"] <= F.col("_h")).alias("fits"),
                ),
            )

        return let(scale, sized)  # bound, or every word would compute it again

    none = F.lit(None).cast("struct<starts:array<int>,size:double,gap:double,fits:boolean>")
    # Bound outside the search: a column used once is inlined, here into a loop.
    search = let(
        F.col("_widths"),
        lambda widths: fold(
            F.sequence(F.lit(0), F.lit(V.FIT_STEPS)), none,
            lambda best, step: F.when(F.coalesce(best["fits"], F.lit(False)), best).otherwise(layout(best, step, widths)),
        ),
    )
    blocks = blocks.withColumn("_fit", search)
    size, gap = py_round(F.col("_fit.size"), 2), py_round(F.col("_fit.gap"), 2)
    blocks = blocks.withColumns(
        {
            "font_size": size, "line_spacing": gap,
            "_lines": F.transform(
                spans(F.col("_fit.starts"), F.size("_words")),
                lambda s: join(F.slice("_words", s["start"], s["length"]), " "),
            ),
        }
    )
    most_lines = F.greatest(F.lit(1), F.floor(F.col("_h") / (F.col("font_size") * F.col("line_spacing"))).cast("int"))
    kept = F.when(F.col("_fit.fits"), F.size("_lines")).otherwise(F.least(most_lines, F.size("_lines")))
    blocks = blocks.withColumn("_kept", kept)
    return blocks.withColumns(
        {
            "lines": F.slice("_lines", F.lit(1), F.col("_kept")),
            "overflow_text": join(F.slice("_lines", F.col("_kept") + 1, F.size("_lines")), " "),
        }
    ).drop("_words", "_w", "_h", "_widths", "_bare", "_fit", "_lines", "_kept")


# --- chunks and blocks ----------------------------------------------------------------------


def chunk_block_links(chunks: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, chunk_id, original_index, block_no, weight, position): the blocks each chunk refers to.

    A paragraph index means the block at that list position; where there is none it
    means the blocks with that block number. A block counts once per chunk, at its
    first reference. Its weight is its number of words, at least one.
    """
    refs = chunks.select(key, "chunk_id", F.posexplode("paragraph_indices").alias("_at", "_index"))
    weight = F.greatest(F.lit(1), ws_count(F.coalesce("text", F.lit(""))))
    slim = blocks.select(key, "original_index", "block_no", weight.alias("weight"))
    out = [key, "chunk_id", "original_index", "block_no", "weight", "_at"]
    tried = refs.join(slim.withColumn("_index", F.col("original_index")), [key, "_index"], "left")
    direct = tried.filter(F.col("original_index").isNotNull()).select(*out)
    by_number = (
        tried.filter(F.col("original_index").isNull()).select(key, "chunk_id", "_at", "_index")
        .join(slim.withColumn("_index", F.col("block_no")), [key, "_index"])
        .select(*out)
    )
    return (
        direct.unionByName(by_number)
        .groupBy(key, "chunk_id", "original_index", "block_no", "weight")
        .agg(F.min("_at").alias("position"))
    )


def dangling_references(chunks: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, chunk_id, paragraph_index) of references that match no block."""
    refs = chunks.select(key, "chunk_id", F.explode("paragraph_indices").alias("paragraph_index"))
    unknown = refs
    for column in ("original_index", "block_no"):
        unknown = unknown.join(
            blocks.select(key, F.col(column).alias("paragraph_index")), [key, "paragraph_index"], "left_anti"
        )
    return unknown.select(key, "chunk_id", "paragraph_index").distinct()


def sequence_audit(expected: DataFrame, received: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq, problem): missing, unexpected and duplicate sequence numbers.

    Both sides are counted first, so copies never meet in the join.
    """
    e = expected.groupBy(key, seq).agg(F.count("*").alias("_e"))
    r = received.groupBy(key, seq).agg(F.count("*").alias("_r"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("_r").isNull(), "missing"),
            F.when(F.col("_e").isNull(), "unexpected"),
            F.when(F.col("_r") > 1, "duplicate"),
        )
    )
    both = e.join(r, [key, seq], "full_outer")
    return each(both, [key, seq], problems, "_pos", "problem").drop("_pos")


def split_words(text: Column, weights: Column) -> Column:
    """Words of a text dealt to blocks in proportion to their weights.

    Every block but the last takes max(1, int(n * weight / total)) words while there
    are any; the last takes the rest.
    """
    def deal(state: Column) -> Column:
        words, n, total, weights_ = state["words"], F.size(state["words"]), state["total"], state["weights"]
        takes = F.transform(
            weights_, lambda w: F.greatest(F.lit(1), F.floor(n * (w / total)).cast("int"))
        )
        k = F.size(weights_)

        def piece(i: Column, takes_: Column) -> Column:
            before = F.least(n, fold(F.slice(takes_, F.lit(1), i), F.lit(0), lambda a, t: a + t))
            length = F.when(i == k - 1, n - before).otherwise(F.least(F.get(takes_, i), n - before))
            return join(F.slice(words, before + 1, length), " ")

        return let(takes, lambda t: F.transform(F.sequence(F.lit(0), k - 1), lambda i: piece(i, t)))

    total = fold(weights, F.lit(0), lambda a, w: a + w)
    return let(
        F.struct(ws_words(text).alias("words"), weights.alias("weights"), total.alias("total")), deal
    )


def distribute_text(text: Column, weights: Column) -> Column:
    """Array of one text per block: by blank lines, else by lines, else by word share."""
    def choose(t: Column) -> Column:
        k = F.size(weights)
        by_blank = non_blank(F.split(t, "\n\n"))
        by_line = non_blank(F.split(t, "\n"))
        return F.when(k == 1, F.array(t)).otherwise(
            let(
                by_blank,
                lambda a: F.when(F.size(a) == k, a).otherwise(
                    let(by_line, lambda b: F.when(F.size(b) == k, b).otherwise(split_words(t, weights)))
                ),
            )
        )

    return let(strip(F.coalesce(text, F.lit(""))), choose)


def distribute_chunks(chunks: DataFrame, blocks: DataFrame, key: str, text: str = "processed") -> DataFrame:
    """Mapped blocks: every chunk's text laid onto the blocks it came from.

    A chunk refers to as many blocks as its own row lists, which bounds the group
    collected per chunk; only weights and numbers are collected, and the block
    columns are joined back by (key, original_index). Blocks and chunks are read
    more than once, so pass written tables or cheap projections of them.
    """
    entry = F.struct("position", "original_index", "weight")
    plan = chunk_block_links(chunks, blocks, key).groupBy(key, "chunk_id").agg(
        F.array_sort(F.collect_list(entry)).alias("_plan")
    )
    pieces = chunks.select(key, "chunk_id", text).join(plan, [key, "chunk_id"])
    shares = F.arrays_zip(
        F.col("_plan.original_index").alias("original_index"),
        distribute_text(F.col(text), F.col("_plan.weight")).alias("rewritten_text"),
    )
    dealt = each(pieces, [key, "chunk_id"], shares, "_i", "_d").select(
        key, "chunk_id", "_d.original_index", "_d.rewritten_text"
    )
    return dealt.join(blocks.withColumnRenamed("text", "original_text"), [key, "original_index"])
