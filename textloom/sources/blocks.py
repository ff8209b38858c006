"""Layout blocks: from HTML pages, from nested tables, to and from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import fixed_values as V
from textloom.functions.core import collapse_ws, each, join, let, strip, ws_count

SPAN = T.StructType(
    [
        T.StructField("font", T.StringType()),
        T.StructField("font_size", T.DoubleType()),
        T.StructField("font_flags", T.IntegerType()),
        T.StructField("color", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
LINE = T.StructType(
    [T.StructField("line_no", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]
    + [T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]
)
BLOCK = T.StructType(
    [T.StructField("page_no", T.IntegerType()), T.StructField("block_no", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1", "width", "height")]
    + [
        T.StructField("text", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("block_type", T.IntegerType()),
        T.StructField("lines", T.ArrayType(LINE)),
    ]
)

INVISIBLE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK_OPEN = r"(?i)<(h[1-6]|p|li)(?:\s[^>]*)?>"
BLOCK_CLOSE = r"(?i)</(?:h[1-6]|p|li)>"
IMAGE = r"(?i)<img\b[^>]*>"
ANY_TAG = r"<[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_blocks(html: Column) -> Column:
    """array<struct(block_no, tag, text, word_count, block_type)> in reading order.

    Headings, paragraphs and list items are text blocks (type 0); images follow as
    type 1 without text. The page stays one row, so nothing shuffles.
    """
    visible = F.regexp_replace(html, INVISIBLE, "")

    def plain(body: Column) -> Column:
        text = F.regexp_replace(F.get(F.split(body, BLOCK_CLOSE, 2), F.lit(0)), ANY_TAG, " ")
        for entity, char in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
        return strip(collapse_ws(text))

    def block(tag: Column, text: Column, kind: int) -> Column:
        return F.struct(
            tag.alias("tag"), text.alias("text"), ws_count(text).alias("word_count"), F.lit(kind).alias("block_type")
        )

    def blocks(page: Column) -> Column:
        tags = F.transform(F.regexp_extract_all(page, F.lit(BLOCK_OPEN), F.lit(1)), F.lower)
        # the part before the first block tag belongs to no block
        texts = let(
            F.split(page, BLOCK_OPEN, -1),
            lambda parts: F.transform(
                tags, lambda tag, i: let(plain(F.get(parts, i + 1)), lambda text: block(tag, text, 0))
            ),
        )
        images = F.transform(
            F.regexp_extract_all(page, F.lit(IMAGE), F.lit(0)), lambda _: block(F.lit("img"), F.lit(""), 1)
        )
        return F.concat(texts, images)

    return F.transform(
        let(visible, blocks),
        lambda b, i: F.struct(
            i.cast("int").alias("block_no"), b["tag"].alias("tag"), b["text"].alias("text"),
            b["word_count"].alias("word_count"), b["block_type"].alias("block_type"),
        ),
    )


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, blocks): one row per page."""
    return pages.select(key, html_blocks(F.col(html)).alias("blocks"))


def explode_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per block of every page."""
    return each(page_blocks(pages, key, html), [key], "blocks", "_pos", "_b").select(key, "_b.*")


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks that are not blank."""
    return blocks.filter((F.col("block_type") == 0) & (strip(F.col("text")) != ""))


def flatten_spans(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per span, with its line's text put together from the spans.

    Blocks without lines and lines without spans keep one row with nulls.
    """
    lines = blocks.select(*keys, F.explode_outer("lines").alias("line"))
    lines = lines.withColumn("line_text", join(F.col("line.spans.text")))
    return lines.select(
        *keys, F.col("line.line_no").alias("line_no"), "line_text",
        F.posexplode_outer("line.spans").alias("span_no", "span"),
    ).select(
        *keys, "line_no", "line_text", "span_no", "span.font", "span.font_size",
        F.coalesce("span.font_flags", F.lit(0)).alias("font_flags"), "span.color", F.col("span.text").alias("text"),
    )


def font_style(spans: DataFrame, flags: str = "font_flags") -> DataFrame:
    def has(bit: int) -> Column:
        return F.col(flags).bitwiseAND(F.lit(bit)) != 0

    return spans.withColumns({"is_bold": has(V.BOLD_FLAG), "is_italic": has(V.ITALIC_FLAG)})


def blocks_to_json(blocks: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in blocks.columns if c not in keys]
    return blocks.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


def blocks_from_json(df: DataFrame, keys: list[str], schema: T.StructType = BLOCK, json: str = "json") -> DataFrame:
    """Parse block JSON; rows that do not parse keep a stub block, the error and the whole record."""
    permissive = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn("_b", F.from_json(json, permissive, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_b").isNull() | F.col("_b._corrupt").isNotNull()
    return parsed.select(
        *keys, *[F.col(f"_b.{f.name}").alias(f.name) for f in schema.fields],
        F.when(bad, F.lit("unreadable block")).alias("error"), F.when(bad, F.col(json)).alias("unreadable"),
    )
