"""Labels for the lines of Markdown texts, so that only prose is processed further."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import count_below, each, let, strip

FENCE = r"^[ \t]*(?:```|~~~)"
TABLE = r"^[ \t]*\|"
LIST = rf"^[ \t]*(?:[-*+]|\d+[.)]){V.WS}"
HEADING = rf"^[ \t]{{0,3}}#{{1,6}}{V.WS}"


def segment_markdown(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, label); label is fence, code, table, list, heading, blank or prose.

    A line is code while the number of fence lines before it is odd. The places of the
    fences are found once, and each line looks up how many are before it.
    """
    lines = df.select(key, F.split(text, "\n").alias("_lines"))
    places = F.filter(
        F.transform("_lines", lambda line, i: F.when(line.rlike(FENCE), i)), lambda i: i.isNotNull()
    )
    marked = let(
        places,
        lambda fences: F.transform(
            "_lines",
            lambda line, i: F.struct(
                line.alias("line"), F.when(F.size(fences) == 0, 0).otherwise(count_below(fences, i)).alias("fences")
            ),
        ),
    )
    rows = each(lines, [key], marked, "line_no", "_l").select(key, "line_no", "_l.line", "_l.fences")
    line = F.col("line")
    label = (
        F.when(line.rlike(FENCE), "fence")
        .when(F.col("fences") % 2 == 1, "code")
        .when(strip(line) == "", "blank")
        .when(line.rlike(HEADING), "heading")
        .when(line.rlike(TABLE), "table")
        .when(line.rlike(LIST), "list")
        .otherwise("prose")
    )
    return rows.select(key, "line_no", "line", label.alias("label"))
