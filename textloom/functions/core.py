"""Small building blocks shared by the text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import fixed_values as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def fold(items: Column, start: Column, step: Callable, finish: Callable | None = None) -> Column:
    return F.aggregate(items, start, step, finish) if finish else F.aggregate(items, start, step)


def count_below(ordered: Column, wanted: Column) -> Column:
    """How many elements of an ascending array are less than ``wanted``, by binary search.

    ``ordered`` should be bound (``let``), since every step looks into it.
    """
    start = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + F.lit(1.0))).cast("int"))

    def step(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        less = (s["low"] < s["high"]) & (F.get(ordered, middle) < wanted)
        return F.struct(
            F.when(less, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(less | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"),
        )

    return fold(halvings, start, step, lambda s: s["low"])


def py_round(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    Spark rounds the shortest decimal text of a double, so 2.675 becomes 2.68
    although its binary value lies below the tie. The rounding error of
    ``value * scale`` is recovered by splitting the factor in two halves, which
    tells on which side of the tie the exact product lies.
    """
    scale = float(10**digits)

    def rounded(v: Column) -> Column:
        big = v * F.lit(134217729.0)
        high = big - (big - v)
        product = v * F.lit(scale)
        error = (high * F.lit(scale) - product) + (v - high) * F.lit(scale)
        low = F.floor(product)
        half = (product - low) - F.lit(0.5)
        up = (half > 0) | ((half == 0) & (error > 0)) | ((half == 0) & (error == 0) & (low % 2 != 0))
        return (low + F.when(up, 1).otherwise(0)).cast("double") / F.lit(scale)

    return let(value.cast("double"), rounded)


# --- white space -----------------------------------------------------------


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(V.WS_CHARS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def ws_words(text: Column) -> Column:
    """Words between runs of white space."""
    # White space of every kind becomes a space; a pattern would be compiled for every text.
    return F.array_remove(F.split(F.translate(text, V.WS_CHARS, " " * len(V.WS_CHARS)), " "), "")


def ws_count(text: Column) -> Column:
    return F.size(ws_words(text))


def collapse_ws(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(text, f"{V.WS}+", by)


def join(parts: Column, separator: str = "") -> Column:
    return F.array_join(parts, separator)


def non_blank(parts: Column) -> Column:
    """Stripped elements, blanks dropped."""
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def ascii_upper_lower_check(text: Column) -> Column:
    """True when all cased characters are upper case and there is at least one."""
    return (F.upper(text) == text) & (F.lower(text) != text)


# --- rows from arrays ----------------------------------------------------------


def each(df: DataFrame, keep: list[str], items: Column | str, position: str, item: str) -> DataFrame:
    """One row per array element with its 0-based position; empty arrays give none.

    The plain explode makes Spark filter on the array's size first, which evaluates
    a computed array a second time. The outer form does not, and its placeholder
    rows are dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, item))
    return rows.filter(F.col(position).isNotNull())
