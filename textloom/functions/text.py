"""Sentence, word, paragraph and naming rules as Column expressions.

There are three sentence splitters on purpose: the chunker, the metrics and the
uniformity score each count sentences differently.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import collapse_ws, fold, join, let, non_blank, strip, ws_count, ws_words

# --- words -------------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-case alphanumeric words with inner hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(V.WORD), F.lit(0))


# --- sentences ---------------------------------------------------------------

_ENDS_WITH_ABBREVIATION = (
    rf"(?i)(?:^|{V.WS})(?:{'|'.join(re.escape(a) for a in V.CHUNK_ABBREVIATIONS)})[.?,!]*{V.WS}*\z"
)


#: Of a piece whose last characters are no long run of marks or spaces, so many decide what it ends with.
_TAIL, _LONGEST = 32, 1 + max(map(len, V.CHUNK_ABBREVIATIONS))


def _ends_with_abbreviation(piece: Column) -> Column:
    """Only the end of a long piece is searched."""
    def decided(tail: Column) -> Column:
        enough = F.length(F.rtrim(tail, F.lit(V.WS_CHARS + ".?,!"))) > _LONGEST
        return F.when(enough, tail.rlike(_ENDS_WITH_ABBREVIATION)).otherwise(piece.rlike(_ENDS_WITH_ABBREVIATION))

    return let(F.substring(piece, -_TAIL, _TAIL), decided)


def sentences_chunk(text: Column) -> Column:
    """Split after .!? and white space, but not after a known abbreviation.

    No piece contains a dot followed by a line feed (that would have been a gap),
    so this pair separates finished sentences while glued ones get a space.
    """
    pieces = F.filter(F.split(text, V.SENTENCE_GAP), lambda p: p != "")
    ended = F.transform(
        pieces, lambda p: F.concat(p, F.when(_ends_with_abbreviation(p), F.lit(" ")).otherwise(F.lit(".\n")))
    )
    return non_blank(F.split(join(ended), r"\.\n"))


def sentences_metrics(text: Column) -> Column:
    """Split after .!? and white space with the dots of abbreviations hidden."""
    dot = V.METRIC_DOT_MASK
    edge = rf"(?<!{V.WORD_CHAR})"  # every abbreviation starts with a letter
    titles = [a[:-1] for a in V.METRIC_ABBREVIATIONS if a.count(".") == 1]
    dotted = [re.escape(a) for a in V.METRIC_ABBREVIATIONS if a.count(".") == 2]
    initials = "".join(sorted({t[0] for t in titles}))
    hidden = F.regexp_replace(text, rf"(?=[{initials}]){edge}({'|'.join(titles)})\.", f"$1{dot}")
    hidden = F.regexp_replace(hidden, rf"(?=[a-zA-Z]\.[a-zA-Z]\.){edge}(?={'|'.join(dotted)})(.)\.(.)\.", f"$1{dot}$2{dot}")
    flat = collapse_ws(strip(hidden))
    pieces = F.filter(F.split(flat, r"(?<=[.!?]) "), lambda s: strip(s) != "")
    return F.transform(pieces, lambda s: F.replace(s, F.lit(dot), F.lit(".")))


def sentences_naive(text: Column) -> Column:
    """Split at every .!? regardless of what follows."""
    return non_blank(F.split(text, "[.!?]"))


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs with their position before blanks are dropped."""
    numbered = F.transform(
        F.split(text, V.PARAGRAPH_GAP),
        lambda p, i: F.struct(i.cast("int").alias("index"), strip(p).alias("text")),
    )
    return F.filter(numbered, lambda p: p["text"] != "")


def split_long(sentence: Column, limit: int) -> Column:
    """Pack clauses up to ``limit`` words, then cut what is still longer."""
    clauses = F.split(sentence, V.CLAUSE_GAP)

    def packed(parts: Column) -> Column:
        counts = F.transform(parts, ws_count)
        starts = group_starts(counts, lambda total, n: total + n > limit)
        # spans looks into the starts for every group; unbound, the whole fold would run each time.
        return F.transform(
            let(starts, lambda found: spans(found, F.size(parts))), lambda s: join(F.slice(parts, s["start"], s["length"]), " ")
        )

    def cut(part: Column) -> Column:
        return let(
            ws_words(part),
            lambda w: F.when(F.size(w) <= limit, F.array(part)).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.size(w), F.lit(limit)), lambda i: join(F.slice(w, i, F.lit(limit)), " ")
                )
            ),
        )

    return F.flatten(F.transform(let(clauses, packed), cut))


def group_starts(counts: Column, overflows) -> Column:
    """1-based start positions of greedily packed groups of word counts."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts")
    )

    def step(state: Column, n: Column) -> Column:
        opens = (state["at"] == 0) | overflows(state["total"], n)
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(opens, n).otherwise(state["total"] + n).alias("total"),
            F.when(opens, F.array_append(state["starts"], state["at"] + 1)).otherwise(state["starts"]).alias("starts"),
        )

    return fold(counts, start, step, lambda s: s["starts"])


def spans(starts: Column, size: Column) -> Column:
    """Turn start positions into (start, length) pairs covering 1..size."""
    return F.transform(
        starts,
        lambda s, i: F.struct(
            s.alias("start"), (F.coalesce(F.get(starts, i + 1), size + 1) - s).alias("length")
        ),
    )


# --- names and previews --------------------------------------------------------


def auto_name(text: Column) -> Column:
    """Name made of the first words of the text."""
    head = ws_words(F.regexp_extract(text, rf"\A{V.WS}*((?:{V.NOT_WS}+{V.WS}+){{0,6}}{V.NOT_WS}+)", 1))  # the rest of the text is not touched
    cleaned = F.filter(F.transform(head, lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", "")), lambda w: w != "")
    name = F.substring(join(F.slice(cleaned, 1, 6), "_"), 1, V.MAX_NAME_CHARS)
    return let(name, lambda n: F.when(n == "", F.lit(V.DEFAULT_NAME)).otherwise(n))


def sanitize_name(name: Column) -> Column:
    kept = strip(F.regexp_replace(name, rf"[^a-zA-Z0-9_\-{V.WS_CLASS}]", ""))
    return F.substring(collapse_ws(kept, "_"), 1, V.MAX_NAME_CHARS)


def document_name(name: Column, text: Column) -> Column:
    """The supplied name if there is one, else one taken from the text."""
    return F.when(F.coalesce(strip(name), F.lit("")) == "", auto_name(text)).otherwise(sanitize_name(strip(name)))


def safe_stem(filename: Column, suffix: str = "") -> Column:
    """File stem without extension, spaces as underscores."""
    base = F.regexp_extract(filename, r"([^/]*)/*\z", 1)
    stem = F.regexp_replace(base, r"(?s)\A(.+)\.[^.]+\z", "$1")
    return F.concat(F.substring(F.replace(stem, F.lit(" "), F.lit("_")), 1, V.MAX_STEM_CHARS), F.lit(suffix))


def length_band(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= V.WARN_TEXT_CHARS, "ok").when(n <= V.MAX_TEXT_CHARS, "warn").otherwise("limit")


def context_head(text: Column) -> Column:
    return F.substring(text, 1, V.CONTEXT_CHARS)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


# --- responses -----------------------------------------------------------------


def strip_fence(text: Column) -> Column:
    """Remove one code fence that wraps the whole answer."""
    bare = strip(F.coalesce(text, F.lit("")))
    return strip(F.regexp_replace(bare, V.FENCE, "$1"))


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), V.THINK, ""))


def quarter_length(text: Column) -> Column:
    """Rough token count: a quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("int")


def estimate_tokens(
    prompt: Column, answer: Column, prompt_tokens: Column, answer_tokens: Column, per_field: bool = False
) -> Column:
    """Reported token counts, or a quarter of the length where they are missing.

    ``per_field`` falls back for each count alone; otherwise one missing count
    discards both.
    """
    usable_p = prompt_tokens.isNotNull()
    usable_a = answer_tokens.isNotNull()
    if not per_field:
        usable_p = usable_a = usable_p & usable_a
    p = F.when(usable_p, prompt_tokens).otherwise(quarter_length(prompt))
    a = F.when(usable_a, answer_tokens).otherwise(quarter_length(answer))
    return F.struct(p.alias("prompt_tokens"), a.alias("completion_tokens"), (p + a).alias("total_tokens"))


# --- structured summaries --------------------------------------------------------


def parse_summary(text: Column) -> Column:
    """Sections, glossary and validity of a three-part summary."""
    # A section begins after the first of its headings and ends at the next one after that; texts
    # that lack a heading are not cut at all.
    def after(heading: str) -> Column:
        return F.get(F.split(text, heading, 2), F.lit(1))

    def until(part: Column, heading: str) -> Column:
        return F.get(F.split(part, heading, 2), F.lit(0))

    headings = (V.SUMMARY_THESIS, V.SUMMARY_METHODOLOGY, V.SUMMARY_GLOSSARY)
    found = reduce(and_, [text.rlike(h) for h in headings])
    thesis = strip(until(after(V.SUMMARY_THESIS), V.SUMMARY_METHODOLOGY))
    method = strip(until(after(V.SUMMARY_METHODOLOGY), V.SUMMARY_GLOSSARY))
    lines = F.transform(
        non_blank(F.split(strip(after(V.SUMMARY_GLOSSARY)), "\n")),
        lambda line: strip(F.ltrim(line, F.lit(V.BULLET_CHARS))),
    )
    terms = F.filter(
        F.transform(
            F.flatten(F.transform(lines, lambda line: non_blank(F.split(line, ",")))),
            lambda t: F.rtrim(t, F.lit(".")),
        ),
        lambda t: t != "",
    )
    count = ws_count(text)
    empty = F.array().cast("array<string>")

    def record(parts: Column) -> Column:
        valid = (
            (parts["thesis"] != "") & (parts["methodology"] != "") & (F.size(parts["glossary"]) == V.SUMMARY_TERMS)
            & parts["word_count"].between(V.SUMMARY_MIN_WORDS, V.SUMMARY_MAX_WORDS)
        )
        return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), parts["thesis"], parts["methodology"], parts["glossary"], parts["word_count"])

    parts = F.struct(thesis.alias("thesis"), method.alias("methodology"), terms.alias("glossary"), count.alias("word_count"))
    none = F.struct(
        F.lit(False).alias("valid"), F.lit(None).cast("string").alias("thesis"), F.lit(None).cast("string").alias("methodology"),
        empty.alias("glossary"), F.lit(None).cast("int").alias("word_count"),
    )
    return F.when(found, let(parts, record)).otherwise(none)


def resolve_summary(attempts: list[Column], default: Column) -> Column:
    """The first attempt that parses as valid, else the default text."""
    return F.coalesce(*[F.when(parse_summary(a)["valid"], a) for a in attempts], default)
