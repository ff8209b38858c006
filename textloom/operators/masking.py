"""Reversible masking of citations and mathematics.

A masking stage never leaves the row: the matches and the texts between them are
two arrays of the same document, the distinct matches give the token numbers and
the pieces are joined again. Each stage is its own projection so that Spark
evaluates it once; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import count_below, each, fold, join, let

_EMPTY = "array<string>"


def _token(template: str, position: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), (position - 1).cast("string"), F.lit(tail))


def _replace_matches(text: Column, pattern: str, matches: Column, token) -> Column:
    """Put ``token(match)`` where each match was; texts without a match pay nothing more."""
    pieces = F.transform(
        F.split(text, pattern, -1),
        lambda piece, i: F.concat(piece, F.coalesce(let(F.get(matches, i), token), F.lit(""))),
    )
    return F.when(F.size(matches) == 0, text).otherwise(join(pieces))


def _token_map(known: Column, template: str) -> Column:
    return F.map_from_arrays(F.transform(known, lambda _, i: _token(template, i + 1)), known)


def _citation_stage(pattern: str):
    def stage(state: Column) -> Column:
        def numbered(hits: Column) -> Column:
            known = F.concat(state["known"], F.array_except(hits, state["known"]))
            return let(
                known,
                lambda k: F.struct(
                    _replace_matches(
                        state["text"], pattern, hits, lambda h: _token(V.CITATION_TOKEN, F.array_position(k, h))
                    ).alias("text"),
                    k.alias("known"),
                ),
            )

        return let(F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0)), numbered)

    return stage


def mask_citations(
    df: DataFrame, text: str = "text", out: str = "masked", token_map: str = "citation_map"
) -> DataFrame:
    """Replace citations by numbered tokens; equal citations share a token."""
    state = F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), F.array().cast(_EMPTY).alias("known"))
    for pattern in V.CITATION_PATTERNS:
        state = let(state, _citation_stage(pattern))
    df = df.withColumn("_masked", state)
    return df.withColumns(
        {out: F.col("_masked.text"), token_map: _token_map(F.col("_masked.known"), V.CITATION_TOKEN)}
    ).drop("_masked")


def _math_stage(kind: str, pattern: str, sign: str):
    def stage(state: Column) -> Column:
        def numbered(hits: Column) -> Column:
            fresh = F.array_except(F.array_except(hits, state["blocks"]), state["inlines"])
            grown = {k: F.concat(state[k], fresh) if k == kind else state[k] for k in ("blocks", "inlines")}

            def replaced(known: Column) -> Column:
                def token(hit: Column) -> Column:
                    block = F.array_position(known["blocks"], hit)
                    return F.when(block > 0, _token(V.MATH_BLOCK_TOKEN, block)).otherwise(
                        _token(V.MATH_INLINE_TOKEN, F.array_position(known["inlines"], hit))
                    )

                return F.struct(
                    _replace_matches(state["text"], pattern, hits, token).alias("text"),
                    known["blocks"].alias("blocks"), known["inlines"].alias("inlines"),
                )

            return let(F.struct(*[v.alias(k) for k, v in grown.items()]), replaced)

        # A text without the sign passes as it is; a plain search for it is cheaper than the pattern.
        some = F.contains(state["text"], F.lit(sign))
        return F.when(some, let(F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0)), numbered)).otherwise(state)

    return stage


def mask_math(df: DataFrame, text: str = "text", out: str = "masked", token_map: str = "math_map") -> DataFrame:
    """Replace formulas by tokens: block notations first, then inline ones.

    The two kinds are numbered separately but share one dictionary, so an inline
    formula equal to a block formula takes the block token.
    """
    none = F.array().cast(_EMPTY)
    state = F.struct(
        F.coalesce(F.col(text), F.lit("")).alias("text"), none.alias("blocks"), none.alias("inlines")
    )
    kinds = (("blocks", V.MATH_BLOCK_PATTERNS, V.MATH_BLOCK_SIGNS), ("inlines", V.MATH_INLINE_PATTERNS, V.MATH_INLINE_SIGNS))
    for kind, patterns, signs in kinds:
        for pattern, sign in zip(patterns, signs, strict=True):
            state = let(state, _math_stage(kind, pattern, sign))
    df = df.withColumn("_masked", state)
    maps = F.map_concat(
        _token_map(F.col("_masked.blocks"), V.MATH_BLOCK_TOKEN),
        _token_map(F.col("_masked.inlines"), V.MATH_INLINE_TOKEN),
    )
    return df.withColumns({out: F.col("_masked.text"), token_map: maps}).drop("_masked")


def mask_all(df: DataFrame, text: str = "text", out: str = "masked") -> DataFrame:
    """Citations first, then mathematics on the result; one numbering per document."""
    df = mask_citations(df, text, "_cited", "citation_map")
    return mask_math(df, "_cited", out, "math_map").drop("_cited")


# --- token maps ------------------------------------------------------------------


def merge_maps(first: Column, second: Column) -> Column:
    """Union of two token maps; the second wins where both hold a token."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def token_rows(df: DataFrame, token_map: str, keys: list[str]) -> DataFrame:
    """The token map as a long table (keys, token, original)."""
    rows = each(df, keys, F.map_entries(token_map), "_pos", "_entry")
    return rows.select(*keys, F.col("_entry.key").alias("token"), F.col("_entry.value").alias("original"))


def mask_counts(citation_map: Column, math_map: Column) -> Column:
    """How many masks of each kind a document holds."""
    def starting(template: str) -> Column:
        prefix = template.split("{}")[0]
        return F.size(F.filter(F.map_keys(math_map), lambda k: F.startswith(k, F.lit(prefix))))

    return F.struct(
        F.size(citation_map).alias("citations"),
        starting(V.MATH_BLOCK_TOKEN).alias("math_blocks"),
        starting(V.MATH_INLINE_TOKEN).alias("math_inlines"),
        (F.size(citation_map) + F.size(math_map)).alias("total"),
    )


# --- restoring ---------------------------------------------------------------------


def _unmask_strict(text: Column, token_map: Column, pattern: str) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def restored(found: Column, token_map: Column) -> Column:
        missing = F.filter(found, lambda t: ~F.map_contains_key(token_map, t))
        replaced = _replace_matches(text, pattern, found, lambda t: F.coalesce(F.try_element_at(token_map, t), t))
        failed = (F.size(token_map) > 0) & (F.size(missing) > 0)
        return F.struct(
            F.when(F.size(token_map) == 0, text).when(~failed, replaced).alias("text"),
            F.when(failed, F.concat(F.lit("unknown tokens: "), join(missing, ", "))).alias("error"),
        )

    return let(tokens, lambda found: let(token_map, lambda known: restored(found, known)))


def unmask_citations(text: Column, token_map: Column) -> Column:
    """Struct(text, error): every citation token must be known unless the map is empty."""
    return _unmask_strict(text, token_map, V.CITATION_TOKEN_PATTERN)


def unmask_math(text: Column, token_map: Column) -> Column:
    """Struct(text, error): one pass, like the citations."""
    return _unmask_strict(text, token_map, V.MATH_TOKEN_PATTERN)


_ANY_TOKEN = r"__(?:CITATION|MATH_BLOCK|MATH_INLINE)_\d+__"
#: A token whose end would also begin another one.
_SHARED_END = r"__(?:CITATION|MATH_BLOCK|MATH_INLINE)_\d+__(?:CITATION|MATH_BLOCK|MATH_INLINE)_\d+__"
_KEY = r"^__(?:CITATION|MATH_BLOCK|MATH_INLINE)_(?:0|[1-9]\d{0,14})__$"
#: Maps up to this size are folded over; larger ones are looked up token by token. The results are the same.
_FEW_TOKENS = 8


def _by_length(token_map: Column) -> Column:
    """Entries (key, value), longest token first, then in the order of the map."""
    return F.array_sort(
        F.transform(
            F.map_entries(token_map),
            lambda e, i: F.struct((-F.length(e["key"])).alias("order"), i.alias("i"), e["key"], e["value"]),
        )
    )


def _code(token: Column) -> Column:
    """One number for each token of the three kinds."""
    kind = F.when(F.contains(token, F.lit("BLOCK")), 1).when(F.contains(token, F.lit("INLINE")), 2).otherwise(0)
    return F.regexp_extract(token, r"\d+", 0).try_cast("bigint") * 3 + kind


def _indexed(entries: Column) -> Column:
    """Entries in the order of their codes, with their rank in the order of replacing."""
    numbered = F.transform(
        entries, lambda e, rank: F.struct(_code(e["key"]).alias("code"), rank.alias("rank"), e["key"], e["value"])
    )
    return F.array_sort(numbered)


def _one_pass(text: Column, index: Column, codes: Column, after: Column) -> Column:
    """Replace every known token whose rank is greater than ``after``; time grows with text and tokens."""
    def known(token: Column) -> Column:
        def entry(code: Column) -> Column:
            return let(
                F.get(index, count_below(codes, code)),
                lambda e: F.when((e["key"] == token) & (e["rank"] > after), e["value"]).otherwise(token),
            )

        return F.coalesce(let(_code(token), entry), token)

    return let(F.regexp_extract_all(text, F.lit(_ANY_TOKEN), F.lit(0)), lambda found: _replace_matches(text, _ANY_TOKEN, found, known))


def _looked_up(text: Column, entries: Column) -> Column:
    """The restored text, or null where replacing one token after the other could give another.

    Values may hold tokens themselves: those that come later in the order are replaced in the values
    first. What is left must not be able to form a token with its surroundings: no double underscore
    outside tokens, none in the values, and no underscore at their ends.
    """
    def expanded(index: Column) -> Column:
        def values(codes: Column) -> Column:
            inner = F.transform(
                index,
                lambda e: F.struct(
                    e["code"], e["rank"], e["key"],
                    F.when(F.contains(e["value"], F.lit("__")), _one_pass(e["value"], index, codes, e["rank"]))
                    .otherwise(e["value"]).alias("value"),
                ),
            )

            def restored(ready: Column) -> Column:
                plain = F.forall(
                    ready,
                    lambda e: (e["value"] != "") & ~F.contains(e["value"], F.lit("__"))
                    & ~F.startswith(e["value"], F.lit("_")) & ~F.endswith(e["value"], F.lit("_")),
                )
                apart = F.forall(F.split(text, _ANY_TOKEN, -1), lambda piece: ~F.contains(piece, F.lit("__")))
                return F.when(plain & apart, _one_pass(text, ready, codes, F.lit(-1)))

            return let(inner, restored)

        return let(F.transform(index, lambda e: e["code"]), values)

    regular = F.forall(entries, lambda e: F.coalesce(e["key"].rlike(_KEY), F.lit(False))) & ~text.rlike(_SHARED_END)
    return F.when(regular, let(_indexed(entries), expanded))


def restore_soft(text: Column, token_map: Column) -> Column:
    """Replace every token that occurs, longest token first, and leave the rest.

    Large maps are not gone through token by token: the text is cut at its tokens once, and each
    looks up its value. Maps or texts of which this could differ from replacing one token after the
    other (own token formats, values that run into tokens, nesting of more than one level) are.
    """
    def restored(entries: Column, value: Column) -> Column:
        in_turn = fold(entries, value, lambda t, e: F.replace(t, e["key"], e["value"]))
        return F.when(F.size(entries) <= _FEW_TOKENS, in_turn).otherwise(F.coalesce(_looked_up(value, entries), in_turn))

    return let(_by_length(token_map), lambda entries: let(F.coalesce(text, F.lit("")), lambda value: restored(entries, value)))


def restore_tokens(text: Column, token_map: Column) -> Column:
    """Struct(text, error): soft restore, then an error if a citation or block token is left."""
    def checked(restored: Column) -> Column:
        left = F.regexp_extract_all(restored, F.lit(V.RESIDUAL_PATTERN), F.lit(0))
        return let(
            left,
            lambda rest: F.struct(
                F.when(F.size(rest) == 0, restored).alias("text"),
                F.when(F.size(rest) > 0, F.concat(F.lit("left over: "), join(rest, ", "))).alias("error"),
            ),
        )

    return let(restore_soft(text, token_map), checked)


def restore_nested(text: Column, citation_map: Column, math_map: Column) -> Column:
    """Exact inverse of ``mask_all``.

    Mathematics is undone before citations because formulas may hold citation
    tokens, and twice because an environment may hold a display-block token.
    """
    def once(value: Column, known: Column) -> Column:
        return let(
            F.regexp_extract_all(value, F.lit(V.MATH_TOKEN_PATTERN), F.lit(0)),
            lambda found: _replace_matches(
                value, V.MATH_TOKEN_PATTERN, found, lambda t: F.coalesce(F.try_element_at(known, t), t)
            ),
        )

    twice = let(math_map, lambda known: let(let(text, lambda t: once(t, known)), lambda first: once(first, known)))
    return let(twice, lambda value: unmask_citations(value, citation_map))


def masks_preserved(source: Column, candidate: Column) -> Column:
    """Every placeholder of the source occurs in the candidate."""
    placeholders = F.regexp_extract_all(source, F.lit(V.PLACEHOLDER_PATTERN), F.lit(0))
    return let(candidate, lambda text: F.forall(placeholders, lambda p: F.contains(text, p)))


def audit_roundtrip(df: DataFrame, text: str = "text") -> DataFrame:
    """Mask and restore every document and say whether the text came back."""
    masked = mask_all(df, text, "masked")
    restored = masked.withColumn(
        "restored", restore_tokens(F.col("masked"), merge_maps(F.col("citation_map"), F.col("math_map")))
    )
    return restored.withColumns(
        {
            "counts": mask_counts(F.col("citation_map"), F.col("math_map")),
            "intact": F.col("restored.text").eqNullSafe(F.coalesce(F.col(text), F.lit(""))),
        }
    )
