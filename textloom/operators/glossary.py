"""One glossary for a whole run: which of its terms a text had and the processed text lost.

A glossary of any size meets all documents through an inverted join and not term by text. Every term
waits at its rarest pair of neighbouring words (a term of one word at that word), so that a document
only meets terms of which it holds the pair that says most; the few candidates of a document are then
verified inside its row. Pairs of the documents that no term holds leave before anything is shuffled,
if those of the terms are few enough for Spark to broadcast them (its own size check), and travel as
(key, pair) otherwise; texts travel once, to the candidates of their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.core import join, let
from textloom.functions.text import words
from textloom.session import stored


def glossary_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, words): different terms as their words with single spaces; those without a word are none."""
    split = terms.select(words(F.col(term)).alias("words")).filter(F.size("words") > 0)
    return split.select(join(F.col("words"), " ").alias("term"), "words").distinct()


#: Searching a text for a term takes about this part of the time of making the windows of a one-word term.
_ONE_BY_ONE = 32


def _windows(words: Column, length: Column | int) -> Column:
    """Every ``length`` words in a row, joined by single spaces."""
    n = F.size(words) - length + 1
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: join(F.slice(words, i, length), " "))


def _pairs(words: Column) -> Column:
    starts = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))))


def candidate_terms(docs: DataFrame, glossary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, candidates): the terms of which a text holds the rarest pair; keys without any are left out.

    ``glossary``: as from ``glossary_terms``. A term with a pair that no text holds is nobody's
    candidate. Rows that share a key share their candidates.
    """
    own_parts = F.when(F.size("words") == 1, F.col("words")).otherwise(_pairs(F.col("words")))
    parts = stored(glossary.withColumn("parts", own_parts).select("term", F.size("parts").alias("n"), F.explode("parts").alias("part")))
    known = parts.select("part").distinct()
    # Single words are only asked for where a term is one.
    alone = glossary.filter(F.size("words") == 1).limit(1).count() > 0
    held_parts = let(words(F.col(text)), lambda w: F.concat(F.array_distinct(w), _pairs(w)) if alone else _pairs(w))
    own = docs.select(F.col(key), F.explode_outer(held_parts).alias("part"))
    held = stored(own.join(known, "part", "left_semi"))
    frequency = held.groupBy("part").agg(F.count(F.lit(1)).alias("docs"))
    rarest = parts.join(frequency, "part").groupBy("term", "n").agg(
        F.count(F.lit(1)).alias("found"), F.min(F.struct("docs", "part")).alias("least")
    )
    waiting = rarest.filter(F.col("found") == F.col("n")).select("term", F.col("least.part").alias("part"))
    return held.join(waiting, "part").groupBy(key).agg(F.collect_set("term").alias("candidates"))


def _held(text: Column, terms: Column) -> Column:
    """The terms whose words stand one after another in the text, in no order of their own.

    Few terms of one length are searched for in the text one by one, more are intersected with all
    windows of that length, so time follows the text however many terms there are.
    """
    def of_length(w: Column, spaced: Column, terms: Column, n: Column) -> Column:
        return let(
            F.filter(terms, lambda t: F.size(F.split(t, " ")) == n),
            lambda same: F.when(
                F.size(same) <= n * _ONE_BY_ONE, F.filter(same, lambda t: F.contains(spaced, F.concat(F.lit(" "), t, F.lit(" "))))
            ).otherwise(F.array_intersect(same, _windows(w, n))),
        )

    def found(w: Column, terms: Column) -> Column:
        lengths = F.array_distinct(F.transform(terms, lambda t: F.size(F.split(t, " "))))
        spaced = F.concat(F.lit(" "), join(w, " "), F.lit(" "))
        return let(
            spaced, lambda s: let(lengths, lambda all_n: F.flatten(F.transform(all_n, lambda n: of_length(w, s, terms, n))))
        )

    return let(terms, lambda t: F.when(F.size(t) == 0, t).otherwise(let(words(F.coalesce(text, F.lit(""))), lambda w: found(w, t))))


def global_glossary_losses(
    docs: DataFrame, terms: DataFrame, key: str, source: str, processed: str, term: str = "term"
) -> DataFrame:
    """All rows of ``docs`` with expected_terms and lost_terms, both sorted.

    A term is expected where its words stand one after another in the source, whatever their case
    and what parts them, and lost where they do not in the processed text. A null source expects
    nothing, a null processed text loses everything expected.
    """
    found = candidate_terms(docs, glossary_terms(terms, term), key, source).withColumnRenamed(key, "_key")
    met = docs.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    near = F.coalesce("candidates", F.array().cast("array<string>"))
    checked = met.withColumn("expected_terms", F.array_sort(_held(F.col(source), near))).drop("candidates")
    return checked.withColumn("lost_terms", F.array_except("expected_terms", _held(F.col(processed), F.col("expected_terms"))))
