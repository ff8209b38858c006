"""Text statistics: per document inside the row, per corpus by two-phase counts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import fixed_values as V
from textloom.functions.core import each, fold, is_blank, let, py_round, ws_count, ws_words
from textloom.functions.text import sentences_metrics, sentences_naive, words
from textloom.session import stored


def _sum(items: Column) -> Column:
    return fold(items, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _mean_and_deviation(lengths: Column) -> Column:
    """Struct(mean, std) with the population deviation; zeros for an empty list."""
    def deviation(mean: Column) -> Column:
        squares = fold(lengths, F.lit(0.0), lambda a, n: a + (n - mean) * (n - mean))
        return F.struct(mean.alias("mean"), F.sqrt(squares / F.size(lengths)).alias("std"))

    zero = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("std"))
    return F.when(F.size(lengths) > 0, let(_sum(lengths) / F.size(lengths), deviation)).otherwise(zero)


def document_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add sentence, word and vocabulary statistics of every text.

    Row-local: the words are found once per sentence and everything else is
    derived from those arrays.
    """
    df = df.withColumn("_words", F.transform(sentences_metrics(F.coalesce(F.col(text), F.lit(""))), words))
    df = df.withColumns(
        {"sentence_lengths": F.transform("_words", lambda w: F.size(w)), "_words": F.flatten("_words")}
    )
    df = df.withColumns(
        {
            "sentence_count": F.size("sentence_lengths"),
            "word_count": F.size("_words"),
            "distinct_words": F.size(F.array_distinct("_words")),
            "_spread": _mean_and_deviation(F.col("sentence_lengths")),
        }
    )
    some = F.col("word_count") > 0
    mean = F.when(some, F.col("_spread.mean")).otherwise(F.lit(0.0))
    std = F.when(some & (F.col("sentence_count") > 1), F.col("_spread.std")).otherwise(F.lit(0.0))
    ttr = F.when(some, F.col("distinct_words") / F.col("word_count")).otherwise(F.lit(0.0))
    df = df.withColumns(
        {
            "sentence_length_mean": py_round(mean, 2),
            "sentence_length_std": py_round(std, 2),
            "type_token_ratio": py_round(ttr, 4),
            "burstiness": burstiness(mean, std),
        }
    )
    return df.drop("_words", "_spread")


def burstiness(mean: Column, std: Column) -> Column:
    """(std - mean) / (std + mean), null where both are zero."""
    return F.when(std + mean != 0, (std - mean) / (std + mean))


#: Bytes of text whose counts of words meet in one task.
PART_BYTES = 16 << 20


def document_word_frequency(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, n): how often each word occurs in each document.

    Words are counted inside the row; rows that share a key meet by (key, word), in parts whose number
    follows the size of the texts, so no task holds more the larger the table is. For keys with many
    texts each see ``group_word_frequency``.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    counts = df.select(key, F.explode(counted_words(F.col(text))).alias("_c")).select(key, "_c.word", "_c.n")
    return counts.repartition(parts, key, "word").groupBy(key, "word").agg(F.sum("n").alias("n"))


def group_word_frequency(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, n) for keys that many texts share: words are counted in every task before they are shuffled."""
    return (
        each(df, [key], words(F.col(text)), "_pos", "word")
        .groupBy(key, "word")
        .agg(F.count("*").alias("n"))
    )


def counted_words(text: Column) -> Column:
    """Array of (word, n), the words of one text in order; counted by sorting, in time that follows the text."""
    def counted(ordered: Column) -> Column:
        firsts = F.filter(
            F.transform(ordered, lambda w, i: F.struct(w.alias("word"), i.alias("at"), F.get(ordered, i - 1).eqNullSafe(w).alias("again"))),
            lambda e: ~e["again"],
        )
        return let(firsts, lambda f: F.transform(f, lambda e, i: F.struct(e["word"].alias("word"), (F.coalesce(F.get(f, i + 1)["at"], F.size(ordered)) - e["at"]).cast("bigint").alias("n"))))

    return let(F.sort_array(words(text)), counted)


def word_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over the corpus."""
    return each(df, [], words(F.col(text)), "_pos", "word").groupBy("word").agg(F.count("*").alias("n"))


def type_token_ratio(frequencies: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct and total words from a frequency table; no distinct is needed."""
    return (
        frequencies.groupBy(*keys)
        .agg(F.count("*").alias("distinct_words"), F.sum("n").alias("total_words"))
        .withColumn("type_token_ratio", F.col("distinct_words") / F.col("total_words"))
    )


def corpus_perplexity(df: DataFrame, key: str, text: str = "text", frequent_share: int = 1000) -> DataFrame:
    """exp(-mean log p(word)) of every key's words under the corpus unigram model.

    The key may be the document or any grouping column. Words that make up more
    than 1/frequent_share of all words number fewer than frequent_share, so their
    probabilities are safe to broadcast; that takes the hot join keys out of the
    shuffle join, which handles the remaining words. A key whose texts hold no word has
    no mean, and no row.
    """
    # Texts are cut into words once. Their counts stay in the row of the text, as written arrays, since the
    # sums over a key need no counts of the key as a whole; only words that are not frequent are shuffled.
    own = stored(df.select(key, counted_words(F.col(text)).alias("_counts")))
    counts = own.select(key, F.explode("_counts").alias("_c")).select(key, "_c.word", "_c.n")
    corpus = stored(counts.groupBy("word").agg(F.sum("n").alias("n")))
    total = corpus.agg(F.sum("n").alias("t")).scalar()
    model = corpus.select(
        "word", F.log(F.col("n") / total).alias("_log_p"), (F.col("n") * frequent_share > total).alias("_frequent")
    )
    frequent = model.filter("_frequent").select("word", F.col("_log_p").alias("_log_frequent"))
    rare = model.filter(~F.col("_frequent")).select("word", "_log_p")
    marked = counts.join(F.broadcast(frequent), "word", "left")
    known = marked.filter(F.col("_log_frequent").isNotNull()).select(key, "n", F.col("_log_frequent").alias("_log_p"))
    looked_up = marked.filter(F.col("_log_frequent").isNull()).join(rare, "word").select(key, "n", "_log_p")

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy(key).agg(F.sum("n").alias("word_count"), F.sum(F.col("n") * F.col("_log_p")).alias("_log_sum"))

    # Each part is summed by itself: rows of one text lie together, so it leaves its task as one row.
    sums = summed(known).unionByName(summed(looked_up)).groupBy(key).agg(F.sum("word_count").alias("word_count"), F.sum("_log_sum").alias("_log_sum"))
    return sums.select(key, "word_count", F.exp(-F.col("_log_sum") / F.col("word_count")).alias("perplexity"))


_BUZZWORD = (
    rf"(?:\A|{V.WS})[{V.BUZZWORD_STRIP}]*(?:{'|'.join(V.BUZZWORDS)})[{V.BUZZWORD_STRIP}]*(?!{V.NOT_WS})"
)


def buzzword_count(text: Column) -> Column:
    """Number of words that are on the list once lower-cased and stripped of punctuation."""
    def counted(lower: Column) -> Column:
        # plain substring tests spare most texts the pattern
        some = reduce(or_, [F.contains(lower, F.lit(w)) for w in V.BUZZWORDS])
        return F.when(some, F.regexp_count(lower, F.lit(_BUZZWORD))).otherwise(F.lit(0))

    return let(F.lower(text), counted)


def buzzword_hits(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, n) of listed words only; the list is nine literals, so the
    semi join is a filter evaluated before the shuffle."""
    listed = F.filter(
        F.transform(ws_words(F.col(text)), lambda w: F.btrim(F.lower(w), F.lit(V.BUZZWORD_STRIP))),
        lambda w: w.isin(*V.BUZZWORDS),
    )
    return each(df, [key], listed, "_pos", "word").groupBy(key, "word").agg(F.count("*").alias("n"))


def uniformity_score(text: Column) -> Column:
    """5..95: even sentence lengths and listed words raise the score; blank gives 0."""
    def score(lengths: Column) -> Column:
        even = F.greatest(F.lit(0.0), F.lit(50.0) - _mean_and_deviation(lengths)["std"] * 5)
        listed = F.least(F.lit(50), buzzword_count(text) * 15)
        return F.least(F.lit(95.0), F.greatest(F.lit(5.0), py_round(F.lit(15.0) + even + listed, 2)))

    lengths = F.transform(sentences_naive(text), lambda s: ws_count(s).cast("bigint"))
    return F.when(is_blank(text), F.lit(0.0)).otherwise(
        let(lengths, lambda n: F.when(F.size(n) == 0, F.lit(50.0)).otherwise(score(n)))
    )


def corpus_statistics(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Document metrics rolled up by a grouping column, with the group's own vocabulary.

    One pass and one shuffle: every document contributes its words and one extra
    element without a word that carries its sums. Partial counts are made before
    the shuffle, so a group holding most documents adds one row per word and task.
    Sums of squares are exact integers and do not depend on arrival order.
    """
    def entry(word, docs, sentences, total, squares) -> Column:
        return F.struct(
            word.cast("string").alias("word"),
            *[c.cast("bigint").alias(n) for c, n in
              ((docs, "docs"), (sentences, "sentences"), (total, "total"), (squares, "squares"))],
        )

    zero = F.lit(0)
    by_sentence = df.select(
        group, F.transform(sentences_metrics(F.coalesce(F.col(text), F.lit(""))), words).alias("_by_sentence")
    ).withColumn("_lengths", F.transform("_by_sentence", lambda w: F.size(w).cast("bigint")))
    own = entry(
        F.lit(None), F.lit(1), F.size("_lengths"), _sum(F.col("_lengths")),
        _sum(F.transform("_lengths", lambda n: n * n)),
    )
    entries = F.concat(
        F.array(own), F.transform(F.flatten("_by_sentence"), lambda w: entry(w, zero, zero, zero, zero))
    )
    sums = [F.sum(c).alias(c) for c in ("docs", "sentences", "total", "squares")]
    counted = (
        each(by_sentence, [group], entries, "_pos", "_e").select(group, "_e.*")
        .groupBy(group, "word").agg(F.count("word").alias("n"), *sums)
    )
    rolled = counted.groupBy(group).agg(F.sum("n").alias("words"), F.count("word").alias("distinct_words"), *sums)
    n, s, ss = F.col("sentences"), F.col("total"), F.col("squares")
    mean, std = F.col("mean_sentence_length"), F.col("std_sentence_length")
    return (
        rolled.withColumns(
            {
                "mean_sentence_length": F.when(n > 0, s / n).otherwise(F.lit(0.0)),
                "std_sentence_length": F.when(n > 0, F.sqrt((ss * n - s * s) / (n * n))).otherwise(F.lit(0.0)),
                "type_token_ratio": F.when(F.col("words") > 0, F.col("distinct_words") / F.col("words"))
                .otherwise(F.lit(0.0)),
            }
        )
        .select(
            group, F.col("docs").alias("documents"), "sentences", "words", "distinct_words",
            mean, std, "type_token_ratio", burstiness(mean, std).alias("burstiness"),
        )
    )
