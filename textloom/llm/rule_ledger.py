"""Quality rules as a ledger: every rule is evaluated once, failures are bits, policies come afterwards.

``rule_ledger`` measures each text once (whole, in Arrow batches), then evaluates every rule on the
measurements and keeps the failures of a document as bits of one long. A policy is a version: masks
over these bits, so any number of policies is applied to a stored ledger without reading a text again
(``apply_policy``), and ablations come from the few distinct bit patterns: ``ablations`` groups by
pattern (partial counts precede the shuffle, so the number of rows that meet is at most that of the
patterns in each task) and says for each rule what it fails, what only it removes, and what it would
remove alone. ``summary`` folds the bits of a group with bit_or, bit_and and bit_xor.

Rules are SQL conditions over the measurements in whole numbers, read alike by any SQL engine.

* null text: no words, all measurements 0; it fails ``few_words`` and what else holds for zeros;
* words are runs of characters other than space and \\x09-\\x0D; other white space is part of a word;
* a text of fewer than 9 words has no repeated window; equal windows may overlap;
* texts of any length are measured whole; repeated rows and ids are judged row by row, null ids too;
* columns of the input are kept, but for those with the name of an added one, which are replaced;
* empty table: empty result with the same columns.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import scored

SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
#: Bytes that do not begin a character of UTF-8.
CONTINUATION = bytes(range(0x80, 0xC0))
#: Words of a window that counts as repeated, and words that are measured at once.
WINDOW, WORDS = 8, 200_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper_words long, n_punct long, n_same_words long"

#: name and condition of failure; the place in the list is the bit. Only append: stored ledgers keep their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("upper_case", "100 * n_upper_words > 50 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "100 * word_chars < 200 * n_words"),
    ("long_words", "100 * word_chars > 2500 * n_words"),
    ("exclamations", "100 * n_punct > 50 * n_words"),
    ("same_words", "100 * n_same_words > 30 * n_words"),
]


@dataclass(frozen=True)
class Policy:
    """Rules that reject at once, and rules of which more than ``tolerated`` failures reject."""

    version: int
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    tolerated: int = 0

    def masks(self, rules=RULES) -> tuple[int, int]:
        places = {name: 1 << i for i, (name, _) in enumerate(rules)}
        return sum(places[n] for n in set(self.hard)), sum(places[n] for n in set(self.soft))


BASE = Policy(1, ("few_words", "repeated_windows"))
#: Policies by version; a version is never changed once ledgers are judged by it.
POLICIES = {
    1: BASE,
    2: Policy(2, (*BASE.hard, "symbols", "upper_case", "same_words"), ("repeated_lines", "short_words", "long_words", "exclamations"), 1),
}


def repeated_words(ids: np.ndarray, text_of: np.ndarray, texts: int, width: int = WINDOW) -> np.ndarray:
    """For each text the number of its words inside windows that the text holds more than once.

    ``ids``: a number for each word, equal for equal words; ``text_of``: the text of each word,
    ascending. Windows get numbers by doubling: equal halves, equal whole; nothing is hashed.
    """
    count = len(ids) - width + 1
    if count < 2:
        return np.zeros(texts, np.int64)
    names, span = np.unique(ids, return_inverse=True)[1], 1
    while span < width:
        pairs = names[:-span] * np.int64(len(names) + 1) + names[span:]
        names, span = np.unique(pairs, return_inverse=True)[1], span * 2
    whole = text_of[:count] == text_of[width - 1 :]
    at = np.flatnonzero(whole)
    keys = text_of[at] * np.int64(len(names) + 1) + names[at]
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    starts = at[times[inverse] > 1]
    edges = np.bincount(starts, minlength=len(ids) + 1) - np.bincount(starts + width, minlength=len(ids) + 1)
    return np.bincount(text_of[np.cumsum(edges)[: len(ids)] > 0], minlength=texts)


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of MEASURES for each UTF-8 text."""
    out = np.zeros((len(texts), 9), np.int64)
    first, held = 0, []

    def repeats(low: int, high: int) -> None:
        sizes = [len(words) for words in held]
        number: dict[bytes, int] = {}
        ids = np.fromiter(map(number.setdefault, itertools.chain.from_iterable(held), itertools.count()), np.int64, sum(sizes))
        text_of = np.repeat(np.arange(high - low), sizes)
        out[low:high, 5] = repeated_words(ids, text_of, high - low)
        out[low:high, 8] = np.bincount(text_of[1:][(ids[1:] == ids[:-1]) & (text_of[1:] == text_of[:-1])], minlength=high - low)

    size = 0
    for i, text in enumerate(texts):
        words = text.split()
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        upper = sum(map(bytes.isupper, words))
        chars = len(text.translate(None, SPACE + CONTINUATION))
        symbols, punct = len(text) - len(text.translate(None, SYMBOLS)), text.count(b"!") + text.count(b"?")
        out[i] = len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), 0, upper, punct, 0
        held.append(words)
        size += len(words)
        if size >= WORDS:
            repeats(first, i + 1)
            first, held, size = i + 1, [], 0
    if held:
        repeats(first, len(texts))
    return out


def _bits(rules) -> Column:
    parts = [F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, condition) in enumerate(rules)]
    total = parts[0]
    for part in parts[1:]:
        total = total.bitwiseOR(part)
    return total


def rule_ledger(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """All rows with their measurements and ``failures``, one bit for each rule that fails."""
    if not 0 < len(rules) < 64:
        raise ValueError("a ledger holds 1 to 63 rules")

    def work():
        return lambda texts: [pa.array(column) for column in measure(texts).T]

    measured = scored(docs.drop("failures"), text, MEASURES, work)
    return measured.withColumn("failures", _bits(rules))


def passes(policy: Policy, failures: Column, rules=RULES) -> Column:
    hard, soft = (F.lit(mask).cast("long") for mask in policy.masks(rules))
    return (failures.bitwiseAND(hard) == 0) & (F.bit_count(failures.bitwiseAND(soft)) <= policy.tolerated)


def apply_policy(ledger: DataFrame, policy: Policy, kept: str = "kept", rules=RULES) -> DataFrame:
    return ledger.withColumn(kept, passes(policy, F.col("failures"), rules))


def summary(ledger: DataFrame, *by: str) -> DataFrame:
    """For each group: documents, bits that any, all, and an odd number of them have."""
    one = [f("failures").alias(name) for f, name in ((F.bit_or, "any_fails"), (F.bit_and, "all_fail"), (F.bit_xor, "odd_fail"))]
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), *one)


def ablations(ledger: DataFrame, policy: Policy, rules=RULES) -> DataFrame:
    """For each rule of the policy, and as rule null for all of them together, documents and words.

    ``failing``: fail the rule; ``removed_alone``: rejected by a policy of this rule only;
    ``decisive``: rejected, but kept were the rule left out. Words are sums of n_words.
    """
    patterns = ledger.groupBy("failures").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
    rejected = ~passes(policy, F.col("failures"), rules)
    named = []
    for name in dict.fromkeys([*policy.hard, *policy.soft]):
        without = Policy(policy.version, tuple(n for n in policy.hard if n != name), tuple(n for n in policy.soft if n != name), policy.tolerated)
        bit = F.lit(1 << [n for n, _ in rules].index(name)).cast("long")
        fails = F.col("failures").bitwiseAND(bit) != 0
        alone = fails if name in policy.hard else fails & F.lit(policy.tolerated < 1)
        named.append(F.struct(F.lit(name).alias("rule"), fails.alias("fails"), alone.alias("alone"), (rejected & passes(without, F.col("failures"), rules)).alias("decisive")))
    whole = F.struct(F.lit(None).cast("string").alias("rule"), (F.col("failures") != 0).alias("fails"), rejected.alias("alone"), rejected.alias("decisive"))
    each = patterns.select("docs", "words", F.explode(F.array(*named, whole)).alias("r"))
    cut = lambda what, of: F.coalesce(F.sum(F.when(F.col(f"r.{of}"), F.col(what))), F.lit(0))
    return each.groupBy("r.rule").agg(
        cut("docs", "fails").alias("failing"), cut("docs", "alone").alias("removed_alone"),
        cut("docs", "decisive").alias("decisive"), cut("words", "decisive").alias("decisive_words"),
    )
