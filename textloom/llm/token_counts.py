"""Token counts of whole texts by rank-synchronous array merging.

The texts of a batch are split into pre-tokens. Those not seen before are laid out as ragged
numpy arrays: one flat array of symbols and the start of each sequence. In every round each
sequence finds the lowest rank among its adjacent pairs, and all occurrences of that pair are
merged in all sequences at once, until no sequence has a pair of the vocabulary. The symbols
that survive are the tokens. Counts of pre-tokens are remembered within a task.

Nothing is shuffled: a text's count depends on that text and the vocabulary alone.

* null text: like the empty text, 0 tokens;
* very long texts and pre-tokens: processed whole; a sequence takes as many rounds as it has
  different merges;
* repeated rows: each keeps its row; other columns pass through, a column with the name of a
  result is replaced;
* an added special string inside a text counts as one token, as the tokenizers library has it.
"""

from __future__ import annotations

import json
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import pre_tokens, scored

#: The pattern that byte-level vocabularies of this kind split by (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered in a task; beyond that the memory starts anew.
REMEMBERED = 300_000
NO_RANK = np.iinfo(np.int64).max


def byte_names() -> list[str]:
    """The printable character that stands for each byte in the files of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in names)
    names.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [names[b] for b in range(256)]


class Merges:
    """Ranks of adjacent symbol pairs as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = np.int64(max(vocab.values(), default=0) + 1)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.of_byte = np.array([vocab[c] for c in byte_names()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)


def surviving(words: list[bytes], merges: Merges) -> np.ndarray:
    """The number of symbols that are left of each word."""
    count = np.array([len(w) for w in words], np.int64)
    symbols = merges.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), count)
    rank = np.full(len(symbols), NO_RANK)
    fresh = np.flatnonzero(owner[:-1] == owner[1:])  # places whose pair has changed
    while len(symbols) > 1:
        rank[fresh] = merges.rank(symbols[fresh], symbols[fresh + 1])
        starts = np.flatnonzero(np.r_[True, owner[:-1] != owner[1:]])
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        chosen = (rank != NO_RANK) & (rank == np.repeat(best, sizes))
        if not chosen.any():
            break
        # A symbol belongs to one merge: of pairs that overlap, every other one counts.
        first = chosen & ~np.r_[False, chosen[:-1]]
        place = np.arange(len(chosen))
        chosen &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
        merged = np.flatnonzero(chosen)
        symbols[merged] = merges.made[rank[merged]]
        count -= np.bincount(owner[merged], minlength=len(words))
        changed = chosen | np.r_[chosen[1:], False]
        rank[changed] = NO_RANK
        keep = np.repeat(best != NO_RANK, sizes)  # sequences without a pair are done
        keep[merged + 1] = False
        symbols, owner, rank, changed = symbols[keep], owner[keep], rank[keep], changed[keep]
        fresh = np.flatnonzero(changed[:-1] & (owner[:-1] == owner[1:]))
    return count


def token_counter(path: str):
    """A function from a list of UTF-8 texts to their numbers of tokens, for a tokenizers file."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    merges = Merges(config["model"]["vocab"], config["model"]["merges"])
    special = [t["content"] for t in config.get("added_tokens") or []]
    split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    known: dict[str, int] = {}

    def count(texts: list[bytes]) -> list[int]:
        if len(known) > REMEMBERED:
            known.clear()
        rows, added = [], []
        for text in texts:
            whole = text.decode()
            parts = split.split(whole) if split else [whole]
            added.append(len(parts) - 1)
            rows.append([t for part in parts for t in pre_tokens(part, PATTERN)])
        new = list(set().union(*rows) - known.keys())
        for low, high in pairwise([*range(0, len(new), 50_000), len(new)]):
            known.update(zip(new[low:high], surviving([w.encode() for w in new[low:high]], merges).tolist(), strict=True))
        return [extra + sum(map(known.__getitem__, row)) for extra, row in zip(added, rows, strict=True)]

    return count


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens above ``limit``).

    ``tokenizer``: the path of a byte-level BPE file of the tokenizers library, the same on every
    executor.
    """

    def work():
        count = token_counter(tokenizer)

        def run(texts: list[bytes]) -> list[pa.Array]:
            return [pa.array(map(len, texts), pa.int64()), pa.array(count(texts), pa.int64())]

        return run

    return scored(docs, text, "n_bytes long, n_tokens long", work).withColumn("over_limit", F.col("n_tokens") > limit)
