"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Everything is counted from the corpus itself by grouped aggregation.

* Text: byte trigrams, hashed into a table of BUCKETS for each language, counted over all texts under
  the language they declare, and smoothed; a text's likelihood is the mean log ratio of its trigrams,
  weighed as if EVIDENCE trigrams had been seen, since those of one text depend on one another.
* Declared language: a declaration is right with probability TRUST, else any other language.
* Address suffix and host: the languages declared by the documents of a host, smoothed towards those
  of its suffix (the last label of the host), which are smoothed towards those of the whole corpus, as
  with STRENGTH documents more. A document's own declaration is taken out of these counts first, so
  that it does not count twice.

The posterior over the languages is the normalised product. A declaration outside the languages, or
none, says nothing; so does an empty host.

A document is rejected if it has no letters at all (of any script; digits, signs, emoji and lone marks
are none), or if no language reaches the least posterior.

* null and empty texts: the other evidence decides the language; they are rejected for want of letters;
* very long texts: every trigram counts;
* repeated rows: each is judged; empty table: empty result;
* other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, in_few_jobs, scored
from textloom.session import stored

#: Hashed trigrams of a language.
BUCKETS = 1 << 16
EVIDENCE = 200.0
TRUST = 0.9
STRENGTH = 20.0
SMOOTH = 0.5
LEAST = 0.5

#: For UTF-8 in which every character beyond ASCII is a letter or a mark.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@functools.cache
def _category(character: str) -> str:
    return unicodedata.category(character)[0]


def letters(text: bytes) -> bytes:
    """The text with spaces for all signs of any script but letters and marks; empty if it has no letter."""
    if text.isascii():
        return text
    whole = text.decode(errors="replace")
    found = set(whole)
    if not any(_category(c) == "L" for c in found):
        return b""
    signs = [c for c in found if not c.isascii() and _category(c) not in "LM"]
    return whole.translate(dict.fromkeys(map(ord, signs), " ")).encode() if signs else text


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of a text's bytes; other signs than letters count as spaces, runs of them as one."""
    b = np.frombuffer(b" ".join([b"", *letters(text).translate(_LOWER).split(), b""]), np.uint8).astype(np.uint32)
    if len(b) < 3:  # no letter
        return np.empty(0, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def trigram_counts(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts of all texts' trigrams by declared language, one row for each of ``languages``.

    Every task sends its counts as one row for a language and block of the table, which a grouped
    aggregation adds up, so what is collected has the size of the table.
    """
    width = 1024

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[language] += np.bincount(trigrams(text), minlength=BUCKETS)
        rows = total.reshape(-1, width)
        place = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array([rows[i].tobytes() for i in place.tolist()], pa.binary())], names=["place", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for data in group.column("counts"):
            total += np.frombuffer(data.as_buffer(), np.int64)
        return pa.table({"place": group.column("place")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    number = F.array_position(F.array(*map(F.lit, languages)), F.col("declared")).cast("int") - 1
    known = docs.select(number.alias("language"), as_bytes("text").alias("text")).filter("language >= 0")
    out = np.zeros((len(languages) * BUCKETS // width, width), np.int64)
    for row in in_few_jobs(known.mapInArrow(count, "place long, counts binary").groupBy("place").applyInArrow(add, "place long, counts binary")):
        out[row["place"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(len(languages), BUCKETS)


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log probability of each trigram by language, less its mean over the languages."""
    p = np.log(counts + SMOOTH) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return p - p.mean(axis=0)


def host_priors(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(__host, __by_host, __by_suffix, __all): declared languages by host, its suffix and over all."""
    counts = [F.count_if(F.col("declared") == language) for language in languages]
    hosts = docs.groupBy(F.col("host").alias("__host")).agg(F.array(*counts).alias("__by_host"))
    hosts = stored(hosts.withColumn("suffix", F.substring_index("__host", ".", -1)))

    def summed(of: str, size: int):
        return F.array(*(F.sum(F.col(of)[i]) for i in range(size)))

    suffixes = hosts.groupBy("suffix").agg(summed("__by_host", len(languages)).alias("__by_suffix"))
    whole = list(suffixes.agg(summed("__by_suffix", len(languages)).alias("all")).first()["all"])
    return hosts.join(suffixes, "suffix").drop("suffix").withColumn("__all", F.array(*(F.lit(n or 0) for n in whole)))


def host_evidence(languages: list[str], declared: str) -> list[Column]:
    """Log prior of each language from the counts of host, suffix and corpus without the document's own."""
    n = len(languages)
    own = [F.when(F.col(declared) == language, 1).otherwise(0) for language in languages]

    def without(name: str, i: int) -> Column:
        return F.col(name)[i] - own[i]

    def whole(name: str) -> Column:
        return sum((without(name, i) for i in range(n)), F.lit(0))

    out = []
    for i in range(n):
        base = (without("__all", i) + 1.0) / (whole("__all") + float(n))
        suffix = (without("__by_suffix", i) + STRENGTH * base) / (whole("__by_suffix") + STRENGTH)
        out.append(F.log((without("__by_host", i) + STRENGTH * suffix) / (whole("__by_host") + STRENGTH)))
    return out


def identify_languages(docs: DataFrame, languages: list[str], declared: str | Column, host: str | Column, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with language, posterior and rejected.

    ``declared`` and ``host``: columns or expressions; ``languages``: the languages to tell apart, in
    the order in which ties are decided.
    """
    declared, host = (F.col(c) if isinstance(c, str) else c for c in (declared, host))
    short = F.lower(F.substring_index(F.substring_index(F.trim(declared), "-", 1), "_", 1))
    marked = docs.drop("language", "posterior", "rejected")
    kept = marked.columns
    marked = marked.select("*", F.when(short.isin(languages), short).alias("__declared"), F.coalesce(F.lower(host), F.lit("")).alias("__host"))
    seen = marked.select(F.col("__declared").alias("declared"), F.col("__host").alias("host"), F.col(text).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(log_ratios(trigram_counts(seen, languages)))

    def work():
        ratios = np.ascontiguousarray(table.value.T)

        def run(texts: list[bytes]) -> list[pa.Array]:
            rows, sizes = [], []
            for one in texts:
                found = trigrams(one)
                sizes.append(len(found))
                counts = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS else None
                total = counts @ ratios if counts is not None else ratios[found].sum(axis=0)
                rows.append((total * min(1.0, EVIDENCE / max(1, len(found)))).tolist())
            return [pa.array(rows, pa.list_(pa.float64())), pa.array(sizes, pa.int64())]

        return run

    spoken = scored(marked, text, "__text_evidence array<double>, __trigrams long", work)
    # Written first: its size is then known, and few hosts are broadcast. A host can hold a third of
    # all documents, but has one row on this side; of a shuffle join adaptive execution splits the other.
    priors = stored(host_priors(seen.select("declared", "host"), languages))
    known = spoken.join(priors, "__host")
    right, wrong = float(np.log(TRUST)), float(np.log((1 - TRUST) / max(1, len(languages) - 1)))
    said = [F.when(F.col("__declared") == language, right).when(F.col("__declared").isNotNull(), wrong).otherwise(0.0) for language in languages]
    total = F.array(*(F.col("__text_evidence")[i] + s + h for i, (s, h) in enumerate(zip(said, host_evidence(languages, "__declared"), strict=True))))
    judged = known.withColumn("__log", total).withColumn("__most", F.array_max("__log"))
    weight = F.aggregate("__log", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__most")))
    language = F.element_at(F.array(*map(F.lit, languages)), F.array_position("__log", F.col("__most")).cast("int"))
    judged = judged.withColumns({"language": language, "posterior": 1.0 / weight})
    return judged.select(*kept, "language", "posterior", ((F.col("__trigrams") == 0) | (F.col("posterior") < least)).alias("rejected"))
