"""The queries of this package's operators, with the parameters the contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.byte_bpe import digests, encode_documents
from textloom.llm.common import small_batches, table
from textloom.llm.exact_topk import exact_top_k
from textloom.llm.language_id import identify_languages
from textloom.llm.ngram_join import similar_documents
from textloom.llm.posting_lists import nearest_neighbours
from textloom.llm.pseudo_likelihood import score_corpus
from textloom.llm.rule_ledger import POLICIES, RULES, apply_policy, passes, rule_ledger
from textloom.llm.source_mix import mix_sources, word_count
from textloom.llm.term_blocks import rank_documents
from textloom.llm.threshold_negatives import hard_negatives
from textloom.llm.token_counts import count_tokens
from textloom.llm.toxicity import judge_toxicity
from textloom.llm.url_filter import host_of, judge_urls
from textloom.session import prepare, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(prepare(spark))
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


LANGUAGES = ["en", "fr", "de", "es"]


@query
def op1_language_id(spark, sf):
    pages = table(spark, sf, "pages")
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([^"'\s>]*)""", 1)
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    marked = pages.select("page_id", host_of(F.col("url")).alias("host"), declared.alias("declared"), text.alias("text"))
    return identify_languages(marked, LANGUAGES, "declared", "host").drop("text")


@query
def op2_ngram_jaccard_join(spark, sf):
    return similar_documents(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "class", "links")


@query
def op3_source_mix(spark, sf):
    sized = stored(table(spark, sf, "documents").select("doc_id", word_count("text").alias("size"), F.array("source").alias("sources")))
    mixed = mix_sources(sized, "sources", "size")
    return mixed.select("doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("targets", F.lit(0)).alias("target"), "taken")


@query
def op4_token_counts(spark, sf):
    counted = count_tokens(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op5_byte_bpe(spark, sf):
    encoded = encode_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return digests(encoded)


@query
def op6_posting_lists(spark, sf):
    return nearest_neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op7_url_filters(spark, sf):
    return judge_urls(table(spark, sf, "pages"), URL_RULES)


@query
def op8_exact_topk(spark, sf):
    return exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op9_toxicity(spark, sf):
    judged = judge_toxicity(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic"))
    return judged.select("doc_id", "held_out", "score", "predicted")


@query
def op10_pseudo_likelihood(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return score_corpus(docs).select("doc_id", "mean_log_likelihood", "n_tokens", "log_likelihood")


#: The version of the policy that keeps documents.
POLICY = 2


@query
def op11_rule_ledger(spark, sf):
    ledger = rule_ledger(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    judged = apply_policy(ledger, POLICIES[POLICY]).withColumn("base_failed", ~passes(POLICIES[1], F.col("failures")))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, "failures", "n_lines", "n_upper_words", "n_punct", "n_same_words")


@query
def op12_term_blocks(spark, sf):
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


@query
def op13_threshold_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)


_RULED = "host = '{h}' OR host LIKE '%.{h}'"


def _rules_sql(column: int) -> str:
    """CASE over the rules, the longest first; column 0 is the verdict, 1 the rule's text."""
    whens = " ".join(
        f"WHEN ({_RULED.format(h=r[1])}) AND starts_with(path, '{r[2]}') THEN '{(r[0], r[1] + r[2])[column]}'"
        for r in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {whens} END"


def _upto(text: str, stops: str) -> str:
    return f"regexp_extract({text}, '^([^{stops}]*)', 1)"


def _ascii_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _split_sql(url: str) -> tuple[str, str]:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return _ascii_lower(_upto(rest, "/?#")), _upto(f"substr({rest}, length({_upto(rest, '/?#')}) + 1)", "?#")


_HOST, _PATH = _split_sql("url")
_TO_HOST, _TO_PATH = _split_sql("target")

ORACLES["op7_url_filters"] = f"""
WITH RECURSIVE parts AS (SELECT page_id, html, {_HOST} AS host, {_PATH} AS path FROM pages),
tags AS (
    SELECT host, path, unnest(list_concat(
        list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')),
            lambda t: regexp_extract(t, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1))[1:1],
        list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
            lambda t: regexp_extract(t, '(?i)url\\s*=\\s*["'']?([^"''\\s>]+)', 1))[1:1])) AS raw
    FROM parts WHERE host <> ''),
named AS (
    SELECT host, path, CASE WHEN starts_with(raw, '//') THEN 'http:' || raw WHEN contains(raw, '://') THEN raw
        ELSE 'http://' || host || CASE WHEN starts_with(raw, '/') THEN '' ELSE regexp_extract(path, '^(.*/)', 1) END || raw END AS target
    FROM tags WHERE raw <> ''),
links AS (SELECT host, path, {_TO_HOST} AS to_host, {_TO_PATH} AS to_path FROM named),
both_ways AS (SELECT * FROM links UNION SELECT to_host, to_path, host, path FROM links),
ends AS (SELECT DISTINCT host, path FROM both_ways),
reached(host, path) AS (
    SELECT host, path FROM ends WHERE {_rules_sql(0)} = 'block'
    UNION SELECT b.to_host, b.to_path FROM reached r JOIN both_ways b ON b.host = r.host AND b.path = r.path)
SELECT page_id, host, path, {_rules_sql(1)} AS "rule",
    coalesce({_rules_sql(0)}, CASE WHEN (host, path) IN (SELECT (host, path) FROM reached) THEN 'block' END, 'allow') AS verdict
FROM parts"""

_WORD = "[^\\x20\\x09-\\x0D]"
_HARD, _SOFT = POLICIES[POLICY].masks()
_FAILURES = " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(RULES))

ORACLES["op11_rule_ledger"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
    FROM d),
windows AS (
    SELECT r, i, array_to_string(words[i:i + 7], chr(32)) AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) > 8)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
measured AS (
    SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
        length(regexp_replace(text, '[^!?]', '', 'g')) AS n_punct,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_same_words
    FROM split LEFT JOIN covered USING (r)),
judged AS (SELECT *, CAST({_FAILURES} AS BIGINT) AS failures FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    (failures & {_HARD}) = 0 AND bit_count(failures & {_SOFT}) <= {POLICIES[POLICY].tolerated} AS kept,
    failures, n_lines, n_upper_words, n_punct, n_same_words
FROM judged"""

_TERMS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(t=_ascii_lower("text"))

ORACLES["op12_term_blocks"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS many, CAST(sum(len(terms)) AS BIGINT) AS whole FROM d WHERE len(terms) > 0),
q AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1))
    GROUP BY 1, 2),
p AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * many + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s),
scored AS (
    SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * many) // whole))))) AS BIGINT) AS score
    FROM q JOIN p USING (term) JOIN w USING (term), s WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""

ORACLES["op13_threshold_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
        CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank
    FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM positives JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
