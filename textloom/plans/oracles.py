"""DuckDB twins of the catalog queries, written independently of the Spark code.

DuckDB's regular expressions know no look-around and an ASCII-only word boundary,
so boundaries are restated: foreign letters become ``_`` before words are found,
and sentence gaps are marked instead of looked behind.
"""

from __future__ import annotations

import re

from textloom import fixed_values as V

ORACLES: dict[str, str] = {}

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WC = r"[a-zA-Z0-9_\p{L}\p{N}]"


def q(text: str) -> str:
    return text.replace("'", "''")


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def flat(x: str, by: str = " ") -> str:
    return f"regexp_replace({x}, '{WS}+', '{by}', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w_: w_ <> '')"


def words(x: str) -> str:
    ascii_only = (
        rf"regexp_replace(regexp_replace(lower({x}), '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
    )
    return rf"regexp_extract_all({ascii_only}, '\b[a-z0-9''-]+\b')"


def sentences_b(x: str) -> str:
    z = V.METRIC_DOT_MASK
    for _ in range(2):  # a title may directly follow another one
        x = rf"regexp_replace({x}, '(^|[^{WC[1:-1]}])(Dr|dr|Mr|mr|Mrs|mrs|Ms|ms|Prof|prof|Col|col|Gen|gen|Vs|vs)\.', '\1\2{z}', 'g')"
    for pattern, out in (
        (r"([eE])\.g\.", rf"\2{z}g{z}"), (r"([iI])\.e\.", rf"\2{z}e{z}"),
        (r"([ap])\.m\.", rf"\2{z}m{z}"), (r"([AP])\.M\.", rf"\2{z}M{z}"),
    ):
        x = rf"regexp_replace({x}, '(^|[^{WC[1:-1]}]){pattern}', '\1{out}', 'g')"
    marked = rf"regexp_replace({flat(trim(x))}, '([.!?]) ', '\1' || chr(1), 'g')"
    return f"list_transform(list_filter(string_split({marked}, chr(1)), lambda s_: trim(s_) <> ''), lambda s_: replace(s_, '{z}', '.'))"


def sentences_a(x: str) -> str:
    pieces = rf"list_filter(string_split(regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda p_: p_ <> '')"
    abbr = "|".join(a.replace(".", r"\.") for a in V.CHUNK_ABBREVIATIONS)
    glued = (
        f"list_transform({pieces}, lambda p_: p_ || CASE WHEN regexp_matches(p_, '(?i)(^|{WS})({abbr})[.?,!]*{WS}*$') "
        f"THEN ' ' ELSE chr(2) END)"
    )
    return (
        f"list_filter(list_transform(string_split(array_to_string({glued}, ''), chr(2)), lambda s_: {trim('s_')}), "
        f"lambda s_: s_ <> '')"
    )


def sentences_c(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[.!?]'), lambda s_: {trim('s_')}), lambda s_: s_ <> '')"


def rnd(v: str, digits: int) -> str:
    """Round the binary value half to even; ``v`` must be a column name."""
    s = f"{10**digits}::DOUBLE"
    p = f"({v} * {s})"
    err = f"((({v}*134217729::DOUBLE - ({v}*134217729::DOUBLE - {v})) * {s} - {p}) + ({v} - ({v}*134217729::DOUBLE - ({v}*134217729::DOUBLE - {v}))) * {s})"
    half = f"({p} - floor({p}) - 0.5::DOUBLE)"
    return (
        f"((floor({p}) + CASE WHEN {half} > 0 OR ({half} = 0 AND {err} > 0) OR ({half} = 0 AND {err} = 0 AND floor({p}) % 2 <> 0) "
        f"THEN 1 ELSE 0 END) / {s})"
    )


def fill(template: str, *values: object) -> str:
    """Put values for {0}, {1}; patterns in the template keep their braces."""
    for i, value in enumerate(values):
        template = template.replace("{%d}" % i, str(value))
    return template


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- intake ----------------------------------------------------------------------

_seven = f"list_transform(({tokens('t')})[1:7], lambda x_: regexp_replace(x_, '[^a-zA-Z0-9]', '', 'g'))"
oracle("document_intake", f"""
WITH d AS (SELECT doc_id, {trim('text')} AS t FROM documents),
n AS (SELECT *, array_to_string((list_filter({_seven}, lambda w_: w_ <> ''))[1:6], '_')[1:60] AS raw FROM d)
SELECT doc_id, CASE WHEN raw = '' THEN 'pasted_text' ELSE raw END AS name,
  CASE WHEN length(t) <= 50000 THEN 'ok' WHEN length(t) <= 60000 THEN 'warn' ELSE 'limit' END AS band,
  length(t) AS n_chars,
  CASE WHEN t = '' THEN 'empty' WHEN length(t) > 60000 THEN 'too long' ELSE 'admitted' END AS verdict,
  least(length(t), 12000) AS context_chars
FROM n""")

oracle("supplied_names", f"""
SELECT page_id, ({flat(trim("regexp_replace(url, '[^a-zA-Z0-9_ -]', '', 'g')"), '_')})[1:60] AS name,
  replace(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1'), ' ', '_')[1:80] || '_result' AS stem
FROM pages""")

oracle("file_admission", """
WITH p AS (SELECT page_id, CASE WHEN contains(url, 'page=') THEN url || '.PDF' ELSE url END AS path,
  length(html) * 1000 AS length, CASE WHEN contains(url, 'www') THEN '%PDF' ELSE html[1:4] END AS head FROM pages)
SELECT page_id, CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'extension' WHEN length > 10485760 THEN 'size'
  WHEN head <> '%PDF' THEN 'signature' ELSE 'admitted' END AS verdict FROM p""")

oracle("answer_cleanup", f"""
WITH c AS (SELECT *, {trim('text')} AS clean FROM conversations)
SELECT conv_id, turn, clean,
  CASE WHEN role = 'user' THEN turn + 7 ELSE length(text) // 4 + length(clean) // 4 END AS tokens,
  CASE WHEN role = 'user' THEN turn ELSE length(text) // 4 END + 7 AS tokens_per_field
FROM c""")

oracle("summary_records", f"""
WITH w AS (SELECT doc_id, text, {words('text')} AS w FROM documents),
g AS (SELECT *, array_to_string(w[1:len(w) // 2], ' ') AS thesis, array_to_string(w[len(w) // 2 + 1:], ' ') AS method,
  list_filter(list_concat(w[1:5], w[6:10]), lambda x_: x_ <> '') AS terms FROM w),
s AS (SELECT *, 'Thesis:' || chr(10) || thesis || chr(10) || chr(10) || 'METHODOLOGY: ' || method || chr(10) || 'GLOSSARY:' || chr(10)
  || '1. ' || array_to_string(w[1:5], ',') || chr(10) || '- ' || array_to_string(w[6:10], '.,') || '.' AS summary FROM g),
c AS (SELECT *, len({tokens('summary')}) AS n,
  list_filter(list_transform(list_concat(
    w[1:5],
    w[6:10]), lambda t_: rtrim(t_, '.')), lambda t_: t_ <> '') AS found FROM s)
SELECT doc_id, (thesis <> '' AND method <> '' AND len(found) = 10 AND n BETWEEN 150 AND 250) AS valid,
  length(thesis) AS thesis_chars, length(method) AS methodology_chars, len(found) AS terms, n AS word_count,
  sha256(CASE WHEN thesis <> '' AND method <> '' AND len(found) = 10 AND n BETWEEN 150 AND 250 THEN summary ELSE 'default' END) AS chosen
FROM c""")

# --- statistics -------------------------------------------------------------------

_LENGTHS = f"""
l AS (SELECT doc_id, lang, source, list_transform({sentences_b('text')}, lambda s_: len({words('s_')})) AS ls, {words('text')} AS w FROM documents),
m AS (SELECT *, len(ls) AS n, len(w) AS words, len(list_distinct(w)) AS distinct_words,
  coalesce(list_sum(ls), 0) AS s, list_sum(list_transform(ls, lambda n_: n_ * n_)) AS ss FROM l)"""
oracle("document_metrics", f"""
WITH {_LENGTHS},
v AS (SELECT *, CASE WHEN words > 0 THEN s / n ELSE 0::DOUBLE END AS mean FROM m),
d AS (SELECT *, CASE WHEN words > 0 AND n > 1 THEN sqrt(list_sum(list_transform(ls, lambda n_: (n_ - mean) * (n_ - mean))) / n) ELSE 0::DOUBLE END AS std,
  CASE WHEN words > 0 THEN distinct_words / words ELSE 0::DOUBLE END AS ttr FROM v)
SELECT doc_id, n AS sentence_count, words AS word_count, distinct_words, array_to_string(ls, ',') AS sentence_lengths,
  {rnd('mean', 2)} AS sentence_length_mean, {rnd('std', 2)} AS sentence_length_std, {rnd('ttr', 4)} AS type_token_ratio,
  round(CASE WHEN std + mean <> 0 THEN (std - mean) / (std + mean) END, 6) AS burstiness
FROM d""")

_VOCAB = f"v AS (SELECT {{0}}, unnest({words('text')}) AS word FROM documents)"
oracle("text_metrics_by_source", f"""
WITH {_LENGTHS}, {fill(_VOCAB, 'source')},
u AS (SELECT source, count(DISTINCT word) AS distinct_words FROM v GROUP BY source),
r AS (SELECT source, count(*) AS documents, sum(n)::BIGINT AS sentences, sum(words)::BIGINT AS words, sum(s)::DOUBLE AS s, sum(ss)::DOUBLE AS ss FROM m GROUP BY source),
x AS (SELECT r.*, u.distinct_words, s / sentences AS mean, sqrt((ss * sentences - s * s) / (sentences * sentences)) AS std FROM r JOIN u USING (source))
SELECT source, documents, sentences, words, distinct_words, round(mean, 6) AS mean_sentence_length, round(std, 6) AS std_sentence_length,
  round(distinct_words / words, 6) AS type_token_ratio, round((std - mean) / (std + mean), 6) AS burstiness FROM x""")

oracle("document_word_frequency", f"WITH {fill(_VOCAB, 'doc_id')} SELECT doc_id, word, count(*) AS n FROM v GROUP BY ALL")
oracle("word_frequency", f"WITH {fill(_VOCAB, '1 AS one')} SELECT word, count(*) AS n FROM v GROUP BY ALL")
oracle("vocabulary_by_language", f"""
WITH {fill(_VOCAB, 'lang')}
SELECT lang, count(DISTINCT word) AS distinct_words, count(*) AS total_words, round(count(DISTINCT word) / count(*), 6) AS type_token_ratio
FROM v GROUP BY lang""")
for _name, _key in (("document_perplexity", "doc_id"), ("source_perplexity", "source")):
    oracle(_name, f"""
WITH {fill(_VOCAB, _key)}, c AS (SELECT word, count(*) / sum(count(*)) OVER () AS p FROM v GROUP BY word)
SELECT {_key}, count(*) AS word_count, round(exp(-avg(ln(p))), 4) AS perplexity FROM v JOIN c USING (word) GROUP BY {_key}""")

_BUZZ = "[" + ", ".join(f"'{w}'" for w in V.BUZZWORDS) + "]"
_TITLED = "[" + ", ".join(f"'{w.capitalize()}'" for w in V.BUZZWORDS) + "]"
_BUZZED = f"b AS (SELECT doc_id, text || chr(10) || array_to_string(({_TITLED})[1:(length(text) % 10)], ', ') || '!' AS text FROM documents)"
_STRIPPED = f"list_transform({tokens('text')}, lambda w_: trim(lower(w_), ',.?!'))"
oracle("uniformity_score", f"""
WITH {_BUZZED},
l AS (SELECT doc_id, text, list_transform({sentences_c('text')}, lambda s_: len({tokens('s_')})) AS ls,
  len(list_filter({_STRIPPED}, lambda w_: list_contains({_BUZZ}, w_))) AS buzz FROM b),
m AS (SELECT *, len(ls) AS n, list_sum(ls) / len(ls) AS mean FROM l),
s AS (SELECT *, sqrt(list_sum(list_transform(ls, lambda n_: (n_ - mean) * (n_ - mean))) / n) AS std FROM m),
r AS (SELECT *, 15::DOUBLE + greatest(0::DOUBLE, 50::DOUBLE - std * 5) + least(50, buzz * 15) AS raw FROM s)
SELECT doc_id, CASE WHEN {trim('text')} = '' THEN 0::DOUBLE WHEN n = 0 THEN 50::DOUBLE
  ELSE least(95::DOUBLE, greatest(5::DOUBLE, {rnd('raw', 2)})) END AS score FROM r""")
oracle("buzzword_hits", f"""
WITH {_BUZZED}, w AS (SELECT doc_id, unnest({_STRIPPED}) AS word FROM b)
SELECT doc_id, word, count(*) AS n FROM w WHERE list_contains({_BUZZ}, word) GROUP BY ALL""")

oracle("sentence_splits", f"""
WITH s AS (SELECT doc_id, {sentences_a('text')} AS a, {sentences_b('text')} AS b, {sentences_c('text')} AS c FROM documents)
SELECT doc_id, len(a) AS n_a, len(b) AS n_b, len(c) AS n_c, sha256(array_to_string(a, '|')) AS sha_a,
  sha256(array_to_string(b, '|')) AS sha_b, sha256(array_to_string(c, '|')) AS sha_c FROM s""")

oracle("paragraph_table", f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS paragraph FROM documents)
SELECT doc_id, paragraph, len({tokens('t')}) AS words, sha256({trim('t')}) AS fingerprint FROM p WHERE {trim('t')} <> ''""")

# clauses packed to 40 words, then cut; positions are numbered over the whole text
_CLAUSES = rf"string_split(regexp_replace({trim('text')}, '([,;:—]){WS}+', '\1' || chr(1), 'g'), chr(1))"
oracle("clause_pieces", f"""
WITH c AS (SELECT doc_id, {_CLAUSES} AS parts FROM documents),
n AS (SELECT *, list_transform(parts, lambda p_: len({tokens('p_')})) AS counts FROM c),
f AS (SELECT *, list_reduce(counts, lambda s_, k_: CASE WHEN s_.g = 0 OR s_.t + k_ > 40
    THEN {{'g': s_.g + 1, 't': k_::BIGINT, 'ids': list_append(s_.ids, s_.g + 1)}}
    ELSE {{'g': s_.g, 't': s_.t + k_, 'ids': list_append(s_.ids, s_.g)}} END, {{'g': 0::BIGINT, 't': 0::BIGINT, 'ids': []::BIGINT[]}}).ids AS ids FROM n),
u AS (SELECT doc_id, unnest(parts) AS part, unnest(ids) AS g, unnest(range(len(parts))) AS i FROM f),
j AS (SELECT doc_id, g, {tokens("string_agg(part, ' ' ORDER BY i)")} AS w FROM u GROUP BY doc_id, g),
k AS (SELECT doc_id, g, w, unnest(range(0, greatest(len(w), 1), 40)) AS o FROM j)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, o) - 1 AS piece, len(w[o + 1:o + 40]) AS words,
  sha256(array_to_string(w[o + 1:o + 40], ' ')) AS sha FROM k""")

oracle("text_fingerprints", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")

# --- masking --------------------------------------------------------------------------

_CITED = """
c AS (SELECT doc_id, text || chr(10) || 'See [' || doc_id || '] and (Smith & Jones, ' || (1950 + doc_id % 70) || 'a), again [' || doc_id
  || '], [Lee et al. ' || (1950 + doc_id % 70) || '], x²⁵ [iv] [1, 2, ' || doc_id || '].' AS text FROM {0})"""
_PATTERNS = [re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", p.replace("(?U)", "")) for p in V.CITATION_PATTERNS]
_FOUND = "list_concat(" * 4 + f"regexp_extract_all(text, '{q(_PATTERNS[0])}')" + "".join(
    f", regexp_extract_all(text, '{q(p)}'))" for p in _PATTERNS[1:]
)
_KNOWN = f"""
a AS (SELECT *, {_FOUND} AS hits FROM c),
k AS (SELECT *, list_filter(hits, lambda h_, i_: list_position(hits, h_) = i_) AS known FROM a)"""
_MASKED = """list_reduce(known, lambda t_, h_: replace(t_, h_, '__CITATION_' || (list_position(known, h_) - 1) || '__'), text)"""
oracle("mask_citations", f"WITH {fill(_CITED, 'documents')}, {_KNOWN} SELECT doc_id, {_MASKED} AS masked, len(known) AS citations FROM k")
oracle("mask_tokens", f"""
WITH {fill(_CITED, 'documents')}, {_KNOWN}
SELECT doc_id, '__CITATION_' || unnest(range(len(known))) || '__' AS token, unnest(known) AS original FROM k""")
oracle("strict_restore", f"WITH {fill(_CITED, 'documents')} SELECT doc_id, sha256(text) AS restored, doc_id % 2 = 1 AS fails, doc_id % 2 = 1 AS left_over FROM c")

_FORMULAS = r"""
f AS (SELECT doc_id, text || chr(10) || 'Let $x_{' || doc_id || '}$ and $x_{' || doc_id || '}$ with \(y\).' || chr(10) || '\[z_{' || doc_id
  || '}\]' || chr(10) || '\begin{align}a &= ' || doc_id || '\end{align}' AS text FROM documents)"""
# Block notations first. Two or more dollars left over afterwards delimit no inline formula.
_NEXT = "list_concat({1}, list_filter({0}, lambda h_, i_: list_position({0}, h_) = i_ AND NOT list_contains({1}, h_)))"
_BETWEEN = (
    "array_to_string(list_transform({0}, lambda p_, i_: p_ || CASE WHEN i_ <= len({1}) "
    "THEN '{3}' || (list_position({2}, {1}[i_]) - 1) || '__' ELSE '' END), '')"
)


def _math_stages(source: str) -> str:
    """Pattern by pattern: the texts between matches joined with the tokens of the matches.

    Before the dollar formulas, runs of two or more dollars are hidden because they
    delimit none.
    """
    stages = [
        ("b", "BLOCK", r"(?s)\$\$[^$].*?\$\$"), ("b", "BLOCK", r"(?s)\\begin\{align\}.+?\\end\{align\}"),
        ("b", "BLOCK", r"(?s)\\\[.+?\\\]"), ("i", "INLINE", r"(?s)\\\(.+?\\\)"), ("i", "INLINE", r"\$[^$\n\x02]{1,500}\$"),
    ]
    out = [f"m0 AS (SELECT doc_id, text AS t, []::VARCHAR[] AS b, []::VARCHAR[] AS i FROM {source})"]
    for n, (kind, name, pattern) in enumerate(stages, 1):
        text = "t"
        if pattern.startswith(r"\$["):
            text = r"regexp_replace(replace(t, '$$', chr(2) || chr(2)), '\x02\$', chr(2) || chr(2), 'g')"
        other = "b" if kind == "i" else "i"
        out.append(
            f"h{n} AS (SELECT doc_id, b, i, string_split_regex({text}, '{pattern}') AS s, regexp_extract_all({text}, '{pattern}') AS h FROM m{n - 1})"
        )
        out.append(f"k{n} AS (SELECT doc_id, s, h, {other}, {fill(_NEXT, 'h', kind)} AS {kind} FROM h{n})")
        out.append(f"m{n} AS (SELECT doc_id, b, i, {fill(_BETWEEN, 's', 'h', kind, '__MATH_' + name + '_')} AS t FROM k{n})")
    out.append("masked AS (SELECT doc_id, b AS blocks, i AS inlines, replace(t, chr(2), '$') AS text FROM m5)")
    return ",\n".join(out)


oracle("mask_math", f"""
WITH {_FORMULAS}, {_math_stages('f')}
SELECT doc_id, text AS masked, len(blocks) AS blocks, len(inlines) AS inlines FROM masked""")
oracle("mask_roundtrip", f"""
WITH {_FORMULAS}, {fill(_CITED, 'f')}
SELECT doc_id, true AS intact, true AS exact, sha256(text) AS restored, doc_id % 2 = 0 AS preserved FROM c""")
oracle("mask_totals", f"""
WITH {_FORMULAS}, {fill(_CITED, 'f')}, {_KNOWN}, ct AS (SELECT doc_id, {_MASKED} AS text FROM k), {_math_stages('ct')}
SELECT doc_id, len(known) AS citations, len(blocks) AS math_blocks, len(inlines) AS math_inlines, len(known) + len(blocks) + len(inlines) AS total
FROM masked JOIN k USING (doc_id)""")
_PLAIN = r"FROM (SELECT doc_id, translate(text, '$\\', '') AS text FROM documents)"
oracle("strict_math_restore", f"""
WITH {_FORMULAS.replace('FROM documents', _PLAIN)} SELECT doc_id, sha256(text) AS restored, CASE WHEN doc_id % 2 = 1 THEN 'unknown tokens: __MATH_INLINE_0__' ELSE '' END AS error FROM f""")

# --- chunks -------------------------------------------------------------------------------

_PARAS = f"""
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para FROM {{0}}),
p1 AS (SELECT doc_id, para, {trim('raw')} AS t FROM p WHERE {trim('raw')} <> ''),
p2 AS (SELECT *, len({tokens('t')}) AS n FROM p1)"""
# Units: rule 0 whole paragraph, 1 packed piece, 2 piece that closes the open chunk.
_UNITS = rf"""
s AS (SELECT doc_id, para, unnest({sentences_a('t')}) AS s, generate_subscripts({sentences_a('t')}, 1) AS si FROM p2 WHERE n > {{1}}),
s1 AS (SELECT *, len({tokens('s')}) AS sn FROM s),
c0 AS (SELECT doc_id, para, si, string_split(regexp_replace(s, '([,;:—]){WS}+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM s1 WHERE sn > {{0}}),
c1 AS (SELECT *, list_reduce(list_transform(parts, lambda p_: len({tokens('p_')})), lambda s_, k_: CASE WHEN s_.g = 0 OR s_.t + k_ > {{0}}
    THEN {{'g': s_.g + 1, 't': k_::BIGINT, 'ids': list_append(s_.ids, s_.g + 1)}}
    ELSE {{'g': s_.g, 't': s_.t + k_, 'ids': list_append(s_.ids, s_.g)}} END, {{'g': 0::BIGINT, 't': 0::BIGINT, 'ids': []::BIGINT[]}}).ids AS ids FROM c0),
c2 AS (SELECT doc_id, para, si, unnest(parts) AS part, unnest(ids) AS g, unnest(range(len(parts))) AS i FROM c1),
c3 AS (SELECT doc_id, para, si, g, {tokens("string_agg(part, ' ' ORDER BY i)")} AS w FROM c2 GROUP BY ALL),
c4 AS (SELECT doc_id, para, si, g, unnest(range(0, len(w), {{0}})) AS o, w FROM c3),
u AS (SELECT doc_id, para, 0 AS si, 0 AS g, 0 AS o, 0 AS rule, n, {tokens('t')} AS w FROM p2 WHERE n <= {{1}}
  UNION ALL SELECT doc_id, para, si, 0, 0, CASE WHEN si = 1 THEN 2 ELSE 1 END, sn, {tokens('s')} FROM s1 WHERE sn <= {{0}}
  UNION ALL SELECT doc_id, para, si, g, o, CASE WHEN g = 1 AND o = 0 THEN 2 ELSE 1 END, len(w[o + 1:o + {{0}}]), w[o + 1:o + {{0}}] FROM c4),
o AS (SELECT doc_id, list({{'para': para, 'rule': rule, 'n': n, 'w': w}} ORDER BY para, si, g, o) AS units FROM u GROUP BY doc_id),
f AS (SELECT doc_id, units, list_reduce(list_transform(units, lambda x_: {{'rule': x_.rule, 'n': x_.n}}),
  lambda s_, x_: CASE WHEN s_.c > 0 AND (x_.rule = 2 OR s_.c + x_.n > {{1}} OR (x_.rule = 0 AND s_.c + x_.n > {{0}} AND s_.c >= greatest(1, {{0}} // 2)))
    THEN {{'c': x_.n::BIGINT, 'id': s_.id + 1, 'ids': list_append(s_.ids, s_.id + 1)}}
    ELSE {{'c': s_.c + x_.n, 'id': s_.id, 'ids': list_append(s_.ids, s_.id)}} END,
  {{'c': 0::BIGINT, 'id': 0::BIGINT, 'ids': []::BIGINT[]}}).ids AS ids FROM o),
x AS (SELECT doc_id, unnest(units) AS u, unnest(ids) AS chunk_id, unnest(range(len(units))) AS i FROM f),
chunks AS (SELECT doc_id, chunk_id, sum(u.n)::BIGINT AS word_count, list_distinct(list(u.para ORDER BY i)) AS paras,
  string_agg(array_to_string(u.w, ' '), ' ' ORDER BY i) AS text FROM x GROUP BY doc_id, chunk_id)"""
oracle("chunk_documents", f"""
WITH {fill(_PARAS, 'documents')}, {fill(_UNITS, 250, 400)}
SELECT doc_id, chunk_id, word_count, array_to_string(list_sort(paras), ',') AS paragraphs, sha256(text) AS sha FROM chunks""")

_ONE_PARA = f"p2 AS (SELECT doc_id, 0 AS para, {trim('text')} AS t, len({tokens('text')}) AS n FROM masked WHERE {trim('text')} <> '')"
oracle("intake_stream", f"""
WITH {_math_stages('documents')}, {_ONE_PARA}, {fill(_UNITS, 250, 400)}
SELECT doc_id, count(*) AS chunks, sum(word_count)::BIGINT AS words FROM chunks GROUP BY doc_id""")
oracle("prepared_chunks", f"""
WITH d AS (SELECT doc_id, {trim('text')} AS text FROM documents),
dp AS (SELECT doc_id, replace(text, chr(10), chr(10) || ' ' || chr(10)) AS text FROM d),
{fill(_CITED, 'dp')}, {_KNOWN}, ct AS (SELECT doc_id, {_MASKED} AS text FROM k), {_math_stages('ct')},
p AS (SELECT doc_id, unnest(string_split(text, chr(10) || ' ' || chr(10))) AS raw,
  generate_subscripts(string_split(text, chr(10) || ' ' || chr(10)), 1) - 1 AS para FROM masked),
p2 AS (SELECT doc_id, para, {trim('raw')} AS t, len({tokens('raw')}) AS n FROM p WHERE {trim('raw')} <> ''), {fill(_UNITS, 250, 400)}
SELECT doc_id AS run_id, count(*) AS chunks, sum(len(regexp_extract_all(text, '__CITATION_[0-9]+__')))::BIGINT AS tokens,
  sum(word_count)::BIGINT AS words, 0::BIGINT AS processed FROM chunks GROUP BY doc_id""")
oracle("finished_documents", f"""
WITH {fill(_CITED, 'documents')} SELECT doc_id, '' AS error, sha256({flat('text', '')}) AS sha FROM c""")
_LAST = "length(regexp_extract(win, '(?s)^(.*){0}', 1))"
oracle("slice_text", rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, 0 AS piece, {trim('text')} AS rest, NULL::VARCHAR AS t FROM documents
  UNION ALL
  SELECT doc_id, piece + 1, CASE WHEN length(rest) <= 1000 THEN '' ELSE {trim('rest[cut + 1:]')} END,
    CASE WHEN length(rest) <= 1000 THEN rest ELSE {trim('rest[1:cut]')} END
  FROM (SELECT *, 850 + CASE WHEN regexp_matches(win, '[.!?]{WS}') THEN {fill(_LAST, '[.!?]' + WS)} + 1
      WHEN regexp_matches(win, '[,;:]{WS}') THEN {fill(_LAST, '[,;:]' + WS)} + 1
      WHEN regexp_matches(win, '{WS}') THEN {fill(_LAST, WS)} ELSE 150 END AS cut
    FROM (SELECT *, rest[851:1000] AS win FROM r WHERE rest <> '')))
SELECT doc_id, piece - 1 AS piece, length(t) AS n_chars, sha256(t) AS sha FROM r WHERE piece > 0""")
oracle("chunk_rows", """
SELECT sha256(conv_id || '|' || turn) AS chunk_id, conv_id AS run_id, turn AS sequence_no, text AS clean_text, 0::BIGINT AS iterations FROM conversations""")
oracle("chunk_reassembly", """
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_pieces FROM conversations GROUP BY conv_id""")
oracle("glossary_losses", f"""
WITH w AS (SELECT doc_id, text, {words('text')} AS w, regexp_replace(text, '^[^\\n]*\\n?', '') AS processed FROM documents),
u AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, list(t ORDER BY i) AS g FROM (SELECT doc_id, t, min(i) AS i FROM u GROUP BY ALL) GROUP BY ALL),
e AS (SELECT doc_id, processed, list_filter(coalesce(g, []), lambda t_: contains(text, t_)) AS e FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(e) AS expected, array_to_string(list_filter(e, lambda t_: NOT contains(processed, t_)), ',') AS lost FROM e""")
oracle("global_glossary_losses", f"""
WITH b AS (SELECT {words('text')} AS w FROM benchmark),
t AS (SELECT array_to_string(w[i:i + 1], ' ') AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b WHERE len(w) > 2)
  UNION SELECT array_to_string(w[i:i + 2], ' ') FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM b WHERE len(w) > 2)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w, {words("regexp_replace(text, '^[^\n]*\n?', '')")} AS p FROM documents),
s AS (SELECT r, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES (2), (3)) v(n))),
k AS (SELECT r, array_to_string(p[i:i + n - 1], ' ') AS term FROM (SELECT r, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM d, (VALUES (2), (3)) v(n))),
e AS (SELECT DISTINCT r, term FROM s WHERE term IN (SELECT term FROM t)),
h AS (SELECT DISTINCT r, term, true AS kept FROM k)
SELECT doc_id, count(term) AS expected, coalesce(string_agg(term, ',' ORDER BY term) FILTER (kept IS NULL), '') AS lost
FROM d LEFT JOIN e USING (r) LEFT JOIN h USING (r, term) GROUP BY r, doc_id""")
oracle("text_comparison", """
WITH d AS (SELECT doc_id, text, rtrim(regexp_replace(text, '  +', ' ', 'g'), ' ') AS p FROM documents)
SELECT doc_id, length(text) AS raw_length, length(p) AS processed_length, text = p AS unchanged, text[1:80] AS raw_snippet, p[1:80] AS processed_snippet FROM d""")
oracle("markdown_lines", f"""
WITH d AS (SELECT doc_id, '# Title' || chr(10) || '| a | b |' || chr(10) || '- item' || chr(10) || '1. first' || chr(10) || chr(10)
  || replace(text, chr(10), chr(10) || '```' || chr(10)) AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM d),
f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l),
k AS (SELECT *, CASE WHEN starts_with(line, '```') THEN 'fence' WHEN n % 2 = 1 THEN 'code' WHEN {trim('line')} = '' THEN 'blank'
  WHEN regexp_matches(line, '^[ \\t]{{0,3}}#{{1,6}}{WS}') THEN 'heading' WHEN regexp_matches(line, '^[ \\t]*\\|') THEN 'table'
  WHEN regexp_matches(line, '^[ \\t]*([-*+]|\\d+[.)]){WS}') THEN 'list' ELSE 'prose' END AS label FROM f)
SELECT doc_id, label, count(*) AS lines, sum(line_no)::BIGINT AS positions FROM k GROUP BY ALL""")

# --- scores -----------------------------------------------------------------------------------

oracle("resolved_scores", f"""
WITH l AS (SELECT d.doc_id, d.text, toxic, quality, list_transform({sentences_c('d.text')}, lambda s_: len({tokens('s_')})) AS ls,
  len(list_filter({_STRIPPED.replace('(text', '(d.text')}, lambda w_: list_contains({_BUZZ}, w_))) AS buzz FROM documents d LEFT JOIN labels USING (doc_id)),
m AS (SELECT *, len(ls) AS n, list_sum(ls) / len(ls) AS mean FROM l),
s AS (SELECT *, sqrt(list_sum(list_transform(ls, lambda n_: (n_ - mean) * (n_ - mean))) / n) AS std FROM m),
r AS (SELECT *, 15::DOUBLE + greatest(0::DOUBLE, 50::DOUBLE - std * 5) + least(50, buzz * 15) AS raw FROM s)
SELECT doc_id, CASE WHEN toxic = 1 AND {trim('text')} = '' THEN 0::DOUBLE WHEN toxic = 1 THEN 90::DOUBLE WHEN quality IS NOT NULL THEN quality * 10::DOUBLE
  WHEN {trim('text')} = '' THEN 0::DOUBLE WHEN n = 0 THEN 50::DOUBLE ELSE least(95::DOUBLE, greatest(5::DOUBLE, {rnd('raw', 2)})) END AS score,
  (toxic IS DISTINCT FROM 1 AND quality IS NULL) AS from_fallback FROM r""")
oracle("prediction_scores", f"""
WITH e AS (SELECT event_id, event_type, least(1::DOUBLE, value / 100) AS s FROM events),
v AS (SELECT event_id, event_type, s * 100::DOUBLE AS a, (1::DOUBLE - s) * 100::DOUBLE AS b FROM e)
SELECT event_id, CASE WHEN event_type = 'signup' THEN 0::DOUBLE WHEN event_type IN ('error', 'view') THEN {rnd('a', 2)} ELSE {rnd('b', 2)} END AS first_score,
  CASE WHEN event_type = 'signup' THEN 0::DOUBLE WHEN event_type IN ('error', 'view') THEN {rnd('a', 2)} ELSE {rnd('b', 2)} END AS fake_score FROM v""")

_ATTEMPTS = """
a AS (SELECT (event_id // 4) // 250 AS run, (event_id // 4) % 250 AS sequence_no, event_id % 4 AS iteration, value AS score,
  event_type = 'signup' AS fb, event_id, event_type FROM events),
acc AS (SELECT * FROM a WHERE iteration = 0 OR event_type <> 'error'),
l AS (SELECT *, lag(score) OVER w AS prev FROM acc WINDOW w AS (PARTITION BY run, sequence_no ORDER BY iteration)),
g AS (SELECT *, score > prev + 5 AS degraded, NOT (score > prev + 5) AND prev - score < 2 AS stalled FROM l)"""
oracle("convergence_flags", f"""
WITH {_ATTEMPTS},
c AS (SELECT *, sum(stalled::INT) OVER (PARTITION BY run, sequence_no ORDER BY iteration) AS stalls FROM g WHERE iteration > 0)
SELECT run::VARCHAR AS run_id, sequence_no, iteration, prev AS previous_score, score, round(score - prev, 6) AS delta, degraded, stalled,
  stalls::BIGINT AS stall_count, degraded OR (stalled AND stalls >= 2) AS stops FROM c""")
_SELECTED = f"""
{_ATTEMPTS},
c AS (SELECT *, coalesce(sum((iteration > 0 AND iteration < 3 AND stalled)::INT) OVER (PARTITION BY run, sequence_no ORDER BY iteration), 0) AS stalls FROM g),
r AS (SELECT *, CASE WHEN iteration = 0 THEN CASE WHEN score < 15 AND NOT fb THEN 'baseline' END WHEN score < 15 THEN 'exit score'
  WHEN iteration < 3 AND degraded THEN 'degraded' WHEN iteration < 3 AND stalled AND stalls >= 2 THEN 'stalled twice' END AS reason FROM c),
st AS (SELECT run, sequence_no, min(CASE WHEN reason IS NOT NULL THEN iteration END) AS stop FROM r GROUP BY ALL),
k AS (SELECT r.*, st.stop FROM r JOIN st USING (run, sequence_no) WHERE iteration <= coalesce(stop, 3)),
agg AS (SELECT run, sequence_no, min(CASE WHEN iteration = 0 THEN score END) AS base, max(CASE WHEN iteration = stop THEN reason END) AS reason,
  count(*) - 1 AS iterations, arg_min(iteration, (score, iteration)) AS best_it, arg_max(fb, iteration) AS last_fb,
  arg_min(iteration, (score, iteration)) FILTER (iteration > 0) AS try_it FROM k GROUP BY ALL),
pick AS (SELECT *, CASE WHEN last_fb AND best_it = 0 AND try_it IS NOT NULL THEN try_it ELSE best_it END AS it FROM agg),
sel AS (SELECT p.*, k.event_id, k.score AS best_score FROM pick p JOIN k ON k.run = p.run AND k.sequence_no = p.sequence_no AND k.iteration = p.it)"""
oracle("candidate_selection", f"""
WITH {_SELECTED}
SELECT run::VARCHAR AS run_id, sequence_no, base AS baseline_score, 'v' || event_id || ' __CITATION_0__' AS processed, best_score, iterations,
  coalesce(reason, 'iterations used up') AS stop_reason FROM sel""")
oracle("batch_outcomes", f"""
WITH {_SELECTED}
SELECT run::VARCHAR AS run_id, count(*) AS chunks, count(*) AS succeeded, 0::BIGINT AS failed, round(avg(best_score), 6) AS mean_best_score,
  sum(iterations)::BIGINT AS total_iterations FROM sel GROUP BY run""")
oracle("score_monitor_stream", """
WITH a AS (SELECT (event_id // 4) // 250 AS run, (event_id // 4) % 250 AS sequence_no, event_id % 4 AS iteration, value AS score FROM events),
l AS (SELECT *, lag(score) OVER w AS prev, min(score) OVER w AS best, first_value(score) OVER w AS base FROM a WINDOW w AS (PARTITION BY run, sequence_no ORDER BY iteration)),
g AS (SELECT *, iteration < 3 AND score > prev + 5 AS degraded, iteration < 3 AND NOT (score > prev + 5) AND prev - score < 2 AS stalled FROM l WHERE iteration > 0),
c AS (SELECT *, sum(stalled::INT) OVER (PARTITION BY run, sequence_no ORDER BY iteration) AS stalls FROM g),
r AS (SELECT *, CASE WHEN score < 15 THEN 'exit score' WHEN degraded THEN 'degraded' WHEN stalled AND stalls >= 2 THEN 'stalled twice' ELSE '' END AS stop_reason FROM c),
f AS (SELECT *, min(iteration) FILTER (stop_reason <> '') OVER (PARTITION BY run, sequence_no) AS stop FROM r)
SELECT run::VARCHAR AS run_id, sequence_no, iteration, score, round(score - prev, 6) AS delta, degraded, stalled, stalls::BIGINT AS stall_count,
  best AS best_score, stop_reason FROM f WHERE base >= 15 AND iteration <= coalesce(stop, 99)""")
oracle("isolated_map", """
SELECT conv_id, turn, role <> 'user' AS success, CASE WHEN role = 'user' THEN role || ':' || text || '!' ELSE replace(role || ':' || text || '!', 'e', '3') END AS processed,
  CASE WHEN role = 'user' THEN 'refused' ELSE '' END AS error, CASE WHEN role = 'user' THEN 100::DOUBLE ELSE -1::DOUBLE END AS best_score FROM conversations""")

# --- providers ------------------------------------------------------------------------------------

_SEQ = "[" + ", ".join(f"'{p}'" for p in V.FAILOVER_SEQUENCE) + "]"
_CALLS = f"""
calls AS (SELECT event_id // 5 AS request_id, event_id % 5 AS priority, ({_SEQ})[event_id % 5 + 1] AS provider,
  CASE WHEN event_type IN ('error', 'view', 'click') THEN 500 WHEN event_type = 'signup' AND value > 200 THEN 429 ELSE 200 END AS status,
  't' || event_id AS text, floor(value)::BIGINT AS tokens, ts FROM events),
quotas AS (SELECT provider, CASE WHEN provider = 'groq' THEN 14400 ELSE 50000000 END::BIGINT AS daily_limit, sum(tokens)::BIGINT AS used_today, 30::BIGINT AS rpm_limit
  FROM calls WHERE provider <> 'google' GROUP BY provider),
made AS (SELECT c.*, coalesce(used_today >= daily_limit, false) AS exhausted FROM calls c LEFT JOIN quotas USING (provider))"""
oracle("failover_resolution", f"""
WITH {_CALLS}, w AS (SELECT request_id, min(priority) AS priority FROM made WHERE NOT exhausted AND status = 200 GROUP BY 1)
SELECT r.request_id, w.priority, c.provider, c.text, w.priority IS NULL AS all_failed
FROM (SELECT DISTINCT request_id FROM calls) r LEFT JOIN w USING (request_id) LEFT JOIN calls c ON c.request_id = w.request_id AND c.priority = w.priority""")
_RUNNING = f"""{_CALLS},
days AS (SELECT provider, CAST(floor(sum(tokens) / (count(DISTINCT ts::DATE) * 2)) AS BIGINT) AS day_limit, min(ts::DATE) AS first_day FROM calls WHERE provider <> 'google' GROUP BY 1),
used AS (SELECT c.*, day_limit,
  CASE WHEN ts::DATE = first_day THEN day_limit // 10 ELSE 0 END + coalesce(sum(tokens) OVER w, 0) AS before,
  coalesce(bool_or(status IN (429, 503)) OVER w, false) AS throttled
  FROM calls c LEFT JOIN days USING (provider) WINDOW w AS (PARTITION BY provider, ts::DATE ORDER BY ts, request_id, priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, CASE WHEN day_limit IS NOT NULL THEN CASE WHEN throttled THEN day_limit ELSE before::BIGINT END END AS used_before FROM used)"""
oracle("exhausted_at_call", f"""
WITH {_RUNNING} SELECT request_id, priority, provider, used_before, coalesce(used_before >= day_limit, false) AS exhausted_at_call FROM judged""")
oracle("running_failover", f"""
WITH {_RUNNING}, w AS (SELECT request_id, min(priority) AS priority FROM judged WHERE NOT coalesce(used_before >= day_limit, false) AND status = 200 GROUP BY 1)
SELECT r.request_id, w.priority, c.provider, c.text, w.priority IS NULL AS all_failed
FROM (SELECT DISTINCT request_id FROM calls) r LEFT JOIN w USING (request_id) LEFT JOIN calls c ON c.request_id = w.request_id AND c.priority = w.priority""")
oracle("failover_errors", f"""
WITH {_CALLS}, w AS (SELECT request_id, min(priority) AS won FROM made WHERE NOT exhausted AND status = 200 GROUP BY 1)
SELECT m.request_id, priority, provider, status::BIGINT AS status FROM made m LEFT JOIN w USING (request_id)
WHERE NOT exhausted AND status <> 200 AND (won IS NULL OR priority < won)""")
oracle("usage_by_day", f"""
WITH {_CALLS} SELECT provider, strftime(ts, '%Y-%m-%d') AS day, sum(tokens)::BIGINT AS tokens, bool_or(status IN (429, 503)) AS throttled FROM calls GROUP BY ALL""")
oracle("quotas_after_calls", f"""
WITH {_CALLS}, u AS (SELECT provider, sum(tokens)::BIGINT AS t, bool_or(status IN (429, 503)) AS throttled FROM calls GROUP BY 1)
SELECT provider, daily_limit, CASE WHEN throttled THEN daily_limit ELSE used_today + t END AS used_today, rpm_limit FROM quotas JOIN u USING (provider)""")
_DEFAULTS = "d(provider, daily_limit, used_today, rpm_limit) AS (VALUES " + ", ".join(
    f"('{p}', {a}::BIGINT, {b}::BIGINT, {c}::BIGINT)" for p, a, b, c in V.DEFAULT_QUOTAS
) + ")"
oracle("quota_listing", f"WITH {_CALLS} SELECT provider, used_today, daily_limit, rpm_limit FROM quotas")
oracle("quota_usage", f"""
WITH {_CALLS}, {_DEFAULTS},
r AS (SELECT d.provider, coalesce(q.daily_limit, d.daily_limit) AS daily_limit, coalesce(q.used_today, d.used_today) AS used_today,
  coalesce(q.rpm_limit, d.rpm_limit) AS rpm_limit FROM d LEFT JOIN quotas q USING (provider)),
m AS (SELECT *, greatest(0, daily_limit - used_today) AS remaining, greatest(0, daily_limit - used_today) / daily_limit * 100::DOUBLE AS pct FROM r)
SELECT provider, daily_limit, used_today, remaining, {rnd('pct', 2)} AS remaining_percentage, rpm_limit FROM m""")
oracle("seeded_quotas", f"""
WITH {_CALLS}, {_DEFAULTS}
SELECT provider, coalesce(d.daily_limit, q.daily_limit) AS daily_limit, CASE WHEN d.provider IS NOT NULL THEN 0 ELSE q.used_today END AS used_today,
  coalesce(q.rpm_limit, d.rpm_limit) AS rpm_limit, q.provider IS NULL AS inserted FROM quotas q FULL JOIN d USING (provider)""")
for _suffix in ("", "_stream"):
    oracle(f"daily_tokens{_suffix}", f"""
WITH {_CALLS}, t AS (SELECT provider, strftime(ts, '%Y-%m-%d') AS day, sum(tokens)::BIGINT AS tokens FROM calls GROUP BY ALL)
SELECT provider, day, tokens, daily_limit, coalesce(tokens >= daily_limit, false) AS over_limit FROM t LEFT JOIN quotas USING (provider)""")
    oracle(f"requests_per_minute{_suffix}", f"""
WITH {_CALLS}, t AS (SELECT provider, strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS requests FROM calls GROUP BY ALL)
SELECT provider, minute, requests, rpm_limit, coalesce(requests > rpm_limit, false) AS over_limit FROM t LEFT JOIN quotas USING (provider)""")

# --- blocks ----------------------------------------------------------------------------------------

_BLOCKS = rf"""
v AS (SELECT page_id, url, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
t AS (SELECT page_id, url, list_transform(regexp_extract_all(h, '(?i)<(h[1-6]|p|li)(?:\s[^>]*)?>', 1), lambda x_: lower(x_)) AS tags,
  string_split_regex(h, '(?i)<(?:h[1-6]|p|li)(?:\s[^>]*)?>')[2:] AS bodies FROM v),
b0 AS (SELECT page_id, url, unnest(tags) AS tag, unnest(bodies) AS body, unnest(range(len(tags))) AS block_no FROM t),
blocks AS (SELECT page_id, url, tag, block_no, {trim(flat("replace(replace(replace(replace(replace(replace(regexp_replace(string_split_regex(body, '(?i)</(?:h[1-6]|p|li)>')[1], '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + "'), '&#39;', ''''), '&amp;', '&')"))} AS text FROM b0),
bw AS (SELECT *, len({tokens('text')}) AS word_count FROM blocks)"""
oracle("page_block_table", f"""
WITH {_BLOCKS} SELECT page_id, block_no, tag, text, word_count, upper(text) = text AND lower(text) <> text AND length(text) < 100 AS heading FROM bw WHERE text <> ''""")
oracle("block_summary", f"""
WITH {_BLOCKS}
SELECT regexp_extract(url, '//([^/]*)', 1) AS site, count(*) AS total_blocks, count(*) FILTER (text <> '') AS text_blocks, count(*) FILTER (text = '') AS image_blocks,
  coalesce(sum(word_count) FILTER (text <> ''), 0)::BIGINT AS total_words, 0::BIGINT AS parse_errors, count(DISTINCT page_id) AS pages FROM bw GROUP BY ALL""")
oracle("page_texts", f"""
WITH {_BLOCKS} SELECT p.page_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_no), '') AS text FROM pages p LEFT JOIN bw USING (page_id) GROUP BY ALL""")
oracle("page_documents", f"""
WITH {_BLOCKS} SELECT page_id, count(*) AS blocks, 0::BIGINT AS errors, sha256({flat("string_agg(text || ' [7] $x_{' || page_id || '}$', '' ORDER BY block_no)", '')}) AS sha
FROM bw WHERE text <> '' GROUP BY page_id""")
oracle("blocks_by_page", f"""
WITH {_BLOCKS} SELECT page_id, count(*) AS n_blocks, string_agg(sha256(text), ' ' ORDER BY block_no) AS fingerprints FROM bw WHERE text <> '' GROUP BY page_id""")

_BOXES = """
g AS (SELECT page_id, url, block_no AS n, word_count AS w, contains(url, '/en/') AS known FROM bw),
s AS (SELECT *, CASE WHEN known THEN 612::DOUBLE ELSE 595::DOUBLE END AS pw, CASE WHEN known THEN 792::DOUBLE ELSE 842::DOUBLE END AS ph FROM g),
r AS (SELECT *, CASE WHEN w % 7 = 0 THEN 0::DOUBLE ELSE (n % 50)::DOUBLE END AS a0, (n * 12)::DOUBLE AS b0,
  CASE WHEN w % 5 = 0 OR w * 3 > 99999 THEN pw ELSE (w * 3)::DOUBLE END AS a1, CASE WHEN w % 11 = 0 THEN ph ELSE (n * 12 + 10)::DOUBLE END AS b1 FROM s),
o AS (SELECT *, least(a0, a1) AS x0, least(b0, b1) AS y0, greatest(a0, a1) AS x1, greatest(b0, b1) AS y1 FROM r)"""
oracle("block_geometry", f"""
WITH {_BLOCKS}, {_BOXES}
SELECT page_id, n AS block_no, x0 - 0.5::DOUBLE AS x0, y0 - 0.5::DOUBLE AS y0, x1 + 0.5::DOUBLE AS x1, y1 + 0.5::DOUBLE AS y1,
  x1 - x0 AS width, y1 - y0 AS height, ph - y0 - 10::DOUBLE AS baseline FROM o""")
oracle("span_styles", f"""
WITH {_BLOCKS}, s AS (SELECT page_id, unnest(string_split(text, ' ')) AS w, text, generate_subscripts(string_split(text, ' '), 1) AS i FROM bw WHERE text <> '')
SELECT page_id, count(*) AS spans, count(*) FILTER ((length(w) % 20) & 16 <> 0) AS bold, count(*) FILTER ((length(w) % 20) & 2 <> 0) AS italic,
  sum(CASE WHEN i = 1 THEN length(replace(text, ' ', '')) END)::BIGINT AS line_chars FROM s GROUP BY page_id""")
oracle("page_count_mismatches", f"""
WITH {_BLOCKS}, s AS (SELECT regexp_extract(url, '//([^/]*)', 1) AS site, * FROM bw),
c AS (SELECT site, count(DISTINCT page_id) FILTER (tag = 'h1') AS left_pages, count(DISTINCT page_id) FILTER (tag = 'p' AND word_count > 60) AS right_pages FROM s GROUP BY 1)
SELECT * FROM c WHERE left_pages <> right_pages""")


def _lines(ws: str, size: str, width: str) -> str:
    ch = f"({size} * 0.38::DOUBLE)"
    return f"""CASE WHEN len({ws}) = 0 THEN 0 ELSE list_reduce({ws}, lambda s_, n_:
  CASE WHEN n_ * {ch} > {width} THEN {{'l': s_.l + (s_.u > 0)::BIGINT + ceil(n_ * {ch} / {width})::BIGINT - 1, 'u': (n_ * {ch}) % {width}}}
       WHEN s_.u + n_ * {ch} > {width} THEN {{'l': s_.l + 1, 'u': n_ * {ch} + {ch}}}
       ELSE {{'l': s_.l, 'u': s_.u + n_ * {ch} + {ch}}} END, {{'l': 1::BIGINT, 'u': 0::DOUBLE}}).l END"""


oracle("overflow_report", f"""
WITH {_BLOCKS}, g AS (SELECT page_id, block_no, list_transform({tokens('text')}, lambda w_: length(w_)) AS ws, (60 + block_no % 200)::DOUBLE AS wd,
  (12 + word_count % 40)::DOUBLE AS ht FROM bw WHERE text <> ''),
e AS (SELECT *, {_lines('ws', '10::DOUBLE', 'wd')} AS lines FROM g),
h AS (SELECT *, lines * 10::DOUBLE * 1.2::DOUBLE AS est FROM e),
o AS (SELECT *, est > ht * (1::DOUBLE + 0.15::DOUBLE) AS overflow FROM h),
k AS (SELECT o.*, s.range AS pct FROM o, range(10, 96) s WHERE overflow),
fit AS (SELECT page_id, block_no, max(pct) AS pct FROM k
  WHERE {_lines('ws', '(10::DOUBLE * (pct / 100::DOUBLE))', 'wd')} * (10::DOUBLE * (pct / 100::DOUBLE)) * 1.2::DOUBLE <= ht GROUP BY ALL)
SELECT page_id, block_no, lines, overflow, round((est - ht) / ht * 100, 6) AS overflow_percentage,
  CASE WHEN overflow THEN coalesce(pct / 100::DOUBLE, 0.1::DOUBLE) ELSE 1::DOUBLE END AS scale, round(est, 6) AS estimated_height
FROM o LEFT JOIN fit USING (page_id, block_no)""")

_PC = f"""
{_BLOCKS},
u AS (SELECT * FROM bw WHERE text <> ''),
pg AS (SELECT page_id, count(*) AS k, string_agg(text, ' ' ORDER BY block_no) AS spaced, list(text ORDER BY block_no) AS texts,
  list(greatest(1, word_count) ORDER BY block_no) AS wt, list(block_no ORDER BY block_no) AS nos FROM u GROUP BY page_id)"""
oracle("distributed_blocks", f"""
WITH {_PC},
a AS (SELECT *, {tokens("'Intro words. ' || spaced")} AS w, list_sum(wt) AS total FROM pg),
x AS (SELECT page_id, k, texts, nos, w, spaced, list_transform(wt, lambda z_: greatest(1, floor(len(w) * (z_ / total))::BIGINT)) AS takes FROM a),
i AS (SELECT *, unnest(nos) AS original_index, unnest(texts) AS original, unnest(range(1, k + 1)) AS i FROM x),
s AS (SELECT *, least(len(w), coalesce(list_sum(takes[1:i - 1]), 0))::BIGINT AS st FROM i)
SELECT page_id, original_index,
  CASE WHEN length(spaced) % 2 <> 0 THEN original WHEN k = 1 THEN 'Intro words. ' || spaced
    WHEN i = k THEN array_to_string(w[st + 1:], ' ') ELSE array_to_string(w[st + 1:least(len(w), st + takes[i])], ' ') END AS rewritten_text,
  length(original) AS original_chars FROM s""")
oracle("dangling_references", f"""
WITH {_PC}, n AS (SELECT p.page_id, coalesce(k, 0) AS k, coalesce(nos, []) AS nos FROM pages p LEFT JOIN pg USING (page_id)),
r AS (SELECT page_id, unnest(range(k, k + 3)) AS paragraph_index, nos FROM n)
SELECT page_id, paragraph_index FROM r WHERE NOT list_contains(nos, paragraph_index)""")

oracle("page_chunks", f"""
WITH {_BLOCKS}, p2 AS (SELECT page_id AS doc_id, block_no AS para, text AS t, word_count AS n FROM bw WHERE text <> ''), {fill(_UNITS, 250, 400)}
SELECT doc_id AS page_id, count(*) AS chunks, sum(word_count)::BIGINT AS words, max(word_count) AS longest, sum(len(paras))::BIGINT AS block_refs FROM chunks GROUP BY doc_id""")
oracle("block_json", f"""
WITH {_BLOCKS}
SELECT page_id, count(*) AS blocks, count(*) FILTER (word_count % 3 = 0) AS errors, coalesce(sum(word_count) FILTER (word_count % 3 <> 0), 0)::BIGINT AS words,
  sum(CASE WHEN word_count % 3 = 0 THEN 595::DOUBLE ELSE word_count * 5::DOUBLE END) AS width,
  coalesce(sum(length(text)) FILTER (word_count % 3 <> 0), 0)::BIGINT AS n_chars FROM bw GROUP BY page_id""")


def _glyphs(widths: dict[int, str]) -> str:
    pairs = ", ".join(f"'{q(c)}': {w}" for w, chars in widths.items() for c in chars)
    return f"MAP {{{pairs}}}"


def _word_widths(widths: dict[int, str]) -> str:
    return (
        f"list_transform(w, lambda w_: list_sum(list_transform(string_split(w_, ''), lambda c_: coalesce(({_glyphs(widths)})[c_], {V.DEFAULT_GLYPH_WIDTH}))))"
    )


_FACTOR = "(1::DOUBLE - 0.1::DOUBLE * (step / 10::DOUBLE))"
_JOINED = "(CASE WHEN s_.u > 0 THEN s_.u + 278 ELSE 0 END + n_)"
oracle("fitted_paragraphs", f"""
WITH {_BLOCKS},
g AS (SELECT page_id, block_no, {tokens('text')} AS w, (120 + block_no % 200)::DOUBLE AS wd, (24 + word_count % 60)::DOUBLE AS ht,
  upper(text) = text AND lower(text) <> text AND length(text) < 100 AS bold FROM bw WHERE text <> ''),
m AS (SELECT *, list_transform(CASE WHEN bold THEN {_word_widths(V.HELVETICA_BOLD_WIDTHS)} ELSE {_word_widths(V.HELVETICA_WIDTHS)} END, lambda x_: x_::BIGINT) AS ws FROM g),
ft AS (SELECT m.*, s.range AS step, greatest(7::DOUBLE, 10::DOUBLE * {_FACTOR}) AS size, 1.2::DOUBLE * {_FACTOR} AS gap FROM m, range(0, 11) s),
f AS (SELECT *, list_reduce(ws, lambda s_, n_: {{
    'p': s_.p + 1,
    'u': CASE WHEN {_JOINED} * 0.001::DOUBLE * size <= wd THEN {_JOINED} WHEN s_.u = 0 AND n_ * 0.001::DOUBLE * size > wd THEN 0 ELSE n_ END,
    'st': CASE WHEN s_.u = 0 OR {_JOINED} * 0.001::DOUBLE * size > wd THEN list_append(s_.st, s_.p + 1) ELSE s_.st END}},
  {{'p': 0::BIGINT, 'u': 0::BIGINT, 'st': []::BIGINT[]}}).st AS st FROM ft),
o AS (SELECT *, len(st) * size * gap <= ht AS fits FROM f),
fb AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY page_id, block_no ORDER BY (NOT fits), CASE WHEN fits THEN step ELSE -step END) = 1),
r AS (SELECT *, round(size, 2) AS fs, round(gap, 2) AS sp, list_transform(range(1, len(st) + 1), lambda i_: array_to_string(w[st[i_]:coalesce(st[i_ + 1], len(w) + 1) - 1], ' ')) AS ls FROM fb),
k AS (SELECT *, CASE WHEN fits THEN len(ls) ELSE least(len(ls), greatest(1, floor(ht / (fs * sp))::BIGINT)) END AS kept FROM r)
SELECT page_id, block_no, kept AS lines, fs AS font_size, sp AS line_spacing, length(array_to_string(ls[kept + 1:], ' ')) AS overflow_chars,
  sha256(array_to_string(ls[1:kept], '|')) AS sha FROM k""")

# --- ledgers ------------------------------------------------------------------------------------------

_LEDGER = """
runs AS (SELECT o_orderkey AS run_id, 'order ' || o_orderkey || CASE WHEN o_orderpriority = '5-LOW' THEN '.pdf' ELSE '' END AS filename, o_orderdate AS start_time,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'paused' END AS status, CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS master_summary FROM orders),
chunks AS (SELECT l_orderkey AS run_id, l_linenumber::BIGINT AS sequence_no, l_partkey AS part, l_returnflag AS flag, l_quantity AS quantity FROM lineitem),
labelled AS (SELECT *, CASE WHEN filename LIKE '%.pdf' THEN 'PDF' ELSE 'Text' END AS kind,
  CASE status WHEN 'running' THEN 'Processing' WHEN 'completed' THEN 'Completed' ELSE status END AS status_label FROM runs)"""
oracle("latest_runs", f"""
WITH {_LEDGER} SELECT run_id, filename, strftime(start_time, '%Y-%m-%d') AS day, kind, status_label FROM labelled ORDER BY start_time DESC, run_id LIMIT 50""")
oracle("latest_runs_with_chunks", f"""
WITH {_LEDGER}, l AS (SELECT * FROM runs ORDER BY start_time DESC, run_id LIMIT 10)
SELECT run_id, status, sequence_no, part, quantity FROM l LEFT JOIN chunks USING (run_id)""")
oracle("runs_with_chunks", f"""
WITH {_LEDGER} SELECT run_id, status, sequence_no, part FROM runs LEFT JOIN (SELECT * FROM chunks WHERE run_id % 7 <> 3) USING (run_id)""")
oracle("run_labels", f"WITH {_LEDGER} SELECT kind, status_label, count(*) AS runs FROM labelled GROUP BY ALL")
oracle("run_violations", f"""
WITH {_LEDGER} SELECT run_id, 'status' AS violation FROM runs WHERE status = 'paused' UNION ALL
SELECT run_id, 'summary missing' FROM runs WHERE master_summary IS NULL""")
oracle("orphan_chunks", f"""
WITH {_LEDGER} SELECT run_id, sequence_no, part FROM chunks WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status <> 'paused')""")
oracle("duplicate_chunks", f"WITH {_LEDGER} SELECT run_id, sequence_no, count(*) AS copies FROM chunks GROUP BY ALL HAVING count(*) > 1")
oracle("sequence_audit", f"""
WITH {_LEDGER}, e AS (SELECT DISTINCT run_id, sequence_no FROM chunks WHERE flag <> 'R'),
r AS (SELECT run_id, sequence_no, count(*) AS n FROM chunks WHERE flag <> 'A' GROUP BY ALL)
SELECT run_id, sequence_no, 'missing' AS problem FROM e ANTI JOIN r USING (run_id, sequence_no)
UNION ALL SELECT run_id, sequence_no, 'unexpected' FROM r ANTI JOIN e USING (run_id, sequence_no)
UNION ALL SELECT run_id, sequence_no, 'duplicate' FROM r WHERE n > 1""")
oracle("deleted_runs", f"""
WITH {_LEDGER} SELECT 'api_quotas' AS table_name, 4::BIGINT AS row_count UNION ALL SELECT 'paper_runs', count(*) FROM runs WHERE status <> 'paused'
UNION ALL SELECT 'text_chunks', count(*) FROM chunks WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'paused')""")
oracle("updated_chunks", """
SELECT conv_id AS run_id, turn AS sequence_no, CASE WHEN role = 'user' THEN text || '*' END AS processed, CASE WHEN role = 'user' THEN 2 ELSE 0 END::BIGINT AS iterations FROM conversations""")
oracle("finished_runs", f"""
WITH {_LEDGER}, n AS (SELECT run_id, count(*) AS n, count(*) FILTER (quantity < 45) AS done FROM chunks GROUP BY 1)
SELECT run_id, coalesce(n, 0) AS total_chunks, CASE WHEN n = done THEN 'completed' ELSE 'failed' END AS status, coalesce(master_summary, '') AS master_summary
FROM runs LEFT JOIN n USING (run_id)""")
oracle("written_results", "SELECT doc_id, lang, sha256(text) AS sha FROM documents")
oracle("run_artifacts", f"""
WITH {_LEDGER}, f AS (SELECT run_id, bool_or(sequence_no = 1) AS pdf, bool_or(sequence_no = 2) AS txt FROM chunks WHERE sequence_no < 3 GROUP BY 1),
j AS (SELECT l.run_id, l.filename, kind = 'PDF' AND coalesce(pdf, false) AS use_pdf, coalesce(txt, false) AS txt FROM labelled l LEFT JOIN f USING (run_id)),
k AS (SELECT *, CASE WHEN use_pdf THEN '/out/' || run_id || '_final.pdf' WHEN txt THEN '/out/' || run_id || '_result.txt' END AS path FROM j)
SELECT run_id::VARCHAR AS run_id, path, CASE WHEN path IS NOT NULL THEN 'order_' || run_id || '_result' || CASE WHEN use_pdf THEN '.pdf' ELSE '.txt' END END AS download_name,
  CASE WHEN path IS NULL THEN 'result not found' END AS error FROM k""")

# --- events --------------------------------------------------------------------------------------------

oracle("parsed_status_events", """
SELECT event_id, user_id::VARCHAR AS run_id, event_type AS category, CASE WHEN event_type = 'signup' THEN '' ELSE 'rewriting' END AS progress_state,
  CASE WHEN event_type = 'signup' THEN -1 ELSE floor(value)::BIGINT END AS google, CASE WHEN event_type = 'signup' THEN -1 ELSE 0 END::BIGINT AS groq,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, CASE WHEN event_type = 'signup' THEN 'missing: progress_state' ELSE '' END AS error FROM events""")
_STATES = "[" + ", ".join(f"'{s}'" for _, s in V.PROGRESS_NODES) + "]"
_STATUS = f"""
e AS (SELECT user_id::VARCHAR AS run_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'info' ELSE 'progress' END AS category,
  ({_STATES})[event_id % 6 + 1] AS progress_state FROM events)"""
for _name in ("run_states", "run_states_stream"):
    oracle(_name, f"""
WITH {_STATUS},
r AS (SELECT run_id, arg_max(progress_state, (ts, event_id)) FILTER (category = 'progress') AS s, max((ts, event_id)) FILTER (category = 'progress') AS seen,
  max((ts, event_id)) FILTER (category = 'error') AS err FROM e WHERE category <> 'info' GROUP BY 1),
f AS (SELECT run_id, s AS progress_state, coalesce(err > seen, false) AS failed, list_position({_STATES}, s) AS p FROM r)
SELECT run_id, progress_state, failed, array_to_string(list_transform(range(1, 7), lambda i_: CASE WHEN p = 6 AND NOT failed THEN 'success'
  WHEN i_ < p THEN 'success' WHEN i_ = p THEN CASE WHEN failed THEN 'error' ELSE 'processing' END ELSE 'idle' END), ',') AS nodes FROM f""")
for _name in ("error_feed", "error_feed_stream"):
    oracle(_name, f"""
WITH {_STATUS},
w AS (SELECT *, last_value(CASE WHEN category = 'progress' THEN progress_state END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM e)
SELECT run_id, event_id, coalesce(state, '') AS state FROM w WHERE category = 'error'""")
oracle("intake_tables_stream", f"""
WITH {fill(_CITED, 'documents')}, {_KNOWN}
SELECT k.doc_id, CASE WHEN k.doc_id % 10 = 3 THEN 0 ELSE len(known) END AS citations,
  CASE WHEN k.doc_id % 10 = 3 THEN '' ELSE sha256({flat('c.text', '')}) END AS sha, CASE WHEN k.doc_id % 10 = 3 THEN 'empty' ELSE '' END AS reason
FROM k JOIN c ON c.doc_id = k.doc_id""")
oracle("committed_updates", ORACLES["updated_chunks"])
oracle("committed_deletion", f"""
WITH {_LEDGER}, paused AS (SELECT run_id FROM runs WHERE status = 'paused')
SELECT 1::BIGINT AS version, 'runs' AS table_name, count(*) AS row_count FROM runs UNION ALL SELECT 1, 'chunks', count(*) FROM chunks
UNION ALL SELECT 2, 'runs', count(*) FROM runs WHERE status <> 'paused'
UNION ALL SELECT 2, 'chunks', count(*) FROM chunks WHERE run_id NOT IN (FROM paused)""")
oracle("admitted_files", """
SELECT rule, table_name, verdict
FROM (VALUES ('upload', 'extension'), ('parquet', 'admitted'), ('signature', 'signature'), ('size', 'size')) r(rule, verdict),
  (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark',
    'labels', 'conversations']) AS table_name)""")
oracle("unusable_attempts", """
WITH a AS (SELECT (event_id // 4) // 250 AS run, (event_id // 4) % 250 AS sequence_no, event_id % 4 + CASE WHEN event_id % 11 = 0 THEN 4 ELSE 0 END AS iteration,
  value % 5 < 1 AS failed FROM events),
b AS (SELECT run, sequence_no, bool_or(iteration = 0 AND NOT failed) AS based FROM a GROUP BY 1, 2),
r AS (SELECT run::VARCHAR AS run_id, sequence_no, iteration,
  CASE WHEN iteration > 3 THEN 'beyond the last iteration' WHEN failed THEN 'no text or score' WHEN NOT based THEN 'no baseline' END AS reason FROM a JOIN b USING (run, sequence_no))
SELECT * FROM r WHERE reason IS NOT NULL""")
oracle("batch_failures", """
SELECT conv_id AS run_id, count(*) AS chunks, count(*) FILTER (role <> 'user') AS succeeded, count(*) FILTER (role = 'user') AS failed,
  round(avg(length(text)), 6) AS mean_best_score, sum(turn)::BIGINT AS total_iterations FROM conversations GROUP BY 1""")
oracle("block_errors", f"""
WITH {_BLOCKS} SELECT page_id, count(*) AS total_blocks, count(*) FILTER (word_count > 30) AS parse_errors FROM bw GROUP BY page_id""")
