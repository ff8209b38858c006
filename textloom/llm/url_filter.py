"""URL rules whose block decisions spread over redirects and canonical links.

A page's URL is judged by the rule with the longest text that fits it. Pages without a rule take
part in an equivalence: a redirect (meta refresh) or a canonical link in a page's markup joins its
URL with the URL it names, and distributed connected components over these edges find all aliases
of an address. A component with a blocked address is blocked as a whole, but for addresses that a
rule allows expressly. Everything else is allowed. Only DataFrame functions are used.

An address is the host and path: scheme, query and fragment do not tell aliases apart.

* null URL, or one without ``://``: host and path are empty, no rule fits, the verdict is allow;
* null or empty markup: no edge; relative targets are taken on the page's own host;
* repeated rows and URLs: each row is judged; equal addresses are one node;
* empty table: empty result. Columns of the table other than id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.graph import connected_components
from textloom.session import stored

_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    ``rules``: (verdict, host, path). The rule list is a parameter, so it becomes one expression;
    longer rules are asked first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def alias_links(pages: DataFrame) -> DataFrame:
    """(host, path, to_host, to_path): addresses that a redirect or canonical link makes one.

    ``pages`` has host, path and html. Targets are read once; a page has at most one of each kind.
    """
    targets = F.array(F.regexp_extract("html", _LINK, 1), F.regexp_extract("html", _REFRESH, 1))
    found = pages.filter(F.col("html").rlike("(?i)canonical|refresh")).select("host", "path", F.explode(targets).alias("to")).filter("to <> ''")
    to = F.col("to")
    absolute = F.when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.contains("://"), to)
    folder = F.when(to.startswith("/"), F.lit("")).otherwise(F.regexp_extract("path", "^(.*/)", 1))
    here = F.when(F.col("host") != "", F.concat(F.lit("http://"), F.col("host"), folder, to))
    named = found.withColumn("to", F.coalesce(absolute, here)).filter(F.col("to").isNotNull())
    return named.select("host", "path", host_of(F.col("to")).alias("to_host"), path_of(F.col("to")).alias("to_path"))


def address(host, path) -> Column:
    return F.xxhash64(host, path)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict for every row."""
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    links = stored(alias_links(parts.filter("host <> ''")))
    components = connected_components(links.select(address("host", "path").alias("a"), address("to_host", "to_path").alias("b")), "a", "b")
    # An address takes part if it is an end of a link; a blocked one blocks its component.
    ends = links.select("host", "path").union(links.select("to_host", "to_path")).distinct()
    blocked_ends = ends.filter(fitting_rule(F.col("host"), F.col("path"), rules)[1] == "block").select(address("host", "path").alias("node"))
    blocked = components.join(blocked_ends, "node", "left_semi").select("component").distinct()
    spread = components.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("spread"))
    rule, decision = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), decision.alias("decision"), address("host", "path").alias("node"))
    verdict = F.coalesce("decision", F.when(F.col("spread"), "block"), F.lit("allow"))
    return judged.join(spread, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
