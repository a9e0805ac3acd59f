"""URL verdicts from rules that are indexed by their rarest literal token."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# host rules of the contract: (verdict, host, path)
HOST_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
# pattern rules for what no host rule fits: (verdict, pattern over the whole url, whole tokens of every url that matches: bounded on both sides within the pattern)
PATTERN_RULES = [
    ("block", r"[?&]utm_[a-z]+=", ["utm"]),
    ("block", r"[?&]page=[0-9]+&ref=", ["page", "ref"]),
    ("block", r"://m\.[^/]*/[a-z]+/[0-9]+\.html", ["m"]),
]
TOKEN_GAP = "[^a-z0-9]+"


def host_of(url):
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule_tokens(host: str, path: str) -> list[str]:
    """Whole tokens of a host rule: all host labels, and path parts that the rule itself ends."""
    parts = [t for t in re.split(TOKEN_GAP, host.lower()) if t]
    inside = re.findall(f"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return parts + inside


def rule_table(pages: DataFrame, host_rules, pattern_rules) -> DataFrame:
    """rule, verdict, subject, pattern, width, tokens.

    A site is host and path around a ``#``, which neither can hold.
    """
    rows = [
        (h + p, v, "site", rf"^(?:[^#]*\.)?{re.escape(h)}#{re.escape(p)}", len(h + p), host_rule_tokens(h, p)) for v, h, p in host_rules
    ] + [(pattern, v, "url", pattern, len(pattern), tokens) for v, pattern, tokens in pattern_rules]
    return pages.sparkSession.createDataFrame(
        rows, "rule string, verdict string, subject string, pattern string, width int, tokens array<string>")


def judge_urls(
    pages: DataFrame, host_rules=tuple(HOST_RULES), pattern_rules=tuple(PATTERN_RULES), key: str = "page_id", url: str = "url",
) -> DataFrame:
    """Verdict on every url: key, host, path, rule, verdict, pattern.

    A host rule (verdict, host, path) fits its host and all subdomains where the
    url's path starts with the rule's; the longest wins (then the first by text).
    Where none fits, the url is blocked if a blocking pattern rule matches, else
    allowed; ``pattern`` names the longest matching one, if any.  All rules
    become regular expressions and are indexed by that token of theirs which
    fewest distinct urls contain; tokens of a url fetch candidates, and only those
    are matched.  Rules without a literal token are tried on every url.

    Null urls and urls without ``://`` have empty host and path; no host rule fits
    them.  Equal urls are judged once; repeated rows each get their row.  The
    project's records hold no urls, so the operator is general.
    """
    rules = rule_table(pages, host_rules, pattern_rules)
    asked = pages.select(F.col(url).alias("u")).filter("u IS NOT NULL").distinct().select(
        "u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("u"), TOKEN_GAP)))
    met = asked.select("u", "h", "p", F.explode(tokens).alias("token"))
    wanted = rules.select("rule", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    # rules are few and given: their tokens are a small table
    seen = met.join(F.broadcast(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    index = wanted.join(seen, "token").groupBy("rule").agg(F.min_by("token", F.struct("urls", "token")).alias("token")).join(rules.drop("tokens"), "rule")
    subject = F.when(F.col("subject") == "site", F.concat_ws("#", "h", "p")).otherwise(F.col("u"))
    hits = met.join(F.broadcast(index), "token").withColumn("s", subject).filter(F.expr("s RLIKE pattern"))
    order = F.struct(F.col("width"), F.col("rule"), F.col("verdict"))
    site = F.when(F.col("subject") == "site", order)
    found = hits.groupBy("u").agg(
        F.max(site).alias("site"), F.max(F.when(F.col("subject") == "url", order)).alias("other"),
        F.max((F.col("subject") == "url") & (F.col("verdict") == "block")).alias("blocked"),
    )
    out = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).join(found, "u", "left")
    return out.select(
        F.col("k").alias(key), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("other.rule").alias("pattern"),
    )
