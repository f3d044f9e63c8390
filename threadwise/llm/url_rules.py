"""Operator 10: URL filters. Pattern rules are indexed by their rarest literal token; the tokens of a URL
fetch candidate rules, and only those run their regular expression.

DataFrame functions only. A token is a lower-cased run of ASCII letters and digits. A literal of a rule
is a token that any URL matching the rule must hold whole; of a rule's literals the one found in the
fewest distinct URLs is its key. A rule without a literal is keyed by the empty token, which every URL has.

Defined cases: a null URL and one without ``://`` have an empty host and path, fit no rule and are allowed;
equal URLs are judged once and share the verdict; empty tables give no row; other columns are kept, and
columns named like the added ones are replaced. Of fitting rules the host rules come before the patterns,
then the longest, then the smallest name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.session import reliable

ADDED = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[0-9A-Za-z]+"


@dataclass(frozen=True)
class UrlRule:
    name: str
    verdict: str  # allow or block
    pattern: str  # regular expression over host and path put together
    literals: tuple[str, ...]
    is_host: bool


def host_rule(verdict: str, host: str, path: str) -> UrlRule:
    """Fits the host and all its subdomains if the path starts with ``path``."""
    literal = host + path
    tokens = re.findall(TOKEN, literal)
    if literal and re.fullmatch(TOKEN, literal[-1]):
        tokens = tokens[:-1]  # the URL's token may go on
    quoted = re.sub(r"([^0-9A-Za-z/])", r"\\\1", literal)
    return UrlRule(literal, verdict, f"^(?:[^/]*\\.)?{quoted}", tuple(t.lower() for t in tokens), True)


def word_rule(verdict: str, word: str) -> UrlRule:
    """Fits where the word stands whole in the host or the path."""
    return UrlRule(word, verdict, f"(?i)(?:^|[^0-9A-Za-z]){word}(?:[^0-9A-Za-z]|$)", (word.lower(),), False)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_behind(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_behind(url), "^[^/?#]*([^?#]*)", 1)


def _behind(url: Column) -> Column:
    return F.coalesce(F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))), F.lit(""))


def tokens_of(text: Column) -> Column:
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TOKEN})"))
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.array(*[F.lit(t) for t in (r.literals or ("",))]).alias("literals"), F.lit(r.is_host).alias("is_host")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The input with ``ADDED``; ``rule`` is named for host rules only.

    Every distinct URL is tokenised once; the rules' literals are counted over all of them. The joins on
    tokens are left to Spark: it broadcasts the rules if they are small by its threshold and splits hot
    tokens otherwise."""
    pages = pages.drop(*[c for c in ADDED if c != url_col and c in pages.columns])
    urls = pages.select(F.col(url_col).cast("string").alias("_url")).where("instr(_url, '://') > 0").distinct()
    urls = urls.select("_url", F.concat(host_of(F.col("_url")), path_of(F.col("_url"))).alias("_site"))
    seen = urls.select("_url", "_site", F.explode(tokens_of(F.col("_site"))).alias("_token"))
    literals = rules.select("name", "is_host", F.explode("literals").alias("_token"))
    counts = seen.join(literals.select("_token").distinct(), "_token").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    rarest = literals.join(counts, "_token", "left").groupBy("name", "is_host").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), "_token"))["_token"].alias("_token"))
    index = rules.drop("literals").join(rarest, ["name", "is_host"])
    hits = seen.join(index, "_token").where("_site RLIKE pattern")
    rank = F.struct(~F.col("is_host"), -F.length("name"), "name", "is_host", "verdict")
    best = reliable(hits.groupBy("_url").agg(F.min(rank).alias("_best")))
    out = pages.join(best, F.col(url_col).cast("string") == F.col("_url"), "left")
    return out.select(
        *pages.columns,
        host_of(F.col(url_col).cast("string")).alias("host"),
        path_of(F.col(url_col).cast("string")).alias("path"),
        F.when(F.col("_best.is_host"), F.col("_best.name")).alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )
