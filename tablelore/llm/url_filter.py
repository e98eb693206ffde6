"""Allow and block rules for urls, matched by hash prefixes of url expressions.

A url has host-suffix and path-prefix expressions: the host and its parent domains, each
with the beginnings of the path. Only shapes that some rule has (so many labels, so many
characters of path) are expanded. Expressions meet the rules in an equi-join on the first
digits of a SHA-256 digest; the whole digest then confirms the match, and the longest
rule wins. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPES = "array<struct<labels:int,chars:int>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _shapes(rules: DataFrame) -> str:
    """The distinct (labels, path length) of the rules, as an SQL literal.

    Bounded by labels of a host name times characters of a path, whatever the number of rules.
    """
    rows = rules.select(F.size(F.split("host", r"\.")).alias("labels"),
                        F.length("path").alias("chars")).distinct().collect()
    items = ", ".join(f"named_struct('labels', {r.labels}, 'chars', {r.chars})"
                      for r in sorted(rows, key=tuple))
    return f"cast(array({items}) as {_SHAPES})"


def judge_urls(urls: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url",
               default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """One row per row of ``urls``: ``key``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block). A rule fits its host
    and all subdomains if the url's path starts with the rule's path. The longest rule
    (host and path together) wins, then the longer host, then block before allow. Rules
    with a null in any of the three never fit, repeated rules count once. Urls that no
    rule fits get ``default`` and a null rule; a null, empty or unparsable url has empty
    host and path. Repeated rows of ``urls`` and null keys stay as they are; other
    columns of ``urls`` are left out, so their names cannot clash. Empty tables give an
    empty result, or the default for all.

    Only hosts and paths are shuffled. Matches are gathered by (host, path), so equal
    urls are one row per task before the shuffle, and written. The join that follows has
    plain tables on both sides: Spark broadcasts the matches while their files are small,
    and beyond that splits a hot url, null ones too, over many tasks.
    """
    rules = rules.select("host", "path", "action").dropna().distinct()
    shapes = _shapes(rules)
    rules = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(F.length(F.concat("host", "path")).alias("chars"),
                 F.length("host").alias("host_chars"),
                 (F.col("action") == "block").alias("blocks"),
                 F.concat("host", "path").alias("rule"),
                 F.col("action").alias("verdict")).alias("found"),
    ).withColumn("prefix", F.substring("rule_digest", 1, prefix_digits))

    host, path = host_and_path(F.col(url))
    parts = urls.select(F.col(key), host.alias("host"), path.alias("path"))
    expressions = parts.select(
        "host", "path", F.split("host", r"\.").alias("parts")).select(
        "host", "path", "parts", F.explode(F.expr(
            f"filter({shapes}, s -> s.labels <= size(parts) and s.chars <= length(path))"
        )).alias("s")).select(
        "host", "path", _digest(
            F.array_join(F.expr("slice(parts, -s.labels, s.labels)"), "."),
            F.expr("left(path, s.chars)")).alias("digest"))
    expressions = expressions.withColumn("prefix", F.substring("digest", 1, prefix_digits))
    best = written(expressions.join(rules, "prefix")
                   .where(F.col("digest") == F.col("rule_digest"))
                   .groupBy("host", "path").agg(F.max("found").alias("found")), "url-rules")
    return parts.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
