"""Allow/block lists over URLs by hash-prefix lookup, in DataFrame operations only.

Every URL is expanded into the expressions a rule could equal: each host suffix joined with each
path prefix. Only suffixes of at most as many labels as any rule host has, and prefixes as long as
some rule path, can match, so an URL makes a fixed small number of expressions. They are equi-joined
with the rules on the first four bytes of their SHA-256, confirmed on the full digest, and the
longest rule wins (ties: longer host, then block before allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Rules up to this number are sent to every task; longer lists are joined by shuffle.
BROADCAST_RULES = 200_000
OUT = ("host", "path", "rule", "verdict")


def _rule_table(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    table = df.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string").select(
        F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict", F.length("rule_host").alias("host_length"), F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest")
    )
    table = table.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    return F.broadcast(table) if len(rules) <= BROADCAST_RULES else table


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``df``, one row out per row in.

    Null URLs and URLs without ``://`` have an empty host and path, match no rule and get
    ``default``; they take no part in any join, so a table of nothing but nulls is no hot key. Each
    distinct host and path is looked up once, however often it comes; only those that a rule fits
    come back, and ties of equal length go to the longer host, then to block. Long URLs make no more
    expressions than short ones. Repeated rows stay, an empty table stays empty. Columns of ``df``
    named host, path, rule or verdict are replaced; any other name is free.
    """
    kept = [c for c in df.columns if c not in OUT or c == url]
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    back = [F.col(f"row.`{c}`").alias(c) for c in kept if c not in OUT]
    none = [F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not rules:
        return base.select(*back, "host", "path", *none)
    labels = max(h.count(".") + 1 for h, _, _ in rules)
    lengths = sorted({len(p) for _, p, _ in rules})

    parts = F.split("host", r"\.", -1)
    most = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.filter(F.array(*[F.substring("path", 1, n) for n in lengths]), lambda p: F.length(p) > 0)
    if 0 in lengths:
        prefixes = F.array_union(prefixes, F.array(F.lit("")))
    prefixes = F.array_distinct(prefixes)
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p), 256))))
    hosted = base.where("host <> ''")
    looked_up = hosted.select("host", "path").distinct().withColumn("digest", F.explode(expressions)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    hits = looked_up.join(_rule_table(df, rules), "short").where("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("length"), "host_length", (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict")).alias("best"))
    judged = hosted.join(best, ["host", "path"], "left").select(*back, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(base.where("host = ''").select(*back, "host", "path", *none))
