"""URL filter rules by host suffix and path prefix, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT_HEX = 8
LENGTHS_PER_ROW = 1_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for a null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _digested(rules: DataFrame) -> DataFrame:
    """Rules with their digest, its short prefix and their shape (labels of the host, length of the path).

    One rule text with two verdicts blocks.
    """
    rule = F.concat("host", "path")
    return (
        rules.dropna(subset=["host", "path", "verdict"])
        .groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(
            F.concat("rule_host", "rule_path").alias("rule"),
            "rule_verdict",
            F.size(F.split("rule_host", r"\.")).alias("labels"),
            F.length("rule_path").alias("path_length"),
            F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"),
        )
        .withColumn("short", F.substring("rule_digest", 1, SHORT_HEX))
    )


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    rules: host, path, verdict ('allow' or 'block'). A rule fits its host and all subdomains if the URL's
    path starts with the rule's path. The longest rule text wins, of equally long ones the one with the
    longer host; a URL that no rule fits gets ``default``.

    Every URL is expanded only into host suffixes and path prefixes of shapes that some rule has: number
    of host labels and, for that number, length of path. This leaves out no match, and neither long paths nor rule lists
    need a cap. The shapes are a small table that is broadcast: n different lengths of one number of labels
    take n^2 / 2 characters of rules, so it grows with the square root of the rules.
    Each distinct URL is judged once. Null URLs have an empty host and path and get ``default``.
    Columns named host, path, rule or verdict in ``urls`` are replaced.
    """
    rules = _digested(rules)
    counts = ",".join(str(row.labels) for row in rules.select("labels").distinct().collect())
    shapes = rules.groupBy(F.col("labels").alias("__for"), F.expr(f"path_length div {LENGTHS_PER_ROW}")).agg(F.collect_set("path_length").alias("__lengths")).select("__for", "__lengths")
    host, path = host_and_path(F.col(f"`{url}`"))
    distinct = urls.select(F.col(f"`{url}`").alias("__url")).filter(F.col("__url").isNotNull()).distinct()
    d_host, d_path = host_and_path(F.col("__url"))
    expanded = (
        distinct.withColumns({"__host": d_host, "__path": d_path})
        .withColumns({"__labels": F.split("__host", r"\."), "__size": F.length("__path")})
        .withColumn("__count", F.explode(F.expr(f"filter(cast(array({counts}) AS array<int>), n -> n <= size(__labels))")))
        .join(F.broadcast(shapes), F.col("__count") == F.col("__for"))
        .withColumn("__length", F.explode(F.expr("filter(__lengths, n -> n <= __size)")))
        .select(
            "__url",
            F.expr("array_join(slice(__labels, -__count, __count), '.')").alias("suffix"),
            F.expr("substring(__path, 1, __length)").alias("prefix"),
        )
        .withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
        .withColumn("short", F.substring("digest", 1, SHORT_HEX))
    )
    best = (
        expanded.join(rules, "short")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("__url")
        .agg(F.max(F.struct(F.length("rule").alias("size"), F.length("suffix").alias("host_size"), "rule", "rule_verdict")).alias("best"))
        .select("__url", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    )
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict") or c == url]
    left = urls.select(*[f"`{c}`" for c in kept], host.alias("__out_host"), path.alias("__out_path"), F.col(f"`{url}`").alias("__key"))
    out = left.join(best, left["__key"] == best["__url"], "left")
    return out.select(
        *[left[f"`{c}`"] for c in kept if c not in ("host", "path", "rule", "verdict")],
        F.col("__out_host").alias("host"),
        F.col("__out_path").alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
