"""URL rules by hashed host suffixes and path prefixes (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of the digest that rules are looked up by: 32 bits


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the path starts
    with the rule's. The longest fitting rule decides (host and path together; among equals the
    longer host, then ``block``); where none fits, ``rule`` is null and ``verdict`` is ``default``.

    Each distinct URL is expanded into host suffixes times path prefixes, of those lengths only
    that rules have. The expressions meet the rules by the first 32 bits of their SHA-256; what
    meets is kept if the whole digest agrees. The rules' side carries no hint: Spark broadcasts it
    when its size is below the session's threshold and shuffles it else, where AQE splits hot
    prefixes.

    Null URLs and URLs without ``://`` have empty parts and the default verdict. Rows that repeat
    stay repeated. Other columns are kept, but columns named like the four results are replaced.
    """
    lengths = rules.agg(
        F.collect_set(F.length("path")).alias("paths"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels")
    ).first()
    paths, labels = sorted(lengths["paths"]), sorted(lengths["labels"])
    known = rules.where("host is not null and path is not null").select(
        F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"), F.length("host").alias("_hosts"),
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("_rule_digest"),
    ).withColumn("_short", F.substring("_rule_digest", 1, SHORT))

    host, path = url_parts(F.col("_url"))
    urls = pages.select(F.col(url).alias("_url")).distinct().where("_url is not null")
    urls = urls.select("_url", host.alias("_host"), path.alias("_path"))
    names = F.split("_host", r"\.")
    suffixes = F.filter(
        F.array(*[F.when(F.size(names) >= n, F.array_join(F.slice(names, -n, n), ".")) for n in labels])
        if labels else F.array().cast("array<string>"), lambda x: x.isNotNull(),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in paths])
        if paths else F.array().cast("array<string>"), lambda x: x.isNotNull(),
    )
    asked = (
        urls.select("_url", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
        .select("_url", F.explode(F.transform(
            "_prefixes", lambda p: F.sha2(F.concat(F.col("_suffix"), F.lit("\n"), p), 256))).alias("_digest"))
        .withColumn("_short", F.substring("_digest", 1, SHORT))
    )
    found = asked.join(known, "_short").where("_digest = _rule_digest")
    best = found.groupBy("_url").agg(F.max(F.struct(
        F.length("_rule").alias("n"), F.col("_hosts").alias("hosts"), (F.col("_verdict") == "block").alias("block"),
        F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"),
    )).alias("_best"))
    # A second key makes Spark shuffle both sides for this join alone, so that AQE may split a hot URL.
    best = best.withColumn("_key", F.xxhash64("_url")).withColumnRenamed("_url", "_url_of_rule")
    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    left = pages.select(
        *[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"), F.xxhash64(url).alias("_row_key"),
        F.col(url).alias("_row_url"),
    )
    joined = left.join(
        best, (left["_row_key"] == best["_key"]) & (left["_row_url"] == best["_url_of_rule"]), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
