"""URL rules by hashed host-suffix and path-prefix expressions; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for text without '://'."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def judge_urls(pages: DataFrame, rules: DataFrame, keys: list[str], url: str = "url", default: str = "allow",
               prefix_chars: int = 8) -> DataFrame:
    """The key columns, host, path, rule and verdict of every page.

    rules (host, path, verdict): a rule fits its host and all hosts below it where the path starts with the
    rule's path. Each URL is expanded into the host suffixes and path prefixes as long as those of some
    rule; an expression meets rules of the same short hash prefix, and the whole SHA-256 confirms them. The
    rule with the most characters wins, block before allow among equals. Without a rule the verdict is
    `default`.

    Work is done once for each distinct (host, path), so copies of a URL are judged together. Null and
    malformed URLs have an empty host and no rule. Null or repeated keys, and other columns, don't matter.
    No rules, or no pages, are no special case. The driver sees only which label counts and path lengths
    the rules have.
    """
    host, path = host_and_path(F.col(url))
    located = pages.select(*keys, host.alias("host"), path.alias("path"))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2("rule", 256))
    shape = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
                      F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels, lengths = sorted(shape.labels), sorted(shape.lengths)
    suffixes = [F.when(F.size("parts") >= n, F.array_join(F.slice("parts", -n, n), ".")) for n in labels]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    no = F.array().cast("array<string>")
    distinct = located.select("host", "path").where("host <> ''").distinct()
    expressions = (distinct.withColumn("parts", F.split("host", r"\."))
                   .withColumn("suffix", F.explode(F.array_compact(F.array(*suffixes)) if suffixes else no))
                   .withColumn("prefix", F.explode(F.array_compact(F.array(*prefixes)) if prefixes else no))
                   .select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("own")))
    short = expressions.withColumn("short", F.substring("own", 1, prefix_chars))
    fits = short.join(rules.withColumn("short", F.substring("digest", 1, prefix_chars)), "short").where("own = digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"),
                                                           "rule", "rule_verdict")).alias("best"))
    return located.join(best, ["host", "path"], "left").select(
        *keys, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
