"""URL filters: host-suffix and path-prefix expressions met through short hash prefixes, then full digests and precedence.

Every distinct (host tail, path head) of the input is expanded once into all expressions that a rule could name: each
suffix of the host at a label border, up to the longest rule host, and each prefix of the path at a length that some
rule path has. Expressions and rules meet on the first four bytes of a SHA-256, full digests confirm, and the longest
rule wins. The verdicts then go back to the rows by one equi-join, whose hot side Spark may split.

Defined results: a null URL, or one without "://", has empty host and path; a URL no rule fits gets rule null and the
default verdict; rules of equal length: the longer host wins, then `block`, then the smaller text; a rule given twice
counts once; an empty table gives an empty table. Repeated rows are each judged; input columns with the names of the four results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that rules and expressions meet on.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """What stands after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, "host/path") pairs as a table: rule, rule_host, rule_path, verdict, digest, prefix."""
    listed = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules)) if rules else F.expr("array()").cast("array<struct<verdict:string,rule:string>>")
    return with_digests(spark.range(1).select(F.inline(listed)))


def with_digests(rules: DataFrame) -> DataFrame:
    """The rules (verdict, rule) split at their first "/", with digests; equal rules are one."""
    host = F.substring_index("rule", "/", 1)
    return (
        rules.where("rule IS NOT NULL AND verdict IS NOT NULL")
        .select("rule", host.alias("rule_host"), F.substr("rule", F.length(host) + 1).alias("rule_path"), "verdict", F.sha2("rule", 256).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .distinct()
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (null if none fits) and verdict; `rules` as `rule_table` makes them."""
    bounds = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.length("rule_path")), F.array_sort(F.collect_set(F.length("rule_path")))).first()
    labels, longest, lengths = bounds[0] or 1, bounds[1] or 0, bounds[2] or []
    own = pages.drop("_tail", "_head", "_key", "_best", *(c for c in ("host", "path", "rule", "verdict") if c != url))
    parsed = own.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    parsed = parsed.withColumns({"_tail": F.substring_index("host", ".", -labels), "_head": F.substring("path", 1, longest)})
    sites = parsed.select("_tail", "_head").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(_tail, '[.]'))), k -> substring_index(_tail, '.', -k))")
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_head")), lambda n: F.substr(F.col("_head"), F.lit(1), n))
    expressions = (
        sites.withColumn("_suffix", F.explode(F.array_distinct(suffixes)))
        .select("_tail", "_head", F.explode(F.transform(heads, lambda p: F.sha2(F.concat("_suffix", p), 256))).alias("_digest"))
        .withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    )
    rank = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), (F.col("verdict") == "block").alias("b"))
    met = expressions.join(rules, F.col("_prefix") == F.col("prefix")).where("_digest = digest")
    best = met.groupBy("_tail", "_head").agg(F.max_by(F.struct("rule", "verdict"), F.struct(rank, F.col("rule"))).alias("_best"))
    # The third key makes the planner deal both sides anew, so that it can split a hot host.
    best = best.withColumn("_key", F.xxhash64("_tail", "_head"))
    joined = parsed.withColumn("_key", F.xxhash64("_tail", "_head")).join(best, ["_key", "_tail", "_head"], "left")
    return joined.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))}).drop("_key", "_tail", "_head", "_best")
