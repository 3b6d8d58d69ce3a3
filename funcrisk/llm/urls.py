"""URL filters: host-suffix and path-prefix expressions, met with rules on short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import ascii_lower

# verdict, host, path
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SHORT = 8  # hex digits of the prefix that is joined on: 32 bits


def rule_table(docs: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rule, verdict, digest, short and rank; a higher rank wins: the longer rule, then block before allow, then the text."""
    order = sorted({(len(h) + len(p), v == "block", h + p, v) for v, h, p in rules})
    rows = [(rank, rule, verdict) for rank, (_, _, rule, verdict) in enumerate(order)]
    table = docs.sparkSession.createDataFrame(rows, "rank int, rule string, verdict string")
    return table.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, SHORT))


def expressions(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """All host suffixes, as deep as any rule's host, with all path prefixes as long as some rule's path."""
    depth = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    lengths = sorted({len(p) for _, _, p in rules})
    # The last `depth` labels are all that can meet a rule; substring_index counts from the right.
    n_labels = F.octet_length(host) - F.octet_length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = [F.when(n_labels >= k, F.substring_index(host, ".", -k)) for k in range(1, depth + 1)]
    prefixes = [F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.filter(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes]), lambda x: x.isNotNull())


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow",
                 id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, the rule that wins and the verdict; without a rule, the default.

    Null or scheme-less urls have an empty host and path and get the default. A number per row keeps repeated
    rows apart; expressions are pre-aggregated where they are made, so a hot host moves one row per page at most.
    The rule side is joined by size: broadcast only where Spark knows it to be small.
    """
    if not rules:
        raise ValueError("url_verdicts needs at least one rule")
    url = F.coalesce(F.col(url_col), F.lit(""))
    base = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("page_id"),
        ascii_lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    table = rule_table(pages, rules)
    wide = base.withColumn("expr", F.explode_outer(expressions(F.col("host"), F.col("path"), rules)))
    wide = wide.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    met = wide.alias("a").join(table.select("short", F.col("digest").alias("full"), "rank").alias("b"), "short", "left")
    confirmed = F.when(F.col("digest") == F.col("full"), F.col("rank"))
    best = met.groupBy("_row", "page_id", "host", "path").agg(F.max(confirmed).alias("rank"))
    return best.join(table.select("rank", "rule", "verdict"), "rank", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
