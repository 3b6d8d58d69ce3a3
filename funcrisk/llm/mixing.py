"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funcrisk.llm.common import keep, split_words

#: Parts of a source's permutation; exponents tried in one pass over the sources, and passes.
BUCKETS, SECTIONS, PASSES = 4096, 16, 6
SEED = 7


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected to meet; exactly one is given.

    repeats: the source that is shown most goes round at most so often as the one shown least.
    entropy: share of the highest possible entropy of the weights.
    """
    repeats: float | None = None
    entropy: float | None = None

    def __post_init__(self) -> None:
        if (self.repeats is None) == (self.entropy is None):
            raise ValueError("give repeats or entropy")


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """_row (all columns of docs), doc_id, _source (null is a source of its own), _tokens (words), _hash (place in the last
    pass) and _bucket (its first bits)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), "doc_id", F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")).alias("_source"),
        F.size(split_words(text)).cast("long").alias("_tokens"), F.xxhash64(F.lit(seed), F.lit(0), F.col("doc_id"), text).alias("_hash"),
    ).withColumn("_bucket", F.shiftrightunsigned("_hash", 52).cast("int"))


def solve_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent in [0, 1] whose weights p^e / sum meet the target, or the end of the range that comes nearest.

    Both figures fall as the exponent moves from 0 (all sources alike; most repeats, highest entropy) to 1 (as they are).
    One pass over the sources tries SECTIONS exponents at once; the driver gets one row of sums a pass.
    """
    total, n, low, high = sources.filter("tokens > 0").agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not n or n == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def figures(es: list[float]) -> list[float]:
        if target.repeats is not None:
            return [(high / low) ** (1 - e) for e in es]
        sums = [x for e in es for x in (F.sum(F.pow(share, F.lit(e))), F.sum(F.pow(share, F.lit(e)) * F.ln(share)))]
        row = sources.filter("tokens > 0").agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
        # With z = sum p^e, the entropy of p^e / z is ln z - e * sum(p^e ln p) / z.
        return [(math.log(row[2 * i]) - e * row[2 * i + 1] / row[2 * i]) / math.log(n) for i, e in enumerate(es)]

    goal = target.repeats if target.repeats is not None else target.entropy
    a, b = 0.0, 1.0
    for _ in range(PASSES):
        es = [a + (b - a) * i / SECTIONS for i in range(SECTIONS + 1)]
        above = [e for e, x in zip(es, figures(es)) if x > goal]
        if not above:
            return a
        if above[-1] >= b:
            return b
        a, b = above[-1], above[-1] + (b - a) / SECTIONS
    return b if target.repeats is not None else a


def weigh(sources: DataFrame, exponent: float, budget: int | None) -> DataFrame:
    """_source, weight, passes (whole ones) and extra (tokens of the last, partial pass).

    Without a budget it is the smallest in which every document is shown once. A source without tokens is shown once.
    """
    power = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    some = sources.filter("tokens > 0")
    z, most = some.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    total = float(budget) if budget is not None else (most or 0.0) * (z or 0.0)
    weight = F.when(F.col("tokens") > 0, power / F.lit(z or 1.0)).otherwise(F.lit(0.0))
    due = F.col("weight") * F.lit(total)
    # A part in 10^9 keeps rounding from turning one whole pass into almost one.
    passes = F.when(F.col("tokens") > 0, F.floor(due / F.col("tokens") + F.lit(1e-9))).otherwise(F.lit(1)).cast("int")
    extra = F.greatest(F.lit(0.0), due - F.col("passes") * F.col("tokens"))
    return sources.withColumn("weight", weight).withColumn("passes", passes).withColumn("extra", F.when(extra > 1e-6 * F.col("tokens"), extra).otherwise(F.lit(0.0)))


def mix_rows(docs: DataFrame, target: Target = Target(repeats=1.25), budget: int | None = None, seed: int = SEED) -> DataFrame:
    """Each row of docs, whole in _row, as often as its source's weight asks, with _tokens, _weight, _pass (from 0) and
    _order (place in that pass's permutation). Columns of docs may have any name.

    Weights are source token shares to a power that is bisected to meet the target. A source's share of the budget
    is shown in blocks: whole passes over all its rows, each in an order of its own, then a pass that ends where the
    budget does, after the row that reaches it. Null sources are one source, null texts have no tokens; rows without
    tokens, and sources of such rows, are shown in whole passes and wherever the last one reaches. Rows that repeat
    count as different rows. No rows give no rows.

    A permutation is cut into BUCKETS by hash, whose tokens are summed where rows are. Rows of whole buckets are decided
    by the sums; only those of the one bucket a source where its budget ends are ordered, so a hot source stays spread.
    """
    rows = keyed(docs, seed)
    buckets = keep(rows.groupBy("_source", "_bucket").agg(F.sum("_tokens").alias("n")), "buckets")
    sources = buckets.groupBy("_source").agg(F.sum("n").alias("tokens"))
    weighed = weigh(sources, solve_exponent(sources, target), budget)
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Buckets up to a source's border are in its last pass, those behind it are not: one row a source tells all.
    behind = (
        buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(weighed, "_source")
        .filter((F.col("before") >= F.col("extra")) | (F.col("before") + F.col("n") > F.col("extra")))
        .groupBy("_source").agg(F.min(F.struct(F.col("_bucket").alias("border"), "before")).alias("b"))
    )
    # As a kept table it is known to be small, so rows need not move to meet it.
    table = keep(weighed.join(behind, "_source", "left").select(
        "_source", F.col("weight").alias("_weight"), F.col("passes").alias("_passes"), F.col("extra").alias("_extra"),
        F.coalesce("b.border", F.lit(BUCKETS)).alias("_border"), F.coalesce("b.before", F.lit(0)).alias("_before")), "sources")
    met = rows.join(table, "_source")
    order = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ordered = (F.col("_bucket") == F.col("_border")) & (F.col("_before") < F.col("_extra"))
    decided = met.filter(~ordered).withColumn("_last", F.col("_bucket") < F.col("_border"))
    border = met.filter(ordered).withColumn("_last", F.col("_before") + F.coalesce(F.sum("_tokens").over(order), F.lit(0)) < F.col("_extra"))
    shown = decided.unionByName(border).withColumn("_copies", F.col("_passes") + F.col("_last").cast("int")).filter("_copies > 0")
    out = shown.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    place = F.when(F.col("_pass") == F.col("_passes"), F.col("_hash")).otherwise(F.xxhash64(F.lit(seed), F.col("_pass") + 1, F.col("_hash")))
    return out.withColumn("_order", place).select("_row", "_tokens", "_weight", "_pass", "_order")


def mix(docs: DataFrame, target: Target = Target(repeats=1.25), budget: int | None = None, seed: int = SEED) -> DataFrame:
    """mix_rows with the columns of docs beside _tokens, _weight, _pass and _order; a column of docs of such a name is left out."""
    added = ("_tokens", "_weight", "_pass", "_order")
    return mix_rows(docs, target, budget, seed).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


def mixture(docs: DataFrame, target: Target = Target(repeats=1.25), budget: int | None = None) -> DataFrame:
    """The mix without texts: doc_id, source, n_tokens, weight, pass, place; other columns of docs are left out."""
    narrow = docs.select("doc_id", "source", "text")
    return mix(narrow, target, budget).select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_pass").alias("pass"), F.col("_order").alias("place"))
