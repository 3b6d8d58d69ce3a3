"""Scores without a fitted model, and the flags every score gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.risk import boosted_score
from funcrisk.functions.text import empty_strings
from funcrisk.scale import join_per_key, keep_table


def rule_score(matrix: DataFrame, constant: str = "raw", materialize: bool = True) -> DataFrame:
    """The matrix with score: six features scaled within the image, weighted, through a sigmoid.

    The ranges are one row per image from partial aggregates, so a large image costs no window.
    A feature that is constant in an image counts with its raw value, or not at all with
    constant="zero". The rows are needed twice, for the ranges and for the scores; materialize
    writes them to a table in the shared folder first, so that texts are not read for features twice.
    """
    if materialize:
        matrix = keep_table(matrix, "rule-score")
    features = [c for c in C.RULE_WEIGHTS if c in matrix.columns]
    ranges = matrix.groupBy("firmware_id").agg(
        *[f(F.col(c)).alias(f"_{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]
    )
    total = F.lit(0.0)
    for c in features:
        lo, hi, value = F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), F.col(c).cast("double")
        flat = value if constant == "raw" else F.lit(0.0)
        total = total + F.when(hi > lo, (value - lo) / F.nullif(hi - lo, F.lit(0))).otherwise(flat) * C.RULE_WEIGHTS[c]
    if {"entropy", "num_dangerous_calls"} <= set(matrix.columns):
        alarming = (F.col("entropy") > 7.0) & (F.col("num_dangerous_calls") > 0)
        total = total + F.when(alarming, F.lit(0.15)).otherwise(F.lit(0.0))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) / (F.lit(1.0) + F.exp(total * -2.0))))
    helpers = [f"_{n}_{c}" for c in features for n in ("lo", "hi")]
    return join_per_key(matrix, ranges, ["firmware_id"]).withColumn("score", score).drop(*helpers)


def boost_and_flag(
    scored: DataFrame, labels: DataFrame | None = None, threshold: float = 0.7, boost: float = 0.3
) -> DataFrame:
    """(firmware_id, func_id, score, cwe, is_vulnerable) from (firmware_id, func_id, score)."""
    rows = scored.select(*C.KEY, "score")
    if labels is None:
        rows = rows.withColumn("cwe", empty_strings())
    else:
        rows = rows.join(labels.select(*C.KEY, "cwe"), C.KEY, "left").withColumn(
            "cwe", F.coalesce("cwe", empty_strings())
        )
    final = boosted_score(F.col("score"), F.col("cwe"), boost)
    return rows.withColumn("score", final).withColumn("is_vulnerable", F.col("score") >= threshold)
