"""Score post-processing, tiers and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from funcrisk import constants as C


def boosted_score(score: Column, cwe: Column, boost: float = 0.3, cap: float = 0.95) -> Column:
    """A labelled function's score rises by boost but ends at cap, even where it was higher."""
    return F.when(F.size(F.coalesce(cwe, F.array().cast("array<string>"))) > 0,
                  F.least(score + boost, F.lit(cap))).otherwise(score)


def risk_tier(score: Column, threshold: float) -> Column:
    return (
        F.when(score >= threshold + 0.2, "high")
        .when(score >= threshold, "above_threshold")
        .when(score >= threshold * 0.7, "medium")
        .otherwise("low")
    )


def tier_order(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in C.TIERS]), tier)


def evidence() -> Column:
    """Reasons why a function looks risky, from its feature columns; never empty."""
    flag = lambda c: F.coalesce(F.col(c) >= 0.5, F.lit(False))
    reasons = F.array(
        F.when(F.col("num_dangerous_calls") > 0,
               F.format_string(C.EVIDENCE_DANGEROUS, F.col("num_dangerous_calls").cast("double"))),
        *[F.when(flag(f"has_{n}"), F.lit(C.EVIDENCE_SIGNAL % n)) for n in ("strcpy", "sprintf", "memcpy")],
        F.when(F.col("entropy") > 7.0,
               F.format_string(C.EVIDENCE_ENTROPY, F.col("entropy").cast("double"))),
        F.when(F.col("cyclomatic_complexity") > 12,
               F.format_string(C.EVIDENCE_COMPLEXITY, F.col("cyclomatic_complexity").cast("double"))),
        F.when(F.col("has_input_validation") < 0.5, F.lit(C.EVIDENCE_VALIDATION)),
        F.when((F.col("has_output_sanitization") < 0.5) & flag("has_sprintf"),
               F.lit(C.EVIDENCE_SANITIZATION)),
    )
    found = F.array_except(reasons, F.array(F.lit(None).cast("string")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(C.EVIDENCE_DEFAULT)))
