"""Predictions turned into ranked findings and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.calls import omit_asm_text
from funcrisk.functions.risk import evidence, risk_tier, tier_order
from funcrisk.functions.text import empty_strings
from funcrisk.scale import number_rows, top_per_key


def to_findings(
    predictions: DataFrame, functions: DataFrame, max_asm_chars: int | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One finding per prediction, with what is known of its function and the prediction's columns in keep."""
    asm = F.col("disassembly") if max_asm_chars is None else F.substring("disassembly", 1, max_asm_chars)
    have = set(functions.columns)
    optional = {
        "source_file": "string", "line_start": "bigint", "line_end": "bigint",
        "has_source_mapping": "boolean", "resolved_source_path": "string", "llm_trace": "string",
        "source_snippet": "struct<resolved_path:string,lines:array<string>>", "address": "string",
    }
    info = functions.select(
        *C.KEY, "func_ordinal", "name", "disassembly",
        *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in optional.items()],
    )
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return predictions.join(info, C.KEY, "left").select(
        *C.KEY,
        F.coalesce("func_ordinal", F.lit(0).cast("bigint")).alias("func_ordinal"),
        F.coalesce(blank("name"), F.col("func_id")).alias("name"),
        "score", "is_vulnerable",
        F.coalesce("cwe", empty_strings()).alias("cwe"),
        "address", "source_file", "line_start", "line_end",
        F.coalesce("has_source_mapping", F.lit(False)).alias("has_source_mapping"),
        F.coalesce(blank("resolved_source_path"), F.col("source_snippet.resolved_path")).alias("resolved_source_path"),
        "source_snippet",
        F.nullif(asm, F.lit("")).alias("disassembly"),
        "llm_trace", *keep,
    )


def has_snippet() -> Column:
    return F.coalesce(F.size("source_snippet.lines") > 0, F.lit(False))


def _score_order() -> list[Column]:
    return [F.col("score").desc(), F.col("func_ordinal")]


def rank_findings(
    predictions: DataFrame, functions: DataFrame, max_rows: int | None = None, source_only: bool = False
) -> DataFrame:
    """Ranked findings per image, all or the first max_rows: readable source first, then any source file, then by score.

    All of them are numbered in buckets that follow the order, so that an image is not one task's work. Only keys and sort columns are ranked; texts and snippets join the winners afterwards.
    """
    have = set(functions.columns)
    slim = functions.select(
        *C.KEY, "func_ordinal",
        (has_snippet() if "source_snippet" in have else F.lit(False)).alias("_snippet"),
        (F.coalesce(F.col("source_file") != "", F.lit(False)) if "source_file" in have else F.lit(False)).alias("_file"),
        (F.coalesce("has_source_mapping", F.lit(False)) if "has_source_mapping" in have else F.lit(False)).alias("_mapped"),
    )
    rows = predictions.join(slim, C.KEY, "left")
    if source_only:
        rows = rows.filter("_mapped")
    order = [F.coalesce("_snippet", F.lit(False)).desc(), F.coalesce("_file", F.lit(False)).desc(), *_score_order()]
    if max_rows is None:
        late = lambda c, n: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(n)
        below = F.floor((1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))) * 1023)
        bucket = late("_snippet", 2048) + late("_file", 1024) + F.coalesce(below, F.lit(1023))
        best = number_rows(rows, ["firmware_id"], bucket, [*order, F.col("func_id")], "rank")
    else:
        best = top_per_key(rows, ["firmware_id"], [*order, F.col("func_id")], max_rows, ["func_id"])
    return to_findings(best.select(*predictions.columns, "rank"), functions, keep=["rank"])


def top_by_score(findings: DataFrame, n: int = 25) -> DataFrame:
    return top_per_key(findings, ["firmware_id"], _score_order(), n, ["func_id"], "score_rank")


def near_threshold(predictions: DataFrame, threshold: float, n: int = 15) -> DataFrame:
    """The best functions per image that just miss the threshold."""
    near = predictions.filter(~F.col("is_vulnerable") & (F.col("score") >= threshold * 0.85))
    return top_per_key(near, ["firmware_id"], _score_order(), n, ["func_id"])


def flagged_detail(
    predictions: DataFrame, functions: DataFrame, matrix: DataFrame, threshold: float,
    labels: DataFrame | None = None, max_asm_lines: int | None = None, max_strings: int | None = None,
) -> DataFrame:
    """Every flagged function with its facts and the evidence, sorted by image and score."""
    flagged = predictions.filter("is_vulnerable")
    strings = F.array_join("strings", ", ")
    if max_strings is not None:
        cut = F.concat(F.array_join(F.slice("strings", 1, max_strings), ", "), F.lit(" …"))
        strings = F.when(F.size("strings") > max_strings, cut).otherwise(strings)
    facts = functions.select(
        *C.KEY, "func_ordinal", "name", "address", "size", "instructions", "calls",
        strings.alias("strings"),
        (F.col("disassembly") if max_asm_lines is None else omit_asm_text(F.col("disassembly"), max_asm_lines)).alias("disassembly"),
    )
    reasons = matrix.select(*C.KEY, evidence().alias("evidence"))
    rows = flagged.join(facts, C.KEY, "left").join(reasons, C.KEY, "left")
    shown = F.col("cwe")
    if labels is not None:
        rows = rows.join(labels.select(*C.KEY, F.col("cwe").alias("_labels")), C.KEY, "left")
        shown = F.coalesce("_labels", "cwe")
    return rows.select(
        *C.KEY, F.coalesce("name", "func_id").alias("name"), "score", F.lit(threshold).alias("threshold"),
        "address", "size", "instructions", F.array_join("calls", ", ").alias("calls"), "strings",
        F.array_join(shown, ", ").alias("cwe"), "disassembly", "evidence", "func_ordinal",
    ).orderBy("firmware_id", F.col("score").desc(), "func_ordinal")


def findings_grid(findings: DataFrame) -> DataFrame:
    """Findings as the short texts of a results table."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))
    path = F.coalesce(F.nullif("resolved_source_path", F.lit("")), F.nullif("source_file", F.lit("")), F.lit("—"))
    start, end = F.col("line_start"), F.col("line_end")
    span = F.when(
        F.coalesce(end, F.lit(0)) != 0,
        F.when(end != start, F.concat_ws("-", start.cast("string"), end.cast("string"))),
    )
    line = F.coalesce(span, start.cast("string"), F.lit(""))
    return findings.select(
        *C.KEY,
        F.format_string("%.3f", F.col("score")).alias("score"),
        F.when(F.col("is_vulnerable"), "VULN").otherwise("ok").alias("status"),
        "name",
        F.when(has_snippet(), "yes").otherwise("no").alias("source"),
        F.substring(F.substring_index(path, "/", -1), 1, 40).alias("file"),
        dash(F.when(start.isNotNull(), line)).alias("line"),
        dash(F.array_join(F.slice("cwe", 1, 3), ", ")).alias("cwe"),
    )


def cwe_rollup(predictions: DataFrame) -> DataFrame:
    """(firmware_id, cwe, functions, description): how many functions carry each id."""
    description = F.coalesce(
        F.create_map(*[F.lit(x) for kv in C.CWE_DESCRIPTIONS.items() for x in kv])[F.col("cwe")], F.lit("")
    )
    return (
        predictions.select("firmware_id", F.explode("cwe").alias("cwe"))
        .groupBy("firmware_id", "cwe").agg(F.count(F.lit(1)).alias("functions"))
        .withColumn("description", description)
    )


def top_cwe(predictions: DataFrame, n: int = 15) -> DataFrame:
    rows = cwe_rollup(predictions).select("firmware_id", "cwe", "functions")
    return top_per_key(rows, ["firmware_id"], [F.col("functions").desc(), F.col("cwe")], n, ["cwe"])


def tier_lists(predictions: DataFrame, functions: DataFrame, threshold: float) -> DataFrame:
    """Functions by image and tier, best score first.

    One row per function in a range-sorted table: a tier of a large image is a stretch of rows
    over many tasks, never one list.
    """
    tier = risk_tier(F.col("score"), threshold)
    return (
        predictions.join(functions.select(*C.KEY, "func_ordinal"), C.KEY, "left")
        .select(*C.KEY, tier.alias("tier"), tier_order(tier).alias("tier_order"), "score", "func_ordinal")
        .orderBy("firmware_id", "tier_order", F.col("score").desc(), "func_ordinal")
    )


def tier_counts(predictions: DataFrame, threshold: float) -> DataFrame:
    tier = risk_tier(F.col("score"), threshold)
    return predictions.groupBy("firmware_id", tier.alias("tier")).agg(F.count(F.lit(1)).alias("functions"))


def analysis_summary(functions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per image: functions, how many map to source, how many show it, how many are flagged.

    All functions count, not only those that make the ranked list.
    """
    have = set(functions.columns)
    mapped = F.coalesce("has_source_mapping", F.lit(False)) if "has_source_mapping" in have else F.lit(False)
    shown = has_snippet() if "source_snippet" in have else F.lit(False)
    totals = functions.groupBy("firmware_id").agg(
        F.count(F.lit(1)).alias("functions_total"),
        F.count_if(mapped).alias("functions_with_source"),
        F.count_if(shown).alias("functions_with_snippet"),
    )
    flagged = predictions.groupBy("firmware_id").agg(F.count_if("is_vulnerable").alias("vulnerable_count"))
    return totals.join(flagged, "firmware_id", "left").withColumn(
        "vulnerable_count", F.coalesce("vulnerable_count", F.lit(0))
    )
