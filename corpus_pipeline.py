"""Documents to packed sequences: quality rules, exact and near deduplication, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcrisk.llm import common, exact, mixing, near, packing, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the verdict is a projection over the row, so nothing moves. A null text has no words and is
    rejected; other columns, of any name, come along."""
    whole = whole_rows(docs).drop("doc_id")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = quality.text_metrics(whole).withColumns({"_verdict": ~failed & quality.passes(quality.RULES), "_number": F.monotonically_increasing_id()})
    # The number keeps the filter above the projection: pushed below it, each metric would be worked out once per use.
    return judged.filter(F.col("_verdict") & (F.col("_number") >= 0)).select("_row.*")


def whole_rows(docs: DataFrame) -> DataFrame:
    """_row, doc_id and text (null as empty): all columns travel as one, so that none clashes with a stage's own."""
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; rows that repeat id and text are one document. A null id is
    the smallest, a null text is empty; other columns, of any name, come along."""
    number = F.coalesce(F.concat(F.lit("i:"), F.col("doc_id").cast("string")), F.lit("null")).alias("_id")
    stay = exact.exact_dedup(docs).filter("kept").select(number, F.col("text_sha256").alias("_sha"))
    # A text moves once, inside its row: digests stand for it in the join, after which equal rows already lie together.
    rows = whole_rows(docs).select("_row", number, F.sha2(common.ascii_lower(F.col("text")), 256).alias("_sha"), F.sha2("text", 256).alias("_exact"))
    return rows.join(stay, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha", "_exact"]).select("_row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, texts of 0.8 shingle similarity, one row stays: that of the smallest doc_id, null
    ids last, then by text. Candidates are pruned by their SimHash fingerprints. A null text is empty; other columns, of
    any name, come along."""
    label = common.keep(near.near_copies(docs), "near")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", near.row_number().alias("node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    placed = common.keep(rows.join(label, "node").select("label", order.alias("order"), "node"), "near-rows")
    first = placed.groupBy("label").agg(F.min("order").getField("node").alias("first"))
    gone = common.keep(placed.join(first, "label").filter("node != first").select("node").distinct(), "near-gone")
    return whole_rows(docs).withColumn("node", near.row_number()).join(gone, "node", "left_anti").select("_row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at least once; those of sources with a raised weight again, as far as the weights ask. Null sources
    are one source; columns may have any name."""
    return mixing.mix_rows(docs, mixing.Target(repeats=1.25)).select("_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder, which the next reads."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
