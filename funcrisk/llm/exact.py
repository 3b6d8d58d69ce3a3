"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import ascii_lower, keep, texts

# A chunk has at least MIN characters and ends after the next white space that follows one of ANCHOR's letters; where
# none follows within MAX, it ends there. Only the text around a cut decides on it, so equal passages cut alike.
MIN_CHARS, MAX_CHARS, ANCHOR = 1024, 8192, "dlmry"


def chunks(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """The text as an array of chunks that give it back when joined; an empty text has one empty chunk."""
    pattern = rf"(?s).{{{low},{high}}}?(?<=[{ANCHOR}]\s)|.{{1,{high}}}"
    return F.when(F.char_length(text) <= low, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def doubled_hashes(pieces: DataFrame) -> Column:
    """The hashes that stand for more than one text, as one array; by chance alone it is empty below about 10^9 chunks.

    Equal chunks fold where they are made, so a copied passage moves once per task, and each distinct text moves once.
    """
    distinct = pieces.groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n"))
    doubled = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    return doubled.agg(F.collect_list("hash").alias("hashes")).scalar()


def recipes(docs: DataFrame, low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """doc_id, text_sha256 and recipe: the ordered identifiers of the text's chunks.

    An identifier is the chunk's 64-bit hash, verified by comparing the texts of all chunks that have it; where a hash
    has several texts, it is followed by the chunk's SHA-256.
    """
    cut = texts(docs).withColumn("text", ascii_lower(F.col("text"))).select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text"), low, high).alias("_chunks"))
    pieces = cut.select(F.explode("_chunks").alias("chunk")).withColumn("hash", F.xxhash64("chunk"))
    marked = cut.withColumn("_doubled", doubled_hashes(pieces))

    def identifier(c: Column) -> Column:
        h = F.xxhash64(c)
        return F.when(F.array_contains("_doubled", h), F.concat(F.hex(h), F.sha2(c, 256))).otherwise(F.hex(h))

    return marked.select("doc_id", "text_sha256", F.array_join(F.transform("_chunks", identifier), ",").alias("recipe"))


def exact_dedup(docs: DataFrame, low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and all empty texts are equal. Groups
    are formed on whole recipes. Of equal rows the largest doc_id stays; null ids lose to any other. Rows that repeat id
    and text are both marked kept, and both count. Other columns of docs are left out.

    Texts move once, as distinct chunks; from then on only recipes do. Groups are counted where rows are before they
    move, and meet the rows again in a join whose hot keys Spark splits.
    """
    kept = keep(recipes(docs, low, high), "recipes")
    groups = kept.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    alone = F.col("group_size").isNull()
    out = kept.join(groups, "recipe", "left").withColumns(
        {"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
