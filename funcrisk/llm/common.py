"""What the text operators share: reading, lower-casing, words, tables in the shared folder."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, null text as empty; other columns, whatever their names, stay out of the work."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the short way is for texts without other letters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, line feed, vertical tab, form feed, return."""
    core = F.btrim(text, F.lit(WHITE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, a local master gets the context's or a new one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    return root.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: worked out once, cut from its lineage, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def among(rows: DataFrame, some: DataFrame, number: str, words: int = 1 << 18) -> DataFrame:
    """The rows whose number, a 64-bit hash, is in `some`, which has each once. Every task gets a table of at most `words`
    words of 64 bits, where each of `some` sets one, so that of the other rows only those move whose bit is set by chance."""
    place = F.pmod(F.col(number), F.lit(64 * words))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    bits = some.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits"))
    met = rows.join(F.broadcast(bits), word == F.col("_word")).filter(F.getbit("_bits", bit) == 1).drop("_word", "_bits")
    # A semi-join would be pushed below the one with the bits.
    return met.join(some, number)


def parts_for(docs: DataFrame, bytes_each: int) -> int:
    """Parts of about so many bytes of text each, one at least: one pass over the lengths."""
    total = docs.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / bytes_each))
