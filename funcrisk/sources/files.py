"""Firmware images and source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcrisk.functions.text import split_lines
from funcrisk.operators.sourcemap import parent_name, stem

SOURCE_SUFFIXES = ["c", "cpp", "cc", "cxx", "h", "hpp", "ino"]


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """All *.elf files below a folder: path, content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.elf")
        .load(folder).select("path", "content")
    )


def firmware_manifest(files: DataFrame, source: str = "unknown") -> DataFrame:
    """One row per distinct path(path, content, source?): names, size, hashes and file type."""
    path = F.regexp_replace("path", "^file:/*", "/")
    origin = F.col("source") if "source" in files.columns else F.lit(source)
    content = F.col("content")
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.select(path.alias("path"), content, origin.alias("source"))
        .select(
            "path",
            name.alias("name"),
            stem(name).alias("stem"),
            parent_name(F.col("path")).alias("parent"),
            "source",
            F.length(content).cast("bigint").alias("size"),
            F.md5(content).alias("md5"),
            F.sha2(content, 256).alias("sha256"),
            (F.hex(F.substring(content, 1, 4)) == "7F454C46").alias("is_elf"),
            F.when(F.length(content) > 0, "xtensa").alias("architecture"),
            F.lit("little").alias("endianness"),
            F.lit(32).alias("bitness"),
        )
        .dropDuplicates(["path"])
        .withColumn("firmware_id", F.sha2(F.concat_ws("|", "path", "sha256"), 256))
    )


def read_source_files(spark: SparkSession, folder: str) -> DataFrame:
    """The source files below a folder: path, content."""
    glob = "*.{" + ",".join(SOURCE_SUFFIXES + [s.upper() for s in SOURCE_SUFFIXES]) + "}"
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    )


def source_files(files: DataFrame) -> DataFrame:
    """(path, lines) from (path, content) bytes or (path, text); bad bytes become U+FFFD."""
    if "content" in files.columns:
        text = F.make_valid_utf8(F.col("content").cast("string"))
    else:
        text = F.col("text")
    return files.select("path", split_lines(text).alias("lines"))


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text), lines counted from 1."""
    return source_files(files).select(
        "path", F.posexplode("lines").alias("_pos", "text")
    ).select("path", (F.col("_pos") + 1).alias("line_no"), "text")
