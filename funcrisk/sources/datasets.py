"""Training sets and findings on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcrisk import constants as C


MANIFEST = "firmware_id string, sha256 string"
# The folder an image's rows lie in; a text that reads as no number.
PART = "_image"


def save_dataset(matrix: DataFrame, labels: DataFrame, cwe: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """features, labels and cwe_labels below folder.

    Files hold ranges of (firmware_id, func_id): even in size whatever an image's share, and few
    of them to open for one image. fmt "csv" writes the first two as CSV, the lists as JSON lines; positions of ids are
    numbers with spaces between.
    """
    for name, df in (("features", matrix), ("labels", labels), ("cwe_labels", cwe)):
        if fmt == "csv" and name != "cwe_labels":
            lists = [c for c, t in df.dtypes if t.startswith("array")]
            df = df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in lists})
        writer = df.repartitionByRange(*C.KEY).sortWithinPartitions(*C.KEY).write.mode("overwrite")
        if fmt == "parquet":
            writer.parquet(f"{folder}/{name}")
        elif name == "cwe_labels":
            writer.json(f"{folder}/{name}")
        else:
            writer.option("header", True).csv(f"{folder}/{name}")


def new_images(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The rows of manifest(firmware_id, sha256, ...) whose image and content the data set in the folder does not hold."""
    if not _exists(spark, f"{folder}/manifest"):
        return manifest
    return manifest.join(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), ["firmware_id", "sha256"], "left_anti")


def add_images(matrix: DataFrame, labels: DataFrame, cwe: DataFrame, images: DataFrame, folder: str) -> None:
    """Writes the rows of the given images (firmware_id, sha256) into the data set, each image as partitions of its own.

    Partitions of images written before are replaced if given again and stay untouched otherwise. The manifest is
    written last: a run that ends before counts as not done, and its next run replaces what it left.
    """
    tables = {"features": matrix, "labels": labels, "cwe_labels": cwe, "manifest": images.select("firmware_id", "sha256").distinct()}
    for name, df in tables.items():
        # Ranges of the key: a large image is many tasks and files, small ones share a task.
        key = C.KEY if name != "manifest" else ["firmware_id"]
        placed = df.withColumn(PART, F.concat_ws("-", F.lit("image"), "firmware_id")).repartitionByRange(*key).sortWithinPartitions(*key)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{folder}/{name}")


def load_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """features, labels and cwe_labels of the images in the manifest; columns that an earlier run lacked are null there."""
    done = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("firmware_id")

    def read(name: str) -> DataFrame:
        rows = spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}").drop(PART)
        return rows.join(done, "firmware_id", "left_semi")

    return read("features"), read("labels"), read("cwe_labels")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_dataset(spark: SparkSession, folder: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of save_dataset, numbers as numbers."""
    if fmt == "parquet":
        return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("features", "labels", "cwe_labels"))
    features = spark.read.option("header", True).csv(f"{folder}/features")
    def value(c: str):
        if c != "cwe_positions":
            return F.col(f"`{c}`").cast("double").alias(c)
        return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "").cast("array<bigint>").alias(c)

    numbers = [value(c) for c in features.columns if c not in C.KEY]
    key = "firmware_id string, func_id string"
    labels = spark.read.schema(f"{key}, label int").option("header", True).csv(f"{folder}/labels")
    cwe = spark.read.schema(f"{key}, cwe array<string>").json(f"{folder}/cwe_labels")
    return features.select(*C.KEY, *numbers), labels, cwe


def write_findings(findings: DataFrame, top: DataFrame, run_info: DataFrame, folder: str) -> None:
    """All findings, the best of them and the run's facts as nested JSON below folder."""
    for name, df in (("predictions", findings), ("predictions_top_by_score", top), ("run_info", run_info)):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def read_findings(spark: SparkSession, folder: str, findings_schema) -> DataFrame:
    return spark.read.schema(findings_schema).json(f"{folder}/predictions")
