"""Joins, top-k and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 32


def join_per_key(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join big to small, where small has at most one row per key and big may have hot keys.

    Spark broadcasts small where it knows its bytes to be few, and splits hot keys of big at run time. With
    salts each row of small is copied once per salt and big is spread over them, for engines set to do neither.
    """
    keys = list(keys)
    if salts is None:
        return big.join(small, keys, how)
    payload = [F.col(c) for c in big.columns]
    salt = F.pmod(F.xxhash64(*payload), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(copies, keys + ["_salt"], how).drop("_salt")


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """First n rows per key with their rank; order must be total within a key.

    Rows are cut to n per (key, salt) first, so the last step sees at most n * salts rows per key.
    Both cuts plan as a group limit that also runs before the shuffle.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_pre", F.row_number().over(pre))
        .filter(F.col("_pre") <= n)
        .drop("_pre", "_salt")
        .withColumn(rank, F.row_number().over(last))
        .filter(F.col(rank) <= n)
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str = "rank",
) -> DataFrame:
    """row_number per key in (bucket, order), without gathering a key in one task.

    bucket must rise with the order. Rows are numbered inside (key, bucket); the counts of the
    earlier buckets, one row per (key, bucket), are added on top.
    """
    keys = list(keys)
    part = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        part.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        part.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, keys + ["_bucket"])
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_inside", "_before", "_bucket")
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the session names for checkpoints, which all executors share.

    Where none is named, a local master, as in tests, gets a new one; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder the session names; set one only where none is named."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """df as a Parquet table in a new shared folder, or below root, read back: lineage ends, and readers fetch the columns they use."""
    folder = shared_folder(df.sparkSession, name) if root is None else f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Workspace:
    """The kept tables of one job, in a folder of their own that goes with release() or the end of a with block.

    Results that are still lazy read these tables: write them out before.
    """

    def __init__(self, spark: SparkSession, name: str = "job"):
        self.spark, self.folder = spark, shared_folder(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return keep_table(df, name, self.folder)

    def release(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        self.release()


def sorted_index(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based position in a total order, for orders that have no natural bucket.

    The rows are range-sorted and kept once; a row's position is its place in its sorted part
    plus the sizes of the parts before it.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per sorted part: bounded by spark.sql.shuffle.partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_part", "_place", "_before", "_id")
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions, by keys."""
    return df.repartition(*keys)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """df itself, or an error when it is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df
