"""Whole-image holdout, and the function-level split for a single image."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.scale import join_per_key, number_rows, sorted_index


def firmware_id_from_key(key: Column) -> Column:
    """Image part of a prefixed id: before the last "_func_", else without a numeric tail."""
    before = F.regexp_extract(key, r"(?s)^(.*)_func_.*$", 1)
    return F.when(F.contains(key, F.lit("_func_")), before).otherwise(
        F.regexp_replace(key, r"_[0-9]+$", "")
    )


def _by_hash(df: DataFrame, keys: list[str], seed: int, *who: str) -> DataFrame:
    """Position of every row in md5 order of seed and key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *who).cast("binary"))
    # Four hex digits spread the rows of a group evenly over 65,536 buckets.
    bucket = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    return number_rows(df.withColumn("_md5", digest), keys, bucket, [F.col("_md5"), *map(F.col, who)], "_pos").drop("_md5")


def image_split(images: DataFrame, frac: float = 0.2, seed: int = 42, method: str = "hash") -> DataFrame:
    """(firmware_id, split) for distinct images; the share frac goes to validation.

    "hash" takes ceil(frac * n) images in md5 order, "tail" the last max(1, int(frac * n)) by name.
    """
    ids = images.select("firmware_id").distinct()
    total = ids.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    if method == "hash":
        placed = _by_hash(ids, [], seed, "firmware_id")
        held = F.col("_pos") <= F.ceil(F.round(F.col("_total") * frac, 9))
    elif method == "tail":
        placed = sorted_index(ids, [F.col("firmware_id")], "_pos")
        held = F.col("_pos") > F.col("_total") - F.greatest(F.lit(1), F.floor(F.col("_total") * frac))
    else:
        raise ValueError(f"unknown split method {method!r}")
    return placed.withColumn("_total", total).select(
        "firmware_id", F.when(held, "validation").otherwise("train").alias("split")
    )


def function_split(labels: DataFrame, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """(firmware_id, func_id, split): functions of one image; by label where both have two or more."""
    # Two rows at most come to the driver.
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    stratify = len(counts) > 1 and min(counts.values()) >= 2
    held_per_label = {k: math.ceil(round(n * frac, 9)) for k, n in counts.items()}
    if stratify:
        placed = _by_hash(labels, ["label"], seed, *C.KEY)
        held = F.lit(False)
        for label, n in held_per_label.items():
            held = held | ((F.col("label") == label) & (F.col("_pos") <= n))
    else:
        placed = _by_hash(labels, [], seed, *C.KEY)
        held = F.col("_pos") <= math.ceil(round(sum(counts.values()) * frac, 9))
    return placed.select(*C.KEY, F.when(held, "validation").otherwise("train").alias("split"))


def split_by_firmware(
    labels: DataFrame, frac: float = 0.2, seed: int = 42, method: str = "hash"
) -> DataFrame:
    """labels(firmware_id, func_id, label) with split; no image is in both parts if there are two or more."""
    images = labels.select("firmware_id").distinct()
    if images.limit(2).count() < 2:
        return labels.join(function_split(labels, frac, seed), C.KEY)
    return join_per_key(labels, image_split(images, frac, seed, method), ["firmware_id"])
