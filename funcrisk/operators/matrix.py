"""Feature frames and the matrix they make."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions import features as X
from funcrisk.operators.labels import cwe_onehot, cwe_vectors


def _frame(functions: DataFrame, parts: DataFrame, columns: dict[str, Column]) -> DataFrame:
    kept = [c for c in C.KEY if c in functions.columns]
    return parts.select(*kept, *[v.alias(k) for k, v in columns.items()])


def structural_features(functions: DataFrame) -> DataFrame:
    return _frame(functions, X.with_parts(functions), X.structural_columns())


def peripheral_features(functions: DataFrame) -> DataFrame:
    return _frame(functions, X.with_parts(functions), X.peripheral_columns())


def embedding_features(functions: DataFrame) -> DataFrame:
    parts = X.with_embedding(X.with_parts(functions))
    unit = {f"embedding_{i}": F.col(f"embedding_{i}") for i in range(C.EMBEDDING_DIMS)}
    return _frame(functions, parts, unit | X.pattern_columns())


def wide_features(functions: DataFrame, families: Sequence[str] = tuple(X.FAMILIES)) -> DataFrame:
    """All families from one pass over the functions: no joins, no shuffle."""
    parts = X.with_parts(functions)
    columns: dict[str, Column] = {}
    if "structural" in families:
        columns |= X.structural_columns()
    if "peripheral" in families:
        columns |= X.peripheral_columns()
    if "embedding" in families:
        parts = X.with_embedding(parts)
        columns |= {f"embedding_{i}": F.col(f"embedding_{i}") for i in range(C.EMBEDDING_DIMS)}
        columns |= X.pattern_columns()
    return _frame(functions, parts, columns)


def merge_families(*families: DataFrame) -> DataFrame:
    """Full outer merge of frames on the key; of columns that occur twice the first is kept."""
    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        new = [c for c in right.columns if c in C.KEY or c not in left.columns]
        return left.join(right.select(*[F.col(f"`{c}`") for c in new]), C.KEY, "full_outer")

    return reduce(merge, families)


def add_labels(
    frame: DataFrame, labels: DataFrame | None, ids: Sequence[str] | None = None, dictionary: DataFrame | None = None
) -> DataFrame:
    """The frame with label columns and interactions; missing numbers become 0.

    With ids the labels are one column each; with a dictionary table they are the positions of the ones, cwe_positions;
    with neither, only their number and has_cwe.
    """
    has_cwe = labels is not None
    if labels is not None:
        if ids is not None:
            coded = cwe_onehot(labels, ids)
        elif dictionary is not None:
            coded = cwe_vectors(labels, dictionary)
        else:
            count = F.size(F.array_distinct(F.coalesce("cwe", F.array().cast("array<string>"))))
            coded = labels.select(*C.KEY, count.alias("num_cwe_labels"), (count > 0).cast("int").alias("has_cwe"))
        frame = frame.join(coded, C.KEY, "left")
    products = X.interaction_columns(has_cwe)
    present = {
        k: v for k, v in products.items()
        if {"entropy", "num_dangerous_calls", "cyclomatic_complexity", "function_size",
            "instruction_count", "num_calls"} <= set(frame.columns)
    }
    zero = lambda c: F.array().cast("array<bigint>") if c == "cwe_positions" else F.lit(0)
    numbers = [c for c in frame.columns if c not in C.KEY]
    filled = frame.select(
        *[F.col(c) for c in frame.columns if c in C.KEY],
        *[F.coalesce(F.col(f"`{c}`"), zero(c)).alias(c) for c in numbers],
    )
    return filled.withColumns(present) if present else filled


def feature_matrix(
    structural: DataFrame, peripheral: DataFrame, embedding: DataFrame,
    labels: DataFrame | None = None, ids: Sequence[str] | None = None,
) -> DataFrame:
    """The matrix from three separately supplied frames."""
    return add_labels(merge_families(structural, peripheral, embedding), labels, ids)


def matrix_from_functions(
    functions: DataFrame, labels: DataFrame | None = None, ids: Sequence[str] | None = None, dictionary: DataFrame | None = None
) -> DataFrame:
    """The matrix straight from the functions, in one pass."""
    return add_labels(wide_features(functions), labels, ids, dictionary)


def drop_label_columns(matrix: DataFrame) -> DataFrame:
    """The matrix without anything that comes from the labels."""
    kept = [
        c for c in matrix.columns
        if not (c.startswith("CWE-") or c.startswith("cwe_") or c in ("has_cwe", "num_cwe_labels"))
    ]
    return matrix.select(*[F.col(f"`{c}`") for c in kept])


def align_features(matrix: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Key columns, then exactly the expected features in that order; absent ones are 0."""
    have = set(matrix.columns)
    return matrix.select(
        *[c for c in C.KEY if c in have],
        *[F.col(f"`{c}`") if c in have else F.lit(0).alias(c) for c in expected],
    )


def union_frames(*frames: DataFrame) -> DataFrame:
    """Frames of several loads in one; columns that one of them lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, order: Sequence[str], keys: Sequence[str] = tuple(C.KEY)) -> DataFrame:
    """The first row per key in the given order.

    An aggregate rather than a window: copies of a key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
