"""Per-function label tables with headers that go by many names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funcrisk import constants as C
from funcrisk.functions import cells
from funcrisk.functions.text import empty_strings
from funcrisk.scale import require_rows
from funcrisk.sources.catalog import is_catalog, load_catalog


def sheet_columns(raw: DataFrame) -> dict[str, str]:
    """Canonical name to header; of several headers for one name the last counts."""
    canonical = {alias: name for name, aliases in C.SHEET_ALIASES.items() for alias in aliases}
    found = {}
    for header in raw.columns:
        name = canonical.get(cells.header_key(header))
        if name:
            found[name] = header
    return found


def normalize_label_rows(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Label rows of raw that hold an id or say whether the function is vulnerable."""
    columns = sheet_columns(raw)
    cell = lambda key: F.col(f"`{columns[key]}`") if key in columns else F.lit(None).cast("string")
    text = lambda key: F.when(cell(key).isNotNull(), cells.text_cell(cell(key)))
    numeric = "address" in columns and isinstance(raw.schema[columns["address"]].dataType, T.NumericType)
    row_idx = F.col(order) if order else F.monotonically_increasing_id()
    rows = raw.select(
        row_idx.cast("bigint").alias("row_idx"),
        text("function_name").alias("function_name"),
        text("func_id").alias("func_id"),
        cells.cwe_list(cell("cwe")).alias("cwe_list"),
        text("source_file").alias("source_file"),
        cells.int_cell(cell("line")).alias("line"),
        cells.address_cell(cell("address"), numeric).alias("address"),
        text("firmware").alias("firmware"),
        cells.flag_cell(cell("vulnerable"), *cells.VULNERABLE).alias("vulnerable"),
    )
    unnamed = F.col("vulnerable") & (F.size("cwe_list") == 0)
    return rows.withColumn(
        "cwe_list", F.when(unnamed, F.array(F.lit(C.UNKNOWN_CWE))).otherwise(F.coalesce("cwe_list", empty_strings()))
    ).filter((F.size("cwe_list") > 0) | F.col("vulnerable").isNotNull())


def load_label_rows(raw: DataFrame, order: str | None = None) -> DataFrame:
    if is_catalog(raw):
        raise ValueError("this table is a rule catalog, not per-function labels")
    if not {"cwe", "vulnerable"} & set(sheet_columns(raw)):
        raise ValueError("a cwe column or a vulnerable column is needed")
    return require_rows(normalize_label_rows(raw, order), "no row has labels")


def load_sheet(spark: SparkSession, raw: DataFrame, order: str | None = None) -> tuple[str, DataFrame]:
    """("catalog", rules) or ("labels", rows), as the headers tell."""
    if is_catalog(raw):
        return "catalog", load_catalog(spark, raw, order=order)
    return "labels", load_label_rows(raw, order)
