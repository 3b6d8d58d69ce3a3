"""Rule catalogs from any table with headers, from bare ids, or the built-in rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions import cells
from funcrisk.scale import require_rows

_SCHEMA = ", ".join(
    ["rule_ordinal bigint"]
    + [
        f"{c} " + {"use_as_label": "boolean", "priority": "bigint"}.get(c, "string")
        for c in C.CATALOG_COLUMNS
    ]
)


def is_catalog(raw: DataFrame) -> bool:
    """True if the headers are those of a rule catalog and not of per-function labels."""
    headers = {cells.header_key(c) for c in raw.columns}
    rules = "cwe_id" in headers and headers & {"llm_labeling_rule", "detection_signals", "use_as_label"}
    return bool(rules) and not headers & {"function_name", "line", "address"}


def default_catalog(spark: SparkSession, ids: Sequence[str] | None = None) -> DataFrame:
    """The built-in rules, or one bare rule per id given."""
    blank = dict.fromkeys(C.CATALOG_COLUMNS, "")
    if ids:
        rules = [
            blank | {"cwe_id": i, "cwe_name": i, "use_as_label": True, "priority": C.DEFAULT_PRIORITY}
            for i in ids
        ]
    else:
        rules = [
            blank
            | {"cwe_id": i, "cwe_name": name, "detection_signals": signals, "llm_labeling_rule": rule,
               "use_as_label": True, "priority": C.BUILT_IN_PRIORITY}
            for i, name, signals, rule in C.DEFAULT_RULES
        ]
    rows = [[n, *[r[c] for c in C.CATALOG_COLUMNS]] for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, _SCHEMA)


def normalize_catalog(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Catalog rows of raw in the fixed schema; rows without an id are left out.

    order names the column that holds the row order; without it the rows keep file order.
    """
    by_header = {cells.header_key(c): c for c in raw.columns}
    cell = lambda key: F.col(f"`{by_header[key]}`") if key in by_header else F.lit(None).cast("string")
    fields = []
    for c in C.CATALOG_COLUMNS:
        if c == "cwe_id":
            field = cells.cwe_id(cell(c))
        elif c == "use_as_label":
            field = F.coalesce(cells.flag_cell(cell(c), *cells.USE_AS_LABEL), F.lit(True))
        elif c == "priority":
            field = F.coalesce(cells.int_cell(cell(c)), F.lit(C.DEFAULT_PRIORITY).cast("bigint"))
        else:
            field = cells.text_cell(cell(c))
        fields.append(field.alias(c))
    ordinal = F.col(order) if order else F.monotonically_increasing_id()
    return raw.select(ordinal.cast("bigint").alias("rule_ordinal"), *fields).filter(F.col("cwe_id").isNotNull())


def load_catalog(
    spark: SparkSession, raw: DataFrame | None = None, ids: Sequence[str] | None = None, order: str | None = None
) -> DataFrame:
    """A catalog table: from raw when given, else from ids, else the built-in rules."""
    if raw is None:
        return default_catalog(spark, ids)
    if not is_catalog(raw):
        raise ValueError("not a rule catalog: cwe_id and a rule, signals or use_as_label column are needed")
    return require_rows(normalize_catalog(raw, order), "no catalog row has a valid cwe_id")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV with headers, all cells as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
