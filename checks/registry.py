"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.view_sql import with_views


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Registers the function under its own name for the operators it shows."""
    def keep(fn):
        REGISTRY[fn.__name__] = Query(fn.__name__, operators, fn, with_views(sql) if sql else None)
        return fn

    return keep


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Columns both engines print alike: whole numbers as bigint, fractions rounded, lists joined."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind == "array<string>":
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)
