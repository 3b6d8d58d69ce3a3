"""Cells of hand-made sheets: ids, flags, numbers and addresses written in many ways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.text import empty_strings, strip


def header_key(name: str) -> str:
    return str(name).strip().lower().replace(" ", "_")


def text_cell(cell: Column) -> Column:
    return strip(F.coalesce(cell.cast("string"), F.lit("")))


def cwe_id(cell: Column) -> Column:
    """CWE-n from text that names one or is all digits, else null."""
    text = text_cell(cell)
    digits = F.regexp_extract(text, r"(?i)CWE-(\d+)", 1)
    return (
        F.when(digits != "", F.concat(F.lit("CWE-"), digits))
        .when(text.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), text))
    )


def flag_cell(cell: Column, yes: Sequence[str], no: Sequence[str]) -> Column:
    """True or false from the words given or from a number, else null."""
    text = F.lower(text_cell(cell))
    number = text.try_cast("double")
    return (
        F.when(text.isin(*no), F.lit(False))
        .when(text.isin(*yes), F.lit(True))
        .otherwise(number.try_cast("bigint") != 0)
    )


def int_cell(cell: Column) -> Column:
    """Whole part of a number written as text, else null."""
    return text_cell(cell).try_cast("double").try_cast("bigint")


def address_cell(cell: Column, numeric: bool = False) -> Column:
    """Address from a number, or from text with an optional 0x, 0o or 0b prefix."""
    if numeric:
        return cell.cast("bigint")
    text = F.lower(text_cell(cell))
    sign = F.when(F.startswith(text, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    body = F.regexp_replace(text, r"^[+-]|_", "")
    based = lambda base: F.conv(F.substring(body, 3, 80), base, 10).try_cast("bigint")
    value = (
        F.when(text.rlike(r"^[+-]?0x(_?0)*(_?[0-9a-f]){1,16}$"), based(16))
        .when(text.rlike(r"^[+-]?0o(_?0)*(_?[0-7]){1,21}$"), based(8))
        .when(text.rlike(r"^[+-]?0b(_?0)*(_?[01]){1,64}$"), based(2))
        .when(text.rlike(r"^[+-]?(0(_?0)*|[1-9](_?[0-9])*)$"), body.try_cast("bigint"))
    )
    return sign * value


def cwe_list(cell: Column) -> Column:
    """Every id a label cell names, sorted and distinct."""
    text = text_cell(cell)
    named = F.regexp_extract_all(text, F.lit(r"(?i)CWE-(\d+)"), F.lit(1))
    tokens = F.filter(
        F.transform(F.split(F.upper(text), r"[,;|\s]+"), lambda t: F.regexp_replace(t, r"^CWE-?(?=\d)", "")),
        lambda t: t.rlike(r"^\d+$") | F.startswith(t, F.lit("CWE")),
    )
    prefixed = F.transform(
        F.when(F.size(named) > 0, named).otherwise(tokens),
        lambda t: F.when(F.startswith(t, F.lit("CWE")), t).otherwise(F.concat(F.lit("CWE-"), t)),
    )
    blank = F.lower(text).isin("", "nan", "none", "-")
    return F.when(blank, empty_strings()).otherwise(F.sort_array(F.array_distinct(prefixed)))


VULNERABLE = (C.VULNERABLE_WORDS, C.SAFE_WORDS)
USE_AS_LABEL = (C.TRUE_WORDS, C.FALSE_WORDS)
