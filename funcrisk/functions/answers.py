"""CWE ids from a model's free-text answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from funcrisk.functions.text import empty_strings, strip

_FENCE = r"(?i)```(?:json)?\s*([\s\S]*?)```"
_LIST = r"\[[\s\S]*?\]"
# Quotes must be double for a list to count as JSON.
_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def parse_cwe_answer(answer: Column, allowed: Sequence[str] | Column | None = None) -> Column:
    """Sorted distinct ids: from the first JSON list, else every id named in the text."""
    text = strip(F.coalesce(answer, F.lit("")))
    body = F.when(text.rlike(_FENCE), strip(F.regexp_extract(text, _FENCE, 1))).otherwise(text)
    listed = F.from_json(F.regexp_extract(body, _LIST, 0), "array<string>", _JSON)
    from_list = F.filter(
        F.transform(listed, lambda s: F.upper(strip(s))), lambda s: s.rlike(r"^CWE-\d+")
    )
    named = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?i)CWE-(\d+)"), F.lit(1)), lambda d: F.concat(F.lit("CWE-"), d)
    )
    ids = F.when(body.rlike(_LIST) & listed.isNotNull(), from_list).otherwise(named)
    if allowed is not None and not isinstance(allowed, Column):
        allowed = F.array(*[F.lit(a.upper()) for a in allowed]) if len(allowed) else None
    if allowed is not None:
        ids = F.array_intersect(ids, allowed)
    return F.coalesce(F.sort_array(F.array_distinct(ids)), empty_strings())
