"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import split_words, texts

SYMBOLS = r"[#*$%&|<>]+"
# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was at by an are this from or "
    "der die das und ist von den zu mit im ein eine nicht auf sich des dem auch es an werden "
    "le la les de et un une des en est que qui pour dans du au par sur pas plus "
    "el los las y del se con una por su para al como lo más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text of from_words words or more passes if low <= metric <= high; None is no bound."""
    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", low=10),
    Rule("word_length", "mean_word_chars", low=1.5, high=25.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.02, from_words=40),
    Rule("lines", "dup_line_ratio", high=0.5),
    Rule("repeats", "repeat_ratio", high=0.2),
)


def passes(rules: Sequence[Rule]) -> Column:
    """The table as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        m, inside = F.col(f"`{r.metric}`"), F.lit(True)
        if r.low is not None:
            inside = inside & (m >= F.lit(r.low))
        if r.high is not None:
            inside = inside & (m <= F.lit(r.high))
        out = out & ((F.col("n_words") < r.from_words) | inside)
    return out


def repeat_cover(windows: Column, width: int) -> tuple[Column, Column, Column]:
    """Columns to add one after another as _sorted, _places and n_repeat_words.

    Texts without an equal pair of windows, most of them, need no sort. The others sort (window, place) pairs;
    a window equal to a neighbour counts, and the words under such windows are counted once each.
    """
    pair = F.size(windows) > F.size(F.array_distinct(windows))
    ordered = F.when(pair, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def twin(x: Column, j: Column) -> Column:
        before, after = F.get(F.col("_sorted"), j - 1), F.get(F.col("_sorted"), j + 1)
        return F.coalesce(x["h"] == before["h"], F.lit(False)) | F.coalesce(x["h"] == after["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(F.col("_sorted"), twin), lambda x: x["i"]))
    step = F.transform(F.col("_places"), lambda p, j: F.least(F.lit(width), F.coalesce(F.get(F.col("_places"), j + 1) - p, F.lit(width))))
    return ordered, places, F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def text_metrics(docs: DataFrame, width: int = 5) -> DataFrame:
    """All columns of docs, which must have text, and the metrics that rules name; row-local.

    An empty text has no words and ratios of 0. Windows are compared by a 64-bit hash within one text.
    """
    words = F.col("_words")
    n = F.size(words)
    windows = F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))
    body = F.regexp_replace("text", SYMBOLS, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    ordered, places, cover = repeat_cover(F.col("_windows"), width)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return (
        docs.withColumns({"_words": split_words(F.col("text")), "_lines": lines, "n_symbols": (F.octet_length("text") - F.octet_length(body)).cast("long")})
        .withColumns({
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": windows,
        })
        .withColumn("_sorted", ordered).withColumn("_places", places).withColumn("n_repeat_words", cover)
        .withColumns({
            "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
            "stop_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
        })
        .drop("_words", "_lines", "_windows", "_sorted", "_places")
    )


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of docs, in whatever order: metrics, base_failed and kept.

    Null text is empty: no words, base_failed, not kept. Repeated rows give repeated results; other columns of docs
    are left out. kept is false where base_failed, else whether all rules pass.
    """
    m = text_metrics(texts(docs))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules)).drop("text")
