"""Line splitting, word tests and rule tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character at which a line ends.
LINE_BREAK_CLASS = r"\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029"
LINE_BREAK = r"\r\n|[" + LINE_BREAK_CLASS + "]"

# The same but for the usual one.
RARE_BREAKS = ["\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]

# Joins list items into one text; no symbol name or string literal holds it.
SEP = "\u0001"

NO_STRINGS = "array<string>"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def split_lines(text: Column) -> Column:
    """The lines of a text; an end of line at the end of the text opens no further line.

    Only texts with a rare line break are cut by the pattern. The parts are bound to a variable, so that a text is cut once.
    """
    def without_empty_end(parts: Column) -> Column:
        last_is_empty = F.element_at(parts, -1) == ""
        return F.when(last_is_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return bound(F.when(any_word(text, RARE_BREAKS), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n")), without_empty_end)


def line_starts(text: Column) -> Column:
    """The text with one newline before each line, so that a pattern can begin at a plain character.

    Rare line breaks are rewritten only in the texts that hold one.
    """
    return F.concat(
        F.lit("\n"),
        F.when(any_word(text, RARE_BREAKS), F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text),
    )


def empty_strings() -> Column:
    return F.array().cast(NO_STRINGS)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joined(items: Column) -> Column:
    """All items in one text, each between two separators; lets one regex look at every item."""
    return F.concat(F.lit(SEP), F.array_join(items, SEP), F.lit(SEP))


def any_word(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def words_found(text: Column, words: Sequence[str]) -> Column:
    """The words that occur in the text, in the order given."""
    # Bound to a variable, the text is worked out once for all words, also inside a function of arrays.
    hits = bound(text, lambda t: F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in words]))
    return F.array_except(hits, F.array(F.lit(None).cast("string")))


def items_with(joined_items: Column, words: Sequence[str]) -> Column:
    """How many items hold any of the words."""
    # A match runs from an item's separator to its first word, so an item without one is walked once and not from each character.
    return _count_if_any(joined_items, words, SEP + "[^" + SEP + "]*?(?:" + "|".join(words) + ")")


def items_equal(joined_items: Column, words: Sequence[str]) -> Column:
    """How many items equal one of the words."""
    return _count_if_any(joined_items, words, SEP + "(?:" + "|".join(words) + ")(?=" + SEP + ")")


def _count_if_any(text: Column, words: Sequence[str], pattern: str) -> Column:
    """How often the pattern, which needs one of the words, is found; texts without any are not given to it."""
    return F.when(text.isNull() | any_word(text, words), F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0))


def signal_tokens(text: Column) -> Column:
    """Lower-case tokens of three or more characters between commas, semicolons, bars and blanks."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[^,;|\s]{3,}"), F.lit(0))


def haystack(
    name: Column,
    calls: Column,
    strings: Column,
    disassembly: Column,
    snippet_lines: Column | None = None,
    asm_chars: int | None = None,
) -> Column:
    """Everything known about a function as one lower-case text.

    asm_chars is how much disassembly counts; None takes all of it.
    """
    asm = F.coalesce(disassembly, F.lit(""))
    parts = [
        F.coalesce(name, F.lit("")),
        F.coalesce(F.array_join(calls, " "), F.lit("")),
        F.coalesce(F.array_join(strings, " "), F.lit("")),
        asm if asm_chars is None else F.substring(asm, 1, asm_chars),
    ]
    if snippet_lines is not None:
        # A null or empty array adds nothing.
        parts.append(snippet_lines)
    return F.lower(F.concat_ws(" ", *parts))
