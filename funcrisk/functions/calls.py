"""Call sets, instruction counts and labels read from disassembly text and symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.text import SEP, bound, empty_strings, line_starts, split_lines, words_found

# Call targets without their angle brackets; plain 0x addresses are no names.
_CALL_TARGET = r"(?iU)\bcall\d*+\s++[<>]*+(?!(?-i:0x))([^\s,]*?)[<>]*+(?![^\s,])"
_JAL_TARGET = r"(?iU)\bjal\s++[<>]*+([^\s,]*?)[<>]*+(?![^\s,])"
# Over line_starts: a whole line that holds a call word.
_CALL_LINE = r"(?iU)\n[^\n]*?(?=c)\bcall\d*\b[^\n]*"
_SYMBOL = r"(?U)<([A-Za-z_][\w.]*)>"
# Over line_starts: a line that is neither blank nor a directive.
_INSTRUCTION_LINE = r"\n(?U:[^\S\n]*+[^\s.])"


def calls_from_asm(asm: Column, max_calls: int | None = None) -> Column:
    """Names called in a disassembly: targets, bracketed symbols, plain mentions; sorted, all or the first max_calls."""
    asm = F.coalesce(asm, F.lit(""))
    call_lines = F.array_join(F.regexp_extract_all(line_starts(asm), F.lit(_CALL_LINE), F.lit(0)), "")
    found = F.concat(
        F.regexp_extract_all(asm, F.lit(_CALL_TARGET), F.lit(1)),
        F.regexp_extract_all(asm, F.lit(_JAL_TARGET), F.lit(1)),
        F.regexp_extract_all(call_lines, F.lit(_SYMBOL), F.lit(1)),
        words_found(F.lower(asm), C.PLAIN_CALL_TOKENS),
    )
    names = F.array_remove(F.array_distinct(found), "")
    names = F.sort_array(names)
    return names if max_calls is None else F.slice(names, 1, max_calls)


def name_hints(name: Column) -> Column:
    """Tokens that the symbol name contains."""
    return words_found(F.lower(F.coalesce(name, F.lit(""))), C.NAME_HINT_TOKENS)


def with_name_hints(calls: Column, name: Column) -> Column:
    return bound(calls, lambda c: F.concat(c, F.array_except(name_hints(name), c)))


def all_calls(asm: Column, name: Column) -> Column:
    return with_name_hints(calls_from_asm(asm), name)


def extend_calls(calls: Column, asm: Column) -> Column:
    """calls plus the library names mentioned in the disassembly that are not yet among them."""
    calls = F.coalesce(calls, empty_strings())
    known = F.split(F.lower(F.array_join(calls, SEP)), SEP)
    mentioned = words_found(F.lower(F.coalesce(asm, F.lit(""))), C.EXTENSION_TOKENS)
    return F.concat(calls, F.array_except(mentioned, known))


def asm_danger_label(asm: Column) -> Column:
    pattern = "|".join(C.DANGER_LABEL_TOKENS)
    return F.coalesce(F.lower(asm).rlike(pattern), F.lit(False)).cast("int")


def instruction_count(asm: Column) -> Column:
    """Lines that are neither blank nor begin with a dot, at least 1."""
    text = F.coalesce(asm, F.lit(""))
    return F.greatest(F.lit(1), F.regexp_count(line_starts(text), F.lit(_INSTRUCTION_LINE)))


def cap_asm_text(asm: Column, max_lines: int = 260, marker: str = "... (%d more lines truncated)") -> Column:
    """First max_lines lines and a note on how many were cut."""
    lines = split_lines(asm)
    head = F.array_join(F.slice(lines, 1, max_lines), "\n")
    more = F.size(lines) - max_lines
    return F.when(more > 0, F.concat(head, F.lit("\n"), F.format_string(marker, more))).otherwise(
        F.array_join(lines, "\n")
    )


def omit_asm_text(asm: Column, max_lines: int = 240) -> Column:
    """The report's cut: the text as it is unless it has more lines than allowed."""
    lines = split_lines(asm)
    head = F.array_join(F.slice(lines, 1, max_lines), "\n")
    more = F.size(lines) - max_lines
    note = F.format_string("\n\n... (%d more lines omitted)", more)
    return F.when(more > 0, F.concat(head, note)).otherwise(asm)
