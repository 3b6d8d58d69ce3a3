"""From raw symbols and sections to numbered functions.

Tables: symbols(firmware_id, ordinal, sym_type, shndx, address, size, name),
sections(firmware_id, name, address, size), asm_lines(firmware_id, func_id, line_no, text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.scale import join_per_key, number_rows, top_per_key


def code_ranges(sections: DataFrame) -> DataFrame:
    """Address ranges [lo, hi) that hold code."""
    return sections.filter(F.col("name").isin(C.CODE_SECTIONS) & (F.col("size") > 0)).select(
        "firmware_id", F.col("address").alias("lo"), (F.col("address") + F.col("size")).alias("hi")
    )


def function_symbols(symbols: DataFrame) -> DataFrame:
    """Defined function symbols that have a size and a name."""
    return symbols.filter(
        (F.col("sym_type") == "STT_FUNC")
        & ~F.col("shndx").isin("SHN_UNDEF", "0")
        & (F.col("size") > 0)
        & (F.col("name") != "")
    )


def symbols_in_code(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols whose address lies in a code range of their image.

    An image's few ranges travel as one row, so every symbol meets one row and is never multiplied.
    """
    per_image = ranges.groupBy("firmware_id").agg(
        F.collect_set(F.struct("lo", "hi")).alias("_ranges")
    )
    inside = F.exists("_ranges", lambda r: (r["lo"] <= F.col("address")) & (F.col("address") < r["hi"]))
    return join_per_key(symbols, per_image, ["firmware_id"]).filter(inside).drop("_ranges")


def dedup_symbols(symbols: DataFrame) -> DataFrame:
    """One symbol per address: the largest, the first of equally large ones."""
    best = F.max_by(
        F.struct("size", "name", "ordinal"), F.struct("size", -F.col("ordinal"), F.col("name"))
    )
    return (
        symbols.groupBy("firmware_id", "address").agg(best.alias("_s"))
        .select("firmware_id", "address", "_s.size", "_s.name", "_s.ordinal")
    )


def number_functions(symbols: DataFrame, max_functions: int | None = None) -> DataFrame:
    """All functions of every image in address order, or the first max_functions, with their ids.

    All of them are numbered by blocks of addresses, so that a large image is not one task's work.
    """
    if max_functions is None:
        block = F.shiftright(F.col("address").cast("bigint"), 14)
        ranked = number_rows(symbols, ["firmware_id"], block, [F.col("address")], "func_ordinal")
    else:
        ranked = top_per_key(symbols, ["firmware_id"], [F.col("address")], max_functions, ["address"], "func_ordinal")
    return ranked.select(
        "firmware_id",
        F.format_string("func_%03d", "func_ordinal").alias("func_id"),
        F.col("func_ordinal").cast("bigint").alias("func_ordinal"),
        "name",
        F.format_string("0x%08X", F.col("address").cast("bigint")).alias("address"),
        F.col("address").cast("bigint").alias("address_int"),
        F.col("size").cast("bigint").alias("size"),
    )


def cap_lines(
    asm_lines: DataFrame, n: int = 260, keys: Sequence[str] = tuple(C.KEY)
) -> DataFrame:
    """First n lines of every function and, where lines were cut, one that says how many."""
    keys = list(keys)
    head = top_per_key(asm_lines, keys, [F.col("line_no")], n, ["line_no"], "_rank").drop("_rank")
    counts = asm_lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("line_no").alias("_last"))
    notes = counts.filter(F.col("_n") > n).select(
        *keys,
        (F.col("_last") + 1).alias("line_no"),
        F.format_string("... (%d more lines truncated)", F.col("_n") - n).alias("text"),
    )
    return head.select(*keys, "line_no", "text").unionByName(notes)


def assemble_disassembly(capped_lines: DataFrame, keys: Sequence[str] = tuple(C.KEY)) -> DataFrame:
    """Disassembly text per function, from lines that cap_lines has bounded."""
    lines = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return capped_lines.groupBy(*keys).agg(F.array_join(lines["text"], "\n").alias("disassembly"))


def instruction_counts(asm_lines: DataFrame, keys: Sequence[str] = tuple(C.KEY)) -> DataFrame:
    """Instructions per function from a table of lines; is_insn, where given, says which count."""
    if "is_insn" in asm_lines.columns:
        counted = F.col("is_insn")
    else:
        counted = F.col("text").rlike(r"(?U)\A\s*[^\s.]")
    return asm_lines.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.count_if(counted)).cast("bigint").alias("instructions")
    )


def debug_images(manifest: DataFrame, sections: DataFrame) -> DataFrame:
    """Every image with whether it is usable; reason is null for the ones that are."""
    with_debug = sections.filter(F.startswith("name", F.lit(".debug_"))).select("firmware_id").distinct()
    flagged = manifest.join(
        with_debug.withColumn("_debug", F.lit(True)), "firmware_id", "left"
    )
    reason = F.when(~F.col("is_elf"), "not an ELF file").when(
        F.col("_debug").isNull(), "no debug sections"
    )
    return flagged.withColumn("reason", reason).drop("_debug")
