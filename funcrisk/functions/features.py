"""Numeric features of a function, as column expressions over one row.

Inputs: name, size, instructions, calls, strings, entropy (may be null), disassembly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.calls import extend_calls
from funcrisk.functions.text import any_word, empty_strings, items_equal, items_with, joined

STRUCTURAL = [
    "function_size", "instruction_count", "bytes_per_instruction", "num_calls", "num_unique_calls",
    "num_dangerous_calls", "has_strcpy", "has_sprintf", "has_memcpy", "num_strings",
    "avg_string_length", "entropy", "cyclomatic_complexity", "num_branches", "num_loops",
    "call_graph_depth", "has_input_validation", "has_output_sanitization", "has_format_strings",
    "has_hardcoded_secrets", "num_conditionals", "num_buffer_ops", "num_allocations",
    "nesting_depth", "has_memory_management",
]
PERIPHERAL = (
    [f"name_contains_{p}" for p in C.IO_PATTERNS]
    + [f"string_contains_{p}" for p in C.IO_PATTERNS]
    + [f"calls_{p}" for p in C.PERIPHERAL_CALLS]
    + ["io_intensity", "is_network_function", "is_input_function", "is_output_function"]
)
EMBEDDING = (
    [f"embedding_{i}" for i in range(C.EMBEDDING_DIMS)]
    + [f"similarity_{p}" for p in C.PATTERN_KEYWORDS]
    + ["semantic_complexity"]
)
FAMILIES = {"structural": STRUCTURAL, "peripheral": PERIPHERAL, "embedding": EMBEDDING}


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def with_parts(functions: DataFrame) -> DataFrame:
    """Columns the formulas share, worked out once per row."""
    calls = F.coalesce(F.col("calls"), empty_strings())
    strings = F.coalesce(F.col("strings"), empty_strings())
    return (
        functions.withColumns(
            {
                "_size": F.coalesce(F.col("size"), F.lit(0)).cast("bigint"),
                "_instr": F.coalesce(F.col("instructions"), F.lit(0)).cast("bigint"),
                "_name": F.lower(F.coalesce(F.col("name"), F.lit(""))),
                "_calls0": calls,
                "_calls": extend_calls(calls, F.col("disassembly")),
                "_strings": joined(strings),
                "_num_strings": F.size(strings).cast("bigint"),
                "_string_chars": F.length(F.array_join(strings, "")).cast("bigint"),
            }
        )
        .withColumns(
            {
                "_all": joined(F.col("_calls")),
                "_all_lower": F.lower(joined(F.col("_calls"))),
                "_calls0_lower": F.lower(joined(F.col("_calls0"))),
                "_strings_lower": F.lower(F.col("_strings")),
                "_num_calls0": F.size("_calls0").cast("bigint"),
            }
        )
    )


def entropy_estimate(size: Column, instructions: Column, num_calls: Column) -> Column:
    """Entropy guessed from size, instructions and calls where none was measured."""
    return F.least(
        F.lit(3.5)
        + F.least(size / 1000.0, F.lit(2.0)) * 0.5
        + F.least(instructions / 100.0, F.lit(2.0)) * 0.3
        + F.least(num_calls / 10.0, F.lit(1.0)) * 0.2,
        F.lit(8.0),
    )


def structural_columns() -> dict[str, Column]:
    """The 25 structural features over with_parts rows."""
    size, instr, name = F.col("_size"), F.col("_instr"), F.col("_name")
    calls, strings_lower = F.col("_calls"), F.col("_strings_lower")
    all_calls, all_lower = F.col("_all"), F.col("_all_lower")
    num_calls = F.size(calls).cast("bigint")
    per_instruction = size / F.greatest(instr, F.lit(1))
    complexity = F.floor(F.lit(1) + F.col("_num_calls0") * 0.5 + F.floor(instr / 15)).cast("bigint")
    allocations = items_with(all_lower, C.ALLOCATION_CALLS).cast("bigint")
    depth = (
        F.when(num_calls == 0, 0).when(num_calls < 3, 1).when(num_calls < 6, 2)
        .when(num_calls < 10, 3).otherwise(4)
    )
    mean_length = F.when(
        F.col("_num_strings") > 0, F.col("_string_chars") / F.col("_num_strings")
    ).otherwise(F.lit(0.0))
    return {
        "function_size": size,
        "instruction_count": instr,
        "bytes_per_instruction": per_instruction,
        "num_calls": num_calls,
        "num_unique_calls": F.size(F.array_distinct(calls)).cast("bigint"),
        "num_dangerous_calls": items_equal(all_calls, C.DANGEROUS_CALLS).cast("bigint"),
        "has_strcpy": _flag(F.array_contains(calls, "strcpy")),
        "has_sprintf": _flag(F.array_contains(calls, "sprintf")),
        "has_memcpy": _flag(F.array_contains(calls, "memcpy")),
        "num_strings": F.col("_num_strings"),
        "avg_string_length": mean_length,
        "entropy": F.coalesce(F.col("entropy"), entropy_estimate(size, instr, F.col("_num_calls0"))),
        "cyclomatic_complexity": complexity,
        "num_branches": F.greatest(F.floor(instr / 10), F.lit(1)).cast("bigint"),
        "num_loops": F.greatest(F.floor(instr / 20), F.lit(0)).cast("bigint"),
        "call_graph_depth": depth,
        "has_input_validation": _flag(
            any_word(name, C.INPUT_VALIDATION_WORDS) | any_word(strings_lower, C.INPUT_VALIDATION_WORDS)
        ),
        "has_output_sanitization": _flag(
            any_word(name, C.OUTPUT_SANITIZATION_WORDS)
            | any_word(strings_lower, C.OUTPUT_SANITIZATION_WORDS)
        ),
        "has_format_strings": _flag(
            any_word(F.col("_strings"), C.FORMAT_INDICATORS) | any_word(all_calls, C.FORMAT_INDICATORS)
        ),
        "has_hardcoded_secrets": _flag(any_word(strings_lower, C.SECRET_WORDS)),
        "num_conditionals": items_with(all_lower, C.CONDITIONAL_WORDS).cast("bigint"),
        "num_buffer_ops": items_with(all_lower, C.BUFFER_CALLS).cast("bigint"),
        "num_allocations": allocations,
        "nesting_depth": F.least(F.floor(complexity / 3), F.lit(5)).cast("bigint"),
        "has_memory_management": _flag(allocations > 0),
    }


def peripheral_columns() -> dict[str, Column]:
    """The 22 peripheral features over with_parts rows; they see the calls before extension."""
    name, strings, calls = F.col("_name"), F.col("_strings_lower"), F.col("_calls0_lower")
    out: dict[str, Column] = {}
    for p in C.IO_PATTERNS:
        out[f"name_contains_{p}"] = _flag(F.contains(name, F.lit(p)))
    for p in C.IO_PATTERNS:
        out[f"string_contains_{p}"] = _flag(F.contains(strings, F.lit(p)))
    counts = {p: items_with(calls, words).cast("bigint") for p, words in C.PERIPHERAL_CALLS.items()}
    for p, count in counts.items():
        out[f"calls_{p}"] = count
    out["io_intensity"] = reduce(lambda a, b: a + b, [counts[p] for p in C.IO_PATTERNS])
    out["is_network_function"] = _flag(
        any_word(name, C.NETWORK_WORDS) | any_word(strings, C.NETWORK_WORDS)
        | any_word(calls, C.NETWORK_WORDS)
    )
    out["is_input_function"] = _flag(any_word(name, C.INPUT_WORDS) | any_word(strings, C.INPUT_WORDS))
    out["is_output_function"] = _flag(any_word(name, C.OUTPUT_WORDS) | any_word(strings, C.OUTPUT_WORDS))
    return out


def pattern_columns() -> dict[str, Column]:
    """Five keyword-pattern scores and the semantic complexity over with_parts rows."""
    name, calls = F.col("_name"), F.col("_calls0_lower")
    out = {}
    for pattern, words in C.PATTERN_KEYWORDS.items():
        hits = [_flag(F.contains(name, F.lit(w)) | F.contains(calls, F.lit(w))) for w in words]
        share = reduce(lambda a, b: a + b, hits) / F.lit(float(len(words)))
        out[f"similarity_{pattern}"] = F.least(share, F.lit(1.0))
    out["semantic_complexity"] = F.col("_num_calls0") * 0.1 + F.col("_num_strings") * 0.05
    return out


def name_gaussians(name: Column) -> list[Column]:
    """Sixteen standard normal values that depend on the name alone.

    One md5 gives four uniforms of 32 bits, hence two pairs for the polar transform.
    """
    values: list[Column] = []
    for block in range(C.EMBEDDING_DIMS // 4):
        digest = F.md5(F.concat(F.coalesce(name, F.lit("")), F.lit(f"#{block}")).cast("binary"))
        uniforms = [
            (F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
            for i in range(4)
        ]
        for u, v in ((uniforms[0], uniforms[1]), (uniforms[2], uniforms[3])):
            radius = F.sqrt(F.lit(-2.0) * F.log(u))
            angle = v * (2.0 * 3.141592653589793)
            values += [radius * F.cos(angle), radius * F.sin(angle)]
    return values


def with_embedding(parts: DataFrame) -> DataFrame:
    """Adds embedding_0..15: the name's values, shifted by size, instructions and calls, unit length."""
    values = name_gaussians(F.col("name"))
    values[0] = values[0] + F.col("_size") / 1000.0
    values[1] = values[1] + F.col("_instr") / 100.0
    values[2] = values[2] + F.col("_num_calls0") / 10.0
    raw = parts.withColumns({f"_e{i}": v for i, v in enumerate(values)})
    square = reduce(lambda a, b: a + b, [F.col(f"_e{i}") * F.col(f"_e{i}") for i in range(len(values))])
    normed = raw.withColumn("_norm", F.sqrt(square) + 1e-8)
    return normed.withColumns(
        {f"embedding_{i}": F.col(f"_e{i}") / F.col("_norm") for i in range(len(values))}
    )


def interaction_columns(has_cwe: bool = True) -> dict[str, Column]:
    """Products of the matrix columns; the label products need has_cwe."""
    out = {}
    if has_cwe:
        for name, column in {
            "cwe_entropy": "entropy",
            "cwe_dangerous": "num_dangerous_calls",
            "cwe_complexity": "cyclomatic_complexity",
            "cwe_size": "function_size",
            "cwe_instructions": "instruction_count",
            "cwe_calls": "num_calls",
        }.items():
            out[name] = F.col("has_cwe") * F.col(column)
    out["entropy_dangerous"] = F.col("entropy") * F.col("num_dangerous_calls")
    out["complexity_dangerous"] = F.col("cyclomatic_complexity") * F.col("num_dangerous_calls")
    return out
