"""Rule catalogs against functions: hints, broad matches and prompts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.text import empty_strings, haystack, signal_tokens
from funcrisk.scale import keep_table

# A catalog of ids and tokens of up to so many bytes is tested inside each row.
INLINE_BYTES = 1 << 16


@dataclass(frozen=True)
class PromptLimits:
    """What a prompt shows at most; None is all of it."""
    rules: int | None = None
    rule_chars: int | None = None
    signal_chars: int | None = None
    strings: int | None = None
    snippet_lines: int | None = None
    asm_chars: int | None = None


def _first_chars(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def _first_items(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def labelable(catalog: DataFrame) -> DataFrame:
    """Rules that may be used as labels."""
    return catalog.filter(F.col("use_as_label") & (F.col("cwe_id") != ""))


def signal_rules(catalog: DataFrame) -> DataFrame:
    """(cwe_id, tokens) from the detection signals of the labelable rules."""
    return labelable(catalog).select("cwe_id", signal_tokens(F.col("detection_signals")).alias("tokens"))


def broad_rules(catalog: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """(cwe_id, tokens) from signals, rule text, components and notes."""
    text = F.concat_ws(
        " ",
        *[F.nullif(F.col(c), F.lit("")) for c in
          ("detection_signals", "llm_labeling_rule", "esp32_components", "notes")],
    )
    tokens = signal_tokens(text)
    if stop_words:
        tokens = F.array_except(tokens, F.array(*[F.lit(w) for w in stop_words]))
    return labelable(catalog).select("cwe_id", tokens.alias("tokens"))


def with_haystack(functions: DataFrame, asm_chars: int | None = None) -> DataFrame:
    snippet = F.col("source_snippet.lines")["text"] if "source_snippet" in functions.columns else None
    return functions.withColumn(
        "haystack",
        haystack(F.col("name"), F.col("calls"), F.col("strings"), F.col("disassembly"), snippet, asm_chars),
    )


def token_index(tokens: DataFrame) -> DataFrame:
    """(piece, tokens): every token of at least three characters under that of its pieces which the fewest tokens have."""
    parts = F.transform(F.sequence(F.lit(1), F.length("token") - 2), lambda i: F.substring("token", i, F.lit(3)))
    pieces = tokens.select("token").distinct().filter(F.length("token") >= 3).select("token", F.explode(F.array_distinct(parts)).alias("piece"))
    shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(shared, "piece").groupBy("token").agg(F.min(F.struct("n", "piece")).getField("piece").alias("piece"))
    return rarest.groupBy("piece").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def rule_matches(
    functions: DataFrame,
    rules: DataFrame,
    name: str,
    method: str | None = None,
    keys: Sequence[str] = tuple(C.KEY),
) -> DataFrame:
    """functions (with a haystack) plus the sorted ids of the rules one of whose tokens it holds.

    method "inline" carries a catalog of up to INLINE_BYTES as one value and tests it inside the row. "index" is for larger
    ones: each token lies under one three-character piece, a text meets the pieces that it has and gets one list of
    candidate tokens, and only these are looked for; the functions with their texts are then a table in the shared folder, as
    three steps read them, so columns that nobody needs are best left out before. Without a method the catalog's size decides. All give the same rows,
    also where keys repeat.
    """
    if method not in (None, "inline", "index"):
        raise ValueError(f"no such method: {method}")
    if method is None:
        size = rules.agg(F.sum(F.octet_length(F.concat_ws(" ", "cwe_id", "tokens")))).first()[0] or 0
        method = "inline" if size <= INLINE_BYTES else "index"
    if method == "inline":
        inline = rules.agg(F.collect_list(F.struct("cwe_id", "tokens")).alias("r")).scalar()

        # The text is bound to a variable first: written inside the test it would be put together
        # again for every token.
        def hits(text: Column) -> Column:
            rules_hit = F.filter(F.col("_rules"), lambda r: F.exists(r["tokens"], lambda t: F.contains(text, t)))
            return F.transform(rules_hit, lambda r: r["cwe_id"])

        ids = F.element_at(F.transform(F.array("haystack"), hits), 1)
        return (
            functions.withColumn("_rules", inline)
            .withColumn(name, F.sort_array(F.array_distinct(ids)))
            .drop("_rules")
        )
    # Rows that repeat a key are told apart by their text; equal ones share their hits.
    functions = keep_table(functions.withColumn("_text", F.xxhash64("haystack")), "haystacks")
    keys = [*keys, "_text"]
    tokens = rules.select("cwe_id", F.explode("tokens").alias("token")).distinct()
    pieces = F.array_distinct(F.regexp_extract_all("haystack", F.lit("(?s)(?=(...))"), F.lit(1)))
    asked = functions.select(*keys, F.explode(pieces).alias("piece")).join(token_index(tokens), "piece")
    candidates = asked.groupBy(*keys).agg(F.flatten(F.collect_set("tokens")).alias("_tokens"))
    # The text is bound to a variable: it is put together once for all of its candidates.
    found = F.element_at(F.transform(F.array("haystack"), lambda x: F.filter("_tokens", lambda t: F.contains(x, t))), 1)
    held = functions.select(*keys, "haystack").join(candidates, keys).select(*keys, F.explode(found).alias("token")).distinct()
    hits = held.join(tokens, "token").groupBy(*keys).agg(F.sort_array(F.collect_set("cwe_id")).alias(name))
    return functions.join(hits, keys, "left").withColumn(name, F.coalesce(name, empty_strings())).drop("_text")


def signal_hints(functions: DataFrame, catalog: DataFrame, asm_chars: int | None = None) -> DataFrame:
    """Functions with hints: ids of the rules whose signals occur in what is known of them."""
    rows = with_haystack(functions, asm_chars)
    return rule_matches(rows, signal_rules(catalog), "hints").drop("haystack")


def signal_matches(
    functions: DataFrame, catalog: DataFrame, asm_chars: int | None = None, stop_words: Sequence[str] = ()
) -> DataFrame:
    """Functions with matches: as hints, over all the prose of a rule."""
    rows = with_haystack(functions, asm_chars)
    return rule_matches(rows, broad_rules(catalog, stop_words), "matches").drop("haystack")


def _bracketed(prefix: str, column: str, suffix: str) -> Column:
    return F.when(F.col(column) != "", F.concat(F.lit(prefix), F.col(column), F.lit(suffix))).otherwise(F.lit(""))


def rule_block(catalog: DataFrame, limits: PromptLimits = PromptLimits()) -> DataFrame:
    """One row: the rules part of every prompt, and the ids it allows."""
    first = labelable(catalog)
    if limits.rules is not None:
        first = first.orderBy("priority", "cwe_id").limit(limits.rules)
    rule = F.trim(
        F.coalesce(
            F.nullif(F.col("llm_labeling_rule"), F.lit("")),
            F.nullif(F.col("detection_signals"), F.lit("")),
            F.col("notes"), F.lit(""),
        )
    )
    signals = F.col("detection_signals")
    text = F.concat(
        F.lit("- "), F.col("cwe_id"), F.lit(" "), F.col("cwe_name"),
        _bracketed(" [ESP32: ", "esp32_relevance", "]"),
        _bracketed(" components=", "esp32_components", ""),
        F.when(rule != "", F.concat(F.lit("\n  Rule: "), _first_chars(rule, limits.rule_chars))).otherwise(F.lit("")),
        F.when((signals != "") & (signals != rule),
               F.concat(F.lit("\n  Signals: "), _first_chars(signals, limits.signal_chars))).otherwise(F.lit("")),
    )
    # One value of the catalog's size, as every prompt holds it.
    ordered = F.sort_array(F.collect_list(F.struct("priority", "cwe_id", text.alias("text"))))
    rows = first.agg(ordered.alias("r"))
    allowed = F.array_join(F.col("r")["cwe_id"], ", ")
    block = F.concat(
        F.lit(C.PROMPT_RULES_HEAD), F.array_join(F.col("r")["text"], "\n"),
        F.lit("\n\nAllowed IDs: "), allowed,
    )
    return rows.select(F.when(F.size("r") > 0, block).otherwise(F.lit("")).alias("block"))


def allowed_ids(catalog: DataFrame) -> DataFrame:
    """One row: all labelable ids in catalog order, as an array (an id universe of bounded size)."""
    ids = F.sort_array(F.collect_list(F.struct("rule_ordinal", "cwe_id")))
    return labelable(catalog).agg(ids.alias("r")).select(F.col("r")["cwe_id"].alias("ids"))


def build_prompts(functions: DataFrame, catalog: DataFrame, limits: PromptLimits = PromptLimits()) -> DataFrame:
    """Functions with the prompt that asks a model for their ids."""
    rows = signal_hints(functions, catalog)
    columns = set(rows.columns)
    empty = F.lit("")
    listed = lambda items, n=None: F.when(
        F.size(items) > 0, F.array_join(_first_items(items, n), ", ")
    ).otherwise(F.lit("(none)"))
    location, source = empty, empty
    if "source_file" in columns:
        has_file = F.coalesce(F.col("source_file"), empty) != ""
        has_line = F.coalesce(F.col("line_start"), F.lit(0)) != 0
        end = F.when(F.coalesce(F.col("line_end"), F.lit(0)) != 0, F.col("line_end")).otherwise(F.col("line_start"))
        lines = F.when(has_line, F.concat(F.lit(" lines "), F.col("line_start"), F.lit("-"), end)).otherwise(empty)
        location = F.when(has_file, F.concat(F.lit("\nSource: "), F.col("source_file"), lines)).otherwise(empty)
    if "source_snippet" in columns:
        shown = F.transform(
            _first_items(F.col("source_snippet.lines"), limits.snippet_lines),
            lambda r: F.concat(F.lit("  "), r["number"], F.lit(": "), r["text"], F.lit("\n")),
        )
        path = F.coalesce(
            F.col("source_snippet.resolved_path"), F.nullif(F.col("source_file"), empty), F.lit("?")
        )
        source = F.when(
            F.size(F.coalesce(F.col("source_snippet.lines"), F.array())) > 0,
            F.concat(F.lit("\nSource ("), path, F.lit("):\n"), F.array_join(shown, "")),
        ).otherwise(empty)
    asm = _first_chars(F.coalesce("disassembly", empty), limits.asm_chars)
    hints = F.when(
        F.size("hints") > 0, F.concat(F.lit("\nConsider: "), F.array_join("hints", ", "), F.lit("\n"))
    ).otherwise(empty)
    allowed = F.when(F.size("_ids") > 0, F.array_join("_ids", ", ")).otherwise(F.lit("(see catalog)"))
    prompt = F.concat(
        F.lit(C.PROMPT_HEAD + "\n\n"), F.col("_block"), hints,
        F.lit("\nFunction: "), F.coalesce("name", F.lit("unknown")),
        F.lit("\nCalls: "), listed(F.coalesce(F.col("calls"), empty_strings())),
        F.lit("\nStrings: "), listed(F.coalesce(F.col("strings"), empty_strings()), limits.strings), location,
        F.lit("\n"), source, F.lit("\nDisassembly:\n"),
        F.when(asm != "", asm).otherwise(F.lit("(none)")),
        F.lit("\n\nAllowed: "), allowed, F.lit("\n" + C.PROMPT_TAIL),
    )
    return (
        rows.withColumns({"_block": rule_block(catalog, limits).scalar(), "_ids": allowed_ids(catalog).scalar()})
        .withColumn("prompt", prompt)
        .drop("_block", "_ids")
    )
