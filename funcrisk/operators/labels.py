"""Labels for functions: from sheets, from answers and from rules.

Tables: functions(firmware_id, func_ordinal, func_id, name, address_int, source_file, line_start,
line_end, ...), label_rows as load_label_rows gives them, responses(firmware_id, func_id, answer).

Sheet rows and functions meet on *match keys*: "id:func_007", "name:main", "addr:4096" and, for a
sheet row with file and line, "line:main.c:12". Every rule is then one equality on a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.answers import parse_cwe_answer
from funcrisk.functions.text import empty_strings
from funcrisk.operators.matching import NUMBER_BITS, lowest_rows
from funcrisk.operators.rules import broad_rules, labelable, rule_matches, signal_rules, with_haystack
from funcrisk.scale import cut_lineage, number_rows, sorted_index

# A sheet line may lie this far from a function's first line.
LINE_SLACK = 2
# Line numbers that share all but this many low bits are compared together.
LINE_BITS = 8
# Characters of the pieces by which texts that contain others are found.
PIECE = 3
RULES = ["id", "name", "addr", "line"]


def _base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))


def _key(rule: str, value: Column) -> Column:
    return F.concat(F.lit(rule + ":"), value.cast("string"))


def row_keys(label_rows: DataFrame) -> DataFrame:
    """(row_idx, fw, key): the match keys of every sheet row; fw is null where any image will do."""
    set_text = lambda c: F.when(F.col(c) != "", F.col(c))
    place = F.concat(_base_name(set_text("source_file")), F.lit(":"), F.col("line").cast("string"))
    keys = F.array(
        _key("id", set_text("func_id")), _key("name", set_text("function_name")),
        _key("addr", F.col("address")), _key("line", place),
    )
    return label_rows.select(
        "row_idx", F.lower(set_text("firmware")).alias("fw"), F.explode(keys).alias("key")
    ).filter(F.col("key").isNotNull())


def function_keys(functions: DataFrame, label_rows: DataFrame) -> DataFrame:
    """(firmware_id, func_ordinal, func_id, key): the match keys of every function.

    For line keys only the file and line pairs that the sheet names are taken, found by file and
    by block of lines.
    """
    who = ["firmware_id", "func_ordinal", "func_id"]
    name = F.nullif(F.trim(F.coalesce(F.col("name"), F.lit(""))), F.lit(""))
    keys = F.array(_key("id", F.col("func_id")), _key("name", name), _key("addr", F.col("address_int")))
    plain = functions.select(*who, F.explode(keys).alias("key")).filter(F.col("key").isNotNull())
    places = (
        label_rows.filter((F.col("source_file") != "") & F.col("line").isNotNull())
        .select(_base_name(F.col("source_file")).alias("_file"), F.col("line").cast("bigint").alias("_line"))
        .distinct()
        .withColumn("_block", F.shiftright("_line", LINE_BITS))
    )
    start = F.col("line_start").cast("bigint")
    end = F.when(F.coalesce(F.col("line_end"), F.lit(0)) != 0, F.col("line_end")).otherwise(start).cast("bigint")
    lo, hi = start - LINE_SLACK, F.greatest(end, start + LINE_SLACK)
    blocks = F.sequence(F.shiftright(lo, LINE_BITS), F.shiftright(hi, LINE_BITS))
    placed = functions.filter(
        (F.col("source_file") != "") & F.col("line_start").isNotNull()
    ).select(
        *who, _base_name(F.col("source_file")).alias("_file"), start.alias("_start"), end.alias("_end"),
        F.explode(blocks).alias("_block"),
    )
    inside = F.col("_line").between(F.col("_start"), F.col("_end"))
    near = F.abs(F.col("_line") - F.col("_start")) <= LINE_SLACK
    by_line = placed.join(places, ["_file", "_block"]).filter(inside | near).select(
        *who, F.concat(F.lit("line:"), F.col("_file"), F.lit(":"), F.col("_line").cast("string")).alias("key")
    )
    return plain.unionByName(by_line)


def _pieces(text: Column, most: int) -> Column:
    """Parts of the text of up to `most` characters, each once."""
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, most + 1)]))


def containments(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): texts of the column inner inside texts of the column outer; both hold different, non-empty texts.

    All pieces of up to PIECE characters index the outer texts. An inner text asks by the rarest of its own pieces and is
    then looked for in what it meets.
    """
    index = outer.select("outer", F.explode(_pieces(F.col("outer"), PIECE)).alias("piece"))
    known = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    width = F.least(F.lit(PIECE), F.length("inner"))
    own = F.transform(F.sequence(F.lit(1), F.length("inner") - width + 1), lambda i: F.substring("inner", i, width))
    asked = inner.select("inner", F.explode(F.array_distinct(own)).alias("piece")).join(known, "piece", "left")
    rarest = asked.groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).filter("r.n > 0")
    met = rarest.select("inner", F.col("r.piece").alias("piece")).join(index, "piece")
    return met.filter(F.contains("outer", "inner")).select("inner", "outer")


def firmware_matches(functions: DataFrame, fw_texts: DataFrame) -> DataFrame:
    """(firmware_id, fw) where either text contains the other, ignoring case.

    An image goes by firmware_stem where the functions carry one, else by firmware_id. Different stems and different texts
    meet, once each way; images come in after that.
    """
    known_as = "firmware_stem" if "firmware_stem" in functions.columns else "firmware_id"
    ids = functions.select("firmware_id", F.lower(known_as).alias("stem")).distinct()
    stems = ids.select("stem").filter("stem != ''").distinct()
    texts = fw_texts.select("fw").filter("fw != ''").distinct()
    of_stems, of_texts = ({k: x.select(F.col(c).alias(k)) for k in ("inner", "outer")} for x, c in ((stems, "stem"), (texts, "fw")))
    text_in_stem = containments(of_texts["inner"], of_stems["outer"]).select(F.col("outer").alias("stem"), F.col("inner").alias("fw"))
    stem_in_text = containments(of_stems["inner"], of_texts["outer"]).select(F.col("inner").alias("stem"), F.col("outer").alias("fw"))
    return ids.join(text_in_stem.unionByName(stem_in_text).distinct(), "stem").select("firmware_id", "fw").distinct()


def named_keys(functions: DataFrame, present: DataFrame, rkeys: DataFrame) -> DataFrame:
    """(firmware_id, fw, key): keys of rows that name an image, in the images that they mean and that have the key."""
    asked = rkeys.filter(F.col("fw").isNotNull()).select("fw", "key").distinct().join(present.select("key").distinct(), "key", "left_semi")
    images = firmware_matches(functions, asked.select("fw"))
    return asked.join(images, "fw").join(present, ["firmware_id", "key"], "left_semi").select("firmware_id", "fw", "key")


def usable_rows(functions: DataFrame, fkeys: DataFrame, rkeys: DataFrame) -> DataFrame:
    """(firmware_id, key, row_idx): the sheet rows each image can use under each of its keys.

    Rows for any image are first cut, per key, to as many as the largest image has functions
    with a key: an image never uses up more rows than that.
    """
    present = fkeys.select("firmware_id", "key").distinct()
    named = rkeys.join(named_keys(functions, present, rkeys), ["fw", "key"]).select("firmware_id", "key", "row_idx")
    most = (
        fkeys.groupBy("firmware_id").agg(F.count_distinct("func_ordinal").alias("n"))
        .agg(F.coalesce(F.max("n"), F.lit(0)))
    )
    general = number_rows(
        rkeys.filter(F.col("fw").isNull()).select("key", "row_idx"), ["key"],
        F.shiftright("row_idx", NUMBER_BITS), [F.col("row_idx")], "_n",
    ).withColumn("_most", most.scalar()).filter(F.col("_n") <= F.col("_most"))
    anywhere = general.join(present, "key").select("firmware_id", "key", "row_idx")
    return named.unionByName(anywhere)


def label_candidates(functions: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Per function: how many sheet rows match by each rule, and the first that matches at all.

    Rows are counted per image and key before they meet the functions, so the pairs of a key that
    many rows and functions share are never formed.
    """
    rkeys = cut_lineage(row_keys(label_rows))
    fkeys = cut_lineage(function_keys(functions, label_rows))
    present = fkeys.select("firmware_id", "key").distinct()
    sums = [F.sum("n").alias("n"), F.min("first").alias("first")]
    per_text = rkeys.groupBy("fw", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first")
    )
    named = per_text.join(named_keys(functions, present, rkeys), ["fw", "key"]).select("firmware_id", "key", "n", "first")
    general = per_text.filter(F.col("fw").isNull()).join(present, "key").select("firmware_id", "key", "n", "first")
    per_key = named.unionByName(general).groupBy("firmware_id", "key").agg(*sums)
    rule = F.substring_index("key", ":", 1)
    who = ["firmware_id", "func_ordinal", "func_id"]
    return (
        fkeys.join(per_key, ["firmware_id", "key"])
        .groupBy(*who)
        .agg(
            *[F.coalesce(F.sum(F.when(rule == r, F.col("n"))), F.lit(0)).alias(f"by_{r}") for r in RULES],
            F.min("first").alias("first_row"),
        )
    )


def match_rows(functions: DataFrame, label_rows: DataFrame) -> DataFrame:
    """(firmware_id, func_ordinal, func_id, row_idx): who takes which sheet row.

    Functions of an image take, in order, the lowest unused row that matches them. Where the
    functions and rows under a key have no other key, the n-th function takes the n-th row, which
    is a numbering on both sides. The entangled rest settles in rounds (matching.lowest_rows); no image
    is one task's work. func_ordinal numbers the functions of an image, each once.
    """
    fkeys = cut_lineage(function_keys(functions, label_rows).distinct())
    usable = cut_lineage(usable_rows(functions, fkeys, cut_lineage(row_keys(label_rows))).distinct())
    live = fkeys.join(usable.select("firmware_id", "key").distinct(), ["firmware_id", "key"], "left_semi")
    tangled_f = live.groupBy("firmware_id", "func_ordinal").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    tangled_r = usable.groupBy("firmware_id", "row_idx").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    tangled_keys = cut_lineage(
        live.join(tangled_f, ["firmware_id", "func_ordinal"], "left_semi").select("firmware_id", "key")
        .unionByName(usable.join(tangled_r, ["firmware_id", "row_idx"], "left_semi").select("firmware_id", "key"))
        .distinct()
    )
    by = ["firmware_id", "key"]
    turn = number_rows(
        live.join(tangled_keys, by, "left_anti"), by,
        F.shiftright(F.col("func_ordinal").cast("bigint"), NUMBER_BITS), [F.col("func_ordinal")], "_turn",
    )
    offer = number_rows(
        usable.join(tangled_keys, by, "left_anti"), by,
        F.shiftright("row_idx", NUMBER_BITS), [F.col("row_idx")], "_turn",
    )
    plain = turn.join(offer, [*by, "_turn"]).select("firmware_id", "func_ordinal", "func_id", "row_idx")
    if tangled_keys.isEmpty():
        return plain

    rest_f = live.join(tangled_keys, by, "left_semi").withColumn("member", F.col("func_ordinal").cast("bigint"))
    rest_r = usable.join(tangled_keys, by, "left_semi").withColumn("member", F.col("row_idx").cast("bigint"))
    pairs = lowest_rows(rest_f.select(*by, "member"), rest_r.select(*by, "member"))
    who = rest_f.select("firmware_id", "func_ordinal", "func_id", F.col("member").alias("function")).distinct()
    entangled = who.join(pairs, ["firmware_id", "function"]).select("firmware_id", "func_ordinal", "func_id", F.col("row").alias("row_idx"))
    return plain.unionByName(entangled)


def assign_labels(functions: DataFrame, label_rows: DataFrame) -> DataFrame:
    """(firmware_id, func_id, row_idx, cwe): the sheet's labels; rows that say safe give an empty list."""
    given = F.when(F.size("cwe_list") > 0, F.col("cwe_list")).when(
        F.col("vulnerable"), F.array(F.lit(C.UNKNOWN_CWE))
    ).otherwise(empty_strings())
    rows = label_rows.select("row_idx", given.alias("cwe"))
    return match_rows(functions, label_rows).join(rows, "row_idx").select(*C.KEY, "row_idx", "cwe")


def label_gaps(functions: DataFrame, sheet: DataFrame) -> DataFrame:
    """Functions that have no sheet label."""
    labelled = sheet.filter(F.size("cwe") > 0).select(*C.KEY)
    return functions.join(labelled, C.KEY, "left_anti")


def auto_labels(
    functions: DataFrame, responses: DataFrame, catalog: DataFrame,
    provider: str = "ollama", model: str = "llama3.2", max_answer_chars: int | None = None,
) -> DataFrame:
    """(firmware_id, func_id, cwe, llm_trace): the answer's ids, else broad matches, which hold all that hints would find."""
    allowed = labelable(catalog).agg(F.collect_set(F.upper("cwe_id")).alias("ids")).scalar()
    rows = with_haystack(functions)
    rows = rows.join(responses.select(*C.KEY, "answer"), C.KEY, "left").withColumn("_allowed", allowed)
    parsed = F.when(F.size("_allowed") > 0, parse_cwe_answer(F.col("answer"), F.col("_allowed"))).otherwise(
        parse_cwe_answer(F.col("answer"))
    )
    rows = rows.withColumn("_parsed", parsed)
    # Nothing is looked for in functions whose answer has ids.
    rows = rows.withColumn("haystack", F.when(F.size("_parsed") > 0, F.lit("")).otherwise(F.col("haystack")))
    rows = rule_matches(rows, broad_rules(catalog), "matches")
    cwe = F.when(F.size("_parsed") > 0, F.col("_parsed")).otherwise(F.col("matches"))
    rows = rows.withColumn("cwe", cwe)
    note = F.when(
        (F.size("_parsed") == 0) & (F.size("cwe") > 0),
        F.concat(F.lit("\n[catalog fallback: "), F.array_join("cwe", ", "), F.lit("]")),
    ).otherwise(F.lit(""))
    noted = F.concat(F.coalesce("answer", F.lit("")), note)
    trace = F.struct(
        F.col("func_id"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("func_id")).alias("function_name"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        (noted if max_answer_chars is None else F.substring(noted, 1, max_answer_chars)).alias("raw_response"),
        F.col("cwe").alias("parsed_cwe"),
    )
    return rows.select(*C.KEY, "cwe", trace.alias("llm_trace"))


def merge_labels(functions: DataFrame, sheet: DataFrame | None, auto: DataFrame) -> DataFrame:
    """(firmware_id, func_id, cwe): sheet labels where there are any, else automatic ones, else none."""
    rows = functions.select(*C.KEY)
    automatic = auto.select(*C.KEY, F.col("cwe").alias("_auto"))
    given = F.col("_auto")
    if sheet is not None:
        rows = rows.join(sheet.filter(F.size("cwe") > 0).select(*C.KEY, F.col("cwe").alias("_sheet")), C.KEY, "left")
        given = F.coalesce("_sheet", "_auto")
    return rows.join(automatic, C.KEY, "left").select(
        *C.KEY, F.coalesce(given, empty_strings()).alias("cwe")
    )


def binary_labels(functions: DataFrame, labels: DataFrame) -> DataFrame:
    """(firmware_id, func_id, label): 1 where the function has any id."""
    has = F.coalesce(F.size("cwe"), F.lit(0)) > 0
    return functions.select(*C.KEY).join(labels.select(*C.KEY, "cwe"), C.KEY, "left").select(
        *C.KEY, has.cast("int").alias("label")
    )


def cwe_onehot(labels: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One 0/1 column per given id, num_cwe_labels and has_cwe. For the ids in use, whatever they are, see cwe_vectors."""
    flags = [F.array_contains("cwe", i).cast("int").alias(i) for i in ids]
    known = F.array(*[F.lit(i) for i in ids]).cast("array<string>")
    count = F.size(F.array_intersect("cwe", known)).cast("int")
    return labels.select(*C.KEY, *flags, count.alias("num_cwe_labels"), (count > 0).cast("int").alias("has_cwe"))


def cwe_dictionary(labels: DataFrame) -> DataFrame:
    """(cwe, position): the ids in use, numbered from 0 in order of their text."""
    used = labels.select(F.explode("cwe").alias("cwe")).filter("cwe IS NOT NULL").distinct()
    return sorted_index(used, [F.col("cwe")], "_n").select("cwe", (F.col("_n") - 1).alias("position"))


def cwe_vectors(labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(firmware_id, func_id, cwe_positions, num_cwe_labels, has_cwe): the one-hot row as the ascending positions of its ones.

    Built from the long form and the dictionary table; no id is a column name, so none comes to the driver. Ids outside
    the dictionary are left out. A function without ids has an empty vector.
    """
    coded = cwe_long(labels).join(dictionary, "cwe").groupBy(*C.KEY).agg(F.sort_array(F.collect_set("position")).alias("_ones"))
    ones = F.coalesce("_ones", F.array().cast("array<bigint>"))
    rows = labels.select(*C.KEY).join(coded, C.KEY, "left").select(*C.KEY, ones.alias("cwe_positions"))
    count = F.size("cwe_positions")
    return rows.withColumns({"num_cwe_labels": count, "has_cwe": (count > 0).cast("int")})


def cwe_long(labels: DataFrame) -> DataFrame:
    """(firmware_id, func_id, cwe): one row per function and id."""
    return labels.select(*C.KEY, F.explode(F.array_distinct("cwe")).alias("cwe"))
