"""Firmware-shaped tables derived from the given ones by plain formulas, row by row.

view_sql.py holds the same formulas for the SQL side. Every view takes whole tables and whole texts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.calls import all_calls, instruction_count
from funcrisk.operators import matrix as X
from funcrisk.operators.scoring import boost_and_flag, rule_score
from funcrisk.operators.sourcemap import build_root_map
from funcrisk.plans.jobs import Tables
from funcrisk.scale import spread
from funcrisk.sources.catalog import default_catalog
from funcrisk.sources.files import source_files

LEXICON = [
    "strcpy", "sprintf", "memcpy", "malloc", "free", "snprintf", "uart_write", "spi_transfer",
    "wifi_init", "gpio_set", "xQueueSend", "http_parse", "gets", "memset", "notify", "i2c_read",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word(index):
    return F.element_at(F.array(*[F.lit(w) for w in LEXICON]), (index % 16 + 1).cast("int"))


def text_of(prefix: str, value):
    return F.concat(F.lit(prefix), value.cast("string"))


def asm_line(line, k):
    doc = F.col("doc_id")
    symbol = word(doc * 7 + (k % (F.lit(1) + doc % 5)) * 3)
    kind = (doc + k * 2) % 5
    note = F.concat(F.lit(" ; "), line)
    return (
        F.when(line == "", line)
        .when(kind == 0, F.concat(F.lit("call8 40081290 <"), symbol, F.lit(">"), note))
        .when(kind == 1, F.concat(F.lit("jal "), symbol, note))
        .when(kind == 2, F.concat(F.lit("CALL0 0x4000"), note))
        .when(kind == 3, F.concat(F.lit("callx8 a5"), note))
        .otherwise(F.concat(F.lit(".word "), line))
    )


def keyed_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.withColumns(
        {
            "firmware_id": F.col("source"),
            "func_ordinal": F.col("doc_id") + 1,
            "func_id": F.format_string("func_%03d", F.col("doc_id") + 1),
            "name": F.concat(word(F.col("doc_id")), F.lit("_"), F.col("lang")),
        }
    )


def v_asm(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), asm_line)
    return keyed_documents(spark, sf).withColumn("disassembly", F.array_join(lines, "\n"))


def v_asm_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), asm_line)
    return keyed_documents(spark, sf).select(*C.KEY, F.posexplode(lines).alias("line_no", "text"))


def v_functions(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    pieces = F.filter(F.transform(F.split("text", "\\."), lambda s: F.trim(s)), lambda s: s != "")
    mapped = doc % 3 != 0
    start = doc % 200 + 1
    return v_asm(spark, sf).select(
        *C.KEY, "func_ordinal", "name", "doc_id",
        (F.lit(1073741824) + doc * 64).alias("address_int"),
        F.format_string("0x%08X", F.lit(1073741824) + doc * 64).alias("address"),
        F.col("n_chars").alias("size"),
        instruction_count(F.col("disassembly")).alias("instructions"),
        all_calls(F.col("disassembly"), F.col("name")).alias("calls"),
        pieces.alias("strings"),
        (F.lit(5.5) + (doc % 30) / 10.0).alias("entropy"),
        "disassembly",
        F.when(mapped, F.concat(F.lit("main/"), F.col("lang"), (doc % 37).cast("string"), F.lit(".c"))).alias("source_file"),
        F.when(mapped, start).alias("line_start"),
        F.when(mapped, start + F.col("n_chars") % 50).alias("line_end"),
        mapped.alias("has_source_mapping"),
    )


def v_cwe(spark: SparkSession, sf: str) -> DataFrame:
    """(firmware_id, func_id, cwe): every function with the ids its label row stands for."""
    docs = keyed_documents(spark, sf).select(*C.KEY, "doc_id")
    rows = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    toxic = F.array(F.lit("CWE-120"), F.lit("CWE-79"))
    poor = F.array(F.lit("CWE-787"))
    none = F.array().cast("array<string>")
    ids = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.array(*map(F.lit, ("CWE-120", "CWE-787", "CWE-79"))))
        .when(F.col("toxic") == 1, toxic).when(F.col("quality") == 0, poor).otherwise(none)
    )
    return rows.select(*C.KEY, ids.alias("cwe"))


def v_predictions(spark: SparkSession, sf: str, threshold: float = 0.7) -> DataFrame:
    """Rule-score predictions; scores to six decimals so that ties are the same in every engine."""
    functions = v_functions(spark, sf)
    scored = rule_score(X.structural_features(functions)).withColumn("score", F.round("score", 6))
    flagged = boost_and_flag(scored, v_cwe(spark, sf), threshold)
    return flagged.withColumn("score", F.round("score", 6))


def v_label_rows(spark: SparkSession, sf: str, all_keys: bool = False) -> DataFrame:
    """Sheet rows: by name only, or with ids, addresses and places as well."""
    docs = keyed_documents(spark, sf)
    rows = docs.join(table(spark, sf, "labels"), "doc_id")
    doc = F.col("doc_id")
    none = F.array().cast("array<string>")
    cwe = (
        F.when(F.col("toxic") == 1, F.array(F.lit("CWE-120"), F.lit("CWE-79")))
        .when(F.col("quality") == 0, F.array(F.lit("CWE-787"))).otherwise(none)
    )
    where = lambda c, v: F.when(c, v) if all_keys else F.lit(None)
    return rows.select(
        doc.alias("row_idx"), "name", (F.col("toxic") == 1).alias("vulnerable"), cwe.alias("cwe_list"),
        F.when(doc % 2 == 0, F.col("source")).alias("firmware"),
        where(doc % 3 == 0, F.col("func_id")).cast("string").alias("func_id"),
        where(doc % 5 == 0, F.lit(1073741824) + doc * 64).cast("bigint").alias("address"),
        where(doc % 7 == 0, F.concat(F.lit("x/"), F.upper("lang"), (doc % 37).cast("string"), F.lit(".c"))).cast("string").alias("source_file"),
        where(doc % 7 == 0, doc % 200 + 20).cast("bigint").alias("line"),
    ).withColumnRenamed("name", "function_name")


def v_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in five styles, each with the whole document around it."""
    doc = F.col("doc_id")
    known = F.array(*[F.lit(x) for x in ("CWE-120", "CWE-787", "CWE-416", "CWE-79", "CWE-999")])
    a = F.element_at(known, (doc % 5 + 1).cast("int"))
    b = F.element_at(known, ((F.floor(doc / 5)) % 5 + 1).cast("int"))
    text = F.col("text")
    style = F.floor(doc / 25) % 5
    answer = (
        F.when(style == 0, F.concat(F.lit('["'), a, F.lit('", "'), F.lower(b), F.lit('", 79]\n'), text))
        .when(style == 1, F.concat(text, F.lit('\n```json\n["'), a, F.lit('"]\n``` and '), b))
        .when(style == 2, F.concat(text, F.lit(" see "), F.lower(a), F.lit(" or "), b, F.lit(".")))
        .when(style == 3, F.concat(F.lit("[] "), text, F.lit(" "), a))
        .otherwise(F.concat(F.lit("['"), a, F.lit("', broken] "), text, F.lit(" "), b))
    )
    return keyed_documents(spark, sf).select(*C.KEY, answer.alias("answer"))


def v_raw_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """An untidy rule sheet made of the parts."""
    key = F.col("p_partkey")
    k = key.cast("string")
    pick = lambda n, *v: F.element_at(F.array(*[x if hasattr(x, "cast") else F.lit(x) for x in v]), (key % n + 1).cast("int"))
    return table(spark, sf, "part").select(
        key.alias("row no"),
        pick(6, F.concat(F.lit("cwe-"), k), k, F.concat(F.lit("CWE"), k), "none", F.concat(F.lit("see CWE-"), k, F.lit(" here")),
             F.concat(F.lit(" CWE-"), k, F.lit(" "))).alias(" CWE ID "),
        F.col("p_name").alias("CWE Name"),
        pick(7, "yes", "No", "0", "2", "maybe", None, " TRUE ").alias("Use As Label"),
        pick(4, F.col("p_size").cast("string"), "12.7", "n/a", None).alias("priority"),
        F.concat(F.regexp_replace("p_name", " ", ", "), F.lit("; "), F.col("p_type"), F.lit("|ab")).alias("Detection Signals"),
        F.concat(F.lit("  Assign if "), F.col("p_brand"), F.lit(" is seen.  ")).alias("LLM Labeling Rule"),
    )


def v_raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    """An untidy label sheet made of the orders."""
    key = F.col("o_orderkey")
    k = key.cast("string")
    pick = lambda n, *v: F.element_at(F.array(*[x if hasattr(x, "cast") else F.lit(x) for x in v]), (key % n + 1).cast("int"))
    c = F.col("o_custkey").cast("string")
    return table(spark, sf, "orders").select(
        key.alias("row no"),
        F.concat(F.lit(" fn_"), c, F.lit(" ")).alias("Symbol"),
        pick(9, F.concat(F.lit("cwe-"), c), F.concat(c, F.lit("; 79")), F.concat(F.lit("CWE"), c), "nan", "", F.lit(None).cast("string"),
             F.concat(F.lit("cwe"), c, F.lit("|CWE7")), "other text", F.concat(F.lit("CWE-9, cwe-10, "), c)).alias("CWE Labels"),
        pick(6, F.concat(F.lit("0x"), F.lower(F.hex(key))), k, F.concat(F.lit("0"), k), F.concat(F.lit("0b101")), "1.0", " 0o17 ").alias("Addr"),
        pick(4, F.concat(c, F.lit(".6")), "nan", "x", c).alias("LineNo"),
        pick(8, "vuln", "OK", "maybe", "1", "0.0", None, "Safe", "3").alias("Is Vulnerable"),
        F.col("o_orderstatus").alias("Image"),
    )


def v_symbols(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        text_of("fw", F.col("l_suppkey")).alias("firmware_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.when(F.col("l_returnflag") == "R", "STT_OBJECT").otherwise("STT_FUNC").alias("sym_type"),
        F.when(F.col("l_discount") == 0, "SHN_UNDEF").otherwise("1").alias("shndx"),
        (part * 64 + 4096).alias("address"),
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint").alias("size"),
        F.when(F.col("l_linenumber") == 6, "").otherwise(
            F.concat(word(part), F.lit("_"), part.cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
        ).alias("name"),
    )


def v_sections(spark: SparkSession, sf: str) -> DataFrame:
    row = lambda name, address, size: F.struct(
        name.alias("name"), F.lit(address).alias("address"), F.lit(size).alias("size")
    )
    rows = F.array(
        row(F.lit(".text"), 4096, 64 * 1200),
        row(F.lit(".rodata"), 4096 + 64 * 1200, 64 * 300),
        row(F.lit(".flash.text"), 4096 + 64 * 1500, 64 * 100000),
        row(F.lit(".iram0.text"), 64, 0),
        row(F.when(F.col("s_suppkey") % 2 == 0, F.lit(".debug_line")).otherwise(F.lit(".bss")), 0, 10),
    )
    return table(spark, sf, "supplier").select(
        text_of("fw", F.col("s_suppkey")).alias("firmware_id"), F.inline(rows)
    ).select("firmware_id", "name", F.col("address").cast("bigint").alias("address"), F.col("size").cast("bigint").alias("size"))


def v_line_table(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf, "events").select(
        text_of("fw", F.col("user_id")).alias("firmware_id"),
        event.alias("ordinal"),
        (F.floor(event / 5) * 64 + (F.col("user_id") % 16) * 4 + 4096).alias("address"),
        F.concat(F.lit("main/"), (event % 997).cast("string"), F.lit(".c")).alias("file"),
        F.floor("value").cast("bigint").alias("line"),
    )


def v_disassembly(spark: SparkSession, sf: str) -> DataFrame:
    """(firmware_id, address, disassembly): one text per code address."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    lines = F.transform(
        F.sequence(F.lit(0).cast("bigint"), part % 6),
        lambda j: F.concat(F.lit("call8 40081290 <"), word(part * 7 + j * 3 + supp), F.lit(">")),
    )
    return (
        table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
        .select(text_of("fw", supp).alias("firmware_id"), (part * 64 + 4096).alias("address"),
                F.array_join(lines, "\n").alias("disassembly"))
    )


def v_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"), "text"
    )


def v_source_files(spark: SparkSession, sf: str) -> DataFrame:
    return source_files(v_files(spark, sf))


def v_roots(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        text_of("fw", k).alias("firmware_id"),
        F.array(text_of("src", k % 20), text_of("src", (k + 7) % 20), F.lit("/none/")).alias("roots"),
    )


def v_manifest(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(text_of("fw", k), F.lit(".elf"))
    return table(spark, sf, "supplier").select(
        text_of("fw", k).alias("firmware_id"),
        F.concat(text_of("/fleet/p", k % 7), F.lit("/"), name).alias("path"),
        name.alias("given_path"), name.alias("name"), text_of("fw", k).alias("stem"),
        text_of("p", k % 7).alias("parent"), (k % 5 != 0).alias("is_elf"),
        k.alias("seq"),
        F.when(k % 3 == 0, text_of("/src/", k)).when(k % 11 == 5, F.lit("  ")).when(k % 3 == 1, text_of("/lib/", k)).alias("root"),
    )


def v_job_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """v_manifest with stems that differ from the ids."""
    k = F.col("seq")
    root = F.when(k % 3 != 1, text_of("src", k % 20))
    return v_manifest(spark, sf).withColumns({"stem": text_of("Board-", k), "root": root})


def v_job_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Sheet rows by address or by name, for some images, named in capitals, or for any."""
    k, part = F.col("o_orderkey"), F.col("o_orderkey") % 997 + 1
    none, some = F.array().cast("array<string>"), lambda *v: F.array(*map(F.lit, v))
    line = F.floor(k / 7) % 5 + 1
    name = F.concat(word(part), F.lit("_"), part.cast("string"), F.lit("_"), line.cast("string"))
    return table(spark, sf, "orders").select(
        k.alias("row_idx"), F.when(k % 2 == 1, name).alias("function_name"), F.lit(None).cast("string").alias("func_id"),
        F.when(k % 5 == 0, some("CWE-416")).when(k % 5 == 1, some("CWE-120", "CWE-362")).otherwise(none).alias("cwe_list"),
        F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("bigint").alias("line"),
        F.when(k % 2 == 0, part * 64 + 4096).cast("bigint").alias("address"),
        F.when(k % 3 != 1, text_of("BOARD-", F.col("o_custkey") % 100)).alias("firmware"), (k % 4 == 0).alias("vulnerable"),
    )


def v_job_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers for some functions of some images, one a function."""
    k = F.col("o_orderkey")
    func = F.format_string("func_%03d", k % 499 + 1)
    answer = F.when(F.col("k") % 3 == 0, '["CWE-787", "cwe-79", "CWE-999"]').when(F.col("k") % 3 == 1, "none that I know").otherwise("see cwe-190.")
    rows = table(spark, sf, "orders").groupBy(text_of("fw", F.col("o_custkey") % 100).alias("firmware_id"), func.alias("func_id"))
    return rows.agg(F.min("o_orderkey").alias("k")).select("firmware_id", "func_id", answer.alias("answer"))


def gated_tables(spark: SparkSession, sf: str) -> Tables:
    """The job's tables with a manifest, roots by key, a label sheet and answers."""
    manifest = v_job_manifest(spark, sf)
    return replace(
        job_tables(spark, sf), roots=None, manifest=manifest, root_map=build_root_map(manifest.select("path", "root", "seq")),
        label_rows=v_job_sheet(spark, sf), responses=v_job_answers(spark, sf),
    )


def job_tables(spark: SparkSession, sf: str) -> Tables:
    return Tables(
        symbols=v_symbols(spark, sf), sections=v_sections(spark, sf), line_table=v_line_table(spark, sf),
        source_files=v_source_files(spark, sf), roots=v_roots(spark, sf), catalog=default_catalog(spark),
        asm=v_disassembly(spark, sf),
    )
