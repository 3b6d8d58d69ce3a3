from pyspark.sql import functions as F

from funcrisk.functions import calls as K
from funcrisk.functions.text import signal_tokens, split_lines


def one(spark, expr, **cells):
    schema = ", ".join(f"{k} " + ("array<string>" if isinstance(v, list) else "string") for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(expr.alias("r")).first()["r"]


def calls(spark, asm):
    return one(spark, K.calls_from_asm(F.col("a")), a=asm)


def test_targets_symbols_and_addresses(spark):
    assert calls(spark, "call8  40081290 <memcpy>") == ["40081290", "memcpy"]
    assert calls(spark, "callx8 a5") == []
    assert calls(spark, "jal x") == ["x"]
    assert calls(spark, "call0 0x4000") == []
    assert calls(spark, "CALL4 <Foo.bar>,1\n  <other>") == ["Foo.bar"]
    assert calls(spark, "main: <before> call8 f\r\nnext <no>") == ["before", "f"]
    assert calls(spark, "call8\n  split") == ["split"]
    assert calls(spark, "recall8 x <y>") == []
    assert calls(spark, "bl vsprintf") == ["sprintf", "vsprintf"]
    assert calls(spark, "line one\u2028call8 deep <in_line>\u2029<off_line>") == ["deep", "in_line"]
    assert calls(spark, "call8 a<b>c") == ["a<b>c", "b"]
    assert calls(spark, None) == [] and calls(spark, "") == []


def test_all_names_and_then_hints(spark):
    asm = "\n".join(f"call8 f{i:03d}" for i in range(80))
    found = one(spark, K.all_calls(F.col("a"), F.col("n")), a=asm, n="WIFI_json_strcpy")
    assert found == [f"f{i:03d}" for i in range(80)] + ["strcpy", "json", "wifi"]
    assert one(spark, K.all_calls(F.col("a"), F.col("n")), a="call8 strcpy", n="my_strcpy") == ["strcpy"]


def test_at_most_64_names_where_the_caller_says_so(spark):
    asm = "\n".join(f"call8 f{i:03d}" for i in range(80))
    names = K.calls_from_asm(F.col("a"), max_calls=64)
    assert one(spark, names, a=asm) == [f"f{i:03d}" for i in range(64)]
    assert one(spark, K.with_name_hints(names, F.col("n")), a=asm, n="WIFI_json_strcpy")[64:] == ["strcpy", "json", "wifi"]


def test_extension_ignores_case_of_known_calls(spark):
    got = one(spark, K.extend_calls(F.col("c"), F.col("a")), c=["STRCPY", "x"], a="strcpy snprintf")
    assert got == ["STRCPY", "x", "snprintf"]


def test_instruction_lines(spark):
    count = lambda a: one(spark, K.instruction_count(F.col("a")), a=a)
    assert count("") == 1 and count(None) == 1
    assert count("a:\n\n  .word\n\tmov a\n   \nret") == 3
    assert count(".x\r\nnop\u2028 nop") == 2


def test_line_splitting_and_caps(spark):
    assert one(spark, split_lines(F.col("a")), a="a\r\nb\n\nc\x0bd\n") == ["a", "b", "", "c", "d"]
    assert one(spark, split_lines(F.col("a")), a="") == []
    assert one(spark, K.cap_asm_text(F.col("a"), 2), a="1\n2\n3\n4") == "1\n2\n... (2 more lines truncated)"
    assert one(spark, K.omit_asm_text(F.col("a"), 2), a="1\n2\n3") == "1\n2\n\n... (1 more lines omitted)"
    assert one(spark, K.cap_asm_text(F.col("a"), 2), a="1\n2\n") == "1\n2"


def test_danger_and_tokens(spark):
    assert one(spark, K.asm_danger_label(F.col("a")), a="x STRNCPY") == 1
    assert one(spark, K.asm_danger_label(F.col("a")), a="nothing") == 0
    assert one(spark, signal_tokens(F.col("a")), a="Ab, cde;f|GHI\tjklm") == ["cde", "ghi", "jklm"]


def test_a_text_is_searched_once_for_its_calls(spark):
    """Written twice in an expression inside a function of arrays, the calls were looked for twice and the text was lowered a word."""
    df = spark.createDataFrame([("jal strcpy", "parse_uri")], "asm string, name string")
    calls = df.select(K.all_calls(F.col("asm"), F.col("name")).alias("c"))
    assert calls.first()["c"] == ["strcpy", "uri", "parse"]
    plan = calls._jdf.queryExecution().analyzed().toString()
    assert plan.count("bjal") == 1 and plan.count("lower(coalesce(asm") == 1
