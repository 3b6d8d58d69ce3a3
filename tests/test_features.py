import math
import time

from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.text import items_equal, items_with, joined
from funcrisk.operators import matrix as M
from funcrisk.operators.scoring import boost_and_flag, rule_score
from funcrisk.functions.risk import risk_tier

SCHEMA = ("firmware_id string, func_id string, name string, size bigint, instructions int, calls array<string>, "
          "strings array<string>, entropy double, disassembly string")


def features(spark, **over):
    row = dict(firmware_id="i", func_id="f", name="n", size=100, instructions=0, calls=[], strings=[], entropy=None,
               disassembly="") | over
    return M.wide_features(spark.createDataFrame([tuple(row.values())], SCHEMA)).first()


def test_empty_function(spark):
    r = features(spark)
    assert r["bytes_per_instruction"] == 100 and r["num_branches"] == 1 and r["num_loops"] == 0
    assert r["avg_string_length"] == 0 and r["call_graph_depth"] == 0 and r["cyclomatic_complexity"] == 1
    assert math.isclose(r["entropy"], 3.55) and r["nesting_depth"] == 0


def test_complexity_uses_calls_before_extension(spark):
    r = features(spark, calls=["a"], disassembly="strcpy gets", instructions=45)
    assert r["num_calls"] == 3 and r["cyclomatic_complexity"] == 4
    assert r["num_dangerous_calls"] == 2 and r["has_strcpy"] == 1


def test_upper_case_call_is_not_dangerous(spark):
    r = features(spark, calls=["STRCPY", "strcpy_s", "memcpy"])
    assert r["num_dangerous_calls"] == 1 and r["has_strcpy"] == 0 and r["num_buffer_ops"] == 3


def test_words_in_names_and_strings(spark):
    r = features(spark, name="Verify_UART", strings=["the KEY", "%d items"], calls=["verify_if", "free_new", "wifi_init"])
    assert r["has_input_validation"] == 1 and r["has_output_sanitization"] == 0
    assert r["has_hardcoded_secrets"] == 1 and r["has_format_strings"] == 1
    assert r["num_conditionals"] == 2 and r["num_allocations"] == 1 and r["has_memory_management"] == 1
    assert r["name_contains_uart"] == 1 and r["calls_wifi"] == 1 and r["is_network_function"] == 1
    assert r["is_input_function"] == 0


def test_embedding_is_a_unit_vector_of_the_name(spark):
    a, b = features(spark), features(spark)
    e = [a[f"embedding_{i}"] for i in range(16)]
    assert e == [b[f"embedding_{i}"] for i in range(16)]
    assert math.isclose(sum(x * x for x in e), 1.0, rel_tol=1e-6)
    assert e != [features(spark, name="m")[f"embedding_{i}"] for i in range(16)]


def sigmoid2(x):
    return 1 / (1 + math.exp(-2 * x))


def scores(spark, rows, **kw):
    cols = "firmware_id string, func_id string, has_strcpy int, has_sprintf int, has_memcpy int, num_dangerous_calls int, entropy double, cyclomatic_complexity int"
    df = rule_score(spark.createDataFrame([("i", str(n), *r) for n, r in enumerate(rows)], cols), **kw)
    return [r["score"] for r in df.orderBy("func_id").collect()]


def test_rule_score_constant_zero_and_alarm(spark):
    assert scores(spark, [(0, 0, 0, 0, 0.0, 0)] * 2) == [0.5, 0.5]
    got = scores(spark, [(1, 0, 0, 0, 6.5, 3)])
    assert math.isclose(got[0], sigmoid2(0.25 + 0.65 + 0.3))
    assert math.isclose(scores(spark, [(1, 0, 0, 0, 6.5, 3)], constant="zero")[0], 0.5)
    quiet, loud = scores(spark, [(0, 0, 0, 0, 7.5, 1), (0, 0, 0, 2, 7.5, 1)], constant="zero")
    assert quiet == 0.5 and math.isclose(loud, sigmoid2(0.2 + 0.15))


def test_boost_lowers_very_high_scores_and_equal_is_flagged(spark):
    df = spark.createDataFrame([("i", "a", 0.99), ("i", "b", 0.5), ("i", "c", 0.7), ("i", "d", 0.69)],
                               "firmware_id string, func_id string, score double")
    labels = spark.createDataFrame([("i", "a", ["CWE-1"]), ("i", "b", ["CWE-1"]), ("i", "c", [])],
                                   "firmware_id string, func_id string, cwe array<string>")
    got = {r["func_id"]: (r["score"], r["is_vulnerable"]) for r in boost_and_flag(df, labels).collect()}
    assert got == {"a": (0.95, True), "b": (0.8, True), "c": (0.7, True), "d": (0.69, False)}


def test_tier_edges(spark):
    df = spark.createDataFrame([(0.75,), (0.74,), (0.5,), (0.49,), (0.35,), (0.34,)], "s double")
    got = [r[0] for r in df.select(risk_tier(F.col("s"), 0.5)).collect()]
    assert got == ["above_threshold" if 0.75 < 0.5 + 0.2 else "high", "high", "above_threshold", "medium", "medium", "low"]


def test_items_are_walked_once(spark):
    long = "x" * 200_000
    row = spark.createDataFrame([([long, "malloc", "my_free", "memcpy"],), ([long],), ([],), (None,)], "c array<string>")
    begun = time.monotonic()
    got = [r["n"] for r in row.select(items_with(joined(F.col("c")), C.ALLOCATION_CALLS).alias("n")).collect()]
    assert got == [2, 0, 0, None]
    assert time.monotonic() - begun < 20
    equal = [r["n"] for r in row.select(items_equal(joined(F.col("c")), ["malloc", "cpy"]).alias("n")).collect()]
    assert equal == [1, 0, 0, None]
