import random

from pyspark.sql import functions as F

from funcrisk import scale as Z
from funcrisk.operators import split as H
from funcrisk.operators import symbols as Y


def rows(spark, n=500):
    r = random.Random(1)
    data = [("hot" if i % 3 else f"k{r.randint(0, 9)}", r.randint(0, 10**6), i) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, v bigint, i bigint")


def test_both_ways_to_join_a_small_side_agree(spark):
    data, df = rows(spark)
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, s int")
    for how in ("inner", "left"):
        a = sorted(map(str, Z.join_per_key(df, small, ["k"], how).collect()))
        assert a == sorted(map(str, Z.join_per_key(df, small, ["k"], how, salts=8).collect()))


def test_top_and_numbers_equal_a_plain_sort(spark):
    data, df = rows(spark)
    groups = {}
    for k, v, i in data:
        groups.setdefault(k, []).append((v, i))
    want = {(k, i): n for k, g in groups.items() for n, (v, i) in enumerate(sorted(g), 1)}
    top = Z.top_per_key(df, ["k"], [F.col("v"), F.col("i")], 20, ["i"])
    assert {(r["k"], r["i"]): r["rank"] for r in top.collect()} == {x: n for x, n in want.items() if n <= 20}
    numbered = Z.number_rows(df, ["k"], F.shiftright("v", 16), [F.col("v"), F.col("i")], "n")
    assert {(r["k"], r["i"]): r["n"] for r in numbered.collect()} == want
    placed = Z.sorted_index(df, [F.col("v"), F.col("i")])
    order = [i for _, i in sorted((v, i) for _, v, i in data)]
    assert [r["i"] for r in placed.orderBy("position").collect()] == order


def test_split_holds_out_whole_images(spark):
    labels = spark.createDataFrame([(f"fw{i % 7}", f"f{i}", i % 2) for i in range(70)], "firmware_id string, func_id string, label int")
    parts = {}
    for r in H.split_by_firmware(labels).collect():
        parts.setdefault(r["split"], set()).add(r["firmware_id"])
    assert not parts["train"] & parts["validation"] and len(parts["validation"]) == 2
    tail = {r["firmware_id"] for r in H.image_split(labels, method="tail").collect() if r["split"] == "validation"}
    assert tail == {"fw6"}
    one = labels.withColumn("firmware_id", F.lit("x"))
    counts = {(r["split"], r["label"]): r["count"] for r in H.split_by_firmware(one).groupBy("split", "label").count().collect()}
    assert counts == {("train", 0): 28, ("train", 1): 28, ("validation", 0): 7, ("validation", 1): 7}
    lonely = spark.createDataFrame([("x", f"f{i}", int(i == 0)) for i in range(10)], "firmware_id string, func_id string, label int")
    assert H.split_by_firmware(lonely).filter("split = 'validation'").count() == 2
    ids = spark.createDataFrame([("a_func_b_func_001",), ("plain_12",), ("x",)], "k string")
    assert [r[0] for r in ids.select(H.firmware_id_from_key(F.col("k"))).collect()] == ["a_func_b", "plain", "x"]


def test_dedup_keeps_the_largest_then_the_first(spark):
    symbols = spark.createDataFrame(
        [("i", 1, 64, 4, "a"), ("i", 2, 64, 9, "b"), ("i", 3, 64, 9, "c"), ("i", 4, 128, 1, "d")],
        "firmware_id string, ordinal bigint, address bigint, size bigint, name string")
    got = Y.number_functions(Y.dedup_symbols(symbols)).orderBy("func_id").collect()
    assert [(r["func_id"], r["name"], r["address"]) for r in got] == [("func_001", "b", "0x00000040"), ("func_002", "d", "0x00000080")]


def test_line_cap(spark):
    lines = spark.createDataFrame([("i", "f", n, f"l{n}") for n in range(5)] + [("i", "g", 0, "x")], "firmware_id string, func_id string, line_no int, text string")
    text = {r["func_id"]: r["disassembly"] for r in Y.assemble_disassembly(Y.cap_lines(lines, 3)).collect()}
    assert text == {"f": "l0\nl1\nl2\n... (2 more lines truncated)", "g": "x"}
