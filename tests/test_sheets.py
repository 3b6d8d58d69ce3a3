import pytest
from pyspark.sql import functions as F

from funcrisk.functions import cells
from funcrisk.functions.answers import parse_cwe_answer
from funcrisk.sources.catalog import default_catalog, is_catalog, load_catalog
from funcrisk.sources.label_sheet import load_label_rows, load_sheet, sheet_columns


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_id_cells(spark):
    assert column(spark, ["cwe-79", "79", " 79 ", "see CWE-1x", "79.0", "CWE120", "", None], cells.cwe_id) == [
        "CWE-79", "CWE-79", "CWE-79", "CWE-1", None, None, None, None]


def test_list_cells(spark):
    assert column(spark, ["cwe-79, CWE-120", "79;120 79", "CWE120", "cwe120|7", "nan", "-", "word", None, "CWE-x"], cells.cwe_list) == [
        ["CWE-120", "CWE-79"], ["CWE-120", "CWE-79"], ["CWE-120"], ["CWE-120", "CWE-7"], [], [], [], [], ["CWE-X"]]


def test_number_cells(spark):
    assert column(spark, ["0x40", "010", "1.0", "10", "0o17", "0b11", "-0x10", "1_000", "0", "x", "", "0xfffffffffffffffff"], cells.address_cell) == [
        64, None, None, 10, 15, 3, -16, 1000, 0, None, None, None]
    assert column(spark, ["12.9", "7", "nan", "inf", "x", None, "1e30"], cells.int_cell) == [12, 7, None, None, None, None, None]


def test_flag_cells(spark):
    flag = lambda c: cells.flag_cell(c, *cells.VULNERABLE)
    assert column(spark, ["vuln", "Yes", "1", "2", "ok", "0", "0.0", "maybe", "", None], flag) == [
        True, True, True, True, False, False, False, None, None, None]


def test_catalog_or_labels(spark):
    rules = spark.createDataFrame([("CWE-1", "a,b", None)], "`CWE ID` string, `Detection Signals` string, `Use as Label` string")
    sheet = spark.createDataFrame([("f", "79")], "`Function` string, `CWE IDs` string")
    assert is_catalog(rules) and not is_catalog(sheet)
    assert load_sheet(spark, rules)[0] == "catalog" and load_sheet(spark, sheet)[0] == "labels"
    r = load_catalog(spark, rules).first()
    assert r["use_as_label"] is True and r["priority"] == 100 and r["notes"] == ""
    with pytest.raises(ValueError):
        load_catalog(spark, sheet)
    with pytest.raises(ValueError):
        load_label_rows(rules)
    with pytest.raises(ValueError):
        load_label_rows(spark.createDataFrame([("f", "nothing")], "function string, cwe string"))
    with pytest.raises(ValueError):
        load_label_rows(spark.createDataFrame([("f",)], "function string"))


def test_last_header_of_a_name_counts(spark):
    raw = spark.createDataFrame([("a", "b", "1", "64")], "name string, symbol string, label string, addr string")
    assert sheet_columns(raw) == {"function_name": "symbol", "vulnerable": "label", "address": "addr"}
    r = load_label_rows(raw).first()
    assert (r["function_name"], r["vulnerable"], r["cwe_list"], r["address"]) == ("b", True, ["CWE-UNKNOWN"], 64)


def test_built_in_rules(spark):
    assert default_catalog(spark).count() == 12
    bare = default_catalog(spark, ["CWE-1"]).first()
    assert bare["cwe_name"] == "CWE-1" and bare["priority"] == 100


@pytest.mark.parametrize("answer, free, allowed", [
    ('```json\n["cwe-120", "CWE-79"]\n``` CWE-1', ["CWE-120", "CWE-79"], ["CWE-120"]),
    ('["CWE-120: X", 79, "x"]', ["CWE-120: X"], []),
    ("[] but CWE-120", [], []),
    ("['CWE-120', broken] cwe-7", ["CWE-120", "CWE-7"], ["CWE-120"]),
    ("prose Cwe-120 and CWE-120", ["CWE-120"], ["CWE-120"]),
    ('[["CWE-120"]]', ["CWE-120"], ["CWE-120"]),
    ("``` no end CWE-120", ["CWE-120"], ["CWE-120"]),
    ("", [], []), (None, [], []),
])
def test_answers(spark, answer, free, allowed):
    df = spark.createDataFrame([(answer,)], "a string")
    r = df.select(parse_cwe_answer(F.col("a")).alias("f"), parse_cwe_answer(F.col("a"), ["cwe-120"]).alias("g")).first()
    assert (r["f"], r["g"]) == (free, allowed)
