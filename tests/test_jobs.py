import os

import pytest
from pyspark.sql import functions as F

from checks import views as V
from funcrisk import constants as C
from funcrisk.config import Config
from funcrisk.operators import labels as L
from funcrisk.operators import model as M
from funcrisk.plans import jobs as J
from funcrisk.scale import Workspace
from funcrisk.sources import datasets

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def gate(spark, manifest, sections, roots):
    manifest = spark.createDataFrame(manifest, "firmware_id string, path string, given_path string, name string, stem string, parent string, is_elf boolean")
    sections = spark.createDataFrame(sections, "firmware_id string, name string, address bigint, size bigint")
    root_map = spark.createDataFrame(roots, "key string, roots array<string>, seq bigint")
    tables = J.Tables(None, sections, None, None, None, None, manifest=manifest, root_map=root_map)
    return {r["firmware_id"]: (r["roots"], r["reason"]) for r in J.admit_images(tables).collect()}


def test_images_pass_the_gate_or_get_a_reason(spark):
    row = lambda i, elf=True: (i, f"/p/{i}.elf", f"{i}.elf", f"{i}.elf", i, "p", elf)
    images = [row("a"), row("b", False), row("c"), row("d"), row("e", None)]
    debug = [(i, ".debug_info", 0, 1) for i in "abde"] + [("c", ".text", 0, 1)]
    got = gate(spark, images, debug, [("a", ["/src"], 1), ("b", ["/src"], 2), ("c", ["/src"], 3), ("d", [], 4), ("e.elf", ["/e"], 5)])
    assert got == {
        "a": (["/src"], None), "b": (["/src"], "not an ELF file"), "c": (["/src"], "no debug sections"),
        "d": (None, "no source folder"), "e": (["/e"], None),
    }
    assert gate(spark, [], [], []) == {}


@needs_tables
def test_an_analysis_has_findings_of_good_images_only_and_gives_its_tables_back(spark):
    with Workspace(spark, "test") as work:
        result = J.analyze(V.gated_tables(spark, SF), work=work)
        good = {r[0] for r in result.findings.select("firmware_id").distinct().collect()}
        bad = {r[0] for r in result.rejects.collect()}
        everyone = {r[0] for r in V.v_job_manifest(spark, SF).select("firmware_id").collect()}
        assert good and good | bad == everyone and not good & bad
        plan = result.summary._jdf.queryExecution().executedPlan().toString()
        assert "disassembly" not in plan.split("ReadSchema", 1)[1], "the summary reads no text"
        assert datasets._exists(spark, work.folder)
    assert not datasets._exists(spark, work.folder)


def test_label_vectors_are_the_onehot_rows(spark):
    rows = [("f", "1", ["CWE-9", "CWE-10", "CWE-9"]), ("f", "2", []), ("g", "1", None), ("g", "2", ["CWE-2", None])]
    labels = spark.createDataFrame(rows, "firmware_id string, func_id string, cwe array<string>")
    dictionary = L.cwe_dictionary(labels)
    ids = [r["cwe"] for r in dictionary.orderBy("position").collect()]
    assert ids == ["CWE-10", "CWE-2", "CWE-9"]
    got = {(r[0], r[1]): (r["cwe_positions"], r["num_cwe_labels"], r["has_cwe"]) for r in L.cwe_vectors(labels, dictionary).collect()}
    want = {(a, b): [i for i, x in enumerate(ids) if x in (c or [])] for a, b, c in rows}
    assert got == {k: (v, len(v), int(bool(v))) for k, v in want.items()}
    assert L.cwe_vectors(labels.limit(0), dictionary.limit(0)).count() == 0


def test_means_of_two_thousand_features(spark):
    n = 2000
    train = spark.range(40).select(
        F.lit("f").alias("firmware_id"), F.col("id").cast("string").alias("func_id"), (F.col("id") % 4 == 0).cast("int").alias("label"),
        *[(F.col("id") * (i % 7) + i).alias(f"x{i}") for i in range(n)],
    )
    model = M.fit_rule_model(train)
    assert len(model.fitted) == 10 and len(model.means) == n
    assert all(abs(model.means[f"x{i}"] - (19.5 * (i % 7) + i)) < 1e-9 for i in range(n))


def test_a_rule_model_keeps_its_means_on_disk(spark, tmp_path):
    rows = [("f", str(i), i % 2, float(i), None, 3.0) for i in range(10)]
    train = spark.createDataFrame(rows, "firmware_id string, func_id string, label int, a double, b double, c double")
    model = M.fit_rule_model(train)
    M.save_model(spark, model, f"{tmp_path}/m")
    again = M.load_model(spark, f"{tmp_path}/m")
    assert again == model and model.means == {"a": 4.5, "b": None, "c": 3.0}


def _set(spark, images, value):
    key = "firmware_id string, func_id string"
    matrix = spark.createDataFrame([(i, str(k), value) for i in images for k in range(3)], f"{key}, x double")
    labels = spark.createDataFrame([(i, str(k), k % 2) for i in images for k in range(3)], f"{key}, label int")
    cwe = spark.createDataFrame([(i, str(k), ["CWE-1"] * (k % 2)) for i in images for k in range(3)], f"{key}, cwe array<string>")
    return matrix, labels, cwe


def test_a_second_run_writes_only_new_images(spark, tmp_path):
    folder = f"{tmp_path}/set"
    manifest = lambda rows: spark.createDataFrame(rows, "firmware_id string, sha256 string")
    first = manifest([("007", "a"), ("x/y=z", "b")])
    assert datasets.new_images(spark, first, folder).count() == 2
    datasets.add_images(*_set(spark, ["007", "x/y=z"], 1.0), first, folder)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.startswith("part")}
    before = files()
    new = datasets.new_images(spark, manifest([("007", "a"), ("x/y=z", "b"), ("new", "c")]), folder).collect()
    assert [tuple(r) for r in new] == [("new", "c")]
    datasets.add_images(*_set(spark, ["new"], 2.0), manifest([("new", "c")]), folder)
    after = files()
    assert before.items() < after.items() and all("image-new" in f for f in after.keys() - before.keys())
    matrix, labels, cwe = datasets.load_images(spark, folder)
    got = sorted(tuple(r) for r in matrix.select("firmware_id", "func_id", "x").collect())
    assert got == sorted((i, str(k), v) for i, v in (("007", 1.0), ("x/y=z", 1.0), ("new", 2.0)) for k in range(3))
    assert labels.count() == cwe.count() == 9


def test_an_unfinished_run_is_done_again(spark, tmp_path):
    folder = f"{tmp_path}/set"
    images = spark.createDataFrame([("a", "1")], "firmware_id string, sha256 string")
    datasets.add_images(*_set(spark, ["a"], 1.0), images, folder)
    changed = spark.createDataFrame([("a", "2")], "firmware_id string, sha256 string")
    assert datasets.new_images(spark, changed, folder).count() == 1
    datasets.add_images(*_set(spark, ["a"], 5.0), changed, folder)
    matrix, _, _ = datasets.load_images(spark, folder)
    assert {r["x"] for r in matrix.collect()} == {5.0} and matrix.count() == 3


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_data_sets_come_back_in_both_formats(spark, tmp_path, fmt):
    matrix, labels, cwe = _set(spark, ["a", "b"], 1.5)
    matrix = matrix.withColumn("cwe_positions", F.when(F.col("func_id") == "1", F.array(F.lit(0), F.lit(4))).otherwise(F.array()).cast("array<bigint>"))
    datasets.save_dataset(matrix, labels, cwe, f"{tmp_path}/d", fmt)
    back = datasets.load_dataset(spark, f"{tmp_path}/d", fmt)
    for was, now in zip((matrix, labels, cwe), back):
        assert sorted(map(tuple, now.select(*was.columns).collect())) == sorted(map(tuple, was.collect()))


def test_training_on_wide_frames_splits_whole_images(spark):
    rows = [(f"i{i}", str(k), k % 2, float(k % 2), float(k)) for i in range(5) for k in range(6)]
    frame = spark.createDataFrame(rows, "firmware_id string, func_id string, label int, a double, b double")
    training = J.train_on(frame.drop("label"), frame.select("firmware_id", "func_id", "label"), Config(model_kind="rule"))
    assert {r["split"]: r["firmwares"] for r in training.summary.collect()} == {"train": 4, "validation": 1}
    assert sum(r["samples"] for r in training.metrics.collect()) == 30


@needs_tables
def test_sources_are_looked_up_and_cut_into_lines_once(spark):
    tables = V.job_tables(spark, SF)
    with Workspace(spark, "test") as work:
        numbered = work.keep(J.numbered_functions(tables), "numbered")
        mapped = J.map_sources(numbered, tables, Config(), work)
        plan = mapped._jdf.queryExecution().optimizedPlan().toString()
        assert "text" not in plan.split() and "event_id" not in plan and "documents" not in "".join(mapped.inputFiles())
        columns = [*C.KEY, "source_file", "resolved_source_path", "source_snippet"]
        kept = {(r[0], r[1]): r for r in mapped.select(columns).collect()}
        plain = {(r[0], r[1]): r for r in J.map_sources(numbered, tables).select(columns).collect()}
        assert kept == plain and any(r["source_snippet"] is not None for r in kept.values())
