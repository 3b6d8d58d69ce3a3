import random

from funcrisk.operators import sourcemap as S

LINES = "firmware_id string, ordinal bigint, address bigint, file string, line bigint"


def lookup(spark, lines, addresses, **kw):
    table = spark.createDataFrame([("i", n, *x) for n, x in enumerate(lines)], LINES)
    samples = spark.createDataFrame([("i", a) for a in addresses], "firmware_id string, address bigint")
    return {r["address"]: (r["file"], r["line"]) for r in S.asof_line(samples, table, **kw).collect()}


def test_edges(spark):
    got = lookup(spark, [(100, "a", 1), (100, "b", 2), (200, "c", 3)], [99, 100, 150, 200, 10**6])
    assert got == {99: (None, None), 100: ("b", 2), 150: ("b", 2), 200: ("c", 3), 10**6: ("c", 3)}
    assert lookup(spark, [(100, "a", 1)], [105, 120], max_gap=10) == {105: ("a", 1), 120: (None, None)}


def test_any_bucket_width_gives_the_plain_answer(spark):
    r = random.Random(5)
    lines = [(r.randint(0, 2000), f"f{r.randint(0, 3)}", n) for n in range(60)]
    addresses = sorted({r.randint(0, 2500) for _ in range(150)})
    order = sorted(range(len(lines)), key=lambda i: lines[i][0])
    want = {}
    for a in addresses:
        below = [i for i in order if lines[i][0] <= a]
        want[a] = lines[below[-1]][1:] if below else (None, None)
    for bits in (3, 6, 12):
        assert lookup(spark, lines, addresses, bucket_bits=bits) == want


def test_span_picks_the_usual_file_and_skips_line_zero(spark):
    functions = spark.createDataFrame(
        [("i", "f1", 100, 100), ("i", "f2", 400, 2), ("i", "f3", 600, 100), ("i", "f4", 1, 4)],
        "firmware_id string, func_id string, address_int bigint, size bigint")
    lines = [(100, "a", 5), (150, "b", 7), (190, "b", 9), (400, "z", 0), (600, "p", 3), (650, "q", 4), (690, "r", 0)]
    table = spark.createDataFrame([("i", n, *x) for n, x in enumerate(lines)], LINES)
    got = {r["func_id"]: (r["source_file"], r["line_start"], r["line_end"], r["has_source_mapping"])
           for r in S.source_span(functions, table).collect()}
    assert got == {"f1": ("b", 7, 9, True), "f2": (None, None, None, False), "f3": ("p", 3, 3, True),
                   "f4": (None, None, None, False)}


def test_candidates_in_order(spark):
    files = spark.createDataFrame([("/r/main/x.c",), ("/r/y.c",), ("/s/d/z.c",), ("/abs/w.c",)], "path string")
    functions = spark.createDataFrame(
        [("i", n, f) for n, f in (("1", "main/x.c"), ("2", "deep/y.c"), ("3", "a/b/d/z.c"), ("4", "/abs/w.c"), ("5", "??"), ("6", None), ("7", "no.c"))],
        "firmware_id string, func_id string, source_file string")
    roots = spark.createDataFrame([("i", ["/r", "/s/"])], "firmware_id string, roots array<string>")
    got = {r["func_id"]: r["resolved_source_path"] for r in S.resolve_source(functions, roots, files).collect()}
    assert got == {"1": "/r/main/x.c", "2": "/r/y.c", "3": "/s/d/z.c", "4": "/abs/w.c", "5": None, "6": None, "7": None}


def test_paths_meet_in_normal_form(spark):
    files = spark.createDataFrame([("/idf/components/a.c",), ("/r/./b//c.c",), ("/top.c",)], "path string")
    functions = spark.createDataFrame(
        [("i", n, f) for n, f in (("1", "../components/a.c"), ("2", "/r/x/../b/./c.c"), ("3", "../../../top.c"), ("4", "x/../../components//a.c"), ("5", ".."))],
        "firmware_id string, func_id string, source_file string")
    roots = spark.createDataFrame([("i", ["/idf/main"])], "firmware_id string, roots array<string>")
    got = {r["func_id"]: r["resolved_source_path"] for r in S.resolve_source(functions, roots, files).collect()}
    assert got == {"1": "/idf/components/a.c", "2": "/r/./b//c.c", "3": "/top.c", "4": "/idf/components/a.c", "5": None}


def test_normal_path_agrees_with_the_standard_library(spark):
    from posixpath import normpath

    from pyspark.sql import functions as F

    r = random.Random(9)
    paths = ["/" * r.randint(0, 1) + "/".join(r.choice(["a", "b", "..", ".", ""]) for _ in range(r.randint(1, 7))).lstrip("/") for _ in range(300)]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.normal_path(F.col("p")).alias("q")).collect()
    assert all((r["q"] or ".") == normpath(r["p"]) for r in rows)


def test_snippet_window(spark):
    functions = spark.createDataFrame(
        [("i", "1", "x.c", 10, 11, "/x.c"), ("i", "2", "x.c", 1, 1, "/x.c"), ("i", "3", "gone.c", 4, 4, None), ("i", "4", None, None, None, None)],
        "firmware_id string, func_id string, source_file string, line_start int, line_end int, resolved_source_path string")
    files = spark.createDataFrame([("/x.c", [f"l{i}" for i in range(1, 16)])], "path string, lines array<string>")
    got = {r["func_id"]: r["source_snippet"] for r in S.snippets(functions, files, 2).collect()}
    assert [(x["number"], x["text"], x["in_function"]) for x in got["1"]["lines"]] == [
        (8, "l8", False), (9, "l9", False), (10, "l10", True), (11, "l11", True), (12, "l12", False), (13, "l13", False)]
    assert [x["number"] for x in got["2"]["lines"]] == [1, 2, 3]
    assert got["3"]["lines"] == [] and got["3"]["error"] == "source_file_not_found" and got["4"] is None


def test_root_map_last_writer_and_key_order(spark):
    images = spark.createDataFrame([("/p/a.elf", "/one", 1), ("/q/a.elf", "/two", 2), ("/p/b.elf", " ", 3)], "path string, root string, seq bigint")
    root_map = S.build_root_map(images)
    manifest = spark.createDataFrame(
        [("1", "/p/a.elf", "a.elf", "a.elf", "a", "p"), ("2", "/z/a.elf", "a.elf", "a.elf", "a", "z"), ("3", "/p/b.elf", "b.elf", "b.elf", "b", "p"), ("4", "/n/n", "n", "n", "n", "n")],
        "firmware_id string, path string, given_path string, name string, stem string, parent string")
    got = {r["firmware_id"]: r["roots"] for r in S.roots_for_images(manifest, root_map).collect()}
    assert got == {"1": ["/one"], "2": ["/two"], "3": ["/one"], "4": None}


def test_windows_over_blocks_of_a_hot_file(spark):
    """Many functions in one long file, windows across block borders, at its end and behind it."""
    lines = [f"line {i}" for i in range(1, 1001)]
    files = spark.createDataFrame([("hot.c", lines), ("empty.c", []), ("other.c", ["only"])], "path string, lines array<string>")
    starts = [1, 2, 250, 256, 257, 500, 511, 513, 768, 990, 1000, 1200]
    rows = [("fw", f"f{i}_{s}", "hot.c", "hot.c", s, s + i % 300) for i in range(0, 600, 7) for s in starts]
    rows += [("fw", "none", None, None, 1, 2), ("fw", "lost", "x.c", None, 1, 2), ("fw", "empty", "empty.c", "empty.c", 1, 5), ("fw", "nulls", "other.c", "other.c", None, None)]
    functions = spark.createDataFrame(rows, "firmware_id string, func_id string, source_file string, resolved_source_path string, line_start int, line_end int")
    got = {r["func_id"]: r["source_snippet"] for r in S.snippets(functions, files, 8).collect()}
    assert len(got) == len(rows) and got["none"] is None and got["lost"]["error"] == "source_file_not_found" and got["empty"]["lines"] == []
    assert [x["text"] for x in got["nulls"]["lines"]] == ["only"]
    for _, f, _, path, lo, hi in rows:
        if path == "hot.c":
            want = [(i, lines[i - 1], lo <= i <= hi) for i in range(max(1, lo - 8), min(1000, hi + 8) + 1)]
            assert [(x["number"], x["text"], x["in_function"]) for x in got[f]["lines"]] == want
