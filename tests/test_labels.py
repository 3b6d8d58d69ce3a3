import random

from funcrisk.operators import labels as L

FUNCTIONS = ("firmware_id string, func_ordinal bigint, func_id string, name string, address_int bigint, "
             "source_file string, line_start int, line_end int")
ROWS = ("row_idx bigint, function_name string, func_id string, cwe_list array<string>, source_file string, "
        "line bigint, address bigint, firmware string, vulnerable boolean")


def matches(row, fn):
    fw, name, fid, sf, line, addr = row["firmware"], row["function_name"], row["func_id"], row["source_file"], row["line"], row["address"]
    image = fn["firmware_id"].lower()
    if fw and fw.lower() not in image and image not in fw.lower():
        return False
    if fid and fid == fn["func_id"] or name and fn["name"] and name == fn["name"] or addr is not None and addr == fn["address_int"]:
        return True
    if sf and line is not None and fn["source_file"]:
        if sf.split("/")[-1].lower() == fn["source_file"].split("/")[-1].lower() and fn["line_start"] is not None:
            lo, hi = fn["line_start"], fn["line_end"] or fn["line_start"]
            return lo <= line <= hi or abs(line - lo) <= 2
    return False


def brute(functions, rows):
    out, used = {}, {}
    for fn in sorted(functions, key=lambda f: (f["firmware_id"], f["func_ordinal"])):
        taken = used.setdefault(fn["firmware_id"], set())
        for row in sorted(rows, key=lambda r: r["row_idx"]):
            if row["row_idx"] not in taken and matches(row, fn):
                taken.add(row["row_idx"])
                out[(fn["firmware_id"], fn["func_id"])] = row["row_idx"]
                break
    return out


def world(seed, all_keys):
    r = random.Random(seed)
    functions, rows = [], []
    for image in ("fw", "fw1", "Board"):
        for i in range(1, 16):
            functions.append(dict(
                firmware_id=image, func_ordinal=i, func_id=f"func_{i:03d}", name=r.choice(["a", "b", "c", "d", ""]),
                address_int=64 * r.randint(1, 9), source_file=r.choice([None, "m/x.c", "n/Y.C"]),
                line_start=r.choice([None, r.randint(1, 30)]), line_end=r.choice([None, r.randint(1, 40)])))
    for i in range(40):
        some = lambda v: v if all_keys and r.random() < 0.4 else None
        rows.append(dict(
            row_idx=i, function_name=r.choice(["a", "b", "c", "z", None]) if all_keys else r.choice("abc"),
            func_id=some(f"func_{r.randint(1, 20):03d}"), cwe_list=r.choice([[], ["CWE-1"]]), source_file=some(r.choice(["q/X.c", "y.c"])),
            line=some(r.randint(1, 40)), address=some(64 * r.randint(1, 9)), firmware=r.choice([None, "FW", "fw1", "the-board-x", "none"]),
            vulnerable=r.choice([None, True, False])))
    return functions, rows


def frames(spark, functions, rows):
    f = spark.createDataFrame([tuple(x.values()) for x in functions], FUNCTIONS)
    r = spark.createDataFrame([tuple(x.values()) for x in rows], ROWS)
    return f, r


def test_one_to_one_match_equals_the_plain_walk(spark):
    for seed, all_keys in ((1, True), (2, True), (3, False)):
        functions, rows = world(seed, all_keys)
        f, r = frames(spark, functions, rows)
        got = {(x["firmware_id"], x["func_id"]): x["row_idx"] for x in L.match_rows(f, r).collect()}
        assert got == brute(functions, rows)


def test_candidates_are_counted_by_rule(spark):
    functions, rows = world(4, True)
    f, r = frames(spark, functions, rows)
    got = {(x["firmware_id"], x["func_id"]): x["first_row"] for x in L.label_candidates(f, r).collect()}
    want = {}
    for fn in functions:
        hits = [row["row_idx"] for row in rows if matches(row, fn)]
        if hits:
            want[(fn["firmware_id"], fn["func_id"])] = min(hits)
    assert got == want


def test_safe_rows_are_used_up_without_a_label(spark):
    base = dict(firmware_id="fw", func_id="func_001", name="a", address_int=1, source_file=None, line_start=None, line_end=None)
    functions = [base | {"func_ordinal": 1}, base | {"func_ordinal": 2, "func_id": "func_002"}, base | {"func_ordinal": 3, "func_id": "func_003"}]
    functions = [{k: x[k] for k in ("firmware_id", "func_ordinal", "func_id", "name", "address_int", "source_file", "line_start", "line_end")} for x in functions]
    row = lambda i, cwe, v: dict(row_idx=i, function_name="a", func_id=None, cwe_list=cwe, source_file=None, line=None, address=None, firmware=None, vulnerable=v)
    f, r = frames(spark, functions, [row(0, [], False), row(1, [], True), row(2, ["CWE-5"], None)])
    sheet = L.assign_labels(f, r)
    got = {x["func_id"]: x["cwe"] for x in sheet.collect()}
    assert got == {"func_001": [], "func_002": ["CWE-UNKNOWN"], "func_003": ["CWE-5"]}
    assert [x["func_id"] for x in L.label_gaps(f, sheet).collect()] == ["func_001"]


def test_rounds_equal_the_walk_on_dense_graphs(spark):
    """Few keys, so that nearly all functions and rows compete."""
    from funcrisk.operators import matching

    for seed in (1, 2):
        r = random.Random(seed)
        sides = [[(image, f"k{r.randrange(6)}", i) for image in ("a", "b") for i in range(7) for _ in range(r.randrange(1, 4))] for _ in range(2)]
        f, w = (spark.createDataFrame(x, "firmware_id string, key string, member bigint") for x in sides)
        want = set()
        for image in ("a", "b"):
            used = set()
            for i in sorted({m for g, _, m in sides[0] if g == image}):
                keys = {k for g, k, m in sides[0] if (g, m) == (image, i)}
                left = sorted({m for g, k, m in sides[1] if g == image and k in keys} - used)
                if left:
                    used.add(left[0])
                    want.add((image, i, left[0]))
        assert {tuple(x) for x in matching.lowest_rows(f, w).collect()} == want
    none = f.filter("member < 0")
    assert matching.lowest_rows(none, w).collect() == matching.lowest_rows(f, none).collect() == []


def test_an_image_of_100000_entangled_functions(spark):
    """One name for all and a second key for two thirds; one row has lost the name, so all behind it move up by one."""
    from pyspark.sql import functions as F

    from funcrisk.operators import matching

    n, lost = 100_000, 60_000
    ids = spark.range(n).select(F.lit("hot").alias("firmware_id"), F.col("id").alias("member"))
    names = ids.withColumn("key", F.lit("name:main"))
    own = ids.filter("member % 3 > 0").withColumn("key", F.concat(F.lit("id:"), F.col("member").cast("string")))
    rows = names.filter(F.col("member") != lost).unionByName(own)
    got = {x["function"]: x["row"] for x in matching.lowest_rows(names.unionByName(own), rows).collect()}
    assert got == {i: i if i < lost else i + 1 for i in range(n - 1)}


def waiting_chain(n):
    """Function i waits for function i - 1: each has its own key and the next one's, and rows lie in that order."""
    functions = [("fw", f"k{i + d}", i) for i in range(n) for d in (0, 1)]
    rows = [("fw", f"k{i + d}", i) for i in range(n) for d in (0, 1)]
    return functions, rows


def test_a_chain_of_waiting_functions_settles_in_few_rounds(spark, monkeypatch):
    """Each key is shared with the neighbours, a round a link before; rounds follow the blocks now."""
    from funcrisk.operators import matching

    counts, cut = [], matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: counts.append(1) or cut(df))
    # A row too few under each third key sets the neighbours against one another.
    r = random.Random(5)
    f, w = waiting_chain(60)
    w = [x for x in w if r.random() < 0.7]
    used, want = set(), set()
    for i in range(60):
        left = sorted({m for _, k, m in w if k in (f"k{i}", f"k{i + 1}")} - used)
        if left:
            used.add(left[0])
            want.add(("fw", i, left[0]))
    sides = [spark.createDataFrame(x, "firmware_id string, key string, member bigint") for x in (f, w)]
    got = matching.lowest_rows(*sides)
    assert {tuple(x) for x in got.collect()} == want and len(counts) <= 5


def test_blocks_and_cut_rows_give_the_walk(spark):
    """Blocks of three functions, and no spare rows, so that keys run out inside the walk."""
    from funcrisk.operators import matching

    r = random.Random(8)
    sides = [[(image, f"k{r.randrange(5)}", i) for image in ("a", "b") for i in range(12) for _ in range(2)] for _ in range(2)]
    f, w = (spark.createDataFrame(x, "firmware_id string, key string, member bigint") for x in sides)
    want = set()
    for image in ("a", "b"):
        used = set()
        for i in range(12):
            keys = {k for g, k, m in sides[0] if (g, m) == (image, i)}
            left = sorted({m for g, k, m in sides[1] if g == image and k in keys} - used)
            if left:
                used.add(left[0])
                want.add((image, i, left[0]))
    assert {tuple(x) for x in matching.lowest_rows(f, w, 3, -1).collect()} == want


def test_a_walk_stops_where_an_unseen_row_might_come_first():
    import pandas as pd

    from funcrisk.operators import matching

    f = pd.DataFrame({"firmware_id": "a", "key": ["x", "y", "x", "y"], "member": [1, 2, 3, 3]})
    w = pd.DataFrame({"row_key": ["x", "y", "y"], "row_member": [1, 4, 9], "cut": [True, False, False]})
    assert matching.walk(f, w).to_numpy().tolist() == [["a", 1, 1], ["a", 2, 4]]
    assert matching.walk(f, w.assign(cut=False)).to_numpy().tolist() == [["a", 1, 1], ["a", 2, 4], ["a", 3, 9]]


def test_containments(spark):
    r = random.Random(9)
    outer = {"".join(r.choice("abAB-") for _ in range(r.randrange(1, 12))) for _ in range(60)} | {"x" * 3000 + "needle" + "y" * 3000}
    inner = {"".join(r.choice("abAB-") for _ in range(r.randrange(1, 5))) for _ in range(60)} | {"needle", "xxxxneedle", "zz"}
    f = L.containments(spark.createDataFrame([(x,) for x in inner], "inner string"), spark.createDataFrame([(x,) for x in outer], "outer string"))
    assert {tuple(x) for x in f.collect()} == {(a, b) for a in inner for b in outer if a in b}
