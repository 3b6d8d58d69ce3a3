"""The pipeline, stage by stage, against plain versions: each stage is judged on what the one before it kept."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import test_operators as plain
from test_near import kept
from pyspark.sql import functions as F

from funcrisk.llm import common, quality


@pytest.fixture(scope="module")
def docs(spark):
    return plain.frame(spark, plain.ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark):
    return common.documents(spark, plain.SF)


def passes(text):
    """All rules and the base test on one text, word by word."""
    words = re.findall(plain.WORD, text)
    n = len(words)
    seen, cover = Counter(tuple(words[i:i + 5]) for i in range(n - 4)), set()
    for i in range(n - 4):
        if seen[tuple(words[i:i + 5])] > 1:
            cover.update(range(i, i + 5))
    if n < 10 or 100 * len(cover) > 20 * n:
        return False
    lines = [x for x in text.split("\n") if re.search(plain.WORD, x)]
    stops = sum(w.lower() in quality.STOP_WORDS for w in words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (1.5 <= sum(map(len, words)) / n <= 25 and symbols / n <= 0.25 and (n < 40 or stops / n >= 0.02)
            and (len(lines) - len(set(lines))) / len(lines) <= 0.5)


def survivors(rows):
    """(doc_id, text) after quality rules, exact and near deduplication, one list a stage."""
    good = [(k, x) for k, x in rows if passes(x or "")]
    last = {}
    for k, x in good:
        low = x.translate(plain.AZ)
        last[low] = max((k, x), last.get(low, (k, x)))
    exact = sorted(set(last.values()))
    near = [min(group) for group in kept(exact).values()]
    return [sorted(good), exact, sorted(near)]


def ids_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def packed(rows):
    """Sequences without gaps and within the size; pieces by document."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
    return {k: Counter(v) for k, v in pieces.items()}


def wanted_pieces(shown):
    """Pieces of every shown document by the library, as often as it is shown."""
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(plain.VOCABULARY), defaultdict(Counter)
    for (k, x), n in shown.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        for i, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a:a + 4096]
            want[k][(i, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += n
    return dict(want)


def check_stages(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, shown = survivors(rows), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.keep(stage(spark, docs, ""), f"test-{name}")
        if k < 3:
            assert ids_of(out) == want[k], name
        elif k == 3:
            shown = Counter(ids_of(out))
            # Every document stays; a weight of at most 1.25 times the least asks for one more pass at most.
            assert set(shown) == set(want[2]) and max(shown.values(), default=1) <= 2
        if k < 4:
            assert out.columns == docs.columns, name
            docs = out
        else:
            assert packed(out.collect()) == wanted_pieces(shown)


def test_stages_on_the_smallest_table(spark, small):
    check_stages(spark, small)


def test_stages_on_odd_rows(spark, docs):
    check_stages(spark, docs)


def test_run_on_no_rows(spark, small, tmp_path):
    small.filter(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []



def test_columns_of_any_name_pass_all_stages(spark, small):
    """Names that stages use for themselves; each keeps its values."""
    names = ["_tokens", "_bucket", "_pass", "_order", "_hash", "_source", "_weight", "_id", "_sha", "_row", "_verdict", "_number", "node", "label", "key"]
    docs = small.limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.keep(stage(spark, docs, ""), f"test-{name}")
        assert docs.columns == [*small.columns, *names]
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name


def test_exact_dedup_moves_texts_once(spark, small):
    """Rows meet and fold by digests, not by their texts."""
    plan = corpus_pipeline.exact_stage(spark, small, "")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and not re.search(r"hashpartitioning\([^)]*(text|doc_id)#", plan)


def test_mixing_does_not_move_rows_to_meet_the_sources(spark):
    """Sources are a small table even where their buckets are not."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('s', id % 3) as source").repartition(4)
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "12k")
    try:
        out = corpus_pipeline.mixing_stage(spark, docs, "")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.select("doc_id").distinct().count() == 6000
    finally:
        spark.conf.set(key, old)
