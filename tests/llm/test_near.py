"""Near copies of at least 0.8 shingle similarity: all of them go, other texts stay."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest

from funcrisk.llm import common, near


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def kept(rows):
    """What stays by brute force: all pairs, then one row a component."""
    sets, parent = [shingles(x or "") for _, x in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            if 5 * len(a & sets[k]) >= 4 * len(a | sets[k]):
                parent[root(i)] = root(k)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[root(i)].append(row)
    return groups


def changed(r, words, similarity):
    """A copy with single words replaced until the similarity would fall below the wanted one."""
    out = list(words)
    while True:
        new = list(out)
        new[r.randrange(len(new))] = f"w{r.randrange(10**6)}"
        a, b = shingles(" ".join(words)), shingles(" ".join(new))
        if len(a & b) < similarity * len(a | b):
            return out
        out = new


@pytest.fixture(scope="module")
def planted():
    r, rows = random.Random(5), []
    line = "all of these texts hold this very common line of many plain words and it does not make them alike "
    for g in range(60):
        words = [f"v{r.randrange(3000)}" for _ in range(r.randrange(12, 400))] + (line.split() if g % 3 else [])
        rows.append((10 * g, " ".join(words)))
        rows += [(10 * g + 1 + i, " ".join(changed(r, words, s))) for i, s in enumerate((0.95, 0.9, 0.85, 0.8))]
        rows.append((10 * g + 6, " ".join(changed(r, words, 0.6))))
    base = [f"u{r.randrange(3000)}" for _ in range(150)]
    rows += [(10_000 + i, " ".join(changed(r, base, r.choice((0.7, 0.8, 0.9))))) for i in range(120)]
    # Null ids, near one another and a numbered one; one id with unlike texts.
    rows += [(None, " ".join(changed(r, base, 0.9))), (None, rows[0][1] + " tail"), (None, "lone " + line), (None, "lone " + line + "x"), (7777, "own words alone"), (7777, line)]
    return rows


@pytest.mark.parametrize("common,group", [(64, 4096), (2, 5)])
def test_all_near_copies_go(spark, planted, common, group, monkeypatch):
    df = spark.createDataFrame([(i, t, "s") for i, t in planted], "doc_id long, text string, node string").repartition(3)
    whole = near.near_copies
    monkeypatch.setattr(near, "near_copies", lambda docs: whole(docs, common, group=group))
    out = corpus_pipeline.near_stage(spark, df, "")
    assert out.columns == df.columns
    got, groups = {(x["doc_id"], x["text"]) for x in out.collect()}, kept(planted)
    for group in groups.values():
        left = [x for x in group if x in got]
        assert len(left) == 1 and left[0][0] == min((k for k, _ in group if k is not None), default=None)
    assert len(got) == len(groups) < len(planted)


def test_no_rows_and_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "a b"), (4, "A  b"), (None, "c d")], "doc_id long, text string")
    assert sorted(x["doc_id"] or 0 for x in corpus_pipeline.near_stage(spark, df, "").collect()) == [0, 1, 3]
    assert corpus_pipeline.near_stage(spark, df.filter("doc_id < 0"), "").collect() == []


def test_few_pairs_of_a_group_with_many_unlike_texts_are_confirmed(spark, monkeypatch):
    """Changed copies of one text are 0.85 like it but 0.73 like one another, and the text itself is not there."""
    r, rows = random.Random(8), []
    base = [f"u{r.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(changed(r, base, 0.86))) for i in range(160)]
    df, tables = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), {}
    monkeypatch.setattr(near, "keep", lambda out, name: tables.setdefault(name, common.keep(out, name)))
    got = {x["doc_id"] for x in corpus_pipeline.near_stage(spark, df, "").collect()}
    assert got == {min(k for k, _ in group) for group in kept(rows).values()}
    assert sum(x.count() for name, x in tables.items() if name.endswith("-pairs")) < 160 * 159 // 2 // 4


def test_a_cell_of_unlike_changed_copies_gives_few_pairs():
    """All have one key and another label; most are less than 0.75 like one another."""
    r = random.Random(8)
    base = [f"u{r.randrange(3000)}" for _ in range(150)]
    sets = [near.shingles(" ".join(changed(r, base, 0.8))) for _ in range(60)]
    rows = pd.DataFrame({"cell": 1, "own": True, "block": 0, "a": range(60), "label": range(60), "fp": [near.fingerprint(x) for x in sets],
                         "n": [len(x) for x in sets], "rest": [len(x) - 1 for x in sets], "sign": [near.sign(x) for x in sets]})
    assert sum(map(len, near.meet_others(iter([rows])))) < 60 * 59 // 2 // 3


def test_signs_drop_no_similar_pair():
    r = random.Random(3)
    for _ in range(300):
        words = [f"u{r.randrange(3000)}" for _ in range(r.randrange(1, 1200))]
        x, y = (near.shingles(" ".join(w)) for w in (words, changed(r, words, 0.8) if len(words) > 60 else words))
        n, m = np.array([len(x)]), np.array([len(y)])
        if near.similar(np.array([len(np.intersect1d(x, y))]), n, m)[0]:
            a, b = (near.sign_rows([near.sign(s)]) for s in (x, y))
            assert near.signs_hold(a, b, n, m)[0]


def test_among_gives_the_rows_of_the_named_ones(spark):
    """Also where many numbers share a bit."""
    rows = spark.range(400).selectExpr("id", "xxhash64(id) as node")
    some = rows.filter("id % 7 = 0").select("node")
    for words in (1, 1 << 18):
        assert sorted(x["id"] for x in common.among(rows, some, "node", words).collect()) == list(range(0, 400, 7))
    assert common.among(rows, some.limit(0), "node").collect() == []
