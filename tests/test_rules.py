"""Rule tokens in texts: the index and the test inside the row against a plain loop."""

import random

import pytest

from funcrisk.operators import rules as U


def world(seed, n_rules, n_texts):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé_") for _ in range(r.randrange(3, 9)))
    rules = [(f"CWE-{i}", [word() for _ in range(r.randrange(4))]) for i in range(n_rules)] + [("CWE-hot", ["memory", "aaa"]), ("CWE-none", [])]
    texts = [("fw", f"f{i}", " ".join(word() for _ in range(r.randrange(60)))) for i in range(n_texts)]
    texts += [("fw", "same", "memory aaa"), ("fw", "same", "memory aaa"), ("fw", "same", "other"), ("fw", "empty", ""), ("fw", "short", "ab")]
    return rules, texts + [("fw", f"hot{i}", "the memory of all") for i in range(n_texts // 3)]


@pytest.mark.parametrize("n_rules,methods", [(30, ["inline", "index", None]), (10_000, ["index", None])])
def test_the_index_finds_what_a_loop_finds(spark, n_rules, methods):
    rules, texts = world(n_rules, n_rules, 120)
    df = spark.createDataFrame(texts, "firmware_id string, func_id string, haystack string").repartition(3)
    catalog = spark.createDataFrame(rules, "cwe_id string, tokens array<string>")
    want = sorted((f, x, sorted({c for c, ts in rules if any(t in x for t in ts)})) for _, f, x in texts)
    for method in methods:
        got = U.rule_matches(df, catalog, "ids", method).collect()
        assert sorted((r["func_id"], r["haystack"], r["ids"]) for r in got) == want, method


def test_each_token_lies_under_one_of_its_pieces(spark):
    rules, _ = world(5, 300, 0)
    tokens = {t for _, ts in rules for t in ts}
    df = spark.createDataFrame([("x", t) for t in tokens], "cwe_id string, token string")
    index = {r["piece"]: r["tokens"] for r in U.token_index(df).collect()}
    assert sorted(t for ts in index.values() for t in ts) == sorted(tokens)
    pieces = {t: {t[i:i + 3] for i in range(len(t) - 2)} for t in tokens}
    shared = {p: sum(p in x for x in pieces.values()) for x in pieces.values() for p in x}
    for p, ts in index.items():
        assert all(p in pieces[t] and shared[p] == min(shared[q] for q in pieces[t]) for t in ts)


def test_the_index_works_out_the_texts_once(spark, monkeypatch):
    """Three steps read the texts, which each of them put together before."""
    kept, keep = [], U.keep_table
    monkeypatch.setattr(U, "keep_table", lambda df, name: kept.append(name) or keep(df, name))
    df = spark.createDataFrame([("a", "1", "uses strcpy"), ("a", "1", "none")], "firmware_id string, func_id string, haystack string")
    rules = spark.createDataFrame([("CWE-1", ["strcpy"])], "cwe_id string, tokens array<string>")
    got = U.rule_matches(df, rules, "ids", "index")
    assert sorted((r["haystack"], r["ids"]) for r in got.collect()) == [("none", []), ("uses strcpy", ["CWE-1"])] and kept == ["haystacks"]
