"""Ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from funcrisk.llm import common, lexical

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (1, None), (2, ""), (3, "...!?"), (4, "alpha beta"), (5, "ALPHA, beta"), (6, "alpha " * 300 + "gamma"), (7, "alpha " * 300 + "gamma"),
    (None, "alpha beta"), (None, "delta"), (8, "İstanbul été́ 漢字 x É"), (9, "beta " * 70_000 + "tail"), (10, "z" * 3_000_000 + " delta"), (10, "delta 42 4_2"),
    (11, "été été été"), (-5, "gamma alpha"),
]
ITEMS = [(1, "alpha beta"), (2, "ALPHA gamma alpha"), (3, None), (4, "!!"), (5, "no such term"), (None, "delta 42"), (7, "x x 漢字 x été"), (7, "tail"), (1, "alpha beta"), (8, "z" * 3_000_000)]


def split(text):
    return TERM.findall((text or "").translate(AZ))


def plain(docs, items, best=10):
    bags = [(k, Counter(split(x))) for k, x in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for k, b in bags:
            m = 10 + 90 * sum(b.values()) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(split(text)) if b[t])
            if s > 0:
                scored.append((-s, k is None, k or 0))
        out += [(item, i + 1, None if none else k, -s) for i, (s, none, k) in enumerate(sorted(scored)[:best])]
    return Counter(out)


def frames(spark, docs=DOCS, items=ITEMS):
    """Tables with columns whose names clash with those that the operator adds."""
    d = spark.createDataFrame([(k, x, b"t", 1, 2) for k, x in docs], "doc_id long, text string, term binary, shard int, n int")
    return d, spark.createDataFrame([(k, x, 1, "r") for k, x in items], "item_id long, text string, item int, rank string")


@pytest.mark.parametrize("size,block", [(1, 1), (2000, 2), (1 << 25, 256)])
def test_odd_rows(spark, size, block):
    docs, items = frames(spark)
    got = lexical.search(lexical.build_index(docs.repartition(3), size), items, item_block=block)
    assert Counter(map(tuple, got.collect())) == plain(DOCS, ITEMS)


def test_no_rows(spark):
    docs, items = frames(spark)
    some, none = lexical.build_index(docs), lexical.build_index(docs.limit(0))
    assert lexical.search(some, items.limit(0)).collect() == lexical.search(none, items).collect() == lexical.search(none, items.limit(0)).collect() == []
    assert lexical.search(lexical.build_index(docs.filter("doc_id < 4 and doc_id > 0")), items).collect() == []


def test_terms_are_cut_between_terms():
    text = ("añb1-" * 900 + "Q" * 5000 + " end").encode()
    whole = text.translate(lexical.TABLE).split()
    assert whole == [x.encode() for x in split(text.decode())]
    old, lexical.SLICE = lexical.SLICE, 100
    try:
        assert [w for words in lexical.terms(text) for w in words] == whole
    finally:
        lexical.SLICE = old


def corpus(r, n):
    """Texts of very uneven lengths over words of very uneven frequency."""
    words, odds = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(r.choices(words, odds, k=int(3 + r.paretovariate(1) * 10) % 900))) for i in range(n)]


def test_many_documents(spark):
    r = random.Random(7)
    docs = corpus(r, 1500)
    docs += [(5000 + i, docs[3][1]) for i in range(40)] + [(i, x) for i, x in docs[:20]]
    r.shuffle(docs)
    items = [(i, " ".join({f"w{int(400 * r.random() ** 2)}" for _ in range(12)})) for i in range(40)]
    d, q = frames(spark, docs, items)
    for size in (20_000, 1 << 25):
        assert Counter(map(tuple, lexical.search(lexical.build_index(d.repartition(2), size), q, item_block=16).collect())) == plain(docs, items)


def test_block_bounds_hold_and_turn_candidates_away(spark, monkeypatch):
    r = random.Random(11)
    docs = corpus(r, 6000)
    shard = lexical.Shard()
    for k, x in docs:
        shard.add(k, x.encode())
    rows = [x for frame in shard.rows(0) for x in frame.to_dict("records")]
    lengths = np.frombuffer(rows[0]["tfs"], "<i8")
    n, total = int((lengths > 0).sum()), int(lengths.sum())
    m, blocks = 10 + 90 * lengths * n // total, (len(lengths) + (1 << lexical.SHIFT) - 1) >> lexical.SHIFT
    lists = {x["term"]: lexical.PostingList(x["blocks"], x["docs"], x["tfs"], x["larges"], blocks, 90 * n / total) for x in rows[1:]}
    bags = [Counter(x.split()) for _, x in docs]
    for t, x in lists.items():
        d, tf = x.decode(np.arange(blocks))
        assert d.tolist() == [i for i, b in enumerate(bags) if b[t.decode()]] and tf.tolist() == [bags[i][t.decode()] for i in d]
        got = np.zeros(blocks, np.int64)
        np.maximum.at(got, d >> lexical.SHIFT, lexical.impact(tf, m[d]))
        assert (got <= x.bound).all() and (x.bound[got > 0] <= 1.1 * got[got > 0] + 2).mean() > 0.2
    read = []
    postings = lexical.PostingList.postings
    monkeypatch.setattr(lexical.PostingList, "postings", lambda self, at, base: read.append(len(at)) or postings(self, at, base))
    asked = [f"w{i}".encode() for i in (0, 1, 2, 5, 90, 200, 390)]
    pairs = [(lists[t], math.floor(1000 * math.log((2 * n + 2) / (2 * sum(lists[t].entry["n"].tolist()) + 1)))) for t in asked]
    lexical.best_of([x for x, _ in pairs], [w for _, w in pairs], m, blocks)
    assert sum(read) < 0.5 * sum(int(x.entry["n"].sum()) for x, _ in pairs)


def test_shards_do_not_gather_documents(spark):
    """A shard holds what one task has read, up to its size."""
    docs, _ = frames(spark, [(i, "word " * 40) for i in range(2000)])
    index = common.keep(lexical.build_index(docs.repartition(4), 10_000), "test-index")
    most = index.filter("octet_length(term) = 0").agg({"n": "max", "shard": "count"}).first()
    assert most["max(n)"] == 50 and most["count(shard)"] >= 40
