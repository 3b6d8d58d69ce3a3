"""Prefix tries against a plain version that keeps every sequence in one dictionary."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from funcrisk.llm import trie

#: Conversations are (conv_id, turn, role, text); 100 is a base that is there, 200 one that is not.
ROWS = [
    (100, 0, "user", "a"), (100, 1, "assistant", "b"), (100, 2, "user", "c"), (100, 3, "assistant", "d"), (100, 4, "user", "e"), (100, 5, "assistant", "f"),
    (101, None, None, "null turn and role"), (101, 0, "user", None), (101, 0, "user", None), (101, 0, "user", "tie"), (102, 5, "user", "x"), (102, 3, "user", "y"),
    (103, 0, "us", "era"), (104, 0, "use", "ra"), (105, 0, "", ""), (105, 1, None, None), (106, 0, "user", "long 漢字🙂 " * 3000),
    (-7, 0, "user", "a"), (-7, 1, "user", "z"), (0, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "nobody's"),
    *[(c, 0, "user", "only one") for c in range(201, 230)], *[(300, i, "user", str(i % 3)) for i in range(700)], *[(i, 0, "user", "a") for i in range(301, 330)],
]


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append(((turn is not None, turn or 0, tie), (role, text)))
    seqs = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(seqs.get(base, [])[:h] + own[h:])
    members = defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    children, sums = defaultdict(set), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            children[p[:-1]].add(p)
    for p, of in sorted(members.items(), key=lambda x: -len(x[0])):
        sums[p][0] += not children[p]
        sums[p][1] += (len(of) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            sums[p[:-1]] = [x + y for x, y in zip(sums[p[:-1]], sums[p])]
    ends = defaultdict(list)
    for c, s in built.items():
        ends[s].append(c)
    return Counter((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), len(children[p]), *sums[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, of in members.items())


def frame(spark, rows=ROWS):
    """Conversations with columns whose names clash with those that the operator adds."""
    return spark.createDataFrame([(*r, 1, b"k", "p") for r in rows], "conv_id long, turn long, role string, text string, id int, key binary, path string")


@pytest.mark.parametrize("shard_turns", [1, 3, 50, 1 << 18])
def test_odd_rows(spark, shard_turns):
    got = trie.prefix_trie(frame(spark).repartition(3), shard_turns=shard_turns)
    assert got.columns == list(trie.NODE_COLUMNS)
    assert Counter(map(tuple, got.collect())) == plain(ROWS)


def test_no_conversations(spark):
    assert trie.prefix_trie(frame(spark).limit(0)).collect() == trie.prefix_trie(frame(spark).filter("conv_id is null")).collect() == []


def test_conversations_without_turns_of_their_own(spark):
    """All are shorter than what they would take from a conversation that is not there."""
    some = [(c, 0, "user", "x") for c in range(401, 499) if zlib.crc32(str(c).encode()) % 6]
    assert Counter(map(tuple, trie.prefix_trie(frame(spark, some)).collect())) == plain(some)
    assert trie.prefix_trie(frame(spark, some)).collect()[0]["depth"] == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    """Few different turns, so that nodes are shared over many small shards, and deep frequent prefixes."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 3000), 200):
        seq = ["hot"] * r.randrange(12) if r.random() < 0.4 else []
        seq += [r.choice("ab") for _ in range(r.randrange(6))] + r.choice([[], ["tail"] * 3, [f"own{c}"]])
        rows += [(c, i, "user", x) for i, x in enumerate(seq or ["only"])]
    for shard_turns in (r.randrange(2, 8), r.randrange(20, 60)):
        got = trie.prefix_trie(frame(spark, rows).repartition(2), shard_turns=shard_turns)
        assert Counter(map(tuple, got.collect())) == plain(rows)


def test_double_arrays_hold_their_paths_and_no_others():
    r = random.Random(3)
    for codes in (2, 40, 3000):
        paths = sorted({tuple(r.randrange(codes) for _ in range(r.randrange(7))) for _ in range(800)})
        t = trie.DoubleArray([list(p) for p in paths])
        nodes = {p[:d] for p in paths for d in range(len(p) + 1)}
        assert len(t.order) == len(nodes) and all(len(t.walk(list(p))) == len(p) + 1 for p in nodes)
        assert len({t.walk(list(p))[-1] for p in nodes}) == len(nodes)
        for _ in range(2000):
            p = tuple(r.randrange(codes) for _ in range(r.randrange(1, 8)))
            assert (len(t.walk(list(p))) == len(p) + 1) == (p in nodes)
        # Paths share one array with few holes.
        assert len(t.check) < 3 * len(nodes) + 2 * codes


def test_a_prefix_of_a_third_is_dealt_over_shards(spark):
    rows = [(c, i, "user", x) for c in range(10_000, 10_900) for i, x in enumerate(["same"] * 8 + [f"{c % 300}", f"{c}"])]
    members = trie.paths(frame(spark, rows), rebuild=lambda c: (c, c * 0), most=1)
    with_key = members.selectExpr("*", "unhex(sha2(array_join(cast(path as array<string>), ','), 256)) as key")
    nodes = trie.shard_rows(with_key, 500)
    sizes = [r["count"] for r in nodes.groupBy("shard").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 500
    assert np.isclose(nodes.filter("depth = 10").count(), 900)
