"""Each operator against a plain version, on odd rows and on the smallest tables."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash

from funcrisk.llm import blocks, exact, mixing, packing, pii, quality, scoring, simhash, suffixes, tokens, urls

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"
PROSE = "the Quick brown fox of 10.2.3.4 and a@b.example.org jumps over that lazy dog in the É day of\x85it "
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two three"), (5, "one TWO three"), (6, PROSE * 40), (7, (PROSE * 40).upper()),
    (8, PROSE * 40 + "tail"), (9, "x" * 3000), (10, "line\nline\nline\n"), (11, "İstanbul ΣΑΣ ﬁ <|endoftext|> it's 'lL e\u0301 \x1c a\u00a0b"),
    (12, "# | # * $ % & < >"), (13, PROSE * 1500), (13, PROSE * 1500), (14, "same passage " * 12 + "then some more of it"),
    (15, "other start, " + "same passage " * 12), (16, "4111 1111 1111 1111 or +1 (366) 555-9807, 1.2.3.4.5.6.7.8 and 999.1.1.1"), (17, "cafe\u0301 café"),
]


def frame(spark, rows, more=""):
    """Documents with columns whose names clash with those that operators add."""
    data = [(i, t, None if i % 5 == 0 else f"s{i % 3}", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, hash int, block int, n_words int")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, ROWS).filter("doc_id < 0")


@pytest.fixture(scope="module")
def small(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["docs", "small"])
def either(request):
    return request.getfixturevalue(request.param)


def test_tokens_are_those_of_the_library(either, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    want = sorted((k, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for k, x in plain_texts(either))
    assert sorted(map(tuple, tokens.count_tokens(either, VOCABULARY).collect())) == want
    assert tokens.count_tokens(empty, VOCABULARY).collect() == []


def test_tokens_of_random_strings():
    from tokenizers import Tokenizer

    t, m, r = Tokenizer.from_file(VOCABULARY), tokens.Merger(VOCABULARY), random.Random(3)
    letters = "abcABC'tsrlvm d  \n\t.,!?0123éßΣσİñ漢字🙂\u0301\u00a0<|>endoftext"
    for _ in range(3000):
        x = "".join(r.choice(letters) for _ in range(r.randrange(40)))
        assert m.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def exact_groups(rows):
    groups = defaultdict(list)
    for k, x in rows:
        groups[x.translate(AZ)].append(k)
    return sorted((k, max(ids), len(ids), k == max(ids), hashlib.sha256(x.encode()).hexdigest()) for x, ids in groups.items() for k in ids)


def test_exact_dedup(either, empty):
    assert sorted(map(tuple, exact.exact_dedup(either).collect())) == exact_groups(plain_texts(either))
    assert exact.exact_dedup(empty).collect() == []


def test_small_chunks_give_the_same_groups(docs):
    assert sorted(map(tuple, exact.exact_dedup(docs, 8, 64).collect())) == exact_groups(plain_texts(docs))


def test_chunks_give_the_text_back(spark, docs):
    from pyspark.sql import functions as F

    rows = docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", exact.chunks(F.col("t"), 16, 64).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in rows)


def test_null_ids_do_not_break(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (None, "long " * 30)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in exact.exact_dedup(df).collect()) == [(0, 0, 1), (0, 3, 3), (0, 3, 3), (3, 3, 3)]
    assert suffixes.remove_repeats(df).count() == scoring.score_texts(df).count() == simhash.near_duplicates(df).count() == 4
    assert quality.quality_rules(df).count() == tokens.count_tokens(df, VOCABULARY).count() == packing.pack(df, VOCABULARY).count() == pii.find_personal_data(df).count() == 4


def removed(rows, length=50):
    raw, first = [(k, x.encode()) for k, x in rows], {}
    for k, x in sorted(raw):
        for i in range(len(x) - length + 1):
            first.setdefault(x[i:i + length], k)
    out = []
    for k, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if first[x[i:i + length]] < k:
                gone[i:i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(x, gone) if not g)
        out.append((k, len(x), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [4 << 20, 60_000])
def test_repeats_go(either, empty, size):
    assert sorted(map(tuple, suffixes.remove_repeats(either, block_bytes=size).collect())) == removed(plain_texts(either))
    assert suffixes.remove_repeats(empty).collect() == []


def test_a_copied_row_leaves_other_rows_of_its_id(spark):
    """Null ids are one document that comes last; so do rows that repeat an id with other texts."""
    own, copy = "only here, " + "0123456789 abcdefghij " * 5, "a passage that two documents hold " * 3
    rows = [(None, copy), (None, own), (None, "a b"), (3, "a b"), (3, copy), (7, copy), (7, copy), (7, own + "and more"), (7, "short"), (9, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None if k == suffixes.LAST else k, *rest) for k, *rest in removed([(suffixes.LAST if k is None else k, x) for k, x in rows])]
    for size in (4 << 20, 200):
        assert Counter(map(tuple, suffixes.remove_repeats(df, block_bytes=size).collect())) == Counter(want)
    lone = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (None, "long " * 30)], "doc_id long, text string")
    assert [r["n_removed"] for r in suffixes.remove_repeats(lone).filter("n_bytes = 150").collect()] == [0]


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 12 <= len(d) <= 19 and total % 10 == 0
                    or kind == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns_on_random_strings():
    r = random.Random(5)
    for _ in range(20_000):
        x = "".join(r.choice("ab1122.@.-+ ()5%") for _ in range(r.randrange(40)))
        assert pii.base_spans(x) == plain_spans(x), x


def test_personal_data(either, empty):
    got = pii.find_personal_data(either, fit_windows=200).collect()
    text = defaultdict(list)
    for k, x in plain_texts(either):
        text[k].append(x)
    for r in got:
        base = plain_spans(text[r["doc_id"]][0])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for _, _, k in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) - {""} <= set(r["spans"].split(","))
    assert len(got) == sum(map(len, text.values())) and pii.find_personal_data(empty).collect() == []


def test_tagger_gradient_and_learning():
    rng = np.random.default_rng(1)
    t = pii.new_tagger(1)
    ids, mask = rng.integers(0, 64, (2, 6)), np.array([[1.0] * 6, [1.0] * 4 + [0.0] * 2])
    tags = rng.integers(0, pii.TAGS, (2, 6))
    _, grads = t.loss_and_grads(ids, tags, mask)
    for name in t.p:
        i = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, h = t.p[name][i], 1e-5
        t.p[name][i] = old + h
        up, _ = t.loss_and_grads(ids, tags, mask)
        t.p[name][i] = old - h
        down, _ = t.loss_and_grads(ids, tags, mask)
        t.p[name][i] = old
        assert math.isclose((up - down) / (2 * h), grads[name][i], rel_tol=1e-4, abs_tol=1e-6), name
    r = random.Random(2)
    make = lambda: ("w" * r.randrange(3, 9) + " ", f"u{r.randrange(99)}@mail{r.randrange(9)}.example.com", " and " + "v" * r.randrange(9))
    rows = [make() for _ in range(400)]
    model = pii.fit(["".join(x)[:64] for x in rows], ["".join(c * len(p) for c, p in zip("010", x))[:64] for x in rows])
    right = total = 0
    for x in [make() for _ in range(100)]:
        piece, label = "".join(x)[:64], "".join(c * len(p) for c, p in zip("010", x))[:64]
        tags = model.decode(*pii.batch_of([piece]))[0][:len(piece)]
        right, total = right + int((tags == np.frombuffer(label.encode(), np.uint8) - 48).sum()), total + len(piece)
    assert right / total > 0.97


def test_scores(either, empty):
    rows = plain_texts(either)
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    split = lambda x: [*re.findall(rb"[^\x20\x09-\x0D]+", x.translate(AZ).encode()), b""]
    count = Counter(w for k, x in rows if not held(k) for w in split(x))
    n, v = sum(count.values()), len(count)
    got = scoring.score_texts(either, block_bytes=200_000).collect()
    want = sorted((k, held(k), len(w := split(x)), sum(count[i] > 0 for i in w), n, round(sum(math.log10((count[i] + 1) / (n + v + 1)) for i in w), 4)) for k, x in rows)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and scoring.score_texts(empty).collect() == []


def test_bit_predictors_make_a_distribution_and_learn(small):
    grams = scoring.flat([x.encode() for _, x in plain_texts(small)[:40]]).grams
    known, seen = scoring.counted(grams)
    slot, both = scoring.bit_counts(known, seen)
    counts = np.zeros((1 << scoring.SLOT_BITS, 2), np.uint16)
    counts[slot.astype(np.int64)] = np.minimum(both, 65535)
    model = scoring.fit(counts, known[:4000], seen[:4000], rounds=1)
    ahead = (known[100] >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert math.isclose((10 ** model.log10(ahead)).sum(), 1.0, rel_tol=1e-6)
    held = scoring.flat([x.encode() for _, x in plain_texts(small)[40:60]]).grams
    assert -model.log10(held).mean() * math.log2(10) < 4.5


def test_mixing_weights_are_learnt_from_all_contexts(spark, small):
    """Every context of every part counts; 65,536 of them at most before. One part alone gives the plain rounds."""
    texts_ = [x.encode() for _, x in plain_texts(small)[:40]]
    halves = [scoring.counted(scoring.flat(t).grams) for t in (texts_[:20], texts_[20:])]
    counts = np.zeros((1 << scoring.SLOT_BITS, 2), np.uint16)
    for known, seen in halves:
        slot, both = scoring.bit_counts(known, seen)
        counts[slot.astype(np.int64)] += both.astype(np.uint16)
    rows = [(i, blocks.pack_keys(known), blocks.planes(seen)) for i, (known, seen) in enumerate(halves)]
    table = lambda x: spark.createDataFrame(x, "part long, keys binary, vals binary")
    one, plain = scoring.taught(table(rows[:1]), counts, 2), scoring.fit(counts, *halves[0])
    assert np.allclose(one.weights, plain.weights, atol=1e-3) and np.allclose(one.refine, plain.refine, atol=1e-3)
    mine = [scoring.Model.untaught(counts) for _ in halves]
    mass = [scoring.learn(m, *h) for m, h in zip(mine, halves)]
    both = scoring.taught(table(rows), counts, 2, passes=1)
    used = sum(u for u, _ in mass)
    want = np.where(used > 0, sum(m.weights * u for m, (u, _) in zip(mine, mass)) / np.maximum(used, 1), 1 / scoring.ORDERS)
    assert np.allclose(both.weights, want, atol=1e-3)
    assert np.isclose(used[:, 0].sum(), 8 * sum(np.minimum(seen, 1000).sum() for _, seen in halves))


def test_the_facts_hold_every_training_context():
    known = np.arange(70_000, dtype=np.uint64) * np.uint64(977)
    seen = np.ones(len(known), np.int64)
    facts = pd.DataFrame({"keys": [blocks.pack_keys(known)], "vals": [blocks.planes(seen)], "block": [0], "n": [len(known)]})
    told = scoring.told((2, 0), facts)
    assert told.loc[told["kind"] == 4, "n"].sum() == len(known)


def test_quality(either, empty):
    want = []
    for k, x in plain_texts(either):
        ws = re.findall(WORD, x)
        seen, cover = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4)), set()
        for i in range(len(ws) - 4):
            if seen[tuple(ws[i:i + 5])] > 1:
                cover.update(range(i, i + 5))
        lines = [y for y in x.split("\n") if re.search(WORD, y)]
        failed = len(ws) < 10 or 100 * len(cover) > 20 * len(ws)
        want.append((k, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(cover), failed))
    got = quality.quality_rules(either).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got) and quality.quality_rules(empty).collect() == []


def test_mixing(spark, either, empty):
    for target in (mixing.Target(repeats=1.5), mixing.Target(entropy=0.97)):
        rows = mixing.mixture(either, target).collect()
        shown, has = Counter(), Counter()
        for r in either.select("source", "text").collect():
            has[r["source"]] += len(re.findall(WORD, r["text"] or ""))
        for r in rows:
            shown[r["source"]] += r["n_tokens"]
        assert Counter(r["doc_id"] for r in rows).keys() == {r["doc_id"] for r in either.select("doc_id").collect()}
        assert len({(r["source"], r["weight"]) for r in rows}) == len(has)
        rate = [shown[s] / has[s] for s in has if has[s]]
        assert min(rate) >= 1 and (target.repeats is None or max(rate) <= target.repeats * 2 + 1)
    assert mixing.mixture(empty).collect() == []


def test_mixing_meets_weights_and_budget(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixture(df, mixing.Target(repeats=2.0)).groupBy("source", "weight").sum("n_tokens").collect()
    total = sum(r[2] for r in out)
    assert all(abs(r[2] / total - r["weight"]) < 0.01 for r in out)
    half = mixing.mixture(df, mixing.Target(repeats=2.0), budget=10_000).collect()
    assert abs(sum(r["n_tokens"] for r in half) - 10_000) < 30 and len({r["doc_id"] for r in half}) == len(half)


def test_packing(either, empty):
    from tokenizers import Tokenizer

    t, size = Tokenizer.from_file(VOCABULARY), 512
    got, by, places = packing.pack(either, VOCABULARY, size=size).collect(), defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for k, x in plain_texts(either):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        for i, a in enumerate(range(0, len(ids), size)):
            part = ids[a:a + size]
            want[k].append((i, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= size
    assert len(places) <= 1.05 * sum(r["length"] for r in got) / size + 1
    assert packing.pack(empty, VOCABULARY).collect() == []


def test_letters_that_python_does_not_know_are_the_librarys():
    words = [f"a{chr(c)}b{x}" for c in (0x558, 0x58B, 0x1C89, 0xA7CB, 0xA7DC, 0x378, 0x1FFFF) for x in ("", "<|endoftext|>", "\u0301é")]
    lib, counts, ids = tokens.library(VOCABULARY), tokens.Merger(VOCABULARY), packing.Ids(VOCABULARY)
    for w in [*words, " and ".join(words)]:
        want = lib.encode(w, add_special_tokens=False).ids
        assert counts.count(w) == len(want) and ids.of(w) == np.array(want, "<u4").tobytes()


def test_a_workers_memory_of_words_ages(monkeypatch):
    """Two ages of a few entries each: ids stay right, what is met again stays known, and memory stays bounded."""
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 30)
    lib, ids, r = tokens.library(VOCABULARY), packing.Ids(VOCABULARY), random.Random(4)
    for i in range(60):
        text = " ".join(["the", "often", "met,", *(f"w{r.randrange(400)}{r.choice(['', 'x.', '-y'])}" for _ in range(10))])
        assert ids.of(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert i < 2 or {"the", "often", "met,"} <= ids.words.keys() | ids.old_words.keys()
        assert max(map(len, (ids.words, ids.old_words, ids.pieces, ids.old_pieces))) <= 30 + 60 + len(ids.fixed)


def test_a_text_is_cut_once_in_normal_form(monkeypatch):
    """Words are remembered in normal form and end at line feeds, too; special strings and odd white space stay the library's."""
    lib, ids = tokens.library(VOCABULARY), packing.Ids(VOCABULARY)
    odd = ["Met met MET\nmet", "\x1cMet\x1c met\u2028met\u00a0MET\x0b", "ΣΑΣ Σ met's", "a<|endoftext|>Met <|endoftext|><|x", "e \u0301\u0323met", "", " \n ", "word " * 3 + "x" * 60]
    for text in [*odd, " ".join(odd), *odd]:
        assert ids.of(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert "met" in ids.words and not {"Met", "MET\nmet", "MET"} & ids.words.keys()
    asked, plain = [], packing.Ids(VOCABULARY)
    monkeypatch.setattr(plain, "learn", lambda new, learn=plain.learn: asked.append(len(new)) or learn(new))
    plain.of("Met met MET\nmet, met.")
    assert asked == [3]


def test_the_program_packs_close_to_the_size_bound():
    rng, room = random.Random(5), 4096
    few = Counter(min(room, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(3000))
    for histogram in (few, {k: 50 * n for k, n in few.items()}):
        bound = -(-sum(k * n for k, n in histogram.items()) // room)
        assert sum(n for n, _ in packing.solve(histogram, room)) <= bound * 1.002 + 1


def test_packing_plan_covers_any_histogram():
    r = random.Random(1)
    for _ in range(20):
        room = r.choice([7, 50, 300])
        histogram = {r.randint(1, room): r.randint(1, 50) for _ in range(r.randint(1, 30))}
        total = Counter()
        for copies, config in packing.solve(histogram, room, rounds=30):
            assert copies > 0 and sum(k * n for k, n in config.items()) <= room
            for k, n in config.items():
                total[k] += copies * n
        assert total == histogram
    assert packing.solve({}, 10) == []


def plain_fingerprint(x):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", x.translate(AZ).encode())
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + 4]), 42) for i in range(max(1, len(ws) - 3))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(y >> b & 1 for y in h) > len(h))


def plain_components(fps):
    ids, parent = sorted(fps), {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids}


def test_near_duplicates(either, empty):
    fps = {k: plain_fingerprint(x) for k, x in plain_texts(either)}
    group = plain_components(fps)
    got = simhash.near_duplicates(either).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(k, f"{v:016x}", group[k]) for k, v in fps.items()}
    assert len(got) == either.count() and simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("limit", [4096, 6])
def test_links_of_dense_groups(spark, limit):
    """A low limit sends groups on to longer chains, up to the whole ring."""
    r = random.Random(4)
    values = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
    fps = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in fps.values()], "fp long").repartition(4)
    label = {x["node"]: x["label"] for x in simhash.components(simhash.links(df, limit=limit)).collect()}
    want, back = plain_components(fps), {v: k for k, v in fps.items()}
    mine = {back[int(np.int64(n).view(np.uint64))]: back[int(np.int64(v).view(np.uint64))] for n, v in label.items()}
    same = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert same(mine) == same(want)


def test_url_verdicts(spark):
    shown = ["https://A.example.NET/en/x?q#f", "http://net", "http://net/", "ftp://x.org/fr/1", "no scheme", None, "a://b://c.net/d", "https://notexample.com/de/", "https://w.example.com/de/", "://", "https://w.example.com/de", "http://.net/x", "http://x.net?y/", "http://net/", "http://" + "a." * 3000 + "net/"]
    df = spark.createDataFrame([(i % 13, u, "h", "p") for i, u in enumerate(shown)], "page_id long, url string, host string, path string")
    want = []
    for i, u in enumerate(shown):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host):])[0], host.translate(AZ)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want.append((i % 13, host, path, rule, verdict))
    assert sorted(map(tuple, urls.url_verdicts(df).collect()), key=str) == sorted(want, key=str)
    assert urls.url_verdicts(df.filter("page_id < 0")).collect() == []
