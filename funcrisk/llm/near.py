"""Near copies by SimHash: fingerprints prune what meets in a rare shingle, whole sets confirm what is left.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Shingles
have one order for all texts, common ones last. A pair of that similarity shares a shingle among the first
n - ceil(0.8 n) + 1 of each text's n, so these alone are join keys, and each carries its text's fingerprint. What meets is
pruned by lengths, by places and by the ring of the fingerprints' segments, then by their full distance; only then sets
move. Texts of that similarity differ in some 10 of 64 bits, 12 in sets of four and five, with a deviation of 3; other
texts in 32 with one of 4: DISTANCE lies four deviations above the former. Signs, the parities of a set's names, bound from
above what two sets share, so that most pairs below 0.8 are dropped where they meet; that bound misses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk.llm import blocks as B
from funcrisk.llm.common import among, keep, texts
from funcrisk.llm.simhash import components, rings_hold

WIDTH, CHUNK, SLICE = 5, 1 << 18, 1 << 23
#: A shingle in more texts than COMMON comes late in the order, the MOST_COMMON ones at most; any order is right.
COMMON, MOST_COMMON = 64, 50_000
#: Fingerprints of near copies differ in at most so many bits; for so many segments on the ring.
DISTANCE, SEGMENTS = 24, 4
#: Bits of a sign.
SIGN = 512
#: Texts of one key and one block, of which two at a time are compared.
GROUP = 4096
#: Texts of a block that all of it is tried with before its pairs are tried one by one.
PROBES = 16
CACHE_ENTRIES = 500_000
U64 = np.uint64
_words: dict[bytes, int] = {}


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct sorted 64-bit names of the text's shingles; a text of fewer words is one shingle, A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_words) > CACHE_ENTRIES:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), U64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    name = np.full(n if width else 1, U64(width))
    for k in range(width):
        name = B.mixed(name * U64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(name)


def fingerprint(names: np.ndarray) -> int:
    """A bit is 1 if set in over half of the names of a text's shingles."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(names), CHUNK):
        ones += np.unpackbits(names[lo:lo + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(names), bitorder="little").view(np.int64)[0])


def sign(names: np.ndarray) -> bytes:
    """Bit k is 1 if an odd number of the names end in k. Each name that only one of two sets has turns one bit."""
    return np.packbits(np.bincount((names & U64(SIGN - 1)).astype(np.int64), minlength=SIGN).astype(np.uint8) & 1).tobytes()


def signs_hold(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m names with signs x and y can be similar: as these differ in at most the names that only one
    set has, of which there are at most (n + m) / 9 then."""
    return 9 * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n.astype(np.int64) + m


def sign_rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), U64).reshape(-1, SIGN // 64)


def least_shared(n: np.ndarray) -> np.ndarray:
    """The shingles of n that a near copy has at least."""
    return (4 * n + 4) // 5


def similar(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether so many shared shingles of n and m make a Jaccard similarity of 0.8."""
    return 9 * shared >= 4 * (n + m)


def row_number() -> Column:
    """Names a row: 64 bits of id and text. Rows equal in both are one."""
    return F.xxhash64("doc_id", "text")


def counted(docs: DataFrame) -> DataFrame:
    """(key, n, sign) of two kinds: how often a slice of the texts has a shingle, single ones left out (sign null), and
    of each node (as key) how many shingles it has, with their sign."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in B.slices(batch["text"].str.len().to_numpy(), SLICE):
                sets = [shingles(x) for x in batch["text"].iloc[a:b]]
                yield pd.DataFrame({"key": batch["node"].iloc[a:b].to_numpy(), "n": [len(x) for x in sets], "sign": [sign(x) for x in sets]})
                names, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"key": names[n > 1].view(np.int64), "n": n[n > 1], "sign": None})

    return keep(docs.select("node", "text").mapInPandas(count, "key long, n long, sign binary"), "near-counted")


def common_shingles(counts: DataFrame, common: int, most: int) -> np.ndarray:
    """Sorted names of shingles in more than `common` texts, by the counts of slices.

    It is for speed alone, as any order serves.
    """
    rows = counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > common).orderBy(F.desc("n"), "key").limit(most).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(U64))


def prefix_keys(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, node, fp, n, rest): the first shingles of each text, its fingerprint, how many it has, and how many come after the key."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in B.slices(batch["text"].str.len().to_numpy(), SLICE):
                out, texts_ = [], []
                for node, text in zip(batch["node"].iloc[a:b], batch["text"].iloc[a:b]):
                    names = shingles(text)
                    n = len(names)
                    late = np.zeros(n, bool)
                    if len(common):
                        late = common[np.minimum(np.searchsorted(common, names), len(common) - 1)] == names
                    out.append(np.concatenate([names[~late], names[late]])[:n - int(least_shared(n)) + 1])
                    texts_.append((node, fingerprint(names), n))
                size = [len(x) for x in out]
                node, fp, n = (np.repeat(np.array(x, np.int64), size) for x in zip(*texts_))
                at = np.concatenate([np.arange(x) for x in size])
                yield pd.DataFrame({"key": np.concatenate(out).view(np.int64), "node": node, "fp": fp, "n": n.astype(np.int32), "rest": (n - 1 - at).astype(np.int32)})

    return docs.mapInPandas(emit, "key long, node long, fp long, n int, rest int")


def may_be(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether texts (fp, n, rest, sign if known) that first meet at this key can be similar: by what follows it in both, by
    the ring of their fingerprints, by the bits in which these differ, and by their signs.

    A pair is asked at each key that it shares; at the first one the bound on what follows holds.
    """
    n, m = x[1].astype(np.int64), y[1].astype(np.int64)
    good = similar(1 + np.minimum(x[2], y[2]).astype(np.int64), n, m)
    diff = (x[0][good] ^ y[0][good]).view(np.uint64)
    near = rings_hold(diff, SEGMENTS, DISTANCE)
    near[near] = np.bitwise_count(diff[near]) <= DISTANCE
    good[good] = near
    if len(x) > 3:
        good[good] = signs_hold(x[3][good], y[3][good], n[good], m[good])
    return good


def pairs_of(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def meet_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each key, rows sorted by (key, n, node): each text with the first one and with the one before it (a < b), and,
    of keys with over three texts, their rows (b null), which have more pairs. Only the open key's first rows and its
    last one are held."""
    names = ["key", "node", "fp", "n", "rest"]
    held, seen = None, 0
    for batch in batches:
        cols = [batch[c].to_numpy() for c in names]
        old = 0
        if held is not None and held[0][0] == cols[0][0]:
            old, cols = len(held[0]), [np.concatenate(x) for x in zip(held, cols)]
        key, node, *facts = cols
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        total = size.copy()
        total[0] += seen - old if old else 0
        first = np.repeat(starts, size)
        now = np.arange(len(key))
        for other in (first, now - 1):
            at = now[(now >= old) & (now > first) & ((other == first) | (now - 1 > first))]
            at = at[node[at] != node[other[at]]]
            at = at[may_be([x[at] for x in facts], [x[other[at]] for x in facts])]
            if len(at):
                yield pairs_of(node[at], node[other[at]]).assign(b=lambda x: x["b"].astype("Int64"), key=0, fp=0, n=0, rest=0)
        # The first three go out with the fourth.
        many = (np.repeat(total, size) > 3) & ((now >= old) | (now < 3) & (seen <= 3))
        if many.any():
            yield pd.DataFrame({"a": node[many], "b": pd.array([None] * int(many.sum()), "Int64"), "key": key[many], "fp": facts[0][many], "n": facts[1][many], "rest": facts[2][many]})
        lo, seen = starts[-1], int(total[-1])
        keep_ = np.unique(np.r_[np.arange(lo, min(lo + 3, len(key))), len(key) - 1])
        held = [x[keep_] for x in cols]


def cells(open_: DataFrame, signs: DataFrame, group: int) -> DataFrame:
    """Rows of keys whose texts have several labels, with their signs, cut into blocks of about `group`: each goes to the
    cells, two blocks of a key, that it belongs to, so that every pair shares one."""
    several = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / group).cast("int").alias("blocks"))
    rows = open_.join(several.filter("lo < hi").select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("a", "key"), F.col("blocks")).cast("int"))
    rows = rows.join(signs.select(F.col("node").alias("a"), "sign"), "a")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), (F.col("block") == F.col("other")).alias("own"), "block", "a", "label", "fp", "n", "rest", "sign")


def whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by cell, cut between cells, which are of bounded size."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        cell = batch["cell"].to_numpy()
        if held and held[-1]["cell"].iloc[-1] != cell[0]:
            yield pd.concat(held)
            held = []
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]])
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held)


def meet_some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each cell the pairs (a < b) of different labels with one of PROBES texts, the first by a scramble of their names,
    so that keys of the same texts ask about the same pairs."""
    for rows in whole_cells(batches):
        cell, node, label, *facts = (rows[c].to_numpy() for c in ("cell", "a", "label", "fp", "n", "rest"))
        facts.append(sign_rows(rows["sign"]))
        order = np.lexsort((B.mixed(node.view(U64)), cell))
        cell, node, label, *facts = (x[order] for x in (cell, node, label, *facts))
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        first, now = np.repeat(starts, np.diff(np.r_[starts, len(cell)])), np.arange(len(cell))
        for k in range(PROBES):
            at = now[now > first + k]
            at = at[label[at] != label[first[at] + k]]
            at = at[may_be([x[at] for x in facts], [x[first[at] + k] for x in facts])]
            if len(at):
                yield pairs_of(node[at], node[first[at] + k])


def meet_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each cell the pairs (a < b) of texts of different labels, and of different blocks where it has two."""
    for rows in whole_cells(batches):
        rows = rows.sort_values(["cell", "label"], kind="stable")
        cell, own, block, node, label, *facts = (rows[c].to_numpy() for c in ("cell", "own", "block", "a", "label", "fp", "n", "rest"))
        facts.append(sign_rows(rows["sign"]))
        now = np.arange(len(cell))
        ends = np.r_[np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
        runs = np.r_[np.flatnonzero((cell[1:] != cell[:-1]) | (label[1:] != label[:-1])) + 1, len(cell)]
        # A text meets all that stand behind those of its label.
        begin, end = runs[np.searchsorted(runs, now, "right")], ends[np.searchsorted(ends, now, "right")]
        after = end - begin
        total = np.cumsum(after)
        lo = 0
        while lo < len(cell):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, "right")))
            x = np.repeat(now[lo:hi], after[lo:hi])
            y = np.repeat(begin[lo:hi], after[lo:hi]) + np.arange(len(x)) - np.repeat(np.r_[0, np.cumsum(after[lo:hi])[:-1]], after[lo:hi])
            apart = own[x] | (block[x] != block[y])
            x, y = x[apart], y[apart]
            good = may_be([f[x] for f in facts], [f[y] for f in facts])
            if good.any():
                yield pairs_of(node[x[good]], node[y[good]])
            lo = hi


def likely(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The different pairs (a, b) whose signs leave it open that they are similar."""
    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[signs_hold(sign_rows(batch["x"]), sign_rows(batch["y"]), batch["n"].to_numpy(), batch["m"].to_numpy()), ["a", "b"]]

    x = signs.select(F.col("node").alias("a"), F.col("n"), F.col("sign").alias("x"))
    y = signs.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sign").alias("y"))
    return pairs.distinct().join(x, "a").join(y, "b").mapInPandas(hold, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar; only texts in pairs move, as names of shingles."""
    pairs = keep(pairs.distinct(), f"{name}-pairs")
    some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "names": [shingles(x).tobytes() for x in batch["text"]]})

    sets = keep(among(docs.select("node", "text"), some, "node").dropDuplicates(["node"]).mapInPandas(named, "node long, names binary"), f"{name}-sets")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                good.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.loc[good, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("names").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("names").alias("y"))
    return keep(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(confirm, "a long, b long"), f"{name}-links")


def near_copies(docs: DataFrame, common: int = COMMON, most: int = MOST_COMMON, group: int = GROUP) -> DataFrame:
    """(node, label) of all rows of docs with a near copy: row_number() and the smallest one of its component.

    Links are pairs of at least 0.8; null text is empty. Texts that meet at a key are first tried with two of them, then with
    PROBES; only pairs that this leaves in different components are tried one by one, so a group of near copies costs few.
    """
    docs = texts(docs).withColumn("node", row_number())
    facts = counted(docs)
    signs = facts.filter("sign is not null").select(F.col("key").alias("node"), "n", "sign").dropDuplicates(["node"])
    keys = prefix_keys(docs.select("node", "text"), common_shingles(facts.filter("sign is null").select("key", "n"), common, most))
    sorted_ = keys.repartition("key").sortWithinPartitions("key", "n", "node")
    met = keep(sorted_.mapInPandas(meet_first, "a long, b long, key long, fp long, n int, rest int"), "near-met")
    links = confirmed(likely(met.filter("b is not null").select("a", "b"), signs), docs, "near-first")
    label, heavy = components(links), met.filter("b is null").drop("b")
    for meet, name in ((meet_some, "near-some"), (meet_others, "near-more")):
        open_ = heavy.join(label.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
        dealt = cells(open_, signs, group)
        dealt = dealt.filter("own") if meet is meet_some else dealt
        more = confirmed(dealt.repartition("cell").sortWithinPartitions("cell").mapInPandas(meet, "a long, b long"), docs, name)
        if not more.isEmpty():
            links = links.unionByName(more)
            label = components(links)
    # A component's smallest node has no row of its own there.
    return label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())
