"""SimHash near-duplicates: pigeonring filtering, then components of the links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import keep, texts

WIDTH, SEED, DISTANCE, SEGMENTS = 4, 42, 4, 5
#: Fingerprints of one key that are compared in place; a larger group goes on with a longer chain.
GROUP = 4096
CHUNK = 1 << 18
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """A bit is 1 if set in over half of the hashes of the text's shingles, repeats included; without words, 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo:lo + CHUNK], stops[lo:lo + CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, a signed 64-bit number; row-local."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in s], np.uint64).view(np.int64))

    return texts(docs).select("doc_id", fp("text").alias("fp"))


def bounds(segments: int = SEGMENTS) -> list[int]:
    return [64 * i // segments for i in range(segments + 1)]


def segment_bits(start: int, k: int, segments: int) -> tuple[int, int]:
    edge, i = bounds(segments), (start + k) % segments
    return edge[i], edge[i + 1]


@lru_cache(maxsize=64)
def chain(start: int, length: int, segments: int, distance: int) -> tuple[np.uint64, np.ndarray]:
    """The bits of `length` segments of the ring from `start`, and all differences there that the budgets allow: at
    most floor(l * distance / segments) bits in the first l segments, for every l."""
    mask, found = 0, [(0, 0)]
    for k in range(length):
        lo, hi = segment_bits(start, k, segments)
        mask |= (1 << hi) - (1 << lo)
        budget = (k + 1) * distance // segments
        found = [(x | sum(1 << b for b in bits), n + r) for x, n in found for r in range(budget - n + 1) for bits in combinations(range(lo, hi), r)]
    return np.uint64(mask), np.array([x for x, _ in found], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def emit_keys(fps: DataFrame, length: int, segments: int, distance: int) -> DataFrame:
    """(key, fp, probe): for every start, the chain's own bits (probe 0) and all allowed variants of them (probe 1)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_fps = batch["fp"].to_numpy().view(np.uint64)
            for start in range(segments):
                mask, variants = chain(start, length, segments, distance)
                step = max(1, (1 << 20) // len(variants))
                tag = np.uint64(start * 0x632BE59BD9B4E019 & (1 << 64) - 1)
                for lo in range(0, len(all_fps), step):
                    fp = all_fps[lo:lo + step]
                    own = fp & mask
                    keys = np.concatenate([mixed(own ^ tag), mixed((own[:, None] ^ variants[None, :]) ^ tag).ravel()])
                    yield pd.DataFrame({
                        "key": keys.view(np.int64), "fp": np.concatenate([fp, np.repeat(fp, len(variants))]).view(np.int64),
                        "probe": np.repeat(np.array([0, 1], np.int8), [len(fp), len(fp) * len(variants)])})

    return fps.mapInPandas(emit, "key long, fp long, probe byte")


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def rings_hold(diff: np.ndarray, segments: int, distance: int) -> np.ndarray:
    """Whether some start has all its chains within budget; needed for, and cheaper than most of, the full check."""
    edge = bounds(segments)
    parts = [np.bitwise_count((diff >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int8) for lo, hi in zip(edge, edge[1:])]
    out = np.zeros(len(diff), bool)
    for start in range(segments):
        total, ok = np.zeros(len(diff), np.int8), np.ones(len(diff), bool)
        for k in range(segments):
            total = total + parts[(start + k) % segments]
            ok &= total <= (k + 1) * distance // segments
        out |= ok
    return out


def link_groups(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, limit: int, segments: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Links (a, b, False) of all keys in the sorted arrays, a spanning set a chunk; (fp, fp, True) for members of keys with over limit."""
    firsts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[firsts, len(key)])
    own = np.add.reduceat((probe == 0).astype(np.int64), firsts)
    large = (own > limit) & (sizes > own)
    if large.any():
        members = np.unique(fp[np.repeat(large, sizes)])
        yield members, members, True
    live = np.flatnonzero((own > 0) & (sizes > 1) & ~large)
    if not len(live):
        return
    lo, k, m = firsts[live], own[live], sizes[live] - own[live]
    # Inside a key the members with probe 0 stand first; each probe meets them all.
    pairs = np.cumsum(k * m)
    cuts = np.searchsorted(pairs, np.arange(0, pairs[-1], CHUNK), "left")
    for a, b in zip(cuts, [*cuts[1:], len(live)]):
        if a >= b:
            continue
        width, n = k[a:b], m[a:b]
        at = np.repeat(lo[a:b], width * n)
        inner = np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(width * n)[:-1]], width * n)
        w = np.repeat(width, width * n)
        left, right = fp[at + inner % w].view(np.uint64), fp[at + w + inner // w].view(np.uint64)
        diff = left ^ right
        good = (diff != 0) & rings_hold(diff, segments, distance)
        good[good] = np.bitwise_count(diff[good]) <= distance
        if good.any():
            nodes, label = smallest_labels(left[good].view(np.int64), right[good].view(np.int64))
            moved = nodes != label
            yield nodes[moved], label[moved], False


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, limit: int = GROUP) -> DataFrame:
    """(a, b) that join all different fingerprints within the distance, directly or through others; fps are distinct.

    By the pigeonring principle two fingerprints within the distance have a start on the ring of segments from which
    every chain of l segments differs in at most floor(l * distance / segments) bits. So the first two segments, with
    the allowed variants of one side, make an equi-join key; the longer chains and the full distance are checked on
    what meets. No pairs leave a task, only a spanning set of links. A key with more than `limit` fingerprints goes
    on with a chain one segment longer, up to the whole ring, where a key is one fingerprint.
    """
    out = None
    for length in range(2, segments + 1):
        most = limit if length < segments else 1 << 62
        keyed = emit_keys(fps, length, segments, distance)
        spread = keyed.repartition("key").sortWithinPartitions("key", "probe")

        def meet(batches: Iterator[pd.DataFrame], most: int = most) -> Iterator[pd.DataFrame]:
            held: list[np.ndarray] | None = None
            # The last key of a batch may go on in the next one.
            for batch in batches:
                cols = [batch["key"].to_numpy(), batch["fp"].to_numpy(), batch["probe"].to_numpy()]
                if held is not None:
                    cols = [np.concatenate(x) for x in zip(held, cols)]
                cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
                held = [x[cut:] for x in cols]
                if cut:
                    for a, b, big in link_groups(*[x[:cut] for x in cols], most, segments, distance):
                        yield pd.DataFrame({"a": a, "b": b, "large": big})
            if held is not None:
                for a, b, big in link_groups(*held, most, segments, distance):
                    yield pd.DataFrame({"a": a, "b": b, "large": big})

        met = keep(spread.mapInPandas(meet, "a long, b long, large boolean"), f"links{length}")
        found = met.filter("not large").select("a", "b").distinct()
        out = found if out is None else out.unionByName(found)
        fps = met.filter("large").select(F.col("a").alias("fp")).distinct()
        if fps.isEmpty():
            return out
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes with edges.

    Alternating large-star and small-star steps; each round is written to the shared folder, and a node's new links go
    to its smallest neighbour only, so that hubs stay spread over their neighbours' rows.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "star")
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = keep(small.filter("u != v").distinct(), "star")
        sums = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, new)]
        now = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, segments: int = SEGMENTS, limit: int = GROUP) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Null text is empty; texts without words have the fingerprint zero and are linked like others. Fingerprints link
    within the distance; component_id is the smallest doc_id reachable over links, null ids only where all are null.
    Texts are read once; equal fingerprints fold into one before anything is compared, so copies cost nothing. Repeated
    rows give repeated results; other columns are left out.
    """
    prints = keep(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = components(links(nodes.select("fp"), distance, segments, limit))
    placed = nodes.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    roots = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keep(placed.join(roots, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
