"""Removal of repeated passages: names of prefixes of doubling length, compared by Spark until unique or long enough."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk.llm import blocks as B
from funcrisk.llm.common import keep, parts_for, texts

LENGTH, BLOCK_BYTES, SLICE = 50, 4 << 20, 1 << 17
#: Stands for a null id, which sorts after all others.
LAST = (1 << 63) - 1
U64 = np.uint64


def doubled(name: np.ndarray, step: int, salt: int) -> np.ndarray:
    """Names of prefixes longer by `step`: each position's name paired with that at the offset."""
    return B.mixed(name[:-step] * U64(2 * salt + 1) + B.mixed(name[step:] ^ U64(salt)))


def names(raw: np.ndarray, length: int) -> np.ndarray:
    """Names of the `length` bytes from each position; `length` is 8 times a power of two.

    Equal bytes have equal names at every position, in every block; different ones differ but for 64-bit collisions.
    """
    padded = np.zeros((len(raw) // 8 + 2) * 8, np.uint8)
    padded[:len(raw)] = raw
    name = np.empty(len(padded) - 8, U64)
    for i in range(8):
        name[i::8] = padded[i:i + len(name)].view(U64)
    name, at = B.mixed(name[:len(raw)] + U64(1)), 8
    while at < length:
        if len(name) <= at:
            return name[:0]
        name, at = doubled(name, at, 2 * at), 2 * at
    return name


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    at = 1
    while at < width and len(x):
        step = min(at, width - at)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        at += step
    return x


def shorter(key: np.ndarray, parts: int) -> np.ndarray:
    """A key as its part and 32 bits: enough to drop most windows, less to send."""
    return B.part_of(key, parts).astype(U64) << U64(32) | B.mixed(key ^ U64(1)) >> U64(32)


def part_in(short: np.ndarray) -> np.ndarray:
    return (short >> U64(32)).astype(np.int64)


def grouped(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys with their smallest and largest owners."""
    if not len(key):
        return key, owner, owner
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)


def spelled(first: np.ndarray, run: np.ndarray) -> np.ndarray:
    """All places of runs."""
    return np.repeat(first - np.r_[0, np.cumsum(run)[:-1]], run) + np.arange(run.sum()) if len(first) else np.zeros(0, np.int64)


def split_long(first: np.ndarray, run: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut so that none is longer than `most`, from their starts."""
    if not len(run) or run.max() <= most:
        return first, run
    n = -(-run // most)
    k = spelled(np.zeros(len(n), np.int64), n)
    return np.repeat(first, n) + k * most, np.minimum(most, np.repeat(run, n) - k * most)


@dataclass
class Runs:
    """Runs of windows in one slice (first text, last text, bytes, sizes, ends, names): first places, lengths, doc_ids, names."""
    part: tuple
    first: np.ndarray
    run: np.ndarray
    ids: np.ndarray
    name: np.ndarray


class Windows:
    """All windows of `length` bytes of a block's texts, as runs of neighbours that one prefix stands for.

    Texts are taken in slices; of each the names of half a window, about, stay in memory.
    """

    def __init__(self, docs: pd.DataFrame, length: int, parts: int):
        self.docs, self.length = docs, length
        self.half = 8
        while 2 * self.half <= length:
            self.half *= 2
        self.ids, self.data = docs["doc_id"].to_numpy(), list(docs["text"])
        self.slices = []
        short, owner = [], []
        for a, b in B.slices(docs["text"].str.len().to_numpy(), SLICE):
            raw = np.frombuffer(b"".join(self.data[a:b]), np.uint8)
            sizes = np.fromiter(map(len, self.data[a:b]), np.int64, b - a)
            ends = np.cumsum(sizes)
            name = names(raw, self.half)
            # Of a window's prefixes of that length the smallest name stands for it: equal windows choose alike.
            low = window_minimum(name, length - self.half + 1)
            inside = np.zeros(len(low), bool)
            for end, n in zip(ends, sizes):
                if n >= length:
                    inside[end - n:end - length + 1] = True
            first = np.flatnonzero(np.r_[len(low) > 0, (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])])
            run = np.diff(np.r_[first, len(low)])
            first, run = first[inside[first]], run[inside[first]]
            key = shorter(low[first], parts)
            short.append(key)
            owner.append(self.ids[a:b][np.searchsorted(ends, first, "right")])
            self.slices.append((a, b, raw, sizes, ends, name, first, run, key))
        self.short, low_id, high_id = grouped(np.concatenate([np.zeros(0, U64), *short]), np.concatenate([np.zeros(0, np.int64), *owner]))
        self.twice = low_id != high_id

    def full(self, name: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Names at the whole length: pairs of names at the offset that is left."""
        step = self.length - self.half
        return B.mixed(name[at] * U64(2 * self.length + 1) + B.mixed(name[at + step] ^ U64(self.length))) if step else name[at]

    def flagged(self, shared: np.ndarray) -> list[Runs]:
        """The runs whose short key is flagged, of at most half a window each, and their names: those of both ends and the length."""
        wanted, out = self.short[shared], []
        for a, b, raw, sizes, ends, name, first, run, key in self.slices:
            hit = np.zeros(len(first), bool)
            if len(wanted) and len(first):
                near = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hit = wanted[near] == key
            first, run = split_long(first[hit], run[hit], max(1, self.length // 2))
            ids = self.ids[a:b][np.searchsorted(ends, first, "right")]
            whole = B.mixed(self.full(name, first) * U64(3) + B.mixed(self.full(name, first + run - 1) ^ run.astype(U64)))
            out.append(Runs((a, b, raw, sizes, ends, name), first, run, ids, whole))
        return out

    def windows_of(self, runs: list[Runs], late: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, doc_ids, names) of the single windows in runs that are not late."""
        out = []
        for r, gone in zip(runs, late):
            first, run = r.first[~gone], r.run[~gone]
            at = spelled(first, run)
            out.append((at, np.repeat(r.ids[~gone], run), self.full(r.part[5], at)))
        return out

    def covered(self, runs: list[Runs], late: list[np.ndarray], single: list[tuple[np.ndarray, np.ndarray, np.ndarray]], known: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(doc_id, text, which bytes go) of every document."""
        for r, gone_runs, (at, ids, name) in zip(runs, late, single):
            a, b, raw, sizes, ends, _ = r.part
            gone = at[least[np.searchsorted(known, name)] < ids] if len(at) else at
            starts = np.concatenate([r.first[gone_runs], gone])
            stops = np.concatenate([(r.first + r.run - 1)[gone_runs], gone]) + self.length
            edge = np.bincount(starts, minlength=len(raw) + 1) - np.bincount(stops, minlength=len(raw) + 1)
            out = np.cumsum(edge[:-1]) > 0
            for k, end, n in zip(range(a, b), ends, sizes):
                yield self.ids[k], self.data[k], out[end - n:end]


def owners(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted names of (names, doc_ids), and the smallest doc_id of each."""
    name = np.concatenate([np.zeros(0, U64), *[x for x, _ in found]])
    return grouped(name, np.concatenate([np.zeros(0, np.int64), *[x for _, x in found]]))[:2]


def result(doc_id: int, text: bytes, gone: np.ndarray) -> tuple:
    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
    starts = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return doc_id, len(text), int(np.count_nonzero(gone)), starts, hashlib.sha256(rest).hexdigest()


def whole_copies(docs: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id and SHA-256 of rows whose text a smaller doc_id has too, byte for byte by SHA-256: all of it repeats."""
    marked = texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), B.block_column(blocks))
    groups = marked.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    return marked.join(groups, "sha").filter("doc_id > least").select("block", "doc_id", "sha").distinct()


def is_copy(texts_: pd.DataFrame, side: pd.DataFrame) -> np.ndarray:
    """Which rows are whole copies, by doc_id and text: other rows of the same doc_id need not be."""
    told = side[side["kind"] == 0]
    known = set(zip(told["part"], map(bytes, told["vals"])))
    ids = {k for k, _ in known}
    return np.array([k in ids and (k, hashlib.sha256(x).digest()) in known for k, x in zip(texts_["doc_id"], texts_["text"])], bool)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id; strings are
    judged on the input and stay inside a document. Null text is empty. Rows of one doc_id, repeated or not, are one
    document's parts: they do not repeat each other. Null ids come last of all. Other columns are left out.

    Prefix doubling: positions are named by their first 8 bytes, then by pairs of names at offsets 8, 16 and so on, which
    needs no exchange as names are 64-bit fingerprints. Spark compares names twice. At the last doubling below the length, where each
    window is ranked by the smallest name in it, a window drops out if no other document has that name. At the full length, runs of
    windows that one prefix stands for are compared first, then the single windows of runs that no smaller doc_id has, by (name, doc_id). Each block sends each name once with its smallest doc_id, so a passage in all documents
    costs one fact a block. Whole copies of a text with a smaller doc_id are settled beforehand and take no part.
    """
    docs = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    blocks = parts_for(docs, block_bytes)
    parts = blocks
    text = B.dealt(docs, blocks)
    nothing = F.lit(None)
    copies = keep(whole_copies(docs, blocks), "copies").select(
        F.lit(0).cast("byte").alias("kind"), F.col("doc_id").alias("part"), "block", F.lit(0).cast("long").alias("n"), F.col("sha").alias("vals"),
        nothing.cast("double").alias("total"), nothing.cast("long").alias("seen"))

    def own(texts_: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        return texts_[~is_copy(texts_, side)].sort_values("doc_id")

    def shared(w: Windows, side: pd.DataFrame) -> np.ndarray:
        return B.answers_of(w.short, side[side["kind"] == 1], np.uint8, part_in(w.short)) > 0

    def ask_keys(group: tuple, texts_: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        w = Windows(own(texts_, side), length, parts)
        return B.facts(1, int(group[0]), w.short, w.twice.astype(np.uint8), part_in(w.short))

    def answer_keys(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [B.unpack_keys(x) for x in rows["keys"]]
        distinct, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        flags = np.concatenate([B.numbers(x, np.uint8) for x in rows["vals"]])
        many = n > 1
        np.logical_or.at(many, at, flags > 0)
        return answer(rows, many[at].astype(np.uint8), 1)

    def late_runs(w: Windows, side: pd.DataFrame) -> tuple[list[Runs], list[np.ndarray]]:
        """A block's flagged runs, and which of them a smaller doc_id has."""
        runs = w.flagged(shared(w, side))
        name, _ = owners([(r.name, r.ids) for r in runs])
        least = B.answers_of(name, side[side["kind"] == 3], np.int64, B.part_of(name, parts))
        return runs, [least[np.searchsorted(name, r.name)] < r.ids for r in runs]

    def ask_runs(group: tuple, texts_: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        w = Windows(own(texts_, side), length, parts)
        name, owner = owners([(r.name, r.ids) for r in w.flagged(shared(w, side))])
        return B.facts(3, int(group[0]), name, owner, B.part_of(name, parts))

    def ask_names(group: tuple, texts_: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        w = Windows(own(texts_, side), length, parts)
        name, owner = owners([(x[2], x[1]) for x in w.windows_of(*late_runs(w, side))])
        return B.facts(2, int(group[0]), name, owner, B.part_of(name, parts))

    def answer_names(rows: pd.DataFrame) -> pd.DataFrame:
        keys, owner = np.concatenate([B.unpack_keys(x) for x in rows["keys"]]), np.concatenate([B.numbers(x, np.int64) for x in rows["vals"]])
        distinct, at = np.unique(keys, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, at, owner)
        # Only whether some other block has a smaller owner matters; that owner is told, else the block's own.
        return answer(rows, least[at], int(rows["kind"].iloc[0]))

    def answer(rows: pd.DataFrame, vals: np.ndarray, kind: int) -> pd.DataFrame:
        ends = np.cumsum(rows["n"].to_numpy())
        return pd.DataFrame({
            "kind": np.full(len(rows), kind, np.int8), "part": rows["part"].to_numpy(), "block": rows["block"].to_numpy(), "n": rows["n"].to_numpy(),
            "vals": [B.planes(vals[e - n:e]) for e, n in zip(ends, rows["n"])], "total": 0.0, "seen": 0})

    def finish(group: tuple, texts_: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        w = Windows(own(texts_, side), length, parts)
        runs, late = late_runs(w, side)
        single = w.windows_of(runs, late)
        name, _ = owners([(x[2], x[1]) for x in single])
        least = B.answers_of(name, side[side["kind"] == 2], np.int64, B.part_of(name, parts))
        rows = [result(*x) for x in w.covered(runs, late, single, name, least)]
        copies_ = texts_[is_copy(texts_, side)]
        rows += [result(doc_id, raw, np.full(len(raw), len(raw) >= length)) for doc_id, raw in zip(copies_["doc_id"], copies_["text"])]
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def both(side: DataFrame):
        return text.groupBy("block").cogroup(side.groupBy("block"))

    asked = both(copies).applyInPandas(ask_keys, B.FACTS)
    told = asked.groupBy("part").applyInPandas(answer_keys, B.ANSWERS)
    side = copies.unionByName(told.select(*copies.columns))
    for ask in (ask_runs, ask_names):
        told = both(side).applyInPandas(ask, B.FACTS).groupBy("part").applyInPandas(answer_names, B.ANSWERS)
        side = side.unionByName(told.select(*copies.columns))
    done = both(side).applyInPandas(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))
