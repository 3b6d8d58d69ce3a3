"""Prefix trie of conversations: double arrays in range shards, shared upper nodes merged over all shards.

A conversation is a path of dense turn ids. Different paths, sorted, are dealt into ranges, so that a shard is a run of
neighbours whatever prefix is frequent, and only nodes on the first and last path of a shard can lie in others too. A
shard packs its paths into BASE and CHECK arrays, walks them and sums up its nodes; the nodes of border paths are partial
and meet by a digest of their path.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funcrisk.llm.common import keep
from funcrisk.scale import number_rows

#: Turns of different paths that one double array holds, a path at least.
SHARD_TURNS = 1 << 18
#: Places that are tried for the children of a node before they go behind all others.
TRIES = 64
#: Members of a node meet in runs of so many ids before they are hashed in order.
RUN = 1024
EMPTY = hashlib.sha256(b"").hexdigest()
Rebuild = Callable[[Column], tuple[Column, Column]]
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NODES = ("shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, chars long, key binary, parent_key binary")


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id and chars: turns by the dense ids of their role and text, which are ranks of SHA-256 digests.

    Texts are read once and do not move.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = keep(conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")), "turns")
    bucket = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    ids = number_rows(turns.select("digest").distinct(), [], bucket, [F.col("digest")], "id")
    return turns.join(ids, "digest").select("conv_id", "turn", "id", "chars")


def grafted(conv_id: Column) -> tuple[Column, Column]:
    """The conversation whose first turns another one takes over, and how many: crc32 of the number modulo 6."""
    return conv_id - conv_id % 100, F.crc32(conv_id.cast("string").cast("binary")) % 6


def paths(conversations: DataFrame, rebuild: Rebuild = grafted, most: int = 5) -> DataFrame:
    """conv_id, path (turn ids), chars (of each turn) of every rebuilt conversation; rebuild asks for `most` turns at most."""
    turns = turn_ids(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns"))
    turns = keep(turns.withColumn("turns", F.transform("turns", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars")))), "conversations")
    source, n = rebuild(F.col("conv_id"))
    first = turns.select(F.col("conv_id").alias("_from"), F.slice("turns", 1, most).alias("_first"))
    own = turns.withColumns({"_from": source, "_n": n.cast("int")}).join(first, "_from", "left")
    head = F.coalesce(F.slice("_first", F.lit(1), F.col("_n")), F.slice("turns", F.lit(1), F.lit(0)))
    seq = F.concat(head, F.slice("turns", F.col("_n") + 1, F.size("turns")))
    return own.select("conv_id", seq.alias("seq")).select("conv_id", F.col("seq.id").alias("path"), F.col("seq.chars").alias("chars"))


def end_digests(members: DataFrame) -> DataFrame:
    """key and ends_sha256 of the conversations (key, conv_id) that end at one node: runs of ids meet, sorted, as a stream."""
    runs = members.groupBy("key", F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch["key"], batch["ids"]):
                if key != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if h is not None:
            yield pd.DataFrame({"key": [now], "ends_sha256": [h.hexdigest()]})

    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInPandas(digest, "key binary, ends_sha256 string")


class DoubleArray:
    """Sorted different paths of dense codes: the child of s by code c is BASE[s] + c, if CHECK there names s. Slot 0 is the root."""

    def __init__(self, paths: list[list[int]]) -> None:
        self.base, self.check, self.free = [0], [0], 1
        #: Slots from the top down, with the depth and the first path of each.
        self.order: list[tuple[int, int, int]] = []
        todo = deque([(0, 0, len(paths), 0)])
        while todo:
            slot, lo, hi, depth = todo.popleft()
            self.order.append((slot, depth, lo))
            # Of sorted different paths, the one that ends here stands first.
            lo += len(paths[lo]) == depth
            starts = [i for i in range(lo, hi) if i == lo or paths[i][depth] != paths[i - 1][depth]] if hi - lo > 1 else [*range(lo, hi)]
            if starts:
                self.base[slot] = base = self.place([paths[i][depth] for i in starts])
                for a, b in zip(starts, [*starts[1:], hi]):
                    child = base + paths[a][depth]
                    self.check[child] = slot
                    todo.append((child, a, b, depth + 1))

    def place(self, codes: list[int]) -> int:
        """A base from which the slots of all codes are free; they are grown, not yet taken."""
        check = self.check
        while self.free < len(check) and check[self.free] >= 0:
            self.free += 1
        at = self.free
        for _ in range(TRIES):
            if all(at - codes[0] + c >= len(check) or check[at - codes[0] + c] < 0 for c in codes):
                break
            at += 1
            while at < len(check) and check[at] >= 0:
                at += 1
        else:
            at = len(check)
        need = at - codes[0] + codes[-1] + 1 - len(check)
        if need > 0:
            check.extend([-1] * need)
            self.base.extend([0] * need)
        return at - codes[0]

    def walk(self, path: list[int]) -> list[int]:
        """The slots of a path from the root on, as far as it is there."""
        out, slot = [0], 0
        for c in path:
            child = self.base[slot] + c
            if not 0 < child < len(self.check) or self.check[child] != slot:
                break
            out.append(child)
            slot = child
        return out


def path_keys(path: np.ndarray) -> list[bytes]:
    """A digest for each prefix of a path of turn ids, the empty one first."""
    h, out = hashlib.blake2b(digest_size=16), []
    for i in path.astype("<i8").tolist():
        out.append(h.digest())
        h.update(i.to_bytes(8, "little"))
    return [*out, h.digest()]


def shard_nodes(shard: int, rows: list[tuple]) -> pd.DataFrame:
    """The nodes of a shard's sorted paths, rows (path, chars, n, first conversation, digest of those that end there)."""
    ids = np.unique(np.concatenate([r[0] for r in rows]))
    codes = [np.searchsorted(ids, r[0]).tolist() for r in rows]
    trie = DoubleArray(codes)
    size = len(trie.check)
    convs, first, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    ends: dict[int, str] = {}
    chars = {slot: int(rows[i][1][depth - 1]) if depth else 0 for slot, depth, i in trie.order}
    for r, path in zip(rows, codes):
        slot = trie.walk(path)[-1]
        ends[slot], convs[slot], first[slot] = r[4], int(r[2]), int(r[3])
    for slot, depth, _ in reversed(trie.order):
        leaves[slot] += not children[slot]
        saved[slot] += (convs[slot] - 1) * chars[slot]
        if depth:
            up = trie.check[slot]
            convs[up] += convs[slot]
            first[up] = first[slot] if first[up] is None else min(first[up], first[slot])
            children[up] += 1
            leaves[up] += leaves[slot]
            saved[up] += saved[slot]
    keys = {}
    for i in (0, len(rows) - 1):
        keys |= dict(zip(trie.walk(codes[i]), path_keys(rows[i][0])))
    slots, depth = [x[0] for x in trie.order], [x[1] for x in trie.order]
    ups = [trie.check[x] if d else None for x, d in zip(slots, depth)]
    whole = lambda x: pd.array(x, "Int64")
    return pd.DataFrame({
        "shard": shard, "conv_id": [first[x] for x in slots], "depth": depth, "parent_conv_id": whole([None if x is None else first[x] for x in ups]),
        "n_convs": [convs[x] for x in slots], "n_children": [children[x] for x in slots], "n_leaves": [leaves[x] for x in slots],
        "saved_tokens": [saved[x] for x in slots], "ends_sha256": [ends.get(x) for x in slots], "chars": [chars[x] for x in slots],
        "key": [keys.get(x) for x in slots], "parent_key": [None if x is None else keys.get(x) for x in ups]})


def shard_rows(members: DataFrame, shard_turns: int) -> DataFrame:
    """NODES of all shards; those with a key are partial."""
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    different = groups.join(members.select("conv_id", "path", "chars"), "conv_id").join(end_digests(members.select("key", "conv_id")), "key")
    different = keep(different.select("path", "chars", "n", "conv_id", "ends_sha256"), "paths")
    turns = different.agg(F.sum(F.size("path") + 1)).first()[0] or 0

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*[batch[c] for c in ("path", "chars", "n", "conv_id", "ends_sha256")]):
                if held and size + len(row[0]) + 1 > shard_turns:
                    yield shard_nodes(part << 32 | made, held)
                    made, held, size = made + 1, [], 0
                held.append(row)
                size += len(row[0]) + 1
        if held:
            yield shard_nodes(part << 32 | made, held)

    ranges = different.repartitionByRange(max(1, math.ceil(turns / shard_turns)), "path").sortWithinPartitions("path")
    return keep(ranges.mapInPandas(pack, NODES), "nodes")


def merged_nodes(parts: DataFrame) -> DataFrame:
    """One row for each key of the partial nodes, with whole sums.

    Sums of a shard's subtree count a node that lies in k shards k times over: as a leaf where it has no child in one of
    them, and with k - 1 members too few saved. What this makes wrong is put right once for each such node and added to
    the nodes above it. Those are found by place: a shared node begins in the shard whose last path it lies on, and the
    shared nodes below it are deeper ones that begin there, and all that begin between its first and last shard.
    """
    whole = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"), F.max("parent_key").alias("parent_key"), F.min("shard").alias("_a"), F.max("shard").alias("_b"),
        F.count(F.lit(1)).alias("_k"), F.max("chars").alias("_chars"), F.sum((F.col("n_children") == 0).cast("long")).alias("_bare"))
    whole = keep(whole, "merged")
    shared = whole.filter("_k > 1").withColumns({"_saved": (F.col("_k") - 1) * F.col("_chars"), "_leaves": -F.col("_bare")})
    chain = Window.partitionBy("_a").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = keep(shared.withColumns({f"{c}_below": F.sum(c).over(chain) for c in ("_saved", "_leaves")}), "shared")
    # One row for each shard.
    run = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = shared.groupBy(F.col("_a").alias("shard")).agg(F.sum("_saved").alias("_saved"), F.sum("_leaves").alias("_leaves"))
    before = parts.select("shard").distinct().join(begun, "shard", "left").fillna(0, ["_saved", "_leaves"])
    before = keep(before.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(run), F.lit(0)) for c in ("_saved", "_leaves")}), "before")
    last = before.select(F.col("shard").alias("_b"), *[F.col(f"{c}_before").alias(f"{c}_last") for c in ("_saved", "_leaves")])
    first = before.select(F.col("shard").alias("_a"), *[(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_first") for c in ("_saved", "_leaves")])
    twice = shared.groupBy(F.col("parent_key").alias("key")).agg(F.sum(F.col("_k") - 1).alias("_twice"))
    more = shared.join(last, "_b").join(first, "_a").join(twice, "key", "left").select(
        "key", F.coalesce("_twice", F.lit(0)).alias("_twice"), *[(F.col(f"{c}_below") + F.col(f"{c}_last") - F.col(f"{c}_first")).alias(f"{c}_more") for c in ("_saved", "_leaves")])
    full = whole.join(more, "key", "left").withColumns({
        "n_children": F.col("n_children") - F.coalesce("_twice", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("_leaves_more", F.lit(0)),
        "saved_tokens": F.col("saved_tokens") + F.coalesce("_saved_more", F.lit(0))})
    return full.join(whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key", "left")


def prefix_trie(conversations: DataFrame, rebuild: Rebuild = grafted, most: int = 5, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each different sequence of first turns of the rebuilt conversations, the empty one included.

    conv_id is its smallest member, parent_conv_id that of the sequence one turn shorter (null for the root); n_convs its
    members, n_children and n_leaves the longer sequences next to it and at the ends below it; saved_tokens, summed over
    its subtree, the code points of a sequence's last turn times its members but one; ends_sha256 the digest of the ids of
    members that end there. Turns go by turn, nulls first, equal ones by the digest of role and text; null role or text
    is empty. Turns without a conv_id belong to no conversation and are left out, as are other columns. Without
    conversations there is no row. A conversation's turn ids are one value: 16 bytes a turn, without its texts.
    """
    members = paths(conversations, rebuild, most).withColumn("key", F.unhex(F.sha2(F.array_join(F.col("path").cast("array<string>"), ","), 256)))
    nodes = shard_rows(keep(members, "members"), shard_turns)
    parts = nodes.filter("key is not null")
    merged = keep(merged_nodes(parts).select("key", *NODE_COLUMNS), "merged-nodes")
    columns = [F.coalesce(F.col(c), F.lit(EMPTY)).alias(c) if c == "ends_sha256" else F.col(c) for c in NODE_COLUMNS]
    inner = nodes.filter("key is null")
    # A node below a partial one takes the name of the whole one; by shard, so that frequent ones stay spread.
    names = parts.select("shard", F.col("key").alias("parent_key")).join(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up")), "parent_key")
    below = inner.filter("parent_key is not null").join(names, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("_up"))
    return merged.select(columns).unionByName(inner.filter("parent_key is null").select(columns)).unionByName(below.select(columns))
