"""Ranked lexical search: an inverted index in shards, answered by Block-Max MaxScore.

A shard holds some documents, numbered by ascending doc_id, and a posting list for each of their terms. A list is cut
into blocks of 64 documents. A posting is one byte for its document in the block and one for its occurrences; a block's
entry states how many it has, the most occurrences and the least length per occurrence, which bound every score in it.
A query takes a shard's blocks by falling bounds, some at a time. Lists whose bounds together stay below the tenth score so far are not
essential: they are only asked about documents that the others found, and block bounds turn most of those away before
their blocks are decoded. Each shard gives a heap of its best documents, and these are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import keep, texts
from funcrisk.scale import top_per_key

BEST = 10
#: A shard ends with the document that brings it to so many bytes of text, or this many documents.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Items that are answered together.
ITEM_BLOCK = 256
SHIFT, WINDOW, SLICE = 6, 64, 1 << 20
#: A term's characters: 0-9, A-Z, a-z and all beyond ASCII. In UTF-8 these are single bytes, so that texts are cut as bytes.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK = np.dtype([("block", "<u2"), ("n", "<u2"), ("most", "<u4"), ("ratio", "<f4")])
LARGE = np.dtype([("at", "<u4"), ("tf", "<u4")])
#: term is empty in a shard's own row: its document ids, whether they are there, and their lengths.
POSTINGS = "shard long, term binary, n long, blocks binary, docs binary, tfs binary, larges binary"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms, by slices of about SLICE bytes that end between terms."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + SLICE)
        # A term that goes on after the slice is followed to its end.
        while hi < len(text) and TABLE[text[hi]] != 32:
            hi += 1
        yield text[lo:hi].translate(TABLE).split()
        lo = hi


class Shard:
    """Documents taken in one by one; rows() gives their posting lists."""

    def __init__(self) -> None:
        self.names: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        parts = []
        for words in terms(text):
            for w in set(words).difference(self.names):
                self.names[w] = len(self.names)
            parts.append(np.fromiter(map(self.names.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.found.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        self.size += len(text)

    def full(self, size: int) -> bool:
        return self.size >= size or len(self.ids) >= SHARD_DOCS

    def rows(self, shard: int) -> Iterator[pd.DataFrame]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        lengths = np.array([len(self.found[i]) for i in order], np.int64)
        keys = np.concatenate([self.found[i] for i in order]).astype(np.int64)
        self.found.clear()
        keys <<= 16
        keys |= np.repeat(np.arange(len(order), dtype=np.uint16), lengths)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[first, len(keys)])
        term, doc = keys[first] >> 16, keys[first] & 0xFFFF
        # Blocks: runs of one term and one range of documents.
        block = keys[first] >> SHIFT
        del keys, first
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        entry = np.zeros(len(starts), BLOCK)
        if len(starts):
            entry["block"], entry["n"] = doc[starts] >> SHIFT, np.diff(np.r_[starts, len(block)])
            entry["most"] = np.maximum.reduceat(tf, starts)
            # Rounded down, so that the bound stays one.
            entry["ratio"] = np.nextafter(np.minimum.reduceat(lengths[doc] / tf, starts).astype("<f4"), np.float32(0))
        offsets, small = (doc & (1 << SHIFT) - 1).astype(np.uint8).tobytes(), np.minimum(tf, 255).astype(np.uint8).tobytes()
        heads, width = entry.tobytes(), BLOCK.itemsize
        lists = np.searchsorted(term, np.arange(len(self.names) + 1))
        block_at = np.searchsorted(term[starts], np.arange(len(self.names) + 1)) if len(starts) else np.zeros(len(self.names) + 1, np.int64)
        large = np.flatnonzero(tf >= 255)
        larges = {}
        for i in large.tolist():
            larges.setdefault(int(term[i]), []).append((i - int(lists[term[i]]), int(tf[i])))
        packed = {t: np.array(v, LARGE).tobytes() for t, v in larges.items()}
        known = np.array([self.ids[i] is not None for i in order], np.uint8)
        ids = np.array([self.ids[i] or 0 for i in order], "<i8")
        yield pd.DataFrame({"shard": [shard], "term": [b""], "n": [len(ids)], "blocks": [ids.tobytes()], "docs": [known.tobytes()], "tfs": [lengths.astype("<i8").tobytes()], "larges": [None]})
        a, b = lists.tolist(), block_at.tolist()
        names = list(self.names)
        for lo in range(0, len(names), 1 << 14):
            some = range(lo, min(len(names), lo + (1 << 14)))
            yield pd.DataFrame({
                "shard": shard, "term": names[some.start:some.stop], "n": [a[t + 1] - a[t] for t in some],
                "blocks": [heads[width * b[t]:width * b[t + 1]] for t in some], "docs": [offsets[a[t]:a[t + 1]] for t in some],
                "tfs": [small[a[t]:a[t + 1]] for t in some], "larges": [packed.get(t) for t in some]})


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows of docs, whole texts, as a table of posting lists in the shared folder.

    Texts stay where they are read: a task cuts its own rows into shards. Null text has no term; rows that repeat an id
    are documents of their own; other columns are left out.
    """
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, shard = TaskContext.get().partitionId(), 0, Shard()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                shard.add(None if doc_id is None else int(doc_id), bytes(text))
                if shard.full(shard_bytes):
                    yield from shard.rows(part << 32 | made)
                    made, shard = made + 1, Shard()
        if shard.ids:
            yield from shard.rows(part << 32 | made)

    # As strings, null ids leave the others whole.
    raw = texts(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return keep(raw.mapInPandas(index, POSTINGS), "postings")


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all terms of all documents; from the shards' own rows."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["tfs"]:
                lengths = np.frombuffer(raw, "<i8")
                yield pd.DataFrame({"docs": [int((lengths > 0).sum())], "terms": [int(lengths.sum())]})

    r = index.filter(F.octet_length("term") == 0).select("tfs").mapInPandas(sums, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class PostingList:
    """One term's list in a shard: bounds of its blocks at once, postings only when asked."""

    def __init__(self, blocks: bytes, docs: bytes, tfs: bytes, larges: bytes | None, n_blocks: int, slope: float) -> None:
        self.entry, self.docs, self.tfs = np.frombuffer(blocks, BLOCK), np.frombuffer(docs, np.uint8), np.frombuffer(tfs, np.uint8)
        self.larges = np.frombuffer(larges, LARGE) if larges else None
        self.base = self.entry["block"].astype(np.int64) << SHIFT
        self.end = np.cumsum(self.entry["n"], dtype=np.int64)
        # m is at least 9 + slope * n, so m / tf is at least this; the sum takes care of the rounding of doubles.
        least = 9 / self.entry["most"].astype(np.float64) + slope * self.entry["ratio"].astype(np.float64)
        self.bound = np.zeros(n_blocks, np.int64)
        self.place = np.full(n_blocks, -1)
        self.place[self.entry["block"]] = np.arange(len(self.entry))
        self.bound[self.entry["block"]] = np.floor(1e9 / (1000 + 8 * least)).astype(np.int64) + 1

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and occurrences of the postings in the blocks asked for, which ascend."""
        place = self.place[blocks]
        place = place[place >= 0]
        n = self.entry["n"][place].astype(np.int64)
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(n) else 0) + np.repeat(self.end[place] - ends, n)
        return self.postings(at, np.repeat(self.base[place], n))

    def postings(self, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tf = self.tfs[at].astype(np.int64)
        if self.larges is not None:
            hit = np.flatnonzero(tf == 255)
            tf[hit] = self.larges["tf"][np.searchsorted(self.larges["at"], at[hit])]
        return base + self.docs[at], tf


def windows(order: np.ndarray) -> Iterator[np.ndarray]:
    """The blocks in their order, one first and then ever more together, up to WINDOW; ascending inside."""
    lo, step = 0, 1
    while lo < len(order):
        yield np.sort(order[lo:lo + step])
        lo, step = lo + step, min(WINDOW, 2 * step)


def best_of(lists: list[PostingList], weights: list[int], m: np.ndarray, n_blocks: int, best: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of a shard's best documents for one query: highest score first, then the smallest number."""
    top = [w * int(x.bound.max()) for x, w in zip(lists, weights)]
    order = sorted(range(len(lists)), key=lambda i: -top[i])
    lists, weights, top = [lists[i] for i in order], [weights[i] for i in order], [top[i] for i in order]
    bound = np.array([x.bound * w for x, w in zip(lists, weights)])
    # rest[j]: what all lists from j on can add in a block; tail[j]: anywhere.
    rest = np.vstack([np.cumsum(bound[::-1], axis=0)[::-1], np.zeros((1, n_blocks), np.int64)])
    tail = [*np.cumsum(top[::-1])[::-1].tolist(), 0]
    score = np.zeros(n_blocks << SHIFT, np.int64)
    docs, scores, least, essential = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, len(lists)
    for blocks in windows(np.argsort(-rest[0], kind="stable")):
        while essential and tail[essential - 1] < least:
            essential -= 1
        blocks = blocks[rest[0, blocks] >= least]
        if not essential or not len(blocks):
            break
        for x, w in zip(lists[:essential], weights):
            d, tf = x.decode(blocks)
            score[d] += w * impact(tf, m[d])
        at, inside = np.nonzero(score.reshape(n_blocks, -1)[blocks])
        found = (blocks[at] << SHIFT) + inside
        for j in range(essential, len(lists) + 1):
            found = found[score[found] + rest[j][found >> SHIFT] >= least]
            if j == len(lists) or not len(found):
                break
            asked = np.unique(found >> SHIFT)
            d, tf = lists[j].decode(asked[lists[j].bound[asked] > 0])
            score[d] += weights[j] * impact(tf, m[d])
        if len(found):
            docs, scores = np.r_[docs, found], np.r_[scores, score[found]]
            kept = np.lexsort((docs, -scores))[:best]
            docs, scores = docs[kept], scores[kept]
            if len(docs) == best:
                least = max(1, int(scores[-1]))
    return docs, scores


def search(index: DataFrame, items: DataFrame, best: int = BEST, item_block: int = ITEM_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents of the index with a score above 0.

    The score sums weight times impact over an item's different terms: weight floor(1000 ln((2 N + 2) / (2 df + 1))),
    impact 10^9 tf div (1000 tf + 8 m) and m = 10 + (90 n N div L). Equal scores go by ascending doc_id, null ids last.
    Items equal in id and text are one; those of one id with other texts are ranked apart. Items without terms, and null
    texts, find nothing. Only lists of the items' terms move, to one group for each shard and block of items.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, item, text in zip(batch["items"], batch["item"], batch["text"]):
                for words in terms(bytes(text)):
                    yield pd.DataFrame({"items": block, "item": item, "term": list(set(words))}, columns=["items", "item", "term"])

    n, total = corpus_size(index)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    asked = keep(asked.withColumn("item", F.xxhash64("item_id", "text")), "items")
    blocks = max(1, math.ceil(asked.count() / item_block))
    cuts = asked.select(F.pmod("item", F.lit(blocks)).alias("items"), "item", F.col("text").cast("binary").alias("text"))
    words = cuts.mapInPandas(cut, "items long, item long, term binary").groupBy("items", "term").agg(F.collect_set("item").alias("wanted"))
    seen = index.join(words.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weighted = words.join(seen, "term").withColumn("weight", weight).filter("weight > 0").select("items", "term", "weight", "wanted")
    # The empty term brings each block of items the shards' own rows.
    own = words.select("items").distinct().select("items", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<long>").alias("wanted"))
    wanted = keep(weighted.unionByName(own), "terms")

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["weight"] == 0].iloc[0]
        ids, known, lengths = np.frombuffer(head["blocks"], "<i8"), np.frombuffer(head["docs"], np.uint8), np.frombuffer(head["tfs"], "<i8")
        m, n_blocks = 10 + 90 * lengths * n // max(1, total), (len(ids) + (1 << SHIFT) - 1) >> SHIFT
        by: dict[int, list[tuple[PostingList, int]]] = {}
        body = rows[rows["weight"] > 0]
        for weight, want, *raw in zip(*[body[c] for c in ("weight", "wanted", "blocks", "docs", "tfs", "larges")]):
            one = PostingList(*raw, n_blocks, 90 * n / max(1, total))
            for item in want:
                by.setdefault(int(item), []).append((one, int(weight)))
        out = []
        for item, pairs in by.items():
            docs, scores = best_of([x for x, _ in pairs], [w for _, w in pairs], m, n_blocks, best)
            doc_id = pd.arrays.IntegerArray(ids[docs].astype(np.int64), known[docs] == 0)
            out.append(pd.DataFrame({"item": item, "doc_id": doc_id, "score": scores, "shard": rows["shard"].iloc[0], "number": docs}))
        return pd.concat(out) if out else pd.DataFrame(columns=["item", "doc_id", "score", "shard", "number"])

    heaps = index.join(wanted, "term").groupBy("items", "shard").applyInPandas(answer, "item long, doc_id long, score long, shard long, number long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("shard"), F.asc("number")]
    merged = top_per_key(heaps, ["item"], order, best, ["shard"])
    return merged.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
