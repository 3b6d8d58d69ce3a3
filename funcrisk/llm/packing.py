"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funcrisk.llm import tokens
from funcrisk.llm.common import keep, texts

ROUNDS, EPSILON = 120, 0.3
#: Lengths that a knapsack is offered, and the greatest part by which a weight raises a price.
CHOICE, SPREAD = 80, 0.0025
#: Words, and pieces, in each of the two ages of a worker's memory, of at most so many characters.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48
#: Digests of texts that a task remembers with their pieces, and the most pieces of such a text.
SEEN_TEXTS, SEEN_PIECES = 50_000, 16
BUCKETS = 1024
PIECES_AND_SPACES = regex.compile(f"{tokens.PIECES.pattern}| ")
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Ids:
    """Token ids of texts as little-endian bytes. Words end at spaces; a text's new words fall into pieces at once, and the
    library's merge model encodes each new piece once, on one thread, as tasks share the cores already."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        special = {x.content: np.array([i], "<u4").tobytes() for i, x in self.library.get_added_tokens_decoder().items()}
        self.special = regex.compile(f"({'|'.join(map(regex.escape, special))})")
        # Pieces come in normal form and cut; what is left is to write their bytes as letters.
        self.library.normalizer = normalizers.Sequence([])
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        end = self.library.model.end_of_word_suffix
        self.last = np.array([(self.library.id_to_token(i) or "").endswith(end) for i in range(self.library.get_vocab_size())])
        self.path = path
        # What was not met in the younger age is looked for in the older one, which is dropped when the younger is full.
        self.words, self.old_words = {"": b""}, {}
        self.fixed, self.pieces, self.old_pieces = special, dict(special), {}

    def age(self) -> None:
        if len(self.words) > CACHE_ENTRIES:
            self.words, self.old_words = {"": b""}, self.words
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces, self.old_pieces = dict(self.fixed), self.pieces

    def whole(self, word: str) -> bytes:
        return np.array(tokens.library(self.path).encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def cuts(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word in normal form, in one go: no piece reaches over a space."""
        xs = PIECES_AND_SPACES.findall(" ".join(words))
        ends = [i for i, x in enumerate(xs) if x == " "]
        return [xs[i:j] for i, j in zip([0, *[i + 1 for i in ends]], [*ends, len(xs)])]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of distinct new pieces: one call; tokens that end a piece tell the pieces apart."""
        if not new:
            return {}
        ids = np.array(self.library.encode(new, is_pretokenized=True, add_special_tokens=False).ids, "<u4")
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        return {x: raw[i:k] for x, i, k in zip(new, [0, *ends[:-1]], ends, strict=True)}

    def of(self, text: str) -> bytes:
        if tokens.unassigned(text):
            # Neither the normal form nor a piece reaches over a space.
            return b"".join([self.whole(w) if tokens.unassigned(w) else self.assigned(w) for w in text.split(" ")])
        return self.assigned(text)

    def assigned(self, text: str) -> bytes:
        """Ids of a text whose letters are all assigned; special strings stand for themselves, as the library takes them from a text."""
        self.age()
        if "<|" not in text:
            return self.plain(text)
        return b"".join([self.fixed[part] if i % 2 else self.plain(part) for i, part in enumerate(self.special.split(text))])

    def plain(self, text: str) -> bytes:
        words = tokens.normal(text).replace("\n", " ").split(" ")
        known, old_words, pieces, old_pieces = self.words, self.old_words, self.pieces, self.old_pieces
        new = set(words).difference(known)
        if not new:
            return b"".join(map(known.__getitem__, words))
        known.update([(w, old_words[w]) for w in new if w in old_words])
        new = [w for w in new if w not in old_words]
        cuts = self.cuts(new)
        unmet = set(chain.from_iterable(cuts)).difference(pieces)
        pieces.update([(x, old_pieces[x]) for x in unmet if x in old_pieces])
        learnt = self.learn([x for x in unmet if x not in old_pieces])
        pieces.update(learnt)
        get = pieces.__getitem__
        known.update(zip(new, [get(xs[0]) if len(xs) == 1 else b"".join(map(get, xs)) for xs in cuts]))
        ids = b"".join(map(known.__getitem__, words))
        # Long pieces, long words and words with a piece not met before serve this text alone.
        fresh = learnt.keys()
        for w, xs in zip(new, cuts):
            if len(w) > CACHE_CHARS or not fresh.isdisjoint(xs):
                del known[w]
        for x in learnt:
            if len(x) > CACHE_CHARS:
                del pieces[x]
        return ids


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cut_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut every `size` ids; row-local."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = ids_of(vocabulary), np.array([end_id], "<u4").tobytes()
        seen: dict[bytes, list[tuple]] = {}

        def parts(text: str) -> list[tuple]:
            # Copies of a text are frequent; each is encoded once a task, while the memory of digests holds.
            digest = hashlib.sha256(text.encode()).digest()
            found = seen.get(digest)
            if found is None:
                raw = ids.of(text) + last
                found = []
                for at in range(0, len(raw), 4 * size):
                    part = raw[at:at + 4 * size]
                    found.append((at // 4, len(part) // 4, zlib.crc32(part)))
                if len(seen) >= SEEN_TEXTS:
                    seen.clear()
                if len(found) <= SEEN_PIECES:
                    seen[digest] = found
            return found

        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                out += [(doc_id.as_py(), k, *part) for k, part in enumerate(parts(text.as_py()))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), PIECE.types)], schema=PIECE)

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(values: np.ndarray, sizes: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """How often each size goes into one bin for the greatest value, at most `most` times: a knapsack by dynamic programming.

    Copies of a size are offered in packets of 1, 2, 4 ..., each taken or not, so the bounds hold exactly.
    """
    packets = []
    for j, (size, n) in enumerate(zip(sizes.tolist(), np.minimum(most, room // sizes).tolist())):
        k = 1
        while n > 0:
            packets.append((j, min(k, n), size * min(k, n), values[j] * min(k, n)))
            n -= k
            k *= 2
    best, taken = np.zeros(room + 1), np.zeros((len(packets), room + 1), bool)
    for i, (_, _, size, value) in enumerate(packets):
        with_it = best[:room + 1 - size] + value
        np.greater(with_it, best[size:], out=taken[i, size:])
        np.maximum(with_it, best[size:], out=best[size:])
    use, left = np.zeros(len(sizes), np.int64), room
    for i in range(len(packets) - 1, -1, -1):
        if taken[i, left]:
            j, k, size, _ = packets[i]
            use[j] += k
            left -= size
    return use


def priced(sizes: np.ndarray, weights: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The dearest configuration found that holds the longest uncovered length: how often it holds each length.

    Prices are the sizes, which solve the dual of the size bound, raised by the weights by at most SPREAD of themselves, so that
    fullness comes first. The knapsack is offered CHOICE lengths: the heaviest weights, and as many spread over all lengths.
    """
    live = np.flatnonzero(left)
    use = np.zeros(len(sizes), np.int64)
    use[live[-1]] = 1
    free = room - int(sizes[live[-1]])
    if len(live) > CHOICE:
        heavy = live[np.argsort(-weights[live] * (1 + sizes[live] / room), kind="stable")[:CHOICE // 2]]
        live = np.union1d(heavy, live[np.linspace(0, len(live) - 1, CHOICE // 2).astype(int)])
    live = live[sizes[live] <= free]
    if len(live):
        prices = sizes[live] * (1 + SPREAD * weights[live] * sizes[live] / room)
        use[live] += best_configuration(prices, sizes[live], (left - use)[live], free)
    return use


def solve(histogram: dict[int, int], room: int, rounds: int = ROUNDS, epsilon: float = EPSILON) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: pieces in each}) that hold every piece of the histogram once.

    The covering program asks for few configurations that cover all lengths. Multiplicative weights solve it: a round prices
    one configuration by a knapsack, then the weights of the lengths that it covers fall in proportion to the share covered. After
    `rounds` of them the shares are rounded down to whole copies. Most lengths of a small corpus have a few pieces only, for which
    shares round to nothing: for these the rounds go on, each buying as many whole copies as the uncovered demand allows, at least
    one. Each of these uses up a length, or a part of its pieces, so on large counts there are about as many as lengths.
    All of it depends on the histogram alone, at most `room` numbers.
    """
    sizes = np.array(sorted(x for x, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    count = np.array([histogram[int(s)] for s in sizes], np.int64)
    weights, chosen = np.ones(len(sizes)), Counter()
    plan: list[tuple[int, dict[int, int]]] = []
    left = count.copy()
    share = max(1.0, float(count @ sizes) / room) / rounds

    def buy(config: tuple[tuple[int, int], ...], copies: int) -> None:
        plan.append((copies, {int(sizes[j]): k for j, k in config}))
        for j, k in config:
            left[j] -= copies * k

    def pieces(use: np.ndarray) -> tuple[tuple[int, int], ...]:
        return tuple((int(j), int(use[j])) for j in np.flatnonzero(use))

    open_demand = count.astype(np.float64)
    for _ in range(rounds if share >= 1 else 0):
        whole = np.floor(open_demand).astype(np.int64)
        if not whole.any():
            break
        use = priced(sizes, weights, whole, room)
        part = min(share, float(min(open_demand[j] / k for j, k in pieces(use))))
        chosen[pieces(use)] += part
        open_demand -= part * use
        weights *= np.exp(-epsilon * part * use / count)
    for config, n in chosen.most_common():
        copies = min(int(n), min(int(left[j]) // k for j, k in config))
        if copies > 0:
            buy(config, copies)
    while left.any():
        use = priced(sizes, weights, left, room)
        config = pieces(use)
        copies = min(int(left[j]) // k for j, k in config)
        weights *= np.exp(-epsilon * copies * use / count)
        buy(config, copies)
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan by length: for ranks from `rank` on of a length, the first sequence, pieces in each, and their offset."""
    rows, taken, first = [], Counter(), 0
    for copies, config in plan:
        at = 0
        for length, k in sorted(config.items(), reverse=True):
            rows.append((length, taken[length], first, k, at))
            taken[length] += copies * k
            at += k * length
        first += copies
    rows.sort()
    return dict(zip(("length", "rank", "first", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with a rank from 0 among those of their length. A length's pieces are dealt over BUCKETS by hash and
    numbered there; the bucket's start comes from the counts, at most BUCKETS rows a length."""
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    return dealt.withColumn("_place", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_place"))


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty; an empty text is one piece, its end token. Texts longer than `size` tokens, end included, are
    cut every `size` tokens; no other is. Repeated rows are packed like different ones; no rows give no rows. Other
    columns are left out. The pieces are written once; the driver sees the histogram of lengths, `size` numbers at most.
    """
    pieces = keep(cut_pieces(docs, vocabulary, size, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(solve(histogram, size))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = max(histogram.values(), default=0) + 1
        keys = table["length"] * span + table["rank"]
        for b in batches:
            k = np.searchsorted(keys, b["length"].to_numpy() * span + b["_rank"].to_numpy(), "right") - 1
            step = b["_rank"].to_numpy() - table["rank"][k]
            b["sequence_id"] = table["first"][k] + step // table["each"][k]
            b["offset"] = table["offset"][k] + step % table["each"][k] * b["length"].to_numpy()
            yield b.drop(columns="_rank")

    ranked = numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
