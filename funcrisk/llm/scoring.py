"""Language-model scores: logistic mixing of hashed-context bit predictors, beside a word unigram."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk.llm import blocks as B
from funcrisk.llm.common import keep, parts_for

U64 = np.uint64
ORDERS, SLOT_BITS, BLOCK_BYTES, SLICE = 5, 22, 8 << 20, 1 << 18
#: Passes over all training contexts in which the mixing weights are learnt, and fractions of one that their sums are kept in.
PASSES, GRAIN = 2, 1 << 16
RANGES = 64
#: Starts and ends a text; no UTF-8 text has this byte.
EDGE = 0xFF
END_WORD = xxhash.xxh64_intdigest(b"", 0)
CLASSES, STEPS = 8, 33
#: Taken off each seen word's count and given to the bytes' model, which spells all words.
DISCOUNT = 0.7
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % 7 == 2


@dataclass
class Flat:
    """Texts end to end, each with its end: every byte with the ORDERS - 1 bytes before it as one number, and where texts begin."""
    grams: np.ndarray
    begins: np.ndarray


def flat(texts_: list[bytes]) -> Flat:
    lead = bytes([EDGE]) * (ORDERS - 1)
    raw = np.frombuffer(lead + b"".join([t + lead + bytes([EDGE]) for t in texts_]), np.uint8)
    grams = np.zeros(len(raw) - ORDERS + 1, U64)
    for i in range(ORDERS):
        grams = grams << U64(8) | raw[i:i + len(grams)]
    sizes = np.fromiter(map(len, texts_), np.int64, len(texts_))
    starts = np.r_[0, np.cumsum(sizes + ORDERS)[:-1]]
    inside = np.ones(len(grams), bool)
    # Behind a text's end come the bytes that lead the next one.
    for k in range(1, ORDERS):
        at = starts + sizes + k
        inside[at[at < len(grams)]] = False
    return Flat(grams[inside], np.r_[0, np.cumsum(sizes + 1)[:-1]])


def in_slices(texts_: list[bytes]) -> Iterator[tuple[int, int, Flat]]:
    for a, b in B.slices(np.fromiter(map(len, texts_), np.int64, len(texts_)), SLICE):
        yield a, b, flat(texts_[a:b])


def counted(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted numbers and how often they occur, or the sums of n."""
    if n is None:
        x = np.sort(x)
    else:
        order = np.argsort(x)
        x, n = x[order], n[order]
    first = np.flatnonzero(np.r_[len(x) > 0, x[1:] != x[:-1]])
    return x[first], np.diff(np.r_[first, len(x)]) if n is None else np.add.reduceat(n, first) if len(x) else n


def context(grams: np.ndarray, order: int) -> np.ndarray:
    """A number for the `order` bytes before the last one, different for each order."""
    return B.mixed(((grams >> U64(8)) & U64((1 << 8 * order) - 1)) | U64(order + 1) << U64(56))


def slots_of(ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of a context and the bits of the byte seen so far."""
    return ((ctx ^ node * U64(0xD6E8FEB86659FD93)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - SLOT_BITS)


def nodes_of(grams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bits so far behind a leading 1, next bit) for the eight bits of each gram's last byte."""
    last = grams & U64(255) | U64(256)
    return [(last >> U64(8 - k), (last >> U64(7 - k)) & U64(1)) for k in range(8)]


def bit_counts(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of zeros and ones there, (n, 2), of grams seen so often."""
    slots = []
    for order in range(ORDERS):
        ctx = context(grams, order)
        for node, bit in nodes_of(grams):
            slots.append(slots_of(ctx, node) << U64(1) | bit)
    cell, n = counted(np.concatenate(slots), np.tile(counts, len(slots)))
    first = np.flatnonzero(np.r_[len(cell) > 0, cell[1:] >> U64(1) != cell[:-1] >> U64(1)])
    slot = cell[first] >> U64(1)
    both = np.zeros((len(slot), 2), np.int64)
    both[np.repeat(np.arange(len(slot)), np.diff(np.r_[first, len(cell)])), (cell & U64(1)).astype(np.int64)] = n
    return slot, both


@dataclass
class Model:
    """counts: zeros and ones by slot. weights: by bit, order and class of evidence; refine: by bit and step of the mixed logit."""
    counts: np.ndarray
    weights: np.ndarray
    refine: np.ndarray

    @staticmethod
    def untaught(counts: np.ndarray) -> Model:
        return Model(counts, np.full((8, ORDERS, CLASSES), 1.0 / ORDERS, np.float64), np.tile(1 / (1 + np.exp(-np.linspace(-16, 16, STEPS))), (8, 1)))

    def inputs(self, ctx: list[np.ndarray], node: np.ndarray, less: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors (orders, n) and their classes of evidence; less[i] is taken off the count of that bit."""
        logit, kind = np.empty((ORDERS, len(node)), np.float32), np.empty((ORDERS, len(node)), np.int64)
        for o in range(ORDERS):
            n = self.counts[slots_of(ctx[o], node)].astype(np.float32)
            if less is not None:
                n = np.maximum(n - np.stack([1 - less, less], 1), 0)
            logit[o] = np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4))
            kind[o] = np.minimum(np.log2(n.sum(1) + 1), CLASSES - 1)
        return logit, kind

    def mixed(self, k: int, logit: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.clip((self.weights[k][np.arange(ORDERS)[:, None], kind] * logit).sum(0), -15.9, 15.9)

    def refined(self, k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a one, after the adaptive table that is read between two steps, with the step and the share of the next."""
        at = (x + 16) * ((STEPS - 1) / 32)
        low = at.astype(np.int64)
        part = at - low
        table = self.refine[k]
        p = 0.5 / (1 + np.exp(-x)) + 0.5 * (table[low] * (1 - part) + table[low + 1] * part)
        return np.clip(p, 1e-6, 1 - 1e-6), low, part

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        ctx, out = [context(grams, o) for o in range(ORDERS)], np.zeros(len(grams))
        for k, (node, bit) in enumerate(nodes_of(grams)):
            p, _, _ = self.refined(k, self.mixed(k, *self.inputs(ctx, node)))
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def fit(counts: np.ndarray, grams: np.ndarray, seen: np.ndarray, rounds: int = 2, batch: int = 512, rate: float = 0.08) -> Model:
    """The mixer learnt from all grams given, in so many rounds."""
    model = Model.untaught(counts)
    for _ in range(rounds):
        learn(model, grams, seen, batch, rate)
    return model


def learn(model: Model, grams: np.ndarray, seen: np.ndarray, batch: int = 512, rate: float = 0.08) -> tuple[np.ndarray, np.ndarray]:
    """One round online: batch after batch the model predicts each bit, then moves the weights that its gates chose
    along the error, and the refining table towards what came. Each gram is predicted without its own occurrence. Returns
    how many occurrences each weight and each step of the table had."""
    used, read = np.zeros_like(model.weights), np.zeros_like(model.refine)
    order = np.argsort(B.mixed(grams ^ U64(17)))
    grams, seen = grams[order], np.minimum(seen[order], 1000).astype(np.float64)
    for lo in range(0, len(grams), batch):
        g, n = grams[lo:lo + batch], seen[lo:lo + batch]
        w = n / n.sum()
        ctx = [context(g, o) for o in range(ORDERS)]
        for k, (node, bit) in enumerate(nodes_of(g)):
            y = bit.astype(np.float64)
            logit, kind = model.inputs(ctx, node, y.astype(np.float32))
            x = model.mixed(k, logit, kind)
            err = w * (y - 1 / (1 + np.exp(-x)))
            for o in range(ORDERS):
                model.weights[k, o] += rate * np.bincount(kind[o], err * logit[o], CLASSES)
                used[k, o] += np.bincount(kind[o], n, CLASSES)
            _, low, part = model.refined(k, x)
            for step, share in ((low, 1 - part), (low + 1, part)):
                mass = np.bincount(step, w * share, STEPS)
                goal = np.bincount(step, w * share * y, STEPS)
                model.refine[k] += 0.5 * (goal - mass * model.refine[k])
                read[k] += np.bincount(step, n * share, STEPS)
    return used, read


def shares(model: Model, used: np.ndarray, read: np.ndarray) -> np.ndarray:
    """What a part of the contexts adds to the mean of all parts' models, as whole numbers, so that any order of adding gives the same."""
    sums = [x.ravel() for x in (model.weights * used, used, model.refine * read, read)]
    return np.rint(np.concatenate(sums) * GRAIN).astype(np.int64)


def averaged(model: Model, sums: np.ndarray) -> Model:
    """The mean of the parts' models, each weight by the occurrences that it had in a part; what had none stays as it is."""
    w, r = model.weights.size, model.refine.size
    parts = [x / GRAIN for x in np.split(np.asarray(sums, np.float64), [w, 2 * w, 2 * w + r])]
    mean = lambda old, top, n: np.where(n > 0, top / np.maximum(n, 1 / GRAIN), old.ravel()).reshape(old.shape)
    return Model(model.counts, mean(model.weights, parts[0], parts[1]), mean(model.refine, parts[2], parts[3]))


def taught(contexts: DataFrame, counts: np.ndarray, parts: int, passes: int = PASSES) -> Model:
    """The mixer learnt from all contexts (part, keys, vals): in each pass every part learns from where all left off, and
    the mean of their models goes on. The driver gets one row per number of a model."""
    context_, model = contexts.sparkSession.sparkContext, Model.untaught(counts)
    table = context_.broadcast(counts)
    dealt = contexts.repartition(parts, "part")
    for _ in range(passes):
        weights, refine = model.weights, model.refine

        def learnt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k, v in zip(b["keys"], b["vals"]):
                    mine = Model(table.value, weights.copy(), refine.copy())
                    x = shares(mine, *learn(mine, B.unpack_keys(k), B.numbers(v, np.int64)))
                    yield pd.DataFrame({"position": np.arange(len(x), dtype=np.int32), "x": x})

        rows = dealt.mapInPandas(learnt, "position int, x long").groupBy("position").agg(F.sum("x").alias("x")).collect()
        if rows:
            sums = np.zeros(len(rows), np.int64)
            sums[[r["position"] for r in rows]] = [r["x"] for r in rows]
            model = averaged(model, sums)
    table.unpersist()
    return model


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in words), U64, len(words))


class Lookup:
    """Values of sorted known grams; a table by hash finds most of them at once."""

    def __init__(self, known: np.ndarray, value: np.ndarray, bits: int = 20):
        self.known, self.value, self.shift = known, value, U64(64 - bits)
        self.table = np.zeros(1 << bits, np.int64)
        self.table[self.place(known)] = np.arange(len(known))

    def place(self, grams: np.ndarray) -> np.ndarray:
        return (grams * U64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.table[self.place(grams)]
        miss = np.flatnonzero(self.known[at] != grams)
        at[miss] = np.searchsorted(self.known, grams[miss])
        return self.value[at]


def gathered(group: tuple, docs: pd.DataFrame, parts: int) -> pd.DataFrame:
    """A block's facts: words with their training counts (kind 1), grams of its training texts with theirs (kind 2)."""
    train, other, learnt = Counter(), set(), []
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        text = text.lower()
        if held_out(doc_id):
            other.update(text.split())
        else:
            train.update(text.split())
            learnt.append(text)
    words = [*train, *(other - train.keys())]
    n = np.zeros(len(words) + 1, np.int64)
    n[:len(train)], n[-1] = np.fromiter(train.values(), np.int64, len(train)), len(learnt)
    keys, counts = counted(np.r_[word_keys(words), U64(END_WORD)], n)
    some = [counted(f.grams) for _, _, f in in_slices(learnt)]
    gram, seen = counted(np.concatenate([np.zeros(0, U64), *[x for x, _ in some]]), np.concatenate([np.zeros(0, np.int64), *[x for _, x in some]]))
    # Grams meet by the two bytes before the last, so that the slots of longer contexts meet in one part too.
    by = B.part_of((gram >> U64(8)) & U64(0xFFFF), parts)
    return pd.concat([B.facts(1, int(group[0]), keys, counts, B.part_of(keys, parts)), B.facts(2, int(group[0]), gram, seen, by)])


def summed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all rows, their sums, and each fact's place among them."""
    keys, vals = np.concatenate([B.unpack_keys(x) for x in rows["keys"]]), np.concatenate([B.numbers(x, np.int64) for x in rows["vals"]])
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, vals, len(distinct)).astype(np.int64), at


def told(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Word counts for each block (kind 1); bit counts by slot range (kind 3), all grams with their counts (kind 4), and
    how often each byte ends a word (kind 5)."""
    kind, part = int(group[0]), int(group[1])
    key, total, at = summed(rows)
    if kind == 1:
        ends, n = np.cumsum(rows["n"].to_numpy()), rows["n"].to_numpy()
        all_vals = total[at]
        once = np.arange(len(rows)) == 0
        return pd.DataFrame({
            "kind": np.full(len(rows), 1, np.int8), "part": part, "block": rows["block"].to_numpy(), "n": n, "keys": b"",
            "vals": [B.planes(all_vals[e - m:e]) for e, m in zip(ends, n)], "total": np.where(once, total.sum(), 0), "seen": np.where(once, (total > 0).sum(), 0)})
    slot, both = bit_counts(key, total)
    span = U64((1 << SLOT_BITS) // RANGES)
    edge = np.searchsorted(slot, np.arange(RANGES + 1, dtype=U64) * span)
    out = [(3, r, -1, b - a, B.pack_keys(slot[a:b]), B.planes(np.ascontiguousarray(both[a:b]).ravel())) for r, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
    last, before = (key & U64(255)).astype(np.int64), (key >> U64(8) & U64(255)).astype(np.int64)
    closes = (SPACES[last] | (last == EDGE)) & ~SPACES[before] & (before != EDGE)
    ends = np.bincount(last[closes], total[closes], 256).astype(np.int64)
    if len(key):
        out.append((4, part, -1, len(key), B.pack_keys(key), B.planes(total)))
    out = [(*x, 0) for x in out] + [(5, int(b), -1, 0, b"", b"", int(ends[b])) for b in np.flatnonzero(ends)]
    return pd.DataFrame(out, columns=["kind", "part", "block", "n", "keys", "vals", "total"]).assign(seen=0)


def slot_range(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """All counts of one slot range, halved until they fit 16 bits."""
    span = (1 << SLOT_BITS) // RANGES
    dense = np.zeros((span, 2), np.int64)
    for k, v in zip(rows["keys"], rows["vals"]):
        dense[(B.unpack_keys(k) - U64(int(group[0]) * span)).astype(np.int64)] += B.numbers(v, np.int64).reshape(-1, 2)
    scale = np.maximum(1.0, dense.max(1, keepdims=True) / 65535)
    return pd.DataFrame({"part": [int(group[0])], "vals": [np.ceil(dense / scale).astype(np.uint16).tobytes()]})


@dataclass
class Corpus:
    """What scoring knows of the training texts: the bytes' model, tokens, distinct tokens, log10 share of each byte after words."""
    model: Model
    tokens: int
    distinct: int
    closing: np.ndarray


def scores(f: Flat, byte_scores: np.ndarray, counts: np.ndarray, corpus: Corpus) -> np.ndarray:
    """log10 of the probability of each text's bytes and its end; counts are of all words in turn.

    A word with the byte that closes it comes either from the words seen, by discounted count, or is spelled by the
    bytes' model; both ways add up. White space beyond that is spelled too.
    """
    last = (f.grams & U64(255)).astype(np.uint8)
    solid = ~SPACES[last] & (last != EDGE)
    edge = np.diff(np.r_[0, solid.astype(np.int8), 0])
    first, close = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.r_[0.0, np.cumsum(byte_scores)]
    spelled = total[close + 1] - total[first]
    n = max(1, corpus.tokens)
    left = np.log10(min(1.0, max(DISCOUNT * corpus.distinct, 0.5) / n))
    with np.errstate(divide="ignore"):
        known = np.log10(np.maximum(counts - DISCOUNT, 0) / n) + corpus.closing[last[close]]
    words = np.logaddexp2(known * np.log2(10), (spelled + left) * np.log2(10)) / np.log2(10)
    # Bytes in no word: white space that closes none, and ends behind it.
    free = ~solid
    free[close] = False
    out = np.where(free, byte_scores + left, 0.0)
    out[first] = words
    return np.add.reduceat(out, f.begins)


def scored(block: pd.DataFrame, side: pd.DataFrame, corpus: Corpus, parts: int) -> pd.DataFrame:
    texts_ = [t.lower() for t in block["text"]]
    split = [t.split() for t in texts_]
    words = list(set().union(*split))
    keys = np.r_[word_keys(words), U64(END_WORD)]
    order = np.argsort(keys)
    distinct, at = keys[order], np.empty(len(keys), np.int64)
    first = np.r_[True, distinct[1:] != distinct[:-1]]
    at[order] = np.cumsum(first) - 1
    distinct = distinct[first]
    counts = B.answers_of(distinct, side, np.int64, B.part_of(distinct, parts))[at]
    count, end = dict(zip(words, counts.tolist())), int(counts[-1])
    pieces = list(in_slices(texts_))
    known, _ = counted(np.concatenate([counted(f.grams)[0] for _, _, f in pieces]))
    value = np.concatenate([corpus.model.log10(known[i:i + (1 << 15)]) for i in range(0, len(known), 1 << 15)])
    find, floor = Lookup(known, value), np.log10(corpus.tokens + corpus.distinct + 1)
    out = []
    for a, b, f in pieces:
        c = np.fromiter(map(count.__getitem__, chain.from_iterable(split[a:b])), np.int64)
        score = scores(f, find(f.grams), c, corpus)
        # Each text's words and its end.
        n = np.fromiter(map(len, split[a:b]), np.int64, b - a) + 1
        tails = np.cumsum(n)
        every = np.full(int(n.sum()), end)
        every[np.delete(np.arange(len(every)), tails - 1)] = c
        starts = tails - n
        base = np.add.reduceat(np.log10(every + 1.0), starts) - n * floor
        size = np.maximum(1, [len(t) for t in texts_[a:b]])
        out.append(pd.DataFrame({
            "doc_id": block["doc_id"].to_numpy()[a:b], "held_out": [held_out(d) for d in block["doc_id"].iloc[a:b]], "n_tokens": n,
            "n_known": np.add.reduceat((every > 0).astype(np.int64), starts), "train_tokens": corpus.tokens, "base_score": base, "score": score,
            "bits_per_byte": -score * np.log2(10) / size}))
    return pd.concat(out)


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts whose crc32(doc_id as text) mod 7 is not 2 are learnt from; all are scored. A-Z is lowered. Null text is empty:
    its end is one token; a null id counts as an empty id text. Repeated rows are learnt and scored each. Other columns are left out.

    base: the words' add-one unigram, end included. score: log10 of the probability of the text's bytes and their end. A
    byte is eight bits; each bit has ORDERS predictors, which count zeros and ones after the last 0 to ORDERS - 1 bytes and the bits so
    far, in 2^SLOT_BITS hashed slots. Their logits are mixed with weights that bit and evidence choose, learnt online, and refined by
    an adaptive table. Whole words seen in training are a further way to the same bytes, by discounted count. All ways
    add up to one at most, so the score is that of a distribution over texts.

    Word and context counts of all training texts are gathered by Spark as packed facts, and the weights are learnt from all
    their contexts where these lie (see taught). The driver gets the slot table and the weights, whose sizes are fixed. The model stands still while it scores, so a byte's score
    follows from its five bytes and is worked out once per distinct five in a block.
    """
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    blocks = parts = parts_for(named, block_bytes)
    text = B.dealt(named, blocks)
    facts = text.groupBy("block").applyInPandas(lambda g, d: gathered(g, d, parts), B.FACTS)
    answers = keep(facts.groupBy("kind", "part").applyInPandas(told, B.FACTS + ", total long, seen long"), "counts")
    n_train, n_words = answers.filter("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    counts = np.zeros((1 << SLOT_BITS, 2), np.uint16)
    span = (1 << SLOT_BITS) // RANGES
    for r in answers.filter("kind = 3").select("part", "keys", "vals").groupBy("part").applyInPandas(slot_range, "part long, vals binary").collect():
        counts[r["part"] * span:(r["part"] + 1) * span] = np.frombuffer(r["vals"], np.uint16).reshape(-1, 2)
    model = taught(answers.filter("kind = 4").select("part", "keys", "vals"), counts, parts)
    closing = np.full(256, 0.5)
    for r in answers.filter("kind = 5").groupBy("part").agg(F.sum("total").alias("n")).collect():
        closing[r["part"]] += r["n"]
    possible = SPACES | (np.arange(256) == EDGE)
    closing = np.log10(np.where(possible, closing, 1e-300) / closing[possible].sum())
    corpus = docs.sparkSession.sparkContext.broadcast(Corpus(model, n_train, n_words, closing))

    def score(block: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        return scored(block, side, corpus.value, parts)

    side = answers.filter("kind = 1").select("block", "part", "vals")
    done = text.groupBy("block").cogroup(side.groupBy("block")).applyInPandas(
        score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
