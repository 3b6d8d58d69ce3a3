"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, REACH = 64, 32, 24
#: Labelled windows that the tagger is fitted on, at most; it then reads all texts.
FIT_WINDOWS = 3000
EMBED, HIDDEN, TAGS = 8, 12, len(KINDS) + 1
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GATE = re.compile(r"[0-9@]+")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """A match starts where the run of local characters before an @ does, or where the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done, 0
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all fixed patterns, by start, then kind; in time that follows the text's length."""
    if not GATE.search(text):
        return []
    out = list(emails(text)) if "@" in text else []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                out.append((at, end, 1))
            at = end + 1
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def codes(text: str) -> np.ndarray:
    """Characters as 0 to 63: digits alike, small letters, capitals alike, marks each, white space, the rest."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CODES[np.minimum(raw, 128)]


def code_table() -> np.ndarray:
    marks = "@.+-()_%/:,;#'\"!?&*=<>[]"
    table = np.full(129, 63, np.int64)
    table[[9, 10, 11, 12, 13, 32]] = 1
    table[48:58], table[65:91], table[97:123] = 2, 3, np.arange(4, 30)
    table[[ord(c) for c in marks]] = np.arange(30, 30 + len(marks))
    return table


CODES = code_table()


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Overlapping (start, end) over all stretches within REACH of a digit or an @, without which no kind is written."""
    lo = hi = -1
    for m in GATE.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if a <= hi:
            hi = b
            continue
        if hi >= 0:
            yield from cut(lo, hi)
        lo, hi = a, b
    if hi >= 0:
        yield from cut(lo, hi)


def cut(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    for a in range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE):
        yield a, min(a + WINDOW, hi)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """p: embedding e, per direction input-and-state weights w and bias b, output o with bias c, transitions t."""
    p: dict[str, np.ndarray]

    def lstm(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        w, b = self.p["w" + way], self.p["b" + way]
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, tape = np.zeros((n, steps, HIDDEN)), []
        for s in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[:, s], h], 1)
            g = z @ w + b
            i, f, o, u = sigmoid(g[:, :HIDDEN]), sigmoid(g[:, HIDDEN:2 * HIDDEN]), sigmoid(g[:, 2 * HIDDEN:3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN:])
            m = mask[:, s, None]
            new = (f * c + i * u) * m
            tape.append((s, z, i, f, o, u, c, new, m))
            c = new
            h = o * np.tanh(c) * m
            out[:, s] = h
        return out, tape

    def lstm_back(self, tape: list, dout: np.ndarray, way: str, grads: dict, dx: np.ndarray) -> None:
        w = self.p["w" + way]
        dh, dc = np.zeros(dout[:, 0].shape), np.zeros(dout[:, 0].shape)
        for s, z, i, f, o, u, c, new, m in reversed(tape):
            dh = (dh + dout[:, s]) * m
            t = np.tanh(new)
            dc = (dc + dh * o * (1 - t * t)) * m
            g = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - u * u)], 1)
            grads["w" + way] += z.T @ g
            grads["b" + way] += g.sum(0)
            dz = g @ w.T
            dx[:, s] += dz[:, :EMBED]
            dh, dc = dz[:, EMBED:], dc * f

    def emissions(self, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["e"][ids]
        f, tf = self.lstm(x, mask, "f")
        r, tr = self.lstm(x, mask, "r")
        h = np.concatenate([f, r], 2)
        return h @ self.p["o"] + self.p["c"], (x, h, tf, tr)

    def loss_and_grads(self, ids: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """CRF negative log-likelihood a window, and its gradients by forward and backward sums."""
        em, (x, h, tf, tr) = self.emissions(ids, mask)
        t, (n, steps, _) = self.p["t"], em.shape
        on = mask.astype(bool)
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for s in range(1, steps):
            a = logsum(alpha[:, s - 1, :, None] + t, 1) + em[:, s]
            alpha[:, s] = np.where(on[:, s, None], a, alpha[:, s - 1])
        for s in range(steps - 2, -1, -1):
            b = logsum(t + (em[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
            beta[:, s] = np.where(on[:, s + 1, None], b, beta[:, s + 1])
        z = logsum(alpha[:, -1], 1)
        d_em = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None, :]
        gold = (em[rows, cols, tags] * mask).sum(1) + (t[tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum(1)
        d_em[rows, cols, tags] -= mask
        pair = np.exp(alpha[:, :-1, :, None] + t + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        d_t = pair.sum((0, 1))
        np.add.at(d_t, (tags[:, :-1], tags[:, 1:]), -mask[:, 1:])
        d_em /= n
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["t"] = d_t / n
        grads["o"], grads["c"] = np.einsum("nsh,nst->ht", h, d_em), d_em.sum((0, 1))
        dh, dx = d_em @ self.p["o"].T, np.zeros_like(x)
        self.lstm_back(tf, dh[:, :, :HIDDEN], "f", grads, dx)
        self.lstm_back(tr, dh[:, :, HIDDEN:], "r", grads, dx)
        np.add.at(grads["e"], ids, dx)
        return float((z - gold).mean()), grads

    def decode(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The best tags of each window by Viterbi."""
        em, _ = self.emissions(ids, mask)
        n, steps, _ = em.shape
        best, back = em[:, 0], np.zeros(em.shape, np.int64)
        for s in range(1, steps):
            reach = best[:, :, None] + self.p["t"]
            back[:, s] = reach.argmax(1)
            on = mask[:, s, None] > 0
            best = np.where(on, reach.max(1) + em[:, s], best)
            back[:, s] = np.where(on, back[:, s], np.arange(TAGS))
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = best.argmax(1)
        for s in range(steps - 1, 0, -1):
            tags[:, s - 1] = back[np.arange(n), s, tags[:, s]]
        return tags


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def new_tagger(seed: int = 0) -> Tagger:
    r = np.random.default_rng(seed)
    p = {"e": r.normal(0, 0.3, (64, EMBED)), "o": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
    for way in "fr":
        p["w" + way] = r.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
        p["b" + way] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    return Tagger(p)


def batch_of(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids, mask = np.zeros((len(pieces), WINDOW), np.int64), np.zeros((len(pieces), WINDOW))
    for k, piece in enumerate(pieces):
        ids[k, :len(piece)] = codes(piece)
        mask[k, :len(piece)] = 1
    return ids, mask


def fit(pieces: list[str], labels: list[str], rounds: int = 5, batch: int = 32, rate: float = 0.02, seed: int = 0) -> Tagger:
    """Adam over the labelled windows; labels are one digit a character."""
    tagger, r = new_tagger(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in tagger.p.items()} for _ in range(2))
    step = 0
    for _ in range(rounds):
        order = r.permutation(len(pieces))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            ids, mask = batch_of([pieces[i] for i in pick])
            tags = np.zeros_like(ids)
            for k, i in enumerate(pick):
                tags[k, :len(labels[i])] = np.frombuffer(labels[i].encode(), np.uint8) - 48
            _, grads = tagger.loss_and_grads(ids, tags, mask)
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                tagger.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return tagger


def reconciled(spots: list[tuple[int, int]], tags: np.ndarray) -> list[Span]:
    """Spans of a text from its windows: each character has the tag of the window in which it stands farthest from an end."""
    tag: dict[int, tuple[int, int]] = {}
    for (a, b), row in zip(spots, tags):
        for i in range(a, b):
            depth = min(i - a, b - 1 - i)
            if i not in tag or depth > tag[i][0]:
                tag[i] = (depth, int(row[i - a]))
    out: list[Span] = []
    for i in sorted(tag):
        kind = tag[i][1] - 1
        if kind < 0:
            continue
        if out and out[-1][1] == i and out[-1][2] == kind:
            out[-1] = (out[-1][0], i + 1, kind)
        else:
            out.append((i, i + 1, kind))
    return out


def believable(text: str, span: Span) -> bool:
    """Whether a span of the tagger is not cut out of a word or number and has the least that its kind needs."""
    part = text[span[0]:span[1]]
    if text[span[0] - 1:span[0]].isalnum() or text[span[1]:span[1] + 1].isalnum():
        return False
    return "@" in part[1:-1] if span[2] == 0 else sum(c in "0123456789" for c in part) >= (4 if span[2] == 1 else 9)


def labelled_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(place, piece, labels) of all windows of all texts; place is a hash, by which a bounded sample is drawn."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spots = list(windows(text))
            if not spots:
                continue
            spans = base_spans(text)
            for a, b in spots:
                label = bytearray(b"0" * (b - a))
                for s, e, k in spans:
                    if s < b and e > a:
                        label[max(s, a) - a:min(e, b) - a] = bytes([49 + k]) * (min(e, b) - max(s, a))
                piece = text[a:b]
                rows.append((xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), 1) >> 1, piece, label.decode()))
        yield pd.DataFrame(rows, columns=["place", "piece", "labels"])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_personal_data(docs: DataFrame, fit_windows: int = FIT_WINDOWS) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base_sha256, spans, n_added.

    Null and empty texts have no spans. Spans count code points. The tagger reads overlapping windows over all stretches near
    a digit or an @; windows of a text are reconciled by depth; a span of its own joins where it meets no fixed one.
    It is fitted on at most fit_windows windows of distinct text, labelled by the fixed patterns, which a hash draws from all
    texts; without any, it adds nothing. Row-local otherwise, so repeated rows give repeated results; other columns are left out.
    """
    narrow = texts(docs)
    sample = narrow.select("text").mapInPandas(labelled_windows, "place long, piece string, labels string").distinct().orderBy("place", "piece", "labels").limit(fit_windows).collect()
    tagger = fit([r["piece"] for r in sample], [r["labels"] for r in sample]) if sample else None

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = list(batch["text"])
            spots = [list(windows(t)) for t in bodies]
            flat = [t[a:b] for t, own in zip(bodies, spots) for a, b in own]
            tags = [tagger.decode(*batch_of(flat[i:i + 512])) for i in range(0, len(flat), 512)] if tagger else []
            all_tags = np.concatenate(tags) if tags else np.zeros((0, WINDOW), np.int64)
            rows, at = [], 0
            for doc_id, text, own in zip(batch["doc_id"], bodies, spots):
                base = base_spans(text) if own else []
                more = [s for s in reconciled(own, all_tags[at:at + len(own)]) if believable(text, s) and not any(s[0] < e and s[1] > b for b, e, _ in base)]
                at += len(own)
                counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more, key=lambda s: (s[0], s[2]))), len(more)))
            frame = pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return narrow.mapInPandas(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
