"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import texts

# Fixed value: the vocabulary's pattern for the pieces that are merged on their own.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
# Below U+0378 every letter is assigned.
HIGH = re.compile("[\u0378-\U0010ffff]")
#: Words and pieces that a worker remembers, of at most so many characters.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if Latin-1 and visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def normal(text: str) -> str:
    """The vocabulary's normal form: composed, then lower case, letter by letter where a final sigma would make lower() look around."""
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def unassigned(text: str) -> bool:
    """Some letter is in no table of Python's, while the library, whose tables are of another year, may know it."""
    return not text.isascii() and HIGH.search(text) is not None and any(unicodedata.category(c) == "Cn" for c in text)


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Merger:
    """Counts tokens of words by the merge table of a byte-pair vocabulary with word ends."""

    def __init__(self, path: str):
        self.path = path
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        letters = byte_letters()
        self.byte = {x: b for b, x in enumerate(letters)}
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.rank: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a] << 20 | vocab[b]] = (r, vocab[a + b])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]))
        self.words: dict[str, int] = {"": 0}
        self.pieces: dict[bytes, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes, less one for each merge.

        The heap holds (rank, left place, left symbol, right symbol); an entry whose symbols have changed is stale.
        """
        n = len(piece)
        sym = [self.inner[b] for b in piece]
        sym[-1] = self.last[piece[-1]]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank.get
        heap = []
        for i in range(n - 1):
            if hit := get(sym[i] << 20 | sym[i + 1]):
                heap.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            left -= 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if hit := get(new << 20 | sym[k]):
                    heapq.heappush(heap, (hit[0], i, new, sym[k], hit[1]))
            if (h := prv[i]) >= 0 and (hit := get(sym[h] << 20 | new)):
                heapq.heappush(heap, (hit[0], h, sym[h], new, hit[1]))
        return left

    def cut(self, text: str) -> list[bytes]:
        """The pieces of a text without special strings; texts with unassigned letters are cut by the library."""
        if not unassigned(text):
            return [x.encode() for x in PIECES.findall(normal(text))]
        lib = library(self.path)
        return [bytes(map(self.byte.__getitem__, x)) for x, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def plain(self, text: str) -> int:
        total = 0
        for raw in self.cut(text):
            n = self.pieces.get(raw)
            if n is None:
                n = self.merged(raw)
                if len(raw) <= CACHE_CHARS:
                    if len(self.pieces) >= CACHE_ENTRIES:
                        self.pieces.clear()
                    self.pieces[raw] = n
            total += n
        return total

    def word(self, word: str) -> int:
        """Tokens of text without spaces; special strings count one each, as the library takes them from a text."""
        if "<|" not in word:
            n = self.plain(word)
        else:
            n = sum(map(self.plain, self.special.split(word))) + len(self.special.findall(word))
        if len(word) <= CACHE_CHARS:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
                self.words[""] = 0
            self.words[word] = n
        return n

    def count(self, text: str) -> int:
        """Words end at spaces, over which neither the normal form nor a piece reaches."""
        known, total = self.words.get, 0
        for w in text.split(" "):
            n = known(w)
            total += self.word(w) if n is None else n
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null text is empty: no bytes, no tokens. Row-local, so repeated rows give repeated results; other columns are left
    out. A worker holds one Arrow batch and a cache of bounded size. vocabulary is a path on every worker.
    """
    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = merger(vocabulary)
        for s in batches:
            yield pd.Series([m.count(t) for t in s], dtype="int64")

    return texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
