"""Blocks of documents whose many small facts meet as packed numbers.

Documents are dealt into blocks of about the same size. A block's facts, unsigned 64-bit keys with a value, go to
key ranges as one packed row per range; a range answers each block with one value per key, in the order it was asked.
So hot keys cost one fact a block, and rows that move are few and of even size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import texts

FACTS = "kind byte, part long, block long, n long, keys binary, vals binary"
ANSWERS = "kind byte, part long, block long, n long, vals binary, total double, seen long"
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def planes(x: np.ndarray) -> bytes:
    """Numbers by significance of their bytes, which the shuffle's codec packs well."""
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def numbers(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(numbers(raw, U64), dtype=U64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys) % U64(parts)).astype(np.int64)


def ordered(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sorted keys by (part, key), and the parts present with their first places."""
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    return order, found, first


def facts(kind: int, block: int, keys: np.ndarray, vals: np.ndarray, part: np.ndarray) -> pd.DataFrame:
    """Packed rows of one block's distinct sorted keys and their values, a row for each part."""
    order, found, first = ordered(part)
    keys, vals, ends = keys[order], vals[order], np.r_[first[1:], len(keys)]
    return pd.DataFrame({
        "kind": np.full(len(found), kind, np.int8), "part": found, "block": block, "n": ends - first,
        "keys": [pack_keys(keys[a:b]) for a, b in zip(first, ends)], "vals": [planes(vals[a:b]) for a, b in zip(first, ends)]})


def answers_of(keys: np.ndarray, rows: pd.DataFrame, dtype: type, part: np.ndarray) -> np.ndarray:
    """The answers to a block's distinct sorted keys, in their order; rows are all its answers of the kind."""
    order, found, first = ordered(part)
    by = dict(zip(rows["part"], rows["vals"]))
    out = np.empty(len(keys), dtype)
    if len(keys):
        out[order] = np.concatenate([numbers(by[p], dtype) for p in found])
    return out


def block_column(blocks: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block")


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id and text as bytes, dealt by block: one exchange, which every later grouping by block uses."""
    raw = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.withColumn("block", block_column(blocks)).repartition(blocks, "block")


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes together, one text at least."""
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(lengths):
        yield lo, len(lengths)
