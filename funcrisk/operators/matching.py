"""Lowest-row matching in rounds: what a walk through an image's functions would give, without the walk.

Functions in order each take the lowest unused row that shares a key with them. All functions rank rows alike and all
rows rank functions alike, so a pair that is first on both sides among what is left belongs to the result whatever
else happens, and all such pairs settle at once. Under a key, the n-th function and the n-th row go with the pairs
before them: a run of pairs settles as long as no row that lacks the key comes before a function's row under another
of its keys, and no function that lacks it before a row's function.

Chains of functions that wait for one another would take a round a link. So each round first walks the next BLOCK open
functions of every image one after the other, over as many rows a key as they may use; a task holds a block, however large
the image is. The rounds are then as few as the blocks of the largest image, or as the links of its longest chain, at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcrisk.scale import cut_lineage, number_rows

# Members numbered together inside a key.
NUMBER_BITS = 14
# Functions of an image that a round walks through, and rows under a key beyond two for each of them that has it.
BLOCK = 1 << 15
SPARE = 64
IMAGE = "firmware_id"


def numbered(side: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """side with the 1-based place of its member (function or row) under the keys."""
    return number_rows(side, keys, F.shiftright("member", NUMBER_BITS), [F.col("member")], name)


def two_keys(side: DataFrame) -> DataFrame:
    """(firmware_id, member, key, other): the ordered pairs of keys that a member has."""
    return side.select(IMAGE, "member", "key").join(side.select(IMAGE, "member", F.col("key").alias("other")), [IMAGE, "member"]).filter("key != other")


def barriers(asking: DataFrame, places: DataFrame) -> DataFrame:
    """(firmware_id, member, key, barrier): for each asking member and key, the first opposite member that lacks the key
    under another key of the asking one; null where there is none.

    Under that other key, those that have the key too stand first as long as their place among themselves is their place.
    """
    both = two_keys(places).join(places.select(IMAGE, "member", F.col("key").alias("other"), "place"), [IMAGE, "member", "other"])
    alike = numbered(both, [IMAGE, "key", "other"], "among").filter("among = place").groupBy(IMAGE, "key", "other").agg(F.max("place").alias("alike"))
    asked = two_keys(asking).join(alike, [IMAGE, "key", "other"], "left").withColumn("place", F.coalesce("alike", F.lit(0)) + 1)
    first = places.select(IMAGE, F.col("key").alias("other"), "place", F.col("member").alias("first"))
    return asked.join(first, [IMAGE, "other", "place"], "left").groupBy(IMAGE, "member", "key").agg(F.min("first").alias("barrier"))


def settled(functions: DataFrame, rows: DataFrame) -> DataFrame:
    """(firmware_id, function, row) that are sure, from what is open: both sides (firmware_id, key, member)."""
    f, r = numbered(functions, [IMAGE, "key"], "place"), numbered(rows, [IMAGE, "key"], "place")
    pairs = f.withColumnRenamed("member", "function").join(r.withColumnRenamed("member", "row"), [IMAGE, "key", "place"])
    before_f = barriers(f, r).select(IMAGE, "key", F.col("member").alias("function"), F.col("barrier").alias("_row"))
    before_r = barriers(r, f).select(IMAGE, "key", F.col("member").alias("row"), F.col("barrier").alias("_function"))
    judged = pairs.join(before_f, [IMAGE, "key", "function"], "left").join(before_r, [IMAGE, "key", "row"], "left")
    free: Column = F.coalesce(F.col("_row") > F.col("row"), F.lit(True)) & F.coalesce(F.col("_function") > F.col("function"), F.lit(True))
    judged = judged.select(IMAGE, "key", "place", "function", "row", free.alias("free"))
    stop = judged.filter(~F.col("free")).groupBy(IMAGE, "key").agg(F.min("place").alias("stop"))
    run = judged.join(stop, [IMAGE, "key"], "left").filter(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    return run.select(IMAGE, "function", "row").distinct()


def walk(functions: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """(firmware_id, function, row): an image's functions (key, member) in order, each with the lowest unused of the rows (row_key, row_member, cut).

    Of a key that is cut only its first rows are here. A function that one of the others might be for ends the walk.
    """
    rows = rows.sort_values("row_member")
    lists = {key: (group["row_member"].tolist(), bool(group["cut"].iloc[0])) for key, group in rows.groupby("row_key", sort=False)}
    at, used, pairs = dict.fromkeys(lists, 0), set(), []
    keys_of: dict[int, list[str]] = {}
    for member, key in zip(functions["member"].tolist(), functions["key"].tolist()):
        keys_of.setdefault(member, []).append(key)
    for function in sorted(keys_of):
        best = unseen = None
        for key in keys_of[function]:
            if key not in lists:
                continue
            members, cut = lists[key]
            i = at[key]
            while i < len(members) and members[i] in used:
                i += 1
            at[key] = i
            if i < len(members):
                best = members[i] if best is None else min(best, members[i])
            elif cut:
                unseen = members[-1] if unseen is None else min(unseen, members[-1])
        if unseen is not None and (best is None or best > unseen):
            break
        if best is not None:
            used.add(best)
            pairs.append((function, best))
    image = functions[IMAGE].iloc[0] if len(functions) else None
    return pd.DataFrame({IMAGE: [image] * len(pairs), "function": [f for f, _ in pairs], "row": [r for _, r in pairs]})


def walked(functions: DataFrame, rows: DataFrame, block: int = BLOCK, spare: int = SPARE) -> DataFrame:
    """(firmware_id, function, row) of the first `block` open functions of every image, or of those up to where a key's rows
    run out that are handed to the walk; both sides (firmware_id, key, member)."""
    first = numbered(functions.select(IMAGE, "member").distinct(), [IMAGE], "nth").filter(F.col("nth") <= block)
    taking = functions.join(first.select(IMAGE, "member"), [IMAGE, "member"], "left_semi")
    asked = taking.groupBy(IMAGE, "key").agg((2 * F.count(F.lit(1)) + spare).alias("most"))
    held = rows.groupBy(IMAGE, "key").agg(F.count(F.lit(1)).alias("held"))
    asked = asked.join(held, [IMAGE, "key"]).select(IMAGE, "key", "most", (F.col("held") > F.col("most")).alias("cut"))
    offered = numbered(rows.join(asked, [IMAGE, "key"]), [IMAGE, "key"], "place").filter("place <= most")
    offered = offered.select(*[F.col(c).alias(f"row_{c}") for c in (IMAGE, "key", "member")], "cut")
    kind = functions.schema[IMAGE].dataType.simpleString()
    return taking.groupBy(IMAGE).cogroup(offered.groupBy(f"row_{IMAGE}")).applyInPandas(walk, f"{IMAGE} {kind}, function long, row long")


def lowest_rows(functions: DataFrame, rows: DataFrame, block: int = BLOCK, spare: int = SPARE) -> DataFrame:
    """(firmware_id, function, row): functions in order each take the lowest unused row under any of their keys.

    Both sides are (firmware_id, key, member), members of an image being different numbers; repeated rows count once.
    Each round is cut from its lineage, so a lost executor costs no earlier round.
    """
    functions, rows = functions.distinct(), rows.distinct()
    found = None
    while True:
        for step in (lambda f, r: walked(f, r, block, spare), settled):
            functions = cut_lineage(functions.join(rows.select(IMAGE, "key").distinct(), [IMAGE, "key"], "left_semi"))
            rows = cut_lineage(rows.join(functions.select(IMAGE, "key").distinct(), [IMAGE, "key"], "left_semi"))
            if functions.isEmpty():
                empty = functions.select(IMAGE, F.col("member").alias("function"), F.col("member").alias("row"))
                return empty if found is None else found
            now = cut_lineage(step(functions, rows))
            found = now if found is None else found.unionByName(now)
            functions = functions.join(now.select(IMAGE, F.col("function").alias("member")), [IMAGE, "member"], "left_anti")
            rows = rows.join(now.select(IMAGE, F.col("row").alias("member")), [IMAGE, "member"], "left_anti")
