"""From addresses to source files, lines and snippets.

Tables: line_table(firmware_id, ordinal, address, file, line), root_map(key, roots, seq),
source_files(path, lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.functions.text import empty_strings
from funcrisk.scale import join_per_key

# Addresses that share all but this many low bits are looked up together.
BUCKET_BITS = 12
# Lines of a file that are held together.
BLOCK_LINES = 256


def asof_line(
    samples: DataFrame,
    line_table: DataFrame,
    max_gap: int | None = None,
    bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """file and line of the last line row at or before each sample's address (null if none).

    Both sides are first cut to one row per image and address, so a bucket of 2**bits addresses
    holds at most twice that many rows, however large the image. A row at the start of each
    bucket carries over the last line row of the buckets before it.
    """
    at = ["firmware_id", "address"]
    bucket = F.shiftright(F.col("address"), bucket_bits)
    entry = F.struct(F.col("address").alias("at"), "file", "line")
    lines = (
        line_table.groupBy(*at)
        .agg(F.max_by(F.struct("file", "line"), "ordinal").alias("_l"))
        .select(*at, "_l.file", "_l.line")
        .select(*at, bucket.alias("_bucket"), entry.alias("_entry"), F.lit(1).alias("_side"))
    )
    wanted = (
        samples.select(*at).distinct()
        .select(*at, bucket.alias("_bucket"), F.lit(None).cast(lines.schema["_entry"].dataType).alias("_entry"),
                F.lit(2).alias("_side"))
    )
    both = lines.unionByName(wanted)
    # One row per touched bucket: at most the address space over the bucket width per image.
    before = Window.partitionBy("firmware_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        both.groupBy("firmware_id", "_bucket")
        .agg(F.max_by("_entry", F.when(F.col("_side") == 1, F.col("address"))).alias("_last"))
        .withColumn("_entry", F.last("_last", ignorenulls=True).over(before))
        .filter(F.col("_entry").isNotNull())
        .select("firmware_id", F.shiftleft("_bucket", bucket_bits).alias("address"), "_bucket",
                "_entry", F.lit(0).alias("_side"))
    )
    upto = (
        Window.partitionBy("firmware_id", "_bucket").orderBy("address", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        both.unionByName(carried)
        .withColumn("_found", F.last("_entry", ignorenulls=True).over(upto))
        .filter(F.col("_side") == 2)
        .select(*at, "_found")
    )
    if max_gap is not None:
        near = F.col("address") - F.col("_found.at") <= max_gap
        found = found.withColumn("_found", F.when(near, F.col("_found")))
    return samples.join(found, at, "left").select(
        *[F.col(c) for c in samples.columns], F.col("_found.file").alias("file"), F.col("_found.line").alias("line")
    )


def sample_addresses(functions: DataFrame) -> DataFrame:
    """Entry, middle and end of each function, distinct, with their place in address order."""
    size = F.greatest(F.lit(4), F.col("size"))
    start = F.col("address_int")
    points = F.array(
        start, start + F.floor(size / 2), start + F.greatest(F.lit(0), size - 4)
    ).cast("array<bigint>")
    return functions.select(
        *C.KEY, F.posexplode(F.sort_array(F.array_distinct(points))).alias("sample", "address")
    )


def source_span(functions: DataFrame, line_table: DataFrame, max_gap: int | None = None) -> DataFrame:
    """The functions with source_file, line_start, line_end and has_source_mapping.

    The file is the one most samples fall in, the earliest sampled on ties.
    """
    hits = asof_line(sample_addresses(functions), line_table, max_gap).filter(
        F.col("file").isNotNull() & (F.col("file") != "") & (F.col("line") != 0)
    )
    per_file = hits.groupBy(*C.KEY, "file").agg(
        F.count(F.lit(1)).alias("_n"), F.min("sample").alias("_first"),
        F.min("line").alias("line_start"), F.max("line").alias("line_end"),
    )
    best = per_file.groupBy(*C.KEY).agg(
        F.max_by(F.struct("file", "line_start", "line_end"), F.struct("_n", -F.col("_first"))).alias("_b")
    ).select(*C.KEY, F.col("_b.file").alias("source_file"), "_b.line_start", "_b.line_end")
    return functions.join(best, C.KEY, "left").withColumn(
        "has_source_mapping", F.col("source_file").isNotNull()
    )


def build_root_map(images: DataFrame) -> DataFrame:
    """(key, roots, seq) from images(path, given_path?, root, seq): up to four keys per image.

    A later image overwrites an earlier one's entry for the same key; blank roots are left out.
    """
    root = F.trim(F.coalesce(F.col("root"), F.lit("")))
    name = F.element_at(F.split("path", "/"), -1)
    keys = F.array_distinct(F.array(F.col("path"), name, stem(name), parent_name(F.col("path"))))
    return (
        images.filter(root != "")
        .select(F.explode(keys).alias("key"), F.array(root).alias("roots"), "seq")
        .groupBy("key").agg(F.max_by("roots", "seq").alias("roots"), F.max("seq").alias("seq"))
    )


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def roots_for_images(manifest: DataFrame, root_map: DataFrame) -> DataFrame:
    """Each image's source roots: the entry under its full path, given path, name, stem or folder.

    manifest: firmware_id, path, given_path, name, stem, parent. Null where no key has an entry.
    """
    keys = F.array("path", "given_path", "name", "stem", "parent")
    wanted = manifest.select("firmware_id", F.posexplode(keys).alias("_priority", "key"))
    entries = root_map.filter(F.size("roots") > 0).groupBy("key").agg(F.max_by("roots", "seq").alias("roots"))
    found = (
        wanted.join(entries, "key")
        .groupBy("firmware_id").agg(F.min_by("roots", "_priority").alias("roots"))
    )
    return manifest.join(found, "firmware_id", "left")


def normal_path(path: Column) -> Column:
    """path without empty and "." steps, and with each ".." taken back by the step before it; nothing lies above "/"."""
    absolute = F.startswith(path, F.lit("/"))
    step = lambda done, p: (
        F.when(p.isin("", "."), done)
        .when((p == "..") & (F.size(done) > 0) & ~F.coalesce(F.try_element_at(done, F.lit(-1)) == "..", F.lit(False)),
              F.slice(done, F.lit(1), F.size(done) - 1))
        .when((p == "..") & absolute, done)
        .otherwise(F.concat(done, F.array(p)))
    )
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), empty_strings(), step), "/"))


def source_candidates(source_file: Column, roots: Column) -> Column:
    """Paths at which a recorded source file may lie, best first, in normal form."""
    parts = F.filter(F.split(source_file, "/"), lambda p: ~p.isin("", "."))
    last = F.try_element_at(parts, F.lit(-1))
    two = F.concat_ws("/", F.slice(parts, -2, 2))
    under = lambda root, tail: F.when(
        F.startswith(tail, F.lit("/")), tail
    ).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), tail))
    per_root = F.flatten(
        F.transform(
            F.coalesce(roots, empty_strings()),
            lambda root: F.array(
                under(root, source_file), under(root, last),
                F.when(F.size(parts) >= 2, under(root, two)),
            ),
        )
    )
    known = source_file.isNotNull() & ~source_file.isin("", "?", "??")
    every = F.when(known, F.concat(F.array(source_file), per_root)).otherwise(empty_strings())
    return F.transform(every, normal_path)


def resolve_source(functions: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """The functions with resolved_source_path: the first candidate that exists among files(path).

    Paths meet in normal form; the file's own path is given. Images record the same few files for many functions, so each is resolved once.
    """
    recorded = functions.select("firmware_id", "source_file").filter(F.col("source_file").isNotNull()).distinct()
    with_roots = join_per_key(recorded, roots.select("firmware_id", "roots"), ["firmware_id"], "left")
    candidates = with_roots.select(
        "firmware_id", "source_file",
        F.posexplode(source_candidates(F.col("source_file"), F.col("roots"))).alias("_priority", "_at"),
    ).filter(F.col("_at").isNotNull())
    known = files.groupBy(normal_path(F.col("path")).alias("_at")).agg(F.min("path").alias("path"))
    resolved = (
        candidates.join(known, "_at")
        .groupBy("firmware_id", "source_file")
        .agg(F.min_by("path", "_priority").alias("resolved_source_path"))
    )
    # Functions without a file have a key of their own, so that those of one image stay spread.
    at = F.coalesce("source_file", _lone_key())
    return functions.withColumn("_at", at).join(resolved.withColumnRenamed("source_file", "_at"), ["firmware_id", "_at"], "left").drop("_at")


def _lone_key() -> Column:
    return F.concat(F.lit("\0"), F.xxhash64(*C.KEY).cast("string"))


def line_blocks(source_files: DataFrame) -> DataFrame:
    """(path, size, block, lines): files cut into blocks of BLOCK_LINES lines, numbered from 0; one row with a null block for a file without lines."""
    count = F.ceil(F.size("lines") / BLOCK_LINES).cast("int")
    cut = F.transform(F.sequence(F.lit(1), count), lambda i: F.slice("lines", (i - 1) * BLOCK_LINES + 1, F.lit(BLOCK_LINES)))
    return source_files.select("path", F.when(F.col("lines").isNotNull(), F.size("lines")).alias("size"), "lines").select(
        "path", "size", F.posexplode_outer(F.when(F.col("size") > 0, cut)).alias("block", "lines")
    )


def line_windows(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """asked (path, lo, hi; 1-based, inside the file) with lines: each different window meets its blocks once."""
    first, last = (F.floor((F.col(c) - 1) / BLOCK_LINES).cast("int") for c in ("lo", "hi"))
    parts = asked.distinct().filter("lo <= hi").withColumn("block", F.explode(F.sequence(first, last)))
    met = join_per_key(parts, blocks.filter(F.col("block").isNotNull()).select("path", "block", "lines"), ["path", "block"])
    before = F.col("block") * BLOCK_LINES
    begin, end = F.greatest(F.col("lo"), before + 1), F.least(F.col("hi"), before + BLOCK_LINES)
    piece = F.struct("block", F.slice("lines", begin - before, end - begin + 1).alias("lines"))
    found = met.select("path", "lo", "hi", piece.alias("piece")).groupBy("path", "lo", "hi").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return found.select("path", "lo", "hi", F.flatten("pieces.lines").alias("lines"))


def snippets(functions: DataFrame, source_files: DataFrame, context: int = 8, blocks: DataFrame | None = None) -> DataFrame:
    """The functions with source_snippet, null where no source file is recorded.

    source_files holds one row per file with all its lines. Files are cut into blocks of lines before anything meets
    them: a function first meets its file's length, then its own window of lines, never a whole file. Functions without
    a file get a key of their own, so that they stay spread. blocks are the files' line_blocks, where they are a kept table: lengths
    and lines both come from them, and functions are read twice as well.
    """
    blocks = line_blocks(source_files) if blocks is None else blocks
    start = F.greatest(F.lit(1), F.coalesce(F.col("line_start"), F.lit(1))).cast("int")
    end = F.greatest(start, F.coalesce(F.col("line_end"), F.lit(1))).cast("int")
    lo = F.greatest(F.lit(1), start - context)
    hi = F.least(end + context, F.col("_size"))
    number = lambda i: F.col("_lo") + i
    inside = lambda i: number(i).between(F.col("_start"), F.col("_end"))
    rows = F.transform(
        F.coalesce(F.col("_lines"), F.array().cast("array<string>")),
        lambda text, i: F.struct(
            number(i).alias("number"), text.alias("text"), inside(i).alias("in_function"), inside(i).alias("highlight"),
        ),
    )
    none = F.array().cast("array<struct<number:int,text:string,in_function:boolean,highlight:boolean>>")
    found = F.col("_size").isNotNull()
    snippet = F.struct(
        "source_file",
        F.when(found, F.col("resolved_source_path")).alias("resolved_path"),
        F.col("line_start").alias("line_start"),
        F.col("line_end").alias("line_end"),
        F.col("_start").alias("highlight_start"),
        F.col("_end").alias("highlight_end"),
        F.when(found, rows).otherwise(none).alias("lines"),
        F.when(~found, F.lit("source_file_not_found")).alias("error"),
    )
    whole = F.col("size").isNotNull() & (F.coalesce("block", F.lit(0)) == 0)
    sizes = blocks.filter(whole).select(F.col("path").alias("_at"), F.col("size").alias("_size"))
    at = F.coalesce("resolved_source_path", _lone_key())
    placed = functions.withColumn("_at", at).join(sizes, "_at", "left").withColumns({"_lo": lo, "_hi": hi, "_start": start, "_end": end})
    asked = placed.filter(found).select(F.col("_at").alias("path"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    windows = line_windows(asked, blocks).select(*[F.col(c).alias(f"_{n}") for c, n in (("path", "at"), ("lo", "lo"), ("hi", "hi"), ("lines", "lines"))])
    # A function without a file has no window either; its own key stands in for the null.
    return (
        placed.withColumn("_hi", F.coalesce("_hi", F.lit(0))).join(windows, ["_at", "_lo", "_hi"], "left")
        .withColumn("source_snippet", F.when(F.col("source_file").isNotNull(), snippet))
        .drop("_at", "_lo", "_hi", "_start", "_end", "_size", "_lines")
    )
