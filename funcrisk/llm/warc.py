"""WARC archives: records written as one gzip member each, and a sequential reader that checks what it reads.

An archive is a file in the folder that all executors share. Tasks write it under a name of their own and hand out the
names as rows, so that only files of tasks that ended count: what a lost or repeated task left is read by nobody.
The reader inflates members bit by bit, frames blocks by their Content-Length and holds every digest against the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk.llm.common import keep, shared_folder

SLICE = 1 << 16
#: Bytes of an archive, compressed, after which a new one starts.
ARCHIVE_BYTES = 256 << 20
#: Parts over which the rows of one payload are dealt.
SALTS = 16
VERSION, END = b"WARC/1.1", b"\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, html binary"


class BadRecord(ValueError):
    """Bytes that are no well-formed record, or not those that its digest names."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path of any store that pyarrow knows; a bare path is local."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


# Writing


def header_value(text: str) -> str:
    """text without bytes that would end a header line or split it: they are percent-encoded, as is the sign itself."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def block(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([first, *[f"{k}: {v}" for k, v in fields], "", ""]).encode("utf-8", "surrogatepass")


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> Iterator[bytes]:
    """The bytes of one record, before compression. A revisit holds the response's head alone, which states the length."""
    digest = base32_sha1(hashlib.sha1(payload).digest())
    head = block("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    body = b"" if revisit else payload
    whole = hashlib.sha1(head)
    whole.update(body)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id or ''}>"),
        ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(head) + len(body))),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(whole.digest())}"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", header_value(url)))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to or ''}>"), ("WARC-Profile", REVISIT)]
    yield block(VERSION.decode(), fields)
    yield head
    yield body
    yield END * 2


def member(parts: Iterator[bytes], level: int) -> Iterator[bytes]:
    """One gzip member, without a time stamp, so that equal records have equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    for part in parts:
        yield z.compress(part)
    yield z.flush()


def warc_verdicts(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """pages with their html in UTF-8 as `_payload` and with `_keep`, the page that holds their payload; itself where none else does.

    Payloads of fewer than at_least bytes are held by each page. Texts move once; the rows of one payload are dealt
    over SALTS parts.
    """
    named = pages.withColumn("_payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")).withColumn("_sha", F.unhex(F.sha2("_payload", 256)))
    long = named.filter(F.octet_length("_payload") >= at_least)
    groups = long.groupBy("_sha").agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_sha", "_keep")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    met = salted.join(copies, ["_sha", "_salt"], "left")
    small = F.octet_length("_payload") < at_least
    return met.withColumn("_keep", F.when(small, F.col("page_id")).otherwise(F.coalesce("_keep", "page_id"))).select(
        "page_id", "url", "_payload", "_keep", (~F.col("page_id").eqNullSafe(F.col("_keep"))).alias("_revisit"))


def write_archives(pages: DataFrame, folder: str, at_least: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html); gives (path, records, bytes) of the archives.

    Of equal payloads the rows of the largest page_id are responses, all others revisits that refer to it. Null html is
    an empty payload, a null url is left out, a null page_id comes before all others, rows that repeat a page_id have
    records of the same name. Other columns are left out; without rows there is no archive.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, place = opened(folder)
        store.create_dir(place, recursive=True)
        out, name, records, size = None, "", 0, 0
        done = []
        for batch in batches:
            for page_id, url, payload, kept, revisit in zip(*[batch[c] for c in ("page_id", "url", "_payload", "_keep", "_revisit")]):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{place}/{name}", compression=None)
                for part in member(record(page_id, url, payload, kept, revisit, date), level):
                    out.write(part)
                    size += len(part)
                records += 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", records, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    told = warc_verdicts(pages.select(F.col("page_id").cast("long"), "url", "html"), at_least)
    told = told.withColumns({c: F.col(c).cast("string") for c in ("page_id", "_keep")})
    return told.mapInPandas(write, "path string, records long, bytes long")


# Reading


class Stream:
    """An archive's bytes as members: each is inflated slice by slice, and what follows its end begins the next one."""

    def __init__(self, raw: BinaryIO, size: int = SLICE) -> None:
        self.raw, self.size, self.ahead, self.ready, self.z = raw, size, b"", b"", None

    def begin(self) -> bool:
        """Whether another member follows; the one before must be read to its end."""
        self.ahead = self.ahead or self.raw.read(self.size)
        self.z = zlib.decompressobj(31) if self.ahead else None
        return self.z is not None

    def more(self) -> bool:
        """Inflates at most `size` further bytes of the member; False at its end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.ahead or self.raw.read(self.size)
            if not data:
                raise BadRecord("the archive ends inside a member")
            self.ahead = b""
            try:
                got = self.z.decompress(data, self.size)
            except zlib.error as e:
                raise BadRecord(f"no gzip member: {e}") from e
            if self.z.eof:
                self.ahead = self.z.unused_data
            if got:
                self.ready += got
                return True
        return False

    def line(self) -> bytes:
        """Up to the next line end, which is taken off."""
        while (at := self.ready.find(END)) < 0:
            if not self.more():
                raise BadRecord("a header without its end")
        out, self.ready = self.ready[:at], self.ready[at + 2:]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.ready and not self.more():
                raise BadRecord("a block shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def fields(self) -> dict[str, str]:
        out: dict[str, str] = {}
        while line := self.line():
            name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
            if not colon:
                raise BadRecord(f"a header line without a colon: {line[:80]!r}")
            out[name.strip().lower()] = value.strip()
        return out

    def end(self) -> None:
        """Two line ends close the record and, with it, the member."""
        if b"".join(self.take(4)) != END * 2 or self.ready or self.more():
            raise BadRecord("bytes after the record in its member")
        self.z = None


def whole_number(text: str | None) -> int:
    if not re.fullmatch("[0-9]+", text or "", re.ASCII):
        raise BadRecord(f"no length: {text!r}")
    return int(text)


def page_of(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]*)>", name)
    if m is None:
        raise BadRecord(f"no record of a page: {name!r}")
    return int(m[1]) if m[1] else None


def read_record(s: Stream, payloads: bool) -> tuple:
    """The member's record as a row of RECORD. Only what payloads asks for is held; digests are taken as bytes pass."""
    if s.line() != VERSION:
        raise BadRecord("no WARC/1.1 record")
    f = s.fields()
    left = whole_number(f.get("content-length"))
    whole, body, head, kept = hashlib.sha1(), hashlib.sha1(), b"", []
    inside, length = False, 0
    for piece in s.take(left):
        whole.update(piece)
        if not inside:
            head += piece
            at = head.find(END * 2)
            if at < 0:
                continue
            inside, piece, head = True, head[at + 4:], head[:at]
        body.update(piece)
        length += len(piece)
        if payloads:
            kept.append(piece)
    s.end()
    if not inside:
        raise BadRecord("a block without its HTTP head")
    stated = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    size, digest, kind = whole_number(stated.get("content-length")), f.get("warc-payload-digest", ""), f.get("warc-type", "")
    if f.get("warc-block-digest") != f"sha1:{base32_sha1(whole.digest())}":
        raise BadRecord(f"{f.get('warc-record-id')}: not the block of its digest")
    if kind == "response" and (size != length or digest != f"sha1:{base32_sha1(body.digest())}"):
        raise BadRecord(f"{f.get('warc-record-id')}: not the payload of its digest")
    if kind == "revisit" and (length or f.get("warc-profile") != REVISIT) or kind not in ("response", "revisit"):
        raise BadRecord(f"{f.get('warc-record-id')}: a record of kind {kind!r}")
    return (page_of(f.get("warc-record-id", "")), kind, page_of(f["warc-refers-to"]) if kind == "revisit" and "warc-refers-to" in f else None, size,
            digest.removeprefix("sha1:"), b"".join(kept) if payloads and kind == "response" else None)


def records_of(raw: BinaryIO, payloads: bool = True, size: int = SLICE) -> Iterator[tuple]:
    """All records of one archive, in order."""
    s = Stream(raw, size)
    while s.begin():
        yield read_record(s, payloads)


def rows_in(records: Iterator[tuple], rows: int = 4096, held: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Frames of at most so many rows, or so many bytes of payload and one more."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def frame(data: list[tuple]) -> pd.DataFrame:
        whole = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"}
        return pd.DataFrame({k: pd.array(v, whole[k]) if k in whole else list(v) for k, v in zip(names, zip(*data))})

    data, total = [], 0
    for r in records:
        data.append(r)
        total += len(r[-1] or b"")
        if len(data) >= rows or total >= held:
            yield frame(data)
            data, total = [], 0
    if data:
        yield frame(data)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in the column path, a row each; an archive is one task's stream.

    A record that is cut off, framed wrongly or not what its digests say raises BadRecord: none is passed over. With
    payloads=False html is null, and no more than a slice of a record is held.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, place = opened(path)
                with store.open_input_stream(place, compression=None) as raw:
                    yield from rows_in(records_of(raw, payloads))

    return archives.select("path").repartition("path").mapInPandas(read, RECORD)


def unmet_revisits(records: DataFrame) -> DataFrame:
    """Revisits that refer to no response of their digest and length; none, if the archives are whole."""
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    return records.filter("record_type = 'revisit'").join(held, ["refers_to", "payload_bytes", "payload_digest"], "left_anti")


def archived_pages(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """All pages written to archives in the shared folder and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = keep(write_archives(pages, folder, at_least), "archives")
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
