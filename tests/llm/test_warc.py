"""Archives against a plain version, the gzip library, and bytes that are wrong on purpose."""

import base64
import gzip
import hashlib
import io
import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from funcrisk.llm import common, warc

HTML = "<html>\r\n\r\n<p>Größe 漢字 🙂 \x00 WARC/1.1\r\n\r\n</p></html>"
PAGES = [
    (1, "http://a.example/1", HTML), (2, None, HTML), (3, "http://x.example/\r\nWARC-Type: fake\r\n\r\n %", HTML), (4, "u", None), (5, "u", ""),
    (6, "", "x" * 200_000), (6, "", "x" * 200_000), (7, "http://ä.example/", "x"), (None, "u", "null id"), (None, "u", HTML), (-8, "u", HTML + " "),
    (9_007_199_254_740_993, "big", "only"), (8, "u", "x"),
]


def frame(spark, rows=PAGES):
    """Pages with columns whose names clash with those that the operator adds."""
    return spark.createDataFrame([(i, u, h, b"k", "s", 1) for i, u, h in rows], "page_id long, url string, html string, _payload binary, _sha string, _keep int")


def plain(rows, at_least=0):
    keep = {}
    for i, _, h in rows:
        keep[h or ""] = max((x for x in (keep.get(h or ""), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        k = keep[h or ""] if len(raw) >= at_least else i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == k else "revisit", None if i == k else k))
    return Counter(out)


@pytest.mark.parametrize("at_least", [0, 2])
def test_pages_come_back(spark, at_least):
    got = warc.archived_pages(frame(spark).repartition(4), at_least)
    assert Counter(map(tuple, got.collect())) == plain(PAGES, at_least)


def test_no_pages(spark):
    assert warc.archived_pages(frame(spark).limit(0)).collect() == []


def archives_of(spark, df, **more):
    folder = f"{common.shared_folder(spark)}/test-warc-{uuid.uuid4().hex}"
    return common.keep(warc.write_archives(df, folder, **more), "test-archives")


def raw_of(path):
    with open(path.removeprefix("file://"), "rb") as f:
        return f.read()


def test_small_archives_hold_payloads_that_any_gzip_reads(spark):
    archives = archives_of(spark, frame(spark).coalesce(1), archive_bytes=600)
    rows = archives.collect()
    assert len(rows) > 2 and sum(r["records"] for r in rows) == len(PAGES)
    got = warc.read_archives(archives)
    want = {h or "" for _, _, h in PAGES}
    assert {bytes(r["html"]).decode() for r in got.filter("record_type = 'response'").collect()} == want
    assert got.filter("record_type = 'revisit' and html is not null").count() == 0 and warc.unmet_revisits(got).count() == 0
    for r in rows:
        raw = raw_of(r["path"])
        assert len(raw) == r["bytes"] and gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: r") == r["records"]
    assert all("\r" not in x and "\n" not in x for x in [warc.header_value(PAGES[2][1])])
    lost = got.filter("not (record_type = 'response' and page_id = 3)")
    assert {r["page_id"] for r in warc.unmet_revisits(lost).collect()} == {1, 2, None}


def one(page_id, payload, **more):
    return b"".join(warc.member(warc.record(page_id, "u", payload, more.get("refers_to"), "refers_to" in more, "2020-01-01T00:00:00Z"), 6))


def test_slices_of_any_size_give_the_same_records():
    raw = one("1", b"") + one("2", HTML.encode() * 50) + one("3", b"", refers_to="2") + one("4", os.urandom(5000))
    want = list(warc.records_of(io.BytesIO(raw)))
    assert [r[:3] for r in want] == [(1, "response", None), (2, "response", None), (3, "revisit", 2), (4, "response", None)]
    for size in (1, 2, 3, 7, 18, 100, 4096):
        assert list(warc.records_of(io.BytesIO(raw), size=size)) == want


def again(raw, change):
    return gzip.compress(change(gzip.decompress(raw)))


@pytest.mark.parametrize("change", [
    lambda b: b.replace(b"payload here", b"payload hers"), lambda b: b.replace(b"WARC/1.1", b"WARC/9.9"), lambda b: b[:-1], lambda b: b + b"more",
    lambda b: b.replace(b"Content-Length: 12", b"Content-Length: 11"), lambda b: b.replace(b"sha1:", b"sha1:A"), lambda b: b.replace(b"urn:page", b"urn:else"),
    lambda b: b.replace(b"WARC-Type: response", b"WARC-Type: revisit"), lambda b: b.replace(b"WARC-Type: r", b"WARC-Type r"),
])
def test_wrong_bytes_raise(change):
    good = one("1", b"payload here")
    assert len(list(warc.records_of(io.BytesIO(good)))) == 1
    with pytest.raises(warc.BadRecord):
        list(warc.records_of(io.BytesIO(one("0", b"") + again(good, change))))


def test_cut_archives_raise(spark):
    good = one("1", b"payload here" * 100)
    for n in (1, 9, 40, len(good) - 9, len(good) - 1):
        with pytest.raises(warc.BadRecord):
            list(warc.records_of(io.BytesIO(good + good[:n])))
    with pytest.raises(warc.BadRecord):
        list(warc.records_of(io.BytesIO(good + b"junk after the last member")))
    path = archives_of(spark, frame(spark).coalesce(1)).first()["path"]
    with open(path.removeprefix("file://"), "r+b") as f:
        f.truncate(200)
    with pytest.raises(Exception, match="BadRecord"):
        warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()
    assert list(warc.records_of(io.BytesIO(b""))) == []


def test_the_rows_of_one_payload_are_dealt_over_parts(spark):
    """A third of all pages with one payload: no part of the join holds them all."""
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("html"))
    got = warc.archived_pages(df)
    assert got.filter("record_type = 'revisit' and refers_to = 2997").count() == 999 and got.count() == 3000
