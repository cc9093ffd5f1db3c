"""Archives: what is read back against what was written, with the magic line inside payloads."""

import base64
import hashlib
import itertools

import pytest

from acuity.llm import warc as W

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [(1, "http://a", "x"), (2, None, None), (3, "u", ""), (4, "u y\r\nz", f"<p>{FAKE}</p>"), (5, "é", "WARC/1.0\r\n"), (6, "é", "x"),
         (7, "é", f"é😀\r\n\r\n{FAKE}{FAKE}é"), (9, "z", FAKE), (8, "z", FAKE), (10, "q", "x"),
         (11, "q", "\r\n\r\nWARC/1.0\r\n\r\nWARC/1.0\r\n"), (None, "n", "nn"), (12, "n", "nn"), (14, "r", "same"), (14, "r", "same")] + [
    (100 + i, f"http://h/{i}", "y" * i + ("WARC/1.0\r\nContent-Length: 7\r\n\r\n" if i % 7 == 0 else "")) for i in range(60)]


def wanted(rows, least=0):
    ids = {}
    for page, _, text in rows:
        ids.setdefault(text or "", []).append(page)
    out = []
    for page, _, text in rows:
        raw = (text or "").encode()
        known = [x for x in ids[text or ""] if x is not None]
        first = min(known) if known and len(raw) >= least else page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("split,least", [("128m", 0), ("3k", 0), ("128m", 3)])
def test_round_trip(spark, tmp_path, split, least):
    pages = spark.createDataFrame([(*r, "extra") for r in PAGES], "page_id long, url string, html string, value string").repartition(2)
    W.write_archive(pages, f"{tmp_path}/w", least)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = [tuple(r) for r in W.read_archive(spark, f"{tmp_path}/w").select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == wanted(PAGES, least)


def test_files_are_chains_of_records(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    W.write_archive(pages, f"{tmp_path}/w")
    n = 0
    for part in tmp_path.glob("w/part-*"):
        raw, at = part.read_bytes(), 0
        while at < len(raw):
            head = raw[at:raw.index(b"\r\n\r\n", at)].decode()
            assert head.startswith("WARC/1.0\r\n")
            fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
            start = at + len(head.encode()) + 4
            at = start + int(fields["Content-Length"])
            assert raw[at:at + 4] == b"\r\n\r\n"
            at += 4
            n += 1
    assert n == len(PAGES)


def test_pointer_jumping(spark):
    chain = [("a", i * 10, i * 10 + 10) for i in range(33)] + [("a", 15, 25), ("a", 25, 40), ("b", 5, 10), ("c", 0, None)]
    got = W.reachable(spark.createDataFrame(chain, "file string, place long, successor long")).collect()
    assert sorted(tuple(r) for r in got) == sorted([*itertools.product("a", range(0, 330, 10)), ("c", 0)])


def test_no_pages(spark, tmp_path):
    W.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert W.read_archive(spark, f"{tmp_path}/w").collect() == []
