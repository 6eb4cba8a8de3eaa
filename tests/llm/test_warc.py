"""WARC archives: written, normalised and read back."""

import base64
import gzip
import hashlib

import pytest

from feedlake.llm import warc
from feedlake.llm.files import read_random, read_stream
from feedlake.session import run_folder

DDL = "page_id long, url string, html string, digest string, last long"


def pages():
    out = [(k, f"http://h.example/{k}?a b", f"<p>{k}</p>\r\n\r\nWARC/1.1\r\n" * (k % 4)) for k in range(40)]
    out += [(100 + k, "https://x.example/é", "same é") for k in range(30)]
    out += [(200, None, None), (201, "u\r\nWARC-Type: x", ""), (None, "http://n/", "only"), (None, "http://n/", "same é"), (202, "http://r/", "twice"), (202, "http://r/", "twice"),
            (203, "http://big/", "long ✓ " * 300_000)]
    return out


def expected(rows):
    last = {}
    for i, _, html in rows:
        last[html or ""] = max((v for v in (last.get(html or ""), i) if v is not None), default=None)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = i == last[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else last[html or ""]))
    return sorted(out, key=repr)


def test_pages_come_back(spark):
    rows = pages()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)
    found = warc.read(warc.archive(table)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == expected(rows)
    assert {r.page_id: r.url for r in found}[100] == "https://x.example/é"


def test_files_are_single_streams_then_members(spark, monkeypatch):
    folder = run_folder(spark, "warc-test")
    table = spark.createDataFrame([(*r, "x", 1) for r in pages()], DDL)
    first = warc.write(table, f"{folder}/one").collect()
    for r in first:
        with read_stream(r.archive) as s:
            data = s.read()
        assert data.count(b"\x1f\x8b\x08") >= 1 and len(list(warc.Reader(iter([gzip.decompress(data)])))) == r.records
    for r in warc.normalise(spark.createDataFrame(first), f"{folder}/two").collect():
        with read_random(r.archive) as file, read_stream(r["index"]) as index:
            lines = index.read().decode().splitlines()
            assert len(lines) == r.records
            place = 0
            for line in lines:
                offset, length, _, name = line.split("\t")
                assert int(offset) == place
                record = gzip.decompress(file.read_at(int(length), place))
                assert record.startswith(b"WARC/1.1\r\n") and name.encode() in record and record.endswith(b"\r\n\r\n")
                place += int(length)
            assert place == file.size()


def test_broken_archives_are_reported():
    with pytest.raises(ValueError):
        list(warc.Reader(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


def test_empty_table(spark):
    assert warc.read(warc.archive(spark.createDataFrame([], DDL))).count() == 0
