"""Pages in record archives: round trips, splits, filters that skip records, torn and foreign files."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from pressdesk.operators.contacts import extract_contacts
from pressdesk.sources import archive as A
from pressdesk.sources import derived as D

ROWS = [
    ("https://a/1", "<p>one</p>"), ("https://a/2", ""), ("https://b/3", "日本\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\n\r\n"),
    ("https://b/4", "x" * 3_000), ("https://b/5", "\r\n\r\n"), ("https://a/1", "again"), ("", "no address"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "url string, html string").coalesce(1)


def read(spark, path, **options):
    return sorted(map(tuple, A.scan_page_archive(spark, path, **options).collect()))


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("split", [250, 1 << 20])
def test_round_trip_at_any_split(spark, tmp_path, monkeypatch, compression, split):
    path = A.write_page_archive(pages(spark), str(tmp_path / "a"), compression)
    for name in os.listdir(path):
        if name.endswith(A.OFFSETS):
            file = str(tmp_path / "a" / name.removesuffix(A.OFFSETS))
            (tmp_path / "a" / name).write_text("\n".join(map(str, places(file))))
    assert read(spark, path, split=split) == sorted(ROWS)


def places(file):
    """Where each record of a file begins."""
    gzipped = file.endswith(".gz")
    with A.fs.LocalFileSystem().open_input_file(file) as f:
        reader, out = (A._Gzipped if gzipped else A._Plain)(f, 0), []
        while head := reader.head():
            out.append(reader.at)
            reader.skip(int(A._fields(head)[b"content-length"]))
    return out


def test_writer_marks_places(spark, tmp_path, monkeypatch):
    rows = [(f"https://a/{i}", "y" * 100_000) for i in range(60)]
    path = A.write_page_archive(pages(spark, rows), str(tmp_path / "a"))
    marks = next(n for n in os.listdir(path) if n.endswith(A.OFFSETS))
    found = [int(x) for x in (tmp_path / "a" / marks).read_text().split()]
    assert len(found) > 4 and set(found) <= set(places(str(tmp_path / "a" / marks.removesuffix(A.OFFSETS))))
    scan = A.scan_page_archive(spark, path, split=1_500_000)
    assert scan.rdd.getNumPartitions() >= 4 and read(spark, path, split=1_500_000) == sorted(rows)


def test_appends_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "a")
    A.write_page_archive(pages(spark), path)
    A.write_page_archive(pages(spark), path)
    assert read(spark, path) == sorted(ROWS * 2)
    A.write_page_archive(pages(spark, ROWS[:2]), path, mode="overwrite")
    assert read(spark, path) == sorted(ROWS[:2])
    A.write_page_archive(pages(spark).filter("false"), path, mode="overwrite")
    assert read(spark, path) == []


def test_filters_skip_records(spark, tmp_path):
    """Bodies of records that a filter rules out are not read: here they can't even be decoded."""
    path = A.write_page_archive(pages(spark), str(tmp_path / "a"))
    scan = A.scan_page_archive(spark, path)
    plans = {
        "equal": (scan.filter("url = 'https://a/1'"), {"https://a/1"}),
        "list": (scan.filter("url IN ('https://a/2', 'https://b/5', 'none')"), {"https://a/2", "https://b/5"}),
        "prefix": (scan.filter("url LIKE 'https://b/%'"), {"https://b/3", "https://b/4", "https://b/5"}),
        "both": (scan.filter("url LIKE 'https://b/%' AND length(html) > 10"), {"https://b/3", "https://b/4"}),
    }
    for name, (rows, urls) in plans.items():
        assert {r.url for r in rows.collect()} == urls, name
    text = plans["equal"][0]._jdf.queryExecution().toString()
    assert "Filter (url" not in text.split("Physical Plan")[1].replace("isnotnull(url", "")
    reader = A.ArchiveReader(path, 1 << 20)
    assert list(reader.pushFilters([A.EqualTo(("url",), "https://a/2")])) == []
    bodies = []
    read_body = A._Plain.body
    try:
        A._Plain.body = lambda self, n: bodies.append(n) or read_body(self, n)
        got = [b.to_pylist() for part in reader.partitions() for b in reader.read(part)]
    finally:
        A._Plain.body = read_body
    assert got == [[{"url": "https://a/2", "html": ""}]] and bodies == [0]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_torn_last_record(spark, tmp_path, compression):
    path = A.write_page_archive(pages(spark, ROWS[:4]), str(tmp_path / "a"), compression)
    file = next(str(tmp_path / "a" / n) for n in os.listdir(path) if not n.endswith(A.OFFSETS) and n[0] not in "._")
    data, last = open(file, "rb").read(), places(file)[-1]
    for end in (last + 5, last + 60, len(data) - 30):
        os.truncate(file, 0)
        open(file, "wb").write(data[:end])
        assert read(spark, path) == sorted(ROWS[:3])
    open(file, "wb").write(data[:last] + b"garbage" * 999)
    with pytest.raises(Exception, match="can't be read at byte"):
        read(spark, path)


def test_foreign_files(spark, tmp_path):
    """Other record kinds, HTTP heads, fields in any case, and no places beside the file."""
    def rec(kind, url, body):
        return f"WARC/1.1\r\nwarc-type: {kind}\r\nwarc-target-uri: {url}\r\ncontent-length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    parts = [rec("warcinfo", "", b"software: x"), rec("request", "https://a/1", b"GET / HTTP/1.1\r\n\r\n"),
             rec("response", "https://a/1", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\xff</p>"), rec("resource", "https://a/2", b"plain")]
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    (tmp_path / "y.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "notes.txt").write_text("no archive")
    assert read(spark, str(tmp_path), split=1 << 10) == sorted([("https://a/1", "<p>�</p>"), ("https://a/2", "plain")] * 2)


def test_null_url_and_page(spark, tmp_path):
    path = A.write_page_archive(pages(spark, [(None, None), ("a\r\nb", "x")]), str(tmp_path / "a"))
    assert read(spark, path) == [("", ""), ("a b", "x")]


def test_extraction_reads_only_the_asked_record(spark, sf_dir, tmp_path):
    landed = D.press_articles(spark, sf_dir).drop("k")
    path = A.write_page_archive(landed, str(tmp_path / "a"))
    url = landed.first().url
    got = extract_contacts(A.scan_page_archive(spark, path)).filter(F.col("url") == url)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in extract_contacts(landed.filter(F.col("url") == url)).collect()]
