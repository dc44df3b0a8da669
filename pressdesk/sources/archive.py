"""Article pages kept in record archives, as a data source: ``spark.read.format("page_archive")``.

An archive is a folder of WARC files, plain or with every record gzipped on its own. The planner
only lists them and cuts large ones into byte ranges; the task that gets a range looks up where the
first record in it begins. Our writer keeps such places beside each file (``.offsets``, one about
every ``STRIDE`` bytes), so a cut never depends on guessing from the bytes of a page. A file without
them is read by one task.

Filters on ``url`` (equality, lists, prefixes) are taken over: the body of a record that they rule
out is passed over, and never decoded.

Defined cases: records other than ``resource`` and ``response`` are no pages; of a response the
HTTP head is cut off; bad bytes are replaced; an empty folder has no pages. A file that breaks off
within its last record, as after a crash of its writer, has the records before it; a record head
that can't be read elsewhere is an error that names file and place.
"""

from __future__ import annotations

import gzip
import os
import posixpath
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

FORMAT = "page_archive"
SCHEMA = "url string, html string"
OFFSETS = ".offsets"
STRIDE = 1 << 20
SPLIT = 64 << 20
FILE = 1 << 30
ROWS = 256
BATCH = 4 << 20
VERSION = b"WARC/1."
END = b"\r\n\r\n"
PAGES = (b"resource", b"response")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; a path without a scheme is a local one."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    """Records of one file that begin in ``[start, stop)``; ``marked`` if places are known."""

    path: str
    start: int
    stop: int
    marked: bool

    def __post_init__(self):
        super().__init__(0)


class Torn(Exception):
    """The file ends within a record."""


class _Plain:
    """Records of an uncompressed file, from a place on."""

    def __init__(self, file, at: int):
        self.file, self.at, self.size = file, at, file.size()

    def head(self) -> bytes:
        """The record's head with its last line break; empty at the end of the file."""
        self.file.seek(self.at)
        data = b""
        while (end := data.find(END)) < 0:
            more = self.file.read(4096)
            if not more:
                if data:
                    raise Torn
                return b""
            data += more
            if not VERSION.startswith(data[: len(VERSION)]) and not data.startswith(VERSION):
                raise ValueError(f"no record begins at byte {self.at}")
        self.body_at = self.at + end + len(END)
        return data[: end + 2]

    def body(self, length: int) -> bytes:
        self.file.seek(self.body_at)
        return self.file.read(length)

    def skip(self, length: int) -> None:
        if self.body_at + length > self.size:
            raise Torn
        self.at = self.body_at + length + len(END)


class _Gzipped:
    """Records of a file in which each is a gzip member."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at

    def head(self) -> bytes:
        self.file.seek(self.at)
        member, out, taken = zlib.decompressobj(31), [], 0
        while not member.eof:
            data = self.file.read(1 << 16)
            if not data:
                if taken:
                    raise Torn
                return b""
            try:
                out.append(member.decompress(data))
            except zlib.error as error:
                raise ValueError(f"no record begins at byte {self.at}") from error
            taken += len(data)
        self.record, self.taken = b"".join(out), taken - len(member.unused_data)
        end = self.record.find(END)
        if end < 0 or not self.record.startswith(VERSION):
            raise ValueError(f"no record begins at byte {self.at}")
        self.body_at = end + len(END)
        return self.record[: end + 2]

    def body(self, length: int) -> bytes:
        return self.record[self.body_at : self.body_at + length]

    def skip(self, length: int) -> None:
        self.at += self.taken


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(b":") for line in lines) if colon}


def _page(kind: bytes, body: bytes) -> str:
    if kind == b"response":
        body = body.partition(END)[2]
    return body.decode("utf-8", "replace")


def records(file, at: int, stop: int, gzipped: bool, wanted=lambda url: True) -> Iterator[tuple[str, str]]:
    """URL and page of the wanted records that begin before ``stop``."""
    reader = (_Gzipped if gzipped else _Plain)(file, at)
    try:
        while reader.at < stop and (head := reader.head()):
            fields = _fields(head)
            length, kind = int(fields[b"content-length"]), fields.get(b"warc-type")
            url = fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")
            found = kind in PAGES and wanted(url)
            body = reader.body(length) if found else b""
            reader.skip(length)
            if found:
                yield url, _page(kind, body)
    except Torn:
        return
    except (KeyError, ValueError) as error:
        raise ValueError(f"a record of the archive can't be read at byte {reader.at}: {error}") from error


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for condition in filters:
            if isinstance(condition, (EqualTo, In, StringStartsWith)) and condition.attribute == ("url",):
                self.filters.append(condition)
            else:
                yield condition

    def wanted(self):
        """The filters as one test of a URL; lists become sets once."""
        tests = []
        for condition in self.filters:
            if isinstance(condition, StringStartsWith):
                tests.append(lambda url, start=condition.value: url.startswith(start))
            else:
                values = condition.value if isinstance(condition, In) else (condition.value,)
                tests.append(lambda url, some=frozenset(values): url in some)
        return lambda url: all(test(url) for test in tests)

    def partitions(self) -> list[Range]:
        system, path = _located(self.path)
        listed = system.get_file_info(fs.FileSelector(path, allow_not_found=False))
        sizes = {i.path: i.size for i in listed if i.type == fs.FileType.File}
        out = []
        for file, size in sorted(sizes.items()):
            if not file.endswith((".warc", ".warc.gz")) or posixpath.basename(file).startswith(("_", ".")):
                continue
            marked = file + OFFSETS in sizes
            step = self.split if marked else max(size, 1)
            out += [Range(file, at, min(at + step, size), marked) for at in range(0, size, step)]
        return out or [Range("", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        system, _ = _located(self.path)
        start, stop = partition.start, partition.stop
        if partition.marked:
            with system.open_input_stream(partition.path + OFFSETS, compression=None) as file:
                marks = [int(line) for line in file.read().split()]
            start = next((m for m in marks if m >= start), partition.stop)
            # A range whose only record began before it holds none.
            stop = next((m for m in marks if m >= stop), sys.maxsize if start < partition.stop else start)
        if start >= partition.stop:
            return
        rows, size = [], 0
        with system.open_input_file(partition.path) as file:
            try:
                for row in records(file, start, stop, partition.path.endswith(".gz"), self.wanted()):
                    rows.append(row)
                    size += len(row[1])
                    if len(rows) >= ROWS or size >= BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
            except ValueError as error:
                raise ValueError(f"{partition.path}: {error}") from error
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    urls, pages = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(pages, pa.string())], ["url", "html"])


def record(url: str, html: str) -> bytes:
    """A page as a record."""
    body = html.encode("utf-8", "replace")
    named = " ".join(url.split())
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
        f"WARC-Target-URI: {named}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + END


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceWriter):
    """Tasks write under hidden names; the files of the tasks that count are renamed at the commit."""

    def __init__(self, path: str, gzipped: bool, overwrite: bool):
        self.path, self.gzipped, self.overwrite = path, gzipped, overwrite
        self.suffix = ".warc.gz" if gzipped else ".warc"

    def write(self, iterator) -> Written:
        system, path = _located(self.path)
        system.create_dir(path, recursive=True)
        rows, files = iter(iterator), []
        row = next(rows, None)
        while row is not None:
            name = f"_{uuid.uuid4().hex}{self.suffix}"
            at, marks = 0, [0]
            with system.open_output_stream(posixpath.join(path, name), compression=None) as file:
                while row is not None and at < FILE:
                    data = record(row.url or "", row.html or "")
                    if self.gzipped:
                        data = gzip.compress(data, 6)
                    if at - marks[-1] >= STRIDE:
                        marks.append(at)
                    file.write(data)
                    at += len(data)
                    row = next(rows, None)
            with system.open_output_stream(posixpath.join(path, name + OFFSETS), compression=None) as file:
                file.write("".join(f"{m}\n" for m in marks).encode())
            files.append(name)
        return Written(files)

    def commit(self, messages) -> None:
        system, path = _located(self.path)
        system.create_dir(path, recursive=True)
        old = system.get_file_info(fs.FileSelector(path)) if self.overwrite else []
        for info in old:
            if not posixpath.basename(info.path).startswith("_") and info.type == fs.FileType.File:
                system.delete_file(info.path)
        for name in (name for m in messages if m is not None for name in m.files):
            for end in (OFFSETS, ""):  # the places first: a file is never seen without them
                system.move(posixpath.join(path, name + end), posixpath.join(path, name[1:] + end))

    def abort(self, messages) -> None:
        system, path = _located(self.path)
        for name in (name for m in messages if m is not None for name in m.files):
            for end in ("", OFFSETS):
                system.delete_file(posixpath.join(path, name + end))


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options.get("compression") == "gzip", overwrite)


# Workers get this module's code with the source, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it hand filters to such sources."""
    spark.dataSource.register(PageArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan_page_archive(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Article pages ``(url, html)`` of an archive folder."""
    register(spark)
    return spark.read.format(FORMAT).option("split", str(split)).load(path)


def write_page_archive(pages: DataFrame, path: str, compression: str = "none", mode: str = "append") -> str:
    """Pages as an archive; URLs in a row are kept on one line, null reads as empty."""
    register(pages.sparkSession)
    rows = pages.select("url", "html").write.format(FORMAT).option("compression", compression)
    rows.mode(mode).save(path)
    return path
