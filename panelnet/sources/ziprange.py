"""Delimited members of a remote ZIP archive, read by byte ranges: a data source with pushed filters.

One request for the archive's tail tells its size and, mostly, its whole directory; each wanted member is then one ranged response, decompressed as it
arrives and taken up where it stopped if the connection breaks. Nothing else is fetched and nothing is kept. The archive may be on a server that
answers range requests, or any file. One member is one partition: its compressed stream has no inner starting points.

    register(spark)
    spark.read.format("zip_range").option("urls", "https://a/x.zip https://b/x.zip").option("member", "Y48112027") \\
        .schema("year string, level string, value string").load()
"""

from __future__ import annotations

import codecs
import csv
import os
import struct
import urllib.request
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains

CHUNK = 1 << 18
#: The end record and the longest comment behind it.
TAIL = 22 + 65535
#: Broken responses in a row that brought nothing.
FRUITLESS = 3
#: Fixed values of the format: signatures of the end record, its 64-bit locator and record, a directory entry and a member.
END, LOCATOR, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED = 0, 8


class Remote:
    """Bytes at a place: ``size`` and the tail are known after the first request; ``fetched`` counts what came."""

    def __init__(self, url: str):
        self.url, self.fetched = url, 0
        with self._opened(f"-{TAIL}") as answer:
            self.size = self._size(answer)
            self.tail = answer.read()
        self.fetched += len(self.tail)

    def _opened(self, span: str) -> BinaryIO:
        return urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": f"bytes={span}"}), timeout=120)

    def _size(self, answer) -> int:
        told = answer.headers.get("Content-Range")
        if answer.status != 206 or not told:
            raise OSError(f"{self.url} does not serve byte ranges")
        return int(told.rpartition("/")[2])

    def stream(self, lo: int, hi: int) -> Iterator[bytes]:
        """The bytes from lo up to hi, in one response as long as it holds; a further one begins where the last one broke off."""
        failed = 0
        while lo < hi:
            began = lo
            try:
                with self._opened(f"{lo}-{hi - 1}") as answer:
                    while lo < hi and (data := answer.read(min(CHUNK, hi - lo))):
                        lo += len(data)
                        self.fetched += len(data)
                        yield data
            except OSError:
                if failed == FRUITLESS:
                    raise
            failed = 0 if lo > began else failed + 1
            if failed > FRUITLESS:
                raise OSError(f"{self.url} gives nothing from byte {lo} on")

    def part(self, lo: int, hi: int) -> bytes:
        if lo >= self.size - len(self.tail):
            at = lo - self.size + len(self.tail)
            return self.tail[at : at + hi - lo]
        return b"".join(self.stream(lo, hi))


class LocalFile(Remote):
    """The same for a file."""

    def _opened(self, span: str) -> BinaryIO:
        file = open(self.url, "rb")  # noqa: SIM115
        lo = span.partition("-")[0]
        file.seek(int(lo) if lo else max(0, os.path.getsize(self.url) - TAIL))
        return file

    def _size(self, answer) -> int:
        return os.path.getsize(self.url)


@dataclass(frozen=True)
class Entry:
    """A member of an archive: its name, where its header lies, and its compressed bytes."""

    name: str
    method: int
    size: int
    offset: int


class Archive:
    """The directory of an archive, and its members as streams of bytes."""

    def __init__(self, remote: Remote):
        self.remote = remote
        at = remote.tail.rfind(END)
        if at < 0:
            raise OSError(f"{remote.url} is no archive")
        size, offset = struct.unpack_from("<2I", remote.tail, at + 12)
        if 0xFFFFFFFF in (size, offset) and remote.tail[at - 20 : at - 16] == LOCATOR:
            where = struct.unpack_from("<Q", remote.tail, at - 12)[0]
            record = remote.part(where, where + 56)
            if record[:4] != END64:
                raise OSError(f"{remote.url} has no 64-bit end record where it says")
            size, offset = struct.unpack_from("<2Q", record, 40)
        self.entries = list(self._read(remote.part(offset, offset + size)))

    @staticmethod
    def _read(directory: bytes) -> Iterator[Entry]:
        at = 0
        while directory[at : at + 4] == ENTRY:
            flags, method = struct.unpack_from("<2H", directory, at + 8)
            size, whole, n_name, n_extra, n_comment = struct.unpack_from("<2I3H", directory, at + 20)
            offset = struct.unpack_from("<I", directory, at + 42)[0]
            begin = at + 46
            name = directory[begin : begin + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            at = begin + n_name + n_extra + n_comment
            extra = directory[begin + n_name : begin + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                if kind == 1:  # 64-bit values of those fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    full = [next(wide) if x == 0xFFFFFFFF else x for x in (whole, size, offset)]
                    _, size, offset = full
                extra = extra[4 + n :]
            yield Entry(name, method, size, offset)

    def namelist(self) -> list[str]:
        return [e.name for e in self.entries]

    def content(self, name: str) -> Iterator[bytes]:
        """A member's bytes, decompressed as they arrive."""
        entry = next(e for e in self.entries if e.name == name)
        if entry.method not in (STORED, DEFLATED):
            raise OSError(f"{name} is compressed by method {entry.method}")
        head = self.remote.part(entry.offset, entry.offset + 30)
        if head[:4] != LOCAL:
            raise OSError(f"{name} does not lie where the directory says")
        begin = entry.offset + 30 + sum(struct.unpack_from("<2H", head, 26))
        inflate = zlib.decompressobj(-zlib.MAX_WBITS) if entry.method == DEFLATED else None
        for data in self.remote.stream(begin, begin + entry.size):
            yield inflate.decompress(data) if inflate else data
        if inflate:
            yield inflate.flush()

    def lines(self, name: str) -> Iterator[str]:
        """A member's lines with their ends, by line feeds; a byte order mark goes."""
        decoder, rest = codecs.getincrementaldecoder("utf-8-sig")(), ""
        for data in self.content(name):
            *whole, rest = (rest + decoder.decode(data)).split("\n")
            yield from (line + "\n" for line in whole)
        if rest := rest + decoder.decode(b"", True):
            yield rest


def open_ranges(url: str) -> Remote:
    return Remote(url) if url.startswith(("http://", "https://")) else LocalFile(url.removeprefix("file://"))


def open_archive(urls: Sequence[str]) -> tuple[Remote, Archive]:
    """The first of the mirrors that opens as an archive."""
    failed = []
    for url in urls:
        try:
            remote = open_ranges(url)
            return remote, Archive(remote)
        except (OSError, struct.error) as e:
            failed.append(f"{url}: {e}")
    raise OSError("no mirror works: " + "; ".join(failed))


def member_names(archive: Archive, codes: Sequence[str]) -> dict[str, str]:
    """For each code the first CSV member whose name contains it."""
    names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
    found = {code: next((n for n in names if code in n), None) for code in codes}
    lost = [c for c, n in found.items() if n is None]
    if lost:
        raise FileNotFoundError(f"no CSV member for {lost}; there are {names[:5]}")
    return found


class _Member(InputPartition):
    def __init__(self, url_list: tuple[str, ...], code: str, name: str):
        self.urls, self.code, self.name = url_list, code, name


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.urls = schema, tuple(options["urls"].split())
        self.codes, self.sep = options["member"].split(), options.get("sep", ";")
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality, membership and substring filters on string columns are applied while reading; the rest go back to Spark."""
        text = {f.name for f in self.schema if isinstance(f.dataType, T.StringType)}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in text and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in text and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in text and isinstance(f, StringContains):
                self.tests.append((name, "contains", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        _, archive = open_archive(self.urls)
        return [_Member(self.urls, code, name) for code, name in member_names(archive, self.codes).items()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        _, archive = open_archive(partition.urls)
        rows = csv.reader(archive.lines(partition.name), delimiter=self.sep)
        header = next(rows, [])
        at = [header.index(f.name) if f.name in header else None for f in self.schema]
        cast = [_CASTS.get(type(f.dataType), str) for f in self.schema]
        tests = [(header.index(n), kind, v) for n, kind, v in self.tests if n in header]  # a column that is missing filters nothing
        for row in rows:
            if row and all(row[i] in v if kind == "in" else v[0] in row[i] for i, kind, v in tests):
                yield tuple(None if i is None or row[i] == "" else c(row[i]) for i, c in zip(at, cast, strict=True))


_CASTS = {T.IntegerType: int, T.LongType: int, T.DoubleType: float}


class ZipRangeSource(DataSource):
    """Options: urls (mirrors, by spaces), member (codes, by spaces), sep. The schema names the wanted columns."""

    @classmethod
    def name(cls) -> str:
        return "zip_range"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register(spark) -> None:
    """Makes the format known to the session and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipRangeSource)
