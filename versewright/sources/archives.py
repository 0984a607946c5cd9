"""ZIP archives as a data source: partitions come from central directories, entries are read as ranges.

    spark.dataSource.register(Archives)
    spark.read.format("archives").load("file:///data/projects")

Only directories are read to plan; filters on an entry's path and archive leave out what they can before any entry is read
(spark.sql.python.filterPushdown.enabled). A partition reads one range of an archive, so neither an archive's size nor its
number of entries is bounded, only that of one entry: a row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "archive string, path string, size bigint, content binary, code string"
#: Compressed bytes of a partition, and the gap that a range may read over.
RANGE, GAP = 64 << 20, 64 << 10
STORED, DEFLATED = 0, 8
_END, _END64, _LOCATOR, _HEADER = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Entry:
    """What a central directory says of an entry."""

    name: str
    method: int
    encrypted: bool
    crc: int
    packed: int
    size: int
    at: int


@dataclass
class Part(InputPartition):
    archive: str
    start: int
    end: int
    entries: list[Entry]


class Ranges:
    """A file of any store that pyarrow knows, read by ranges; ``count`` is how many were."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
        self.file, self.count = store.open_input_file(path), 0
        self.size = self.file.size()

    def read(self, at: int, length: int) -> bytes:
        self.count += 1
        return self.file.read_at(length, at)


def directory(source: Ranges) -> list[Entry]:
    """The entries of an archive in the order of their places; ValueError if it is none."""
    tail_at = max(0, source.size - 22 - _FULL16)
    tail = source.read(tail_at, source.size - tail_at)
    i = tail.rfind(_END)
    if i < 0 or len(tail) < i + 22:
        raise ValueError("no end of a central directory")
    size, at = struct.unpack("<LL", tail[i + 12 : i + 20])
    count = struct.unpack("<H", tail[i + 10 : i + 12])[0]
    if _FULL32 in (size, at) or count == _FULL16:
        j = tail.rfind(_LOCATOR, 0, i)
        if j >= 0:
            end = source.read(struct.unpack("<Q", tail[j + 8 : j + 16])[0], 56)
            if end[:4] != _END64:
                raise ValueError("no end of a ZIP64 directory")
            size, at = struct.unpack("<QQ", end[40:56])
    raw = tail[at - tail_at : at - tail_at + size] if at >= tail_at else source.read(at, size)
    out, p = [], 0
    while p + 46 <= len(raw) and raw[p : p + 4] == _HEADER:
        flags, method = struct.unpack("<HH", raw[p + 8 : p + 12])
        crc, packed, full, n, m, k = struct.unpack("<LLLHHH", raw[p + 16 : p + 34])
        place = struct.unpack("<L", raw[p + 42 : p + 46])[0]
        name, extra = raw[p + 46 : p + 46 + n], raw[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:  # ZIP64 sizes stand in the order of the fields that are full
            kind, length = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                full = next(wide, full) if full == _FULL32 else full
                packed = next(wide, packed) if packed == _FULL32 else packed
                place = next(wide, place) if place == _FULL32 else place
            extra = extra[4 + length :]
        out.append(Entry(name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), crc, packed, full, place))
        p += 46 + n + m + k
    if p != size:
        raise ValueError("a broken central directory")
    return sorted(out, key=lambda e: e.at)


def content(entry: Entry, raw: bytes, start: int) -> tuple[bytes | None, str | None]:
    """(content, None) of an entry in a range that starts at a place, or (None, why not)."""
    p = entry.at - start
    if raw[p : p + 4] != b"PK\x03\x04":
        return None, "ENTRY_HEADER_MISSING"
    n, m = struct.unpack("<HH", raw[p + 26 : p + 30])
    packed = raw[p + 30 + n + m : p + 30 + n + m + entry.packed]
    if entry.encrypted or entry.method not in (STORED, DEFLATED):
        return None, "ENTRY_UNSUPPORTED"
    try:
        out = packed if entry.method == STORED else zlib.decompress(packed, -15)
    except zlib.error:
        return None, "ENTRY_CORRUPT"
    return (out, None) if len(out) == entry.size and zlib.crc32(out) == entry.crc else (None, "ENTRY_CORRUPT")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))
        self.wanted: list[Filter] = []
        self.open = Ranges

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("path",), ("archive",)):
                self.wanted.append(f)
            else:
                yield f

    def _holds(self, archive: str, name: str | None) -> bool:
        for f in self.wanted:
            v = archive if f.attribute == ("archive",) else name
            if v is None:
                continue
            ok = v == f.value if isinstance(f, EqualTo) else v in f.value if isinstance(f, In) else v.startswith(f.value) if isinstance(f, StringStartsWith) else v.endswith(f.value)
            if not ok:
                return False
        return True

    def archives(self) -> list[str]:
        from pyarrow import fs

        remote = "://" in self.path or self.path.startswith("file:")
        store, path = fs.FileSystem.from_uri(self.path) if remote else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(path)
        found = [path] if info.is_file else [x.path for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith(self.suffix)]
        front = self.path[: self.path.index(path)] if remote and path in self.path else ""
        return sorted(f"{front}{x}" for x in found)

    def partitions(self) -> list[Part]:
        out = []
        for archive in self.archives():
            if not self._holds(archive, None):
                continue
            source = self.open(archive)
            try:
                every = directory(source)
            except (ValueError, struct.error, UnicodeDecodeError):
                out.append(Part(archive, 0, 0, []))
                continue
            ends = [e.at for e in every[1:]] + [source.size]  # an entry ends before the next one begins
            part = None
            for e, end in zip(every, ends):
                end = min(end, e.at + 30 + 2 * _FULL16 + e.packed)
                if not self._holds(archive, e.name):
                    continue
                if part is None or e.at - part.end > GAP or end - part.start > self.range:
                    part = Part(archive, e.at, end, [])
                    out.append(part)
                part.entries.append(e)
                part.end = end
        return out or [Part("", 0, 0, [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = ["archive", "path", "size", "content", "code"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds)], names)
        if not partition.entries:
            if partition.archive:
                yield row(partition.archive, None, None, None, "ZIP_INVALID")
            return
        raw = self.open(partition.archive).read(partition.start, partition.end - partition.start)
        for e in partition.entries:
            if not e.name.endswith("/"):
                yield row(partition.archive, e.name, e.size, *content(e, raw, partition.start))


class Archives(DataSource):
    """(archive, path, size, content, code) of each file in the ZIP archives at a path: content, or why there is none. An
    archive that can't be read is a row without a path. Options: suffix, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
