"""Archives read by ranges, against zipfile; filters that leave entries unread; an archive beyond 2 GB."""

import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

from versewright.sources import archives as A


class Counting(A.Ranges):
    made: list = []

    def __init__(self, uri):
        super().__init__(uri)
        Counting.made.append(self)


@pytest.fixture()
def folder(tmp_path):
    for no in range(3):
        with zipfile.ZipFile(tmp_path / f"a{no}.tstudio", "w") as z:
            z.writestr("manifest.json", f'{{"no": {no}}}')
            z.writestr("dir/", "")
            for i in range(40):
                z.writestr(f"p/{i:02}/01.txt", f"text {i} é " * (i * 50), zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    (tmp_path / "broken.tstudio").write_bytes(b"no archive at all")
    (tmp_path / "empty.tstudio").write_bytes(b"")
    (tmp_path / "other.txt").write_text("x")
    return tmp_path


def rows(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [1000, 1 << 26])
def test_entries(folder, size):
    got = rows(A.Reader({"path": str(folder), "suffix": ".tstudio", "rangeBytes": str(size)}))
    want = {}
    for no in range(3):
        with zipfile.ZipFile(folder / f"a{no}.tstudio") as z:
            want |= {(str(folder / f"a{no}.tstudio"), n): z.read(n) for n in z.namelist() if not n.endswith("/")}
    assert {(r["archive"], r["path"]): r["content"] for r in got if r["code"] is None} == want
    assert sorted(r["archive"].split("/")[-1] for r in got if r["code"] == "ZIP_INVALID") == ["broken.tstudio", "empty.tstudio"] and len(got) == len(want) + 2


def test_one_entry_costs_one_range(folder):
    r = A.Reader({"path": str(folder), "suffix": ".tstudio"})
    r.open = Counting
    assert [type(f).__name__ for f in r.pushFilters([EqualTo(("path",), "manifest.json"), IsNotNull(("path",)), StringStartsWith(("archive",), str(folder / "a1"))])] == ["IsNotNull"]
    parts = r.partitions()
    Counting.made.clear()
    assert len(parts) == 1 and [x["content"] for p in parts for b in r.read(p) for x in b.to_pylist()] == [b'{"no": 1}']
    assert [s.count for s in Counting.made] == [1] and parts[0].end - parts[0].start < 200


def test_through_spark(spark, folder):
    spark.dataSource.register(A.Archives)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        d = spark.read.format("archives").option("suffix", ".tstudio").load(f"file://{folder}")
        assert d.where("code is null").count() == 123 and d.where("code = 'ZIP_INVALID'").count() == 2
        m = d.where("path = 'manifest.json'")
        assert sorted(bytes(r["content"]) for r in m.collect()) == [b'{"no": 0}', b'{"no": 1}', b'{"no": 2}']
        assert m.rdd.getNumPartitions() <= 5
        assert d.where(F.col("path").startswith("p/3") & (F.col("size") > 100)).count() == 30
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_beyond_two_gigabytes(tmp_path):
    """A stored entry of 2.5 GB of nothing, a hole in the file, and a small one behind it whose place needs more than 31 bits."""
    hole, small = 2_500_000_000, b"behind it all"
    path = tmp_path / "large.zip"
    head = lambda name, crc, size: b"PK\x03\x04" + struct.pack("<HHHHHLLLHH", 20, 0, 0, 0, 0, crc, size, size, len(name), 0) + name
    entry = lambda name, crc, size, at: b"PK\x01\x02" + struct.pack("<HHHHHHLLLHHHHHLL", 20, 20, 0, 0, 0, 0, crc, size, size, len(name), 0, 0, 0, 0, 0, at) + name
    with open(path, "wb") as f:
        f.write(head(b"hole", 0, hole))
        f.seek(hole, 1)
        at = f.tell()
        f.write(head(b"small.txt", zlib.crc32(small), len(small)) + small)
        start = f.tell()
        raw = entry(b"hole", 0, hole, 0) + entry(b"small.txt", zlib.crc32(small), len(small), at)
        f.write(raw + b"PK\x05\x06" + struct.pack("<HHHHLLH", 0, 0, 2, 2, len(raw), start, 0))
    r = A.Reader({"path": str(path)})
    assert list(r.pushFilters([EqualTo(("path",), "small.txt")])) == []
    assert [(x["path"], x["content"]) for x in rows(r)] == [("small.txt", small)]


def test_corrupt_entries(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", "hello hello")
        z.writestr("b", "fine")
        z.writestr("c", "x" * 100, zipfile.ZIP_BZIP2)
    raw = bytearray(path.read_bytes())
    raw[raw.index(b"hello")] ^= 1
    path.write_bytes(bytes(raw))
    assert [(r["path"], r["content"], r["code"]) for r in rows(A.Reader({"path": str(path)}))] == [("a", None, "ENTRY_CORRUPT"), ("b", b"fine", None), ("c", None, "ENTRY_UNSUPPORTED")]
