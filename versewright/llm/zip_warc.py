"""WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file with stored members: archive/data.warc.gz (each record a gzip member of its own),
indexes/index.cdxj (for each record a line of its url's key, its time, and JSON with file, offset and length,
sorted) and datapackage.json (names, sizes and digests of the others). The reader parses the ZIP's central
directory, also the ZIP64 one, finds where stored members begin, and reads single records as byte ranges of
the file: nothing is extracted. It takes any number of indexes and of data files in an archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: An archive is closed when its data have so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Up to so many groups of equal payloads are broadcast (40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
DATE = "1970-01-01T00:00:00Z"
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_FULL = 0xFFFFFFFF


# ---- ZIP


def zip_file(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """The parts of a ZIP file with stored members; its ZIP64 form where sizes ask for it, or always."""
    at, central = 0, []
    for name, data in members:
        n, crc, raw = len(data), zlib.crc32(data), name.encode()
        big = zip64 or n >= _FULL
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        yield struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, _FULL if big else n, _FULL if big else n, len(raw), len(extra)) + raw + extra
        yield data
        far = zip64 or at >= _FULL
        values = ([n, n] if big else []) + ([at] if far else [])
        more = struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if big or far else 20, 0x800, 0, 0, 0x21, crc, _FULL if big else n, _FULL if big else n, len(raw), len(more), 0, 0, 0, 0, _FULL if far else at) + raw + more)
        at += 30 + len(raw) + len(extra) + n
    directory = b"".join(central)
    yield directory
    big = zip64 or at >= _FULL or len(central) >= 0xFFFF
    if big:
        yield struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, len(central), len(central), len(directory), at)
        yield struct.pack("<4sIQI", _LOCATOR, 0, at + len(directory), 1)
    yield struct.pack("<4sHHHHIIH", _END, 0, 0, 0xFFFF if big else len(central), 0xFFFF if big else len(central), _FULL if big else len(directory), _FULL if big else at, 0)


class ZipReader:
    """Members of a ZIP file that is read through ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 65557)
        tail = read(tail_at, size - tail_at)
        end = len(tail)
        while (end := tail.rfind(_END, 0, end + 3)) >= 0:
            if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] <= len(tail):
                break
        if end < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        n, length, at = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == _LOCATOR:
            (where,) = struct.unpack_from("<Q", tail, end - 12)
            head = read(where, 56)
            if head[:4] != _END64:
                raise ValueError("the ZIP64 end of central directory isn't where its locator says")
            n, length, at = struct.unpack_from("<QQQ", head, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}  # method, stored size, size, offset of the local header
        raw, p = read(at, length), 0
        for _ in range(n):
            if raw[p : p + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, p + 8)
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, p + 20)
            (local,) = struct.unpack_from("<I", raw, p + 42)
            name = raw[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[p + 46 + n_name : p + 46 + n_name + n_extra]
            full, packed, local = _zip64(extra, full, packed, local)
            self.members[name] = (method, packed, full, local)
            p += 46 + n_name + n_extra + n_note

    def place(self, name: str) -> tuple[int, int]:
        """Offset in the file and size of a stored member's data."""
        method, packed, _, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored; its records have no ranges")
        head = self.read(local, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"no local header for {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, packed


def _zip64(extra: bytes, *values: int) -> list[int]:
    out, p = list(values), 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, p)
        if kind == 1:
            q = p + 4
            for i, v in enumerate(out):
                if v == _FULL:
                    (out[i],) = struct.unpack_from("<Q", extra, q)
                    q += 8
        p += 4 + n
    return out


# ---- WARC


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page: int | None, url: str | None, payload: bytes, first: int | None, response: bool) -> bytes:
    """A gzip member with one WARC record: a response with its payload, or a revisit of page ``first``."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest32(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if response:
        body = http + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first)}", f"X-Payload-Length: {len(payload)}"]
        body = http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(h["content-length"])]
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    out = {"page_id": _page(h["warc-record-id"]), "url": h["warc-target-uri"], "record_type": h["warc-type"], "payload_digest": digest, "refers_to": None, "payload": None}
    if h["warc-type"] == "revisit":
        return out | {"refers_to": _page(h["warc-refers-to"]), "payload_bytes": int(h["x-payload-length"])}
    payload = body.partition(b"\r\n\r\n")[2]
    if digest32(payload) != digest:
        raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
    return out | {"payload": payload, "payload_bytes": len(payload)}


# ---- index and package


def url_key(url: str | None) -> str:
    """The key that an index sorts by: host parts from the end, joined by commas, then path and query, in small letters."""
    p = urlsplit((url or "about:blank").replace("\n", "").lower())
    host = ",".join(reversed((p.hostname or "").removeprefix("www.").split("."))) if p.netloc else p.scheme
    return quote(f"{host}){p.path or '/'}" + (f"?{p.query}" if p.query else ""), safe="):/?#[]@!$&(*+,;=%~'")


def index_line(page: int | None, url: str | None, digest: str, response: bool, offset: int, length: int) -> str:
    about = {"url": url, "mime": "text/html" if response else "warc/revisit", "status": "200", "digest": f"sha1:{digest}", "length": str(length), "offset": str(offset), "filename": DATA.rpartition("/")[2], "record": _urn(page)}
    return f"{url_key(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(about)}"


def package(members: list[tuple[str, bytes]]) -> bytes:
    """The descriptor of an archive's members."""
    named = [{"name": n.rpartition("/")[2], "path": n, "hash": f"sha256:{hashlib.sha256(d).hexdigest()}", "bytes": len(d)} for n, d in members]
    return json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": named}, indent=1).encode()


# ---- Spark


def firsts(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with ``response`` and ``first``, the smallest page_id of an equal payload.

    Only groups of several pages are joined back, by SHA-1 and length; single pages are responses anyway.
    """
    key = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("__k", F.sha1("html")).withColumn("__n", F.octet_length("html"))
    groups = key.select("page_id", "__k", "__n").where(F.col("__n") >= least_bytes).groupBy("__k", "__n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = stored(groups, "payloads")
    few = groups.count() <= BROADCAST_ROWS
    d = key.join(F.broadcast(groups) if few else groups, ["__k", "__n"], "left")
    return d.select("page_id", "url", "html", "first", (F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))).alias("response"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages' records into archives in a folder; (path, records, bytes) of each, stored.

    Tasks name their archives at random and a task that is run again writes others: only archives in the
    returned table count. Null htmls are empty payloads; pages without a page_id are revisits of an equal
    page with one, else responses; rows that repeat the smallest page_id of a payload are responses too.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        data, index = bytearray(), []

        def close() -> pd.DataFrame:
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            size = 0
            with store.open_output_stream(path) as out:
                members = [(DATA, bytes(data)), (INDEX, ("\n".join(sorted(index)) + "\n").encode())]
                for part in zip_file([*members, (PACKAGE, package(members))]):
                    out.write(part)
                    size += len(part)
            row = pd.DataFrame([(path, len(index), size)], columns=["path", "records", "bytes"])
            data.clear()
            index.clear()
            return row

        for pdf in batches:
            for page, url, html, first, response in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["first"], pdf["response"]):
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                payload = html.encode("utf-8", "surrogatepass")
                member = record(page, url, payload, first, bool(response))
                index.append(index_line(page, url, digest32(payload), bool(response), len(data), len(member)))
                data += member
                if len(data) >= archive_bytes:
                    yield close()
        if index:
            yield close()

    d = firsts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes)
    d = d.withColumn("page_id", F.col("page_id").cast("string")).withColumn("first", F.col("first").cast("string"))  # whole longs, also beside nulls
    return stored(d.mapInPandas(write, "path string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of archives(path), each read as a range, urls as they were given: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]."""
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path in pdf["path"]:
                with store.open_input_file(path) as f:

                    def at(offset: int, length: int, f=f) -> bytes:
                        f.seek(offset)
                        return f.read(length)

                    z = ZipReader(at, f.size())
                    starts = {n.rpartition("/")[2]: z.place(n)[0] for n in z.members if n.startswith("archive/") and n.endswith(".warc.gz")}
                    lines = [x for n in sorted(z.members) if n.startswith("indexes/") and n.endswith(".cdxj") for x in at(*z.place(n)).decode().split("\n") if x]
                    for lo in range(0, len(lines), 1000):
                        about = [json.loads(x.split(" ", 2)[2]) for x in lines[lo : lo + 1000]]
                        rows = [parse(at(starts[x["filename"]] + int(x["offset"]), int(x["length"]))) | {"url": x["url"]} for x in about]
                        out = pd.DataFrame(rows, columns=fields)
                        for c in ("page_id", "refers_to"):
                            out[c] = pd.array([r[c] for r in rows], dtype="Int64")
                        yield out

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    n = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism))
    return archives.select("path").repartition(n).mapInPandas(read, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from archives."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = write_archives(pages, folder, least_bytes)
    return read_archives(spark, archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
