"""WARC records in ZIP packages: a writer, and a reader that takes ranges without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` and, where records
are many, ``archive/data-1.warc.gz`` and so on (one gzip member a record), then ``indexes/index.cdx`` (key,
number of the archive, offset, length of each record). A reader takes the end of the file, from there the
central directory (ZIP64 where sizes or counts ask for it), from there the members' places, then the index
and each record by its range: through the file system that tasks can open, or the store's own client in
pyarrow.fs. Only on a store that has neither does Spark hand over the file's content.

Packages are written by Spark's own committer, one a task. An archive is sent on as soon as it has
PACKAGE_BYTES, so a task holds no more than that, however many pages it has.

Edge cases: a null payload is empty; payloads below MIN_REVISIT bytes are always responses; a null
page id is kept as null, never what a revisit refers to unless no other row has the payload; rows
with the smallest page id of equal payloads are all responses; a null or odd url gets a stand-in;
no pages give no packages; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MIN_REVISIT = 100
PACKAGE_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LOCAL, CENTRAL, END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
END64, LOCATOR = struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


class Package:
    """A ZIP file of stored members, made in parts: the bytes of each part, and one byte between it and the next,
    so that parts can be sent on at once. ZIP64 records where a number needs them, or everywhere."""

    def __init__(self, *, zip64: bool = False):
        self.zip64, self.at, self.central, self.index, self.archives = zip64, 0, [], [], 0

    def member(self, name: str, data: bytes) -> bytes:
        raw, crc, big = name.encode(), zlib.crc32(data), self.zip64 or len(data) >= _FULL32 or self.at >= _FULL32
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data)) if big else b""
        n = _FULL32 if big else len(data)
        head = LOCAL.pack(b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra)) + raw + extra
        more = struct.pack("<2H3Q", 1, 24, len(data), len(data), self.at) if big else b""
        self.central.append(CENTRAL.pack(b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(more), 0, 0, 0, 0, _FULL32 if big else self.at) + raw + more)
        self.at += len(head) + len(data) + 1
        return head + data

    def archive(self, records: list[tuple[str, bytes]]) -> bytes:
        """The next archive, of (key, record); each record is a gzip member of its own."""
        parts, at = [], 0
        for key, raw in records:
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            packed = squeeze.compress(raw) + squeeze.flush()
            self.index.append(f"{key} {self.archives} {at} {len(packed)}\n")
            parts.append(packed)
            at += len(packed)
        self.archives += 1
        return self.member(data_name(self.archives - 1), b"".join(parts))

    def end(self) -> bytes:
        """The index and the directory; the byte after it is the file's comment."""
        last = self.member(INDEX, "".join(self.index).encode()) + b"\n"
        size, count = sum(map(len, self.central)), len(self.central)
        big = self.zip64 or self.at >= _FULL32 or count >= _FULL16
        wide = END64.pack(b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, self.at) + LOCATOR.pack(b"PK\6\7", 0, self.at + size, 1) if big else b""
        tail = END.pack(b"PK\5\6", 0, 0, _FULL16 if big else count, _FULL16 if big else count, _FULL32 if big else size, _FULL32 if big else self.at, 1)
        return b"".join([last, *self.central, wide, tail])


def data_name(i: int) -> str:
    return f"archive/data-{i}.warc.gz" if i else DATA


def package(records: list[tuple[str, bytes]], *, zip64: bool = False, each: int | None = None) -> bytes:
    """A whole package of (key, record), ``each`` records an archive; ends with a newline, as its comment."""
    made, step = Package(zip64=zip64), each or len(records) or 1
    parts = [made.archive(records[i : i + step]) for i in range(0, max(len(records), 1), step)]
    return b"\n".join([*parts, made.end(), b""])


def opened(where: str):
    """A seekable file: by path, or by the client that pyarrow has for the address."""
    at = urlsplit(where)
    if at.scheme in ("", "file"):
        return open(unquote(at.path), "rb")  # noqa: SIM115
    store_of, path = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", where))
    return store_of.open_input_file(path)


def by_range(path: str) -> bool:
    """Whether files at ``path`` can be opened without Spark."""
    if urlsplit(path).scheme in ("", "file"):
        return True
    try:
        pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    except (OSError, ValueError):  # pyarrow has no client for it, or none that works here
        return False
    return True


class Ranges:
    """Ranges of an open file, or of bytes at hand. Counts the bytes it reads."""

    def __init__(self, source, size: int):
        self.size, self.taken = size, 0
        self.file = source if hasattr(source, "seek") else None
        self.data = None if self.file else source

    def read(self, at: int, n: int) -> bytes:
        self.taken += n
        if self.file:
            self.file.seek(at)
            got = self.file.read(n)
        else:
            got = self.data[at : at + n]
        if len(got) != n:
            raise EOFError("the package ends early")
        return got

    def close(self) -> None:
        if self.file:
            self.file.close()


def directory(r: Ranges) -> dict[str, tuple[int, int]]:
    """Name -> (place of the local header, size) of each stored member, from the central directory."""
    n = min(r.size, 65_535 + END.size + LOCATOR.size)
    tail = r.read(r.size - n, n)
    i = tail.rfind(b"PK\5\6")
    while i >= 0 and i + END.size + END.unpack_from(tail, i)[7] != len(tail):
        i = tail.rfind(b"PK\5\6", 0, i)
    if i < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, count, size, at, _ = END.unpack_from(tail, i)
    if count == _FULL16 or size == _FULL32 or at == _FULL32:
        sign, _, where, _ = LOCATOR.unpack_from(tail, i - LOCATOR.size)
        if sign != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        found = END64.unpack(r.read(where, END64.size))
        if found[0] != b"PK\6\6":
            raise ValueError("no ZIP64 end")
        count, size, at = found[7], found[8], found[9]
    raw, out, p = r.read(at, size), {}, 0
    for _ in range(count):
        (sign, _, _, _, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, place) = CENTRAL.unpack_from(raw, p)
        if sign != b"PK\1\2":
            raise ValueError("a broken central directory")
        p += CENTRAL.size
        name, extra = raw[p : p + n_name].decode(), raw[p + n_name : p + n_name + n_extra]
        p += n_name + n_extra + n_note
        wide, q = b"", 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack_from("<2H", extra, q)
            if kind == 1:
                wide = extra[q + 4 : q + 4 + length]
            q += 4 + length
        numbers = iter(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))
        plain = next(numbers) if plain == _FULL32 else plain
        packed = next(numbers) if packed == _FULL32 else packed
        place = next(numbers) if place == _FULL32 else place
        if method == 0:
            out[name] = (place, packed)
    return out


def member(r: Ranges, place: int) -> int:
    """Where a member's data begins: after its local header, whose own lengths count."""
    head = LOCAL.unpack(r.read(place, LOCAL.size))
    if head[0] != b"PK\3\4":
        raise ValueError("no local header")
    return place + LOCAL.size + head[9] + head[10]


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP head alone, which tells the payload's length."""
    target = re.sub(r"[\x00-\x20\x7f]", "", url or "") or f"urn:page:{page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record; names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    web = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    return fields, web, payload


def records(r: Ranges, *, keys: set[str] | None = None):
    """Raw records of a package, each by its own range; all, or those of the index' ``keys``."""
    members = directory(r)
    place, size = members[INDEX]
    lines = r.read(member(r, place), size).decode().splitlines()
    begin: dict[str, int] = {}
    for line in lines:
        key, archive, at, n = line.rsplit(" ", 3)
        if keys is None or key in keys:
            if archive not in begin:
                begin[archive] = member(r, members[data_name(int(archive))][0])
            yield zlib.decompress(r.read(begin[archive] + int(at), int(n)), 31)


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a package for each task's pages at ``path``."""
    rows = pages.select(pages[key].cast("long").alias("key"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    groups = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = store.written(groups.withColumnRenamed("digest", "same"), "repeated-payloads")
    total = rows.agg(F.sum("size")).first()[0] or 0
    # payloads below MIN_REVISIT have nothing to meet: each has a key of its own
    rows = rows.withColumn("same", F.when(F.col("size") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("key").cast("string"), F.col("url"), F.lit("")))))
    rows = store.joined(rows, groups, ["same"], "n")
    revisit = (F.col("size") >= MIN_REVISIT) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    rows = rows.select("key", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    tasks = pages.rdd.getNumPartitions()
    if total > tasks * PACKAGE_BYTES:
        rows = rows.repartition(-(-total // PACKAGE_BYTES))

    def run(batches):
        made, held, size = Package(), [], 0
        for b in batches:
            for i in range(b.num_rows):  # one page at a time: a batch's pages may be long
                page, link, text, n, digest, refers_to, again = (c[i].as_py() for c in b.columns)
                held.append((str(page), record(page, link, None if text is None else text.encode(), n, digest, refers_to, again)))
                size += len(held[-1][1])
                if size >= PACKAGE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([made.archive(held)], pa.binary())], names=["package"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([made.archive(held)], pa.binary())], names=["package"])
        if made.archives:
            yield pa.RecordBatch.from_arrays([pa.array([made.end()], pa.binary())], names=["package"])

    store.write_blobs(rows.mapInArrow(run, "package binary"), "package", path)


def read(spark: SparkSession, path: str, *, key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of each record of the packages at
    ``path``; a response's are taken from its payload, a revisit's from its heads."""
    files = store.blobs(spark, path)
    ranges = by_range(path)
    files = files.select("path" if ranges else "content", "length")
    kinds = f"`{key}` long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        for b in batches:
            for where, size in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                r = Ranges(opened(where.as_py()) if ranges else where.as_py(), size)
                out = []
                for raw in records(r):
                    fields, web, payload = parsed(raw)
                    again = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    n = int(web["content-length"]) if again else len(payload)
                    if not again and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload is not what its digest says")
                    out.append((_page(fields["warc-record-id"]), n, digest, fields["warc-type"], _page(fields["warc-refers-to"]) if again else None))
                r.close()
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], names=[key, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(run, kinds)


def oracle() -> str:
    """The same over ``pages`` in DuckDB's SQL."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= {MIN_REVISIT} GROUP BY digest)
SELECT p.page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (digest)"""
