"""WARC records in ZIP packages: a writer, and a reader that ranges over them without extraction.

A package is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member a record, and
`indexes/index.cdx`, a line a record: key, offset, length, type, digest. The reader parses the end-of-central-directory
record, its ZIP64 form and locator, the central directory and the ZIP64 extra fields, finds where a stored member's
bytes begin, and reads an index and then single records by their ranges.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest key is a `response`, the others are
`revisit` records that name it and hold no payload.

Defined results: null text is an empty payload; rows with an equal largest key and an equal payload are all responses;
a null key is smaller than any other; repeated rows give a record each; very long payloads are written whole; columns other than page_id, url and
html are not read, whatever their names; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_rows, lean, new_path, pick, stored

MIN_REVISIT = 1000
#: Compressed bytes after which an archive is closed and the next begun: what a task holds in memory.
ARCHIVE_BYTES = 16 << 20
#: Pages of a batch that a task hands to Python, and digests of repeated payloads that may be sent to all tasks (about 100 bytes each).
BATCH_ROWS, BROADCAST_GROUPS = 500, 200_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_NAMESPACE = uuid.UUID("6f2c8f5e-57c5-4a3e-8a0b-0d5f6c1f7a11")


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(key))}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record; its block is an HTTP response, without the payload in a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Record-Key: {'' if key is None else key}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"WARC-Refers-To-Key: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """Collects records and gives the bytes of a ZIP package."""

    def __init__(self) -> None:
        self.data, self.index, self.count = io.BytesIO(), [], 0

    def add(self, key: int | None, kind: str, whole: bytes) -> None:
        packed, at = gzip.compress(whole, 1, mtime=0), self.data.tell()
        self.data.write(packed)
        self.index.append(f"{'-' if key is None else key} {at} {len(packed)} {kind}\n")
        self.count += 1

    def size(self) -> int:
        return self.data.tell()

    def packed(self, zip64: bool = False) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in ((DATA, self.data.getbuffer()), (INDEX, "".join(self.index).encode())):
                with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as member:
                    member.write(content)
        return out.getvalue()


class ZipReader:
    """Members of a ZIP file by ranges. read(offset, length) gives bytes of the file, size is its length."""

    def __init__(self, read, size: int) -> None:
        self.read, self.size = read, size
        self.members = {name: (at, length, method) for name, at, length, method in self._central()}

    def _central(self) -> Iterator[tuple[str, int, int, int]]:
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        entries, length, at = struct.unpack_from("<HII", tail, end + 10)
        if (entries == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and tail_at + end >= 20:
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] == b"PK\6\7":
                wide = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if wide[:4] != b"PK\6\6":
                    raise ValueError("broken ZIP64 end of central directory")
                entries, length, at = struct.unpack_from("<QQQ", wide, 32)
        central, i = self.read(at, length), 0
        for _ in range(entries):
            if central[i : i + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", central, i + 8)
            packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", central, i + 20)
            (begin,) = struct.unpack_from("<I", central, i + 42)
            name = central[i + 46 : i + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = central[i + 46 + n_name : i + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # ZIP64: only the fields that didn't fit, in this order
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    begin = wide.pop(0) if begin == 0xFFFFFFFF else begin
                e += 4 + n
            i += 46 + n_name + n_extra + n_note
            yield name, begin, packed, method

    def span(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and their number."""
        at, length, method = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored")
        local = self.read(at, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        return at + 30 + sum(struct.unpack_from("<HH", local, 26)), length

    def range(self, name: str, offset: int, length: int) -> bytes:
        at, size = self.span(name)
        if offset < 0 or offset + length > size:
            raise ValueError(f"range beyond {name}")
        return self.read(at + offset, length)

    def whole(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name][1])


def parse(whole: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (with lower-case names) and block of a WARC record."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def described(headers: dict[str, str], block: bytes) -> dict:
    """What a record says of its payload; a response's is checked against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't fit its digest")
    key, other = headers.get("warc-record-key"), headers.get("warc-refers-to-key")
    return {
        "page_id": int(key) if key else None,
        "payload_bytes": int(fields["content-length"]),
        "payload_digest": digest,
        "record_type": headers["warc-type"],
        "refers_to": int(other) if other else None,
    }


def read_records(reader: ZipReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record by the range that the package's index has for it."""
    at, size = reader.span(DATA)
    for line in reader.whole(INDEX).decode().splitlines():
        _, offset, length, _ = line.split(" ")
        if int(offset) + int(length) > size:
            raise ValueError("index entry beyond the archive")
        yield parse(zlib.decompress(reader.read(at + int(offset), int(length)), 31))


def roles(pages: DataFrame) -> DataFrame:
    """key, url, payload, refers_to (null for a response): pages by the revisit rule."""
    rows = pick(pages, key="page_id", url="url", html="html").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumn("bytes", F.octet_length("payload"))
    rows = rows.withColumn("digest", F.when(F.col("bytes") >= MIN_REVISIT, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    groups = (
        rows.where(F.col("bytes") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.max("key").alias("last"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.col("digest").alias("g_digest"), "last")
    )
    groups = stored(groups, "warc-groups")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)  # no payload moves
    other = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return rows.join(groups, rows["digest"] == groups["g_digest"], "left").select("key", "url", "payload", F.when(other, F.col("last")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """path, records, bytes: the packages written to folder, which all machines share. Each task writes its own files under new names, so one that runs again disturbs nothing; only listed files count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        open_package = Package()

        def closed() -> pa.RecordBatch:
            path, content = f"{root}/{uuid.uuid4().hex}.wacz", open_package.packed(zip64)
            with system.open_output_stream(path) as out:
                out.write(content)
            return pa.RecordBatch.from_pydict({"path": [path.removeprefix(root + "/")], "records": [open_package.count], "bytes": [len(content)]})

        for batch in batches:
            for key, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                key, refers_to = key.as_py(), refers_to.as_py()
                whole = record(key, url.as_py(), payload.as_py(), refers_to, refers_to is not None)
                open_package.add(key, "revisit" if refers_to is not None else "response", whole)
                if open_package.size() >= ARCHIVE_BYTES:
                    yield closed()
                    open_package = Package()
        if open_package.count:
            yield closed()

    with arrow_rows(pages.sparkSession, BATCH_ROWS):
        return stored(roles(pages).mapInArrow(lean(write), "path string, records bigint, bytes bigint"), "warc-packages")


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """RECORDS: a row for each record of the packages (path under folder)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{path}") as file:
                    reader = ZipReader(lambda at, n: file.read_at(n, at), file.size())
                    rows = [described(*x) for x in read_records(reader)]
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return packages.select("path").repartition(max(1, packages.count())).mapInArrow(lean(read), RECORDS)


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """pages written as packages and read back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder), folder)


def warc_sql(pages: str = "pages") -> str:
    return f"""
with rows as (select page_id, encode(coalesce(html, '')) as payload from {pages}),
sized as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from rows),
grouped as (select *, case when payload_bytes >= {MIN_REVISIT} then max(page_id) over (partition by payload_digest, payload_bytes) else page_id end as last from sized)
select page_id, payload_bytes, payload_digest,
  case when last = page_id then 'response' else 'revisit' end as record_type,
  case when last = page_id then null else last end as refers_to
from grouped
"""
