"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, whose records are
gzip members of their own, and ``indexes/index.cdxj`` with the place of each record. The reader
parses the central directory (ZIP64 or not), finds where the stored members begin, reads the
index, and then fetches blocks of neighbouring records, each with one range read.

Packages lie in the shared folder and are opened with ``pyarrow.fs``, so the folder may be any
store that it knows (local or mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import ship
from .common import materialize, shared_folder

ship(__name__)

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
#: A package is closed, and a block of records is cut, once it holds this many bytes.
PACKAGE_BYTES = 256 << 20
BLOCK_BYTES = 2 << 20
#: Bytes of packages that one reading task gets.
TASK_BYTES = 16 << 20
#: Rows up to which the table of repeated digests is broadcast; a larger one is shuffled.
SHARED_ROWS = 100_000
_LEVEL = 1


# --- records ------------------------------------------------------------------------


def _uri(page_id: int | None) -> str:
    return f"<{ID}{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    number = (uri or "")[len(ID) + 1 : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC record with its HTTP header; a revisit has no payload but its full length."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='''!#$%&'()*+,/:;=?@[]~''')}")
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in lines.decode("utf-8").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_record(data: bytes) -> dict:
    """Page id, type, digest, length and payload (None for a revisit) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    return {
        "page_id": _page(h["warc-record-id"]),
        "url": h.get("warc-target-uri"),
        "record_type": h["warc-type"],
        "refers_to": _page(h.get("warc-refers-to")) if revisit else None,
        "declared_digest": h["warc-payload-digest"].partition(":")[2],
        "declared_bytes": int(_headers(http)["content-length"]),
        "payload": None if revisit else payload,
    }


# --- packages -----------------------------------------------------------------------


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _key(url: str | None) -> str:
    """The host from its last part to its first, then the path, as crawl indexes sort."""
    try:
        parts = urlsplit(quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"))
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return "-"
    return f"{host}){parts.path or '/'}"


def write_package(sink, rows: Iterator[tuple]) -> int:
    """Write rows (arguments of ``record``) until PACKAGE_BYTES; gives the number written."""
    entries, size = [], 0
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
        with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as out:
            for row in rows:
                data = _gzip(record(*row))
                out.write(data)
                entry = {"recordid": _uri(row[0]), "offset": size, "length": len(data), "filename": ARCHIVE}
                entries.append(f"{_key(row[1])} {DATE} {json.dumps(entry)}\n")
                size += len(data)
                if size >= PACKAGE_BYTES:
                    break
        with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
            for line in sorted(entries):
                out.write(line.encode())
    return len(entries)


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


_END, _END64, _LOCATOR, _CENTRAL, _LOCALHEADER = (
    b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
)


def directory(source) -> dict[str, Member]:
    """The members of a package, from its central directory."""
    size = source.size()
    start = max(0, size - 65_557)
    tail = source.read_at(size - start, start)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HLL", tail, at + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        place = start + at - 20
        locator = source.read_at(20, place) if place >= 0 else b""
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        end64 = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    data, at, found = source.read_at(length, offset), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, plain, n, extra, comment = struct.unpack_from("<LLHHH", data, at + 20)
        header, = struct.unpack_from("<L", data, at + 42)
        name = data[at + 46 : at + 46 + n].decode("utf-8")
        packed, header = _wide(data[at + 46 + n : at + 46 + n + extra], packed, plain, header)
        found[name] = Member(name, method, packed, header)
        at += 46 + n + extra + comment
    return found


def _wide(extra: bytes, packed: int, plain: int, header: int) -> tuple[int, int]:
    """Packed size and header offset, from the ZIP64 field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            if plain == 0xFFFFFFFF:
                next(values)
            if packed == 0xFFFFFFFF:
                packed = next(values)
            if header == 0xFFFFFFFF:
                header = next(values)
        at += 4 + n
    return packed, header


def data_offset(source, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; only stored members have ranges")
    head = source.read_at(30, member.header)
    if head[:4] != _LOCALHEADER:
        raise ValueError("broken local header")
    n, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + extra


def read_index(source) -> list[tuple[int, int]]:
    """(offset in the file, length) of every record, in the order of the archive."""
    members = directory(source)
    index, archive = members[INDEX], data_offset(source, members[ARCHIVE])
    lines = source.read_at(index.size, data_offset(source, index)).decode("utf-8").splitlines()
    entries = (json.loads(line.split(" ", 2)[2]) for line in lines)
    return sorted((archive + e["offset"], e["length"]) for e in entries)


def blocks(places: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring records of about BLOCK_BYTES."""
    run: list[tuple[int, int]] = []
    for place in places:
        full = run and place[0] + place[1] - run[0][0] > BLOCK_BYTES
        if run and (full or place[0] != run[-1][0] + run[-1][1]):
            yield run
            run = []
        run.append(place)
    if run:
        yield run


def _open(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


# --- DataFrames ---------------------------------------------------------------------


def with_revisits(pages: DataFrame, payload: Column) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, revisit``: who repeats whose payload.

    Only payloads of at least REVISIT_FROM bytes can be revisits, of the smallest page id that
    has the same payload. Rows with that id itself are responses; null ids are never smallest.
    """
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    first = (
        rows.filter(F.octet_length("payload") >= REVISIT_FROM)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    first = materialize(first, "repeated-payloads")
    small = first.limit(SHARED_ROWS + 1).count() <= SHARED_ROWS
    joined = rows.join(F.broadcast(first) if small else first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"),
    )


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``with_revisits`` rows; gives a table with the path of each complete package.

    Every attempt of a task takes file names of its own, and only the paths of the attempt
    that Spark accepts are in the table, so lost and repeated tasks do no harm.
    """
    names = ["page_id", "url", "payload", "digest", "refers_to", "revisit"]

    def write(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        each = (
            row for b in batches for row in zip(*(b.column(n).to_pylist() for n in names), strict=True)
        )
        for first in each:
            name = f"pages-{uuid.uuid4().hex}.wacz"
            rows = _chain(first, each)
            with store.open_output_stream(f"{root}/{name}") as sink:
                n = write_package(sink, rows)
                size = sink.tell()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]}
            )

    out = rows.select(*names).mapInArrow(write, "path string, records bigint, bytes bigint")
    return materialize(out, "packages")


def _chain(first, rest):
    yield first
    yield from rest


def find_records(packages: DataFrame) -> DataFrame:
    """Blocks (path, offsets, lengths) of neighbouring records of each package in ``path``."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as source:
                    found = list(blocks(read_index(source)))
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(found), pa.string()),
                    "offsets": pa.array([[o for o, _ in b] for b in found], pa.list_(pa.int64())),
                    "lengths": pa.array([[n for _, n in b] for b in found], pa.list_(pa.int64())),
                })

    return packages.select("path").mapInArrow(
        run, "path string, offsets array<bigint>, lengths array<bigint>"
    )


RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, declared_digest string, "
    "declared_bytes bigint, payload binary"
)


def read_records(places: DataFrame, tasks: int) -> DataFrame:
    """The records of each block, fetched with one range read per block.

    The blocks are dealt to a fixed number of tasks: their rows are small, but their work is
    not, so joining small partitions would put all of it into one task.
    """

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("declared_digest", pa.string()),
        ("declared_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def run(batches):
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin, end = offsets[0], offsets[-1] + lengths[-1]
                with _open(path) as source:
                    data = source.read_at(end - begin, begin)
                rows = [
                    parse_record(zlib.decompress(data[o - begin : o - begin + n], 31))
                    for o, n in zip(offsets, lengths, strict=True)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = places.repartition(tasks, F.col("path"), F.col("offsets")[0])
    return spread.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for every page, read all records back, and describe their payloads.

    Length and digest of a response are those of the payload that was read; a revisit carries
    both in its headers. Null html is an empty payload.
    """
    folder = f"{shared_folder(pages.sparkSession)}/wacz-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    packages = write_packages(with_revisits(pages, payload), folder)
    size = packages.agg(F.sum("bytes")).first()[0] or 0
    r = read_records(find_records(packages), max(1, -(-size // TASK_BYTES)))
    return r.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("bigint"), "declared_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "declared_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
