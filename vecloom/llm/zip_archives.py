"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip member for each WARC
record), ``indexes/index.cdxj`` (one line for each record: key, time, and JSON with its offset and length
in the archive) and ``datapackage.json``. Nothing in it is deflated, so a record lies at one range of bytes of
the package: data of the archive member, plus the offset in the index.

Reading takes two passes. The first parses each package's directories (end record, ZIP64 locator and
end record, central directory, local headers) and its index, and deals the records out in spans of
bounded length. The second opens packages again, anywhere, and reads only the spans. Archives without a
usable index are read in pieces from start to end.

Packages are written by Spark's text writer, one row a file, so that its commit protocol drops
what lost tasks left and any store that Spark writes to will do. The line end which that writer adds is the package's
comment, which a ZIP file may have.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.packed import arrow_rows, rows_of
from vecloom.session import new_path

ARCHIVE, INDEX, DESCRIPTION = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Compressed bytes of records after which a package is closed.
PACKAGE_BYTES = 8_000_000
#: Compressed bytes of records that a task reads at a time.
SPAN_BYTES = 1_000_000
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Compressed bytes that a task reads in all, on average.
TASK_BYTES = 8_000_000
DATE = "2023-01-01T00:00:00Z"
COMMENT = b"\n"

# Fixed values of the ZIP format: signatures and layouts of its records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
LOCAL_LAYOUT, CENTRAL_LAYOUT, END_LAYOUT = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
END64_LAYOUT, LOCATOR64_LAYOUT = "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32, ZIP64_EXTRA, UTF8_FLAG = 0xFFFF, 0xFFFFFFFF, 1, 0x800
#: 1980-01-01 in the format's days.
DAY = 33

RECORD_COLUMNS = (
    "package string, record_id string, record_type string, target_uri string, refers_to_id string, "
    "payload_bytes long, payload_digest string, intact boolean, payload binary"
)


# Writing


def _member_headers(name: str, data: bytes, at: int, zip64: bool) -> tuple[bytes, bytes]:
    """Local and central header of a stored member that starts at ``at``."""
    raw, crc, size = name.encode(), zlib.crc32(data), len(data)
    large = zip64 or size >= FULL32 or at >= FULL32
    short = FULL32 if large else size
    version = 45 if large else 20
    extra = struct.pack("<2H2Q", ZIP64_EXTRA, 16, size, size) if large else b""
    local = struct.pack(LOCAL_LAYOUT, LOCAL, version, UTF8_FLAG, 0, 0, DAY, crc, short, short, len(raw), len(extra))
    if large:
        extra = struct.pack("<2H3Q", ZIP64_EXTRA, 24, size, size, at)
    central = struct.pack(
        CENTRAL_LAYOUT, CENTRAL, version, version, UTF8_FLAG, 0, 0, DAY, crc, short, short,
        len(raw), len(extra), 0, 0, 0, 0, FULL32 if large else at,
    )
    return local + raw + (struct.pack("<2H2Q", ZIP64_EXTRA, 16, size, size) if large else b""), central + raw + extra


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False, comment: bytes = COMMENT) -> bytes:
    """A ZIP file of stored members whose comment is ``comment``; with ZIP64 records if asked for or needed."""
    body, directory = bytearray(), bytearray()
    for name, data in members:
        local, central = _member_headers(name, data, len(body), zip64)
        body += local
        body += data
        directory += central
    at, size, n = len(body), len(directory), len(members)
    large = zip64 or at >= FULL32 or n >= FULL16
    tail = b""
    if large:
        tail = struct.pack(END64_LAYOUT, END64, 44, 45, 45, 0, 0, n, n, size, at)
        tail += struct.pack(LOCATOR64_LAYOUT, LOCATOR64, 0, at + size, 1)
    short = FULL16 if large else n
    end = struct.pack(
        END_LAYOUT, END, 0, 0, short, short, FULL32 if large else size, FULL32 if large else at, len(comment)
    )
    return bytes(body + directory + tail + end + comment)


def _safe(url: str) -> str:
    """A URL that fits in one header line; only control characters, blanks and what is not ASCII change."""
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~|\\^{}\"<>`")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without its payload where ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def index_line(page_id: int | None, url: str | None, offset: int, length: int) -> str:
    place = {"offset": offset, "length": length, "filename": ARCHIVE, "id": record_id(page_id)}
    return f"{_safe(url or '-')} {DATE} {json.dumps(place)}\n"


def _write_packages(package_bytes: int):
    schema = pa.schema([("package", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, index = bytearray(), []

        def package() -> pa.RecordBatch:
            members = [(ARCHIVE, bytes(archive)), (INDEX, "".join(sorted(index)).encode())]
            described = [{"path": n, "bytes": len(d), "hash": f"sha256:{hashlib.sha256(d).hexdigest()}"} for n, d in members]
            members.append((DESCRIPTION, json.dumps({"profile": "data-package", "resources": described}).encode()))
            # The comment is left to the text writer.
            return arrow_rows(schema, [(zip_package(members, zip64=True)[: -len(COMMENT)],)])

        for page_id, url, payload, digest, refers_to in rows_of(batches):
            record = gzip.compress(warc_record(page_id, url, payload, digest, refers_to), 6, mtime=0)
            index.append(index_line(page_id, url, len(archive), len(record)))
            archive += record
            if len(archive) >= package_bytes:
                yield package()
                archive, index = bytearray(), []
        if index:
            yield package()

    return write


def write_packages(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    package_bytes: int = PACKAGE_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """One WARC record a row, in packages below ``path``.

    Rows whose payloads are equal and of ``revisit_bytes`` or more revisit the one with the smallest
    id; rows that share that id are responses each, as are all rows without an id. A null payload is empty, a
    null URL has no header. Other columns are not read. An empty table writes no package.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Copies are combined before the shuffle, and only payloads that repeat are joined; adaptive
    # execution splits a payload that holds a large share of the rows.
    first = (
        rows.filter((F.length("payload") >= revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
        .filter("first_id < last_id")
        .select("digest", "first_id")
    )
    rows = rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.expr("CASE WHEN page_id > first_id THEN first_id END").alias("refers_to")
    )
    packages = rows.mapInArrow(_write_packages(package_bytes), "package binary")
    packages.select(F.col("package").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


# Reading


def open_package(uri: str) -> BinaryIO:
    """A seekable file of any store that pyarrow opens; the path is as Spark lists it."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri if not uri.startswith("file:/") else "file:///" + uri[5:].lstrip("/"))
    return found.open_input_file(path)


def read_range(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) != n:
        raise ValueError(f"package ends inside the range {at}+{n}")
    return data


def _wide_fields(extra: bytes, wanted: list[int]) -> list[int]:
    """The given sizes and offset, those marked as full taken in order from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == ZIP64_EXTRA:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(values) if value == FULL32 else value for value in wanted]
        at += 4 + n
    return wanted


def read_directory(file: BinaryIO, length: int) -> list[dict]:
    """Members of a package: name, method, size, stored (bytes in the package) and the offset of the local header.

    The directory is found from the end record (behind a comment of any length), through the ZIP64 locator where
    the end record's fields are full. A file without an end record raises ``ValueError``.
    """
    tail_length = min(length, 22 + FULL16)
    tail = read_range(file, length - tail_length, tail_length)
    at = tail.rfind(END)
    while at >= 0:
        if at + 22 <= len(tail):
            end = struct.unpack_from(END_LAYOUT, tail, at)
            if at + 22 + end[7] == len(tail):
                break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP package: no end record")
    n, size, start = end[4], end[5], end[6]
    end_at = length - tail_length + at
    if n == FULL16 or size == FULL32 or start == FULL32:
        locator = read_range(file, end_at - 20, 20) if end_at >= 20 else b""
        if locator[:4] == LOCATOR64:
            end64 = read_range(file, struct.unpack(LOCATOR64_LAYOUT, locator)[2], 56)
            if end64[:4] != END64:
                raise ValueError("the ZIP64 locator leads to no ZIP64 end record")
            n, size, start = struct.unpack(END64_LAYOUT, end64)[7:10]
    directory, members, at = read_range(file, start, size), [], 0
    for _ in range(n):
        entry = struct.unpack_from(CENTRAL_LAYOUT, directory, at)
        if entry[0] != CENTRAL:
            raise ValueError("damaged central directory")
        name_at, extra_at = at + 46, at + 46 + entry[10]
        at = extra_at + entry[11] + entry[12]
        name = directory[name_at:extra_at].decode("utf-8" if entry[3] & UTF8_FLAG else "cp437")
        plain, stored, offset = _wide_fields(directory[extra_at : extra_at + entry[11]], [entry[9], entry[8], entry[16]])
        members.append({"name": name, "method": entry[4], "size": plain, "stored": stored, "header": offset})
    return members


def data_start(file: BinaryIO, member: dict) -> int:
    """Where a member's bytes begin; its local header has lengths of its own."""
    local = struct.unpack(LOCAL_LAYOUT, read_range(file, member["header"], 30))
    if local[0] != LOCAL:
        raise ValueError(f"no local header of {member['name']}")
    return member["header"] + 30 + local[9] + local[10]


def indexed_places(index: bytes) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of the records of each archive that a CDXJ index names, in order."""
    places: dict[str, list[tuple[int, int]]] = {}
    for line in index.decode("utf-8").splitlines():
        start = line.find("{")
        if start >= 0:
            place = json.loads(line[start:])
            places.setdefault(place["filename"], []).append((int(place["offset"]), int(place["length"])))
    return {name: sorted(p) for name, p in places.items()}


def _spans(span_bytes: int):
    schema = pa.schema([("package", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("places", pa.binary())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for package, length in rows_of(batches):
            with open_package(package) as file:
                members = read_directory(file, length)
                places: dict[str, list[tuple[int, int]]] = {}
                for member in members:
                    if member["name"].startswith("indexes/") and member["name"].endswith(".cdxj") and member["method"] == 0:
                        index = read_range(file, data_start(file, member), member["size"])
                        for name, found in indexed_places(index).items():
                            # An index may name the archive by its last part alone.
                            places.setdefault(name.rsplit("/", 1)[-1], []).extend(found)
                for member in members:
                    name = member["name"]
                    if not name.endswith((".warc", ".warc.gz")):
                        continue
                    if member["method"] != 0:
                        raise ValueError(f"{package}: {name} is compressed as a whole and has no record ranges")
                    start = data_start(file, member)
                    rows = _in_spans(sorted(set(places.get(name.rsplit("/", 1)[-1], []))), span_bytes)
                    if not rows:
                        rows = [(0, member["size"], b"")]
                    yield arrow_rows(schema, [(package, start + at, size, kept) for at, size, kept in rows])

    return spans


def _in_spans(places: list[tuple[int, int]], span_bytes: int) -> list[tuple[int, int, bytes]]:
    """Neighbouring records in spans: (start, length, packed offsets in the span and lengths)."""
    spans, now = [], []
    for place in places:
        if now and place[0] + place[1] - now[0][0] > span_bytes:
            spans.append(now)
            now = []
        now.append(place)
    if now:
        spans.append(now)
    return [
        (s[0][0], max(a + n for a, n in s) - s[0][0], b"".join(struct.pack("<2q", a - s[0][0], n) for a, n in s))
        for s in spans
    ]


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
    return headers, block


def _record_row(package: str, record: bytes) -> tuple:
    headers, block = parse_record(record)
    kind = headers.get("warc-type")
    payload, n = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        n = len(payload)
        if kind == "revisit":
            named = [line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            n = int(named[0].split(b":")[1]) if named else None
    told = headers.get("warc-payload-digest", "").partition(":")[2]
    if kind == "revisit":
        digest, intact, payload = told, True, None
    else:
        digest = hashlib.sha256(payload).hexdigest()
        intact = not headers.get("warc-payload-digest", "").startswith("sha256:") or digest == told
    return (
        package, headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-refers-to"),
        n, digest, intact, payload,
    )


def _unindexed(file: BinaryIO, start: int, size: int, piece: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive from start to end, read in pieces; gzip members or plain records."""
    at, end, held, unpack = start, start + size, bytearray(), None
    zipped = size >= 2 and read_range(file, start, 2) == b"\x1f\x8b"
    while at < end:
        data = read_range(file, at, min(piece, end - at))
        at += len(data)
        while data:
            if not zipped:
                held += data
                break
            unpack = unpack or zlib.decompressobj(31)
            held += unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = None
        while (n := _record_length(held)) is not None and n <= len(held):
            yield bytes(held[:n])
            del held[:n]
    if bytes(held).strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def _record_length(held: bytearray) -> int | None:
    """Bytes of the record that ``held`` begins with, blank lines before it included; None if its head is not whole."""
    start = 0
    while held[start : start + 2] == b"\r\n":
        start += 2
    if start:
        del held[:start]
    head = held.find(b"\r\n\r\n")
    if head < 0:
        return None
    headers = bytes(held[:head]).decode("utf-8").lower().split("\r\n")
    return head + 4 + next(int(h.split(":")[1]) for h in headers if h.startswith("content-length:"))


def _read_spans(with_payload: bool):
    schema = pa.schema(
        [("package", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
         ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("intact", pa.bool_()), ("payload", pa.binary())]
    )

    def records(package: str, start: int, size: int, places: bytes) -> Iterator[bytes]:
        with open_package(package) as file:
            if not places:
                yield from _unindexed(file, start, size)
                return
            span = read_range(file, start, size)
        for at, n in struct.iter_unpack("<2q", places):
            part = span[at : at + n]
            yield gzip.decompress(part) if part[:2] == b"\x1f\x8b" else part

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for span in rows_of(batches):
            for record in records(*span):
                row = _record_row(span[0], record)
                rows.append(row if with_payload else (*row[:-1], None))
                size += len(record)
                if size > 8_000_000 or len(rows) >= 5000:
                    yield arrow_rows(schema, rows)
                    rows, size = [], 0
        if rows:
            yield arrow_rows(schema, rows)

    return read


def read_packages(
    spark: SparkSession, path: str, with_payload: bool = True, span_bytes: int = SPAN_BYTES, name: str = "*"
) -> DataFrame:
    """Per WARC record of all packages below ``path`` whose file name matches ``name``.

    Columns: package, record_id, record_type, target_uri, refers_to_id, payload_bytes, payload_digest, intact (the
    digest that the record names is its payload's), payload (null for revisits, or if not asked
    for). Spark lists the packages. Members but archives and indexes are not read; index and archive must be stored, a
    package cut short or with an archive that is deflated raises. Empty files are no packages; no package gives an empty result.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", name)
        .option("recursiveFileLookup", "true")
        .load(path)
        .filter("length > 0")
        .select("path", "length")
    )
    spans = files.mapInArrow(_spans(span_bytes), "package string, start long, size long, places binary")
    # A package may hold any number of spans; they are dealt evenly, whatever package they are of. A span is a few
    # bytes and stands for many, so the number of tasks follows the packages, not the rows that are dealt.
    size = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES))
    return spans.repartition(tasks, "package", "start").mapInArrow(_read_spans(with_payload), RECORD_COLUMNS)


def with_revisited_payloads(records: DataFrame) -> DataFrame:
    """Records with the payloads of revisits taken from the responses that they refer to; null where there is none."""
    responses = records.filter("record_type = 'response'").groupBy("record_id").agg(F.first("payload").alias("seen"))
    return (
        records.join(responses.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
        .withColumn("payload", F.coalesce("payload", "seen"))
        .select(records.columns)
    )


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes packages of pages and reads them back.

    Per page: page_id, payload_bytes, payload_digest, record_type (response or revisit), refers_to, intact. Rows
    as in ``write_packages``. Packages go below ``path``, a new folder of the shared one if not given.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "packages")
    write_packages(pages, path)
    records = read_packages(spark, path, with_payload=False, name="part-*")
    number = lambda name: F.regexp_extract(name, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to_id").alias("refers_to"),
        "intact",
    )
