"""Packages against Python's own ZIP module, records by exact round trips."""

import gzip
import io
import os
import struct
import zipfile
from hashlib import sha256

import pytest

from vecloom.llm import zip_archives as za

COLUMNS = "page_id long, url string, html string, digest string, first_id int, payload int, value string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "v") for r in rows], COLUMNS).repartition(3)


def awkward():
    text = "<p>copy</p>" * 30
    rows = [(i, f"http://h{i % 5}.example/{i}", f"<html>page {i} ü \r\n\r\n WARC/1.1</html>" * 9) for i in range(30)]
    rows += [(100 + i, "http://copies.example/", text) for i in range(25)]
    rows += [(200, None, None), (201, "", ""), (202, "http://a b/\r\nx: ü", "short"), (203, "u", "short")]
    rows += [(None, "http://x/", text), (None, None, None), (100, "again", text), (300, "long", "long ü " * 100_000)]
    return rows


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html] = min(first.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = page_id is not None and len(data) >= 100 and page_id > first[html]
        out.append((page_id, len(data), sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None, True))
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def test_round_trip_of_awkward_pages(spark, tmp_path):
    rows = awkward()
    got = za.archived_pages(pages(spark, rows), f"file://{tmp_path}/p").collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_payloads_come_back_whole_from_small_spans_and_revisits(spark, tmp_path):
    rows = awkward()
    path = f"file://{tmp_path}/p"
    za.write_packages(pages(spark, rows), path, package_bytes=2_000)
    assert len(os.listdir(tmp_path / "p")) > 4
    records = za.with_revisited_payloads(za.read_packages(spark, path, span_bytes=500, name="part-*"))
    got = sorted((r.record_id, r.target_uri, bytes(r.payload).decode()) for r in records.collect() if r.record_id != "<urn:page:>")
    want = sorted((f"<urn:page:{i}>", u and za._safe(u), h or "") for i, u, h in rows if i is not None)
    assert [(a, b or None, c) for a, b, c in got] == [(a, b or None, c) for a, b, c in want]


def test_empty_table(spark, tmp_path):
    assert za.archived_pages(pages(spark, [])).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_agrees_with_zipfile(zip64):
    members = [("a.txt", b"one"), ("dir/ü.bin", bytes(range(256)) * 9), ("empty", b"")]
    package = za.zip_package(members, zip64)
    with zipfile.ZipFile(io.BytesIO(package)) as told:
        assert told.testzip() is None and [(i.filename, told.read(i)) for i in told.infolist()] == members
    assert read_members(package) == members


def read_members(package):
    file = io.BytesIO(package)
    found = za.read_directory(file, len(package))
    return [(m["name"], za.read_range(file, za.data_start(file, m), m["stored"])) for m in found]


def test_packages_of_others_with_comments_extras_and_many_members():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as made:
        for i in range(66_000):  # more than the plain end record can count
            made.writestr(f"m{i}", str(i))
        made.comment = b"PK\x05\x06" + b"x" * 60_000
    found = read_members(held.getvalue())
    assert len(found) == 66_000 and found[65_999] == ("m65999", b"65999")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as made, made.open("big", "w", force_zip64=True) as member:
        member.write(b"streamed")
    assert read_members(held.getvalue()) == [("big", b"streamed")]


def test_offsets_beyond_four_gigabytes(tmp_path):
    """A sparse file: the member lies behind 5 GB of nothing, so only ZIP64 fields can place it."""
    at = 5 << 30
    local, central = za._member_headers("far", b"away", at, True)
    end64_at = at + len(local) + 4 + len(central)
    tail = struct.pack(za.END64_LAYOUT, za.END64, 44, 45, 45, 0, 0, 1, 1, len(central), at + len(local) + 4)
    tail += struct.pack(za.LOCATOR64_LAYOUT, za.LOCATOR64, 0, end64_at, 1)
    tail += struct.pack(za.END_LAYOUT, za.END, 0, 0, za.FULL16, za.FULL16, za.FULL32, za.FULL32, 0)
    path = tmp_path / "far.zip"
    with open(path, "wb") as file:
        file.seek(at)
        file.write(local + b"away" + central + tail)
    with za.open_package(f"file://{path}") as file:
        (member,) = za.read_directory(file, os.path.getsize(path))
        assert za.read_range(file, za.data_start(file, member), 4) == b"away"


@pytest.mark.parametrize("kind", ["data.warc", "data.warc.gz"])
def test_archives_without_an_index_are_read_in_pieces(spark, tmp_path, kind):
    payloads = [f"payload {i} ü \r\n\r\n".encode() * (i * 3000) for i in range(6)]
    records = [za.warc_record(i, f"u{i}", p, sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    data = b"".join(map(gzip.compress, records)) if kind.endswith("gz") else b"".join(records)
    (tmp_path / "other.wacz").write_bytes(za.zip_package([("archive/" + kind, data), ("note.txt", b"x")], comment=b""))
    rows = za.read_packages(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_id, bytes(r.payload), r.intact) for r in rows) == [(f"<urn:page:{i}>", p, True) for i, p in enumerate(payloads)]
    file = io.BytesIO(data)
    assert list(za._unindexed(file, 0, len(data), piece=1000))[0].startswith(b"WARC/1.1")


def test_damage_is_told(spark, tmp_path):
    with pytest.raises(ValueError, match="no end record"):
        za.read_directory(io.BytesIO(b"x" * 100), 100)
    record = za.warc_record(1, "u", b"payload", "0" * 64, None)
    assert za._record_row("p", record)[-2] is False
    with pytest.raises(ValueError, match="cut short"):
        za.parse_record(record[:-9])
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as made:
        made.writestr("archive/data.warc", record * 50)
    (tmp_path / "x.zip").write_bytes(held.getvalue())
    with pytest.raises(Exception, match="compressed as a whole"):
        za.read_packages(spark, f"file://{tmp_path}").collect()
