"""WARC packages: exact round trips, ZIP and ZIP64 directories, broken archives, and the contract's columns."""

import base64
import hashlib
import io
import random
import zipfile

import pyarrow.fs as pafs
import pytest

from basketflow.llm import zip_warc
from basketflow.llm.zip_warc import data_offset, directory, page_records, read_records, record_ranges, write_packages

SCHEMA = "page_id long, url string, html string, key string, number string"


def reader(data):
    return lambda offset, length: data[offset : offset + length]


def pages(seed=1, count=300):
    draw = random.Random(seed)
    rows = [(i, f"http://h/{i} x\r\nInjected: y", f"<p>{draw.randrange(120)}é</p>" * draw.randint(1, 40), "k", "n") for i in range(count)]
    rows += [(1000 + i, "http://same", "<html>one</html>", "k", "n") for i in range(150)]
    rows += [(2000, None, None, "k", "n"), (2001, "u", "", "k", "n"), (None, "v", "", None, None), (None, "w", "<html>one</html>", "k", "n")]
    rows += [(3, rows[3][1], rows[3][2], "k", "n"), (2002, "big", "\r\n\r\n" + "x" * 3_000_000, "k", "n")]
    draw.shuffle(rows)
    return rows


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("records", [7, 50_000])
def test_round_trip(spark, monkeypatch, records):
    monkeypatch.setattr(zip_warc, "PACKAGE_RECORDS", records)
    monkeypatch.setattr(zip_warc, "RANGE_BYTES", 2000 if records == 7 else 4 << 20)
    rows = pages(records)
    packages = write_packages(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sum(r.records for r in packages.collect()) == len(rows)
    found = page_records(packages).collect()
    assert page_records(packages).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in found) == sorted(
        (str(r[0]), len((r[2] or "").encode()), digest(r[2])) for r in rows
    )
    largest = {}
    for page, _, html, *_ in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    by_digest = {digest(h): p for h, p in largest.items()}
    for name in by_digest:
        same = [r for r in found if r.payload_digest == name]
        (one,) = [r for r in same if r.record_type == "response"]
        assert one.page_id == by_digest[name] and one.refers_to is None
        assert all(r.refers_to == one.page_id for r in same if r.record_type == "revisit")
    payloads = read_records(packages).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in payloads} == {h.encode() for h in largest}


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "a", "xx", "", ""), (2, "b", "xx", "", ""), (3, "c", "yyyy", "", ""), (4, "d", "yyyy", "", "")]
    found = page_records(write_packages(spark.createDataFrame(rows, SCHEMA), least_bytes=3)).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in found} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_empty_table(spark):
    packages = write_packages(spark.createDataFrame([], SCHEMA))
    assert packages.collect() == [] and page_records(packages).collect() == []


def test_packages_are_plain_zip_files(spark):
    packages = write_packages(spark.createDataFrame(pages(5, 40), SCHEMA).coalesce(1)).collect()
    for row in packages:
        system, path = pafs.FileSystem.from_uri(row.path)
        data = system.open_input_file(path).read()
        with zipfile.ZipFile(io.BytesIO(data)) as package:
            assert package.testzip() is None
            assert {i.compress_type for i in package.infolist()} == {zipfile.ZIP_STORED}
            archive = package.read(zip_warc.ARCHIVE)
        start = data_offset(reader(data), next(m for m in directory(reader(data), len(data)) if m.name == zip_warc.ARCHIVE))
        assert data[start : start + len(archive)] == archive
        ranges = sorted(record_ranges(reader(data), len(data)))
        assert len(ranges) == row.records and ranges[0][0] == start and sum(n for _, n in ranges) == len(archive)


@pytest.mark.parametrize("limit", [None, 50, 3])
def test_zip64_directories(monkeypatch, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 4)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        for i in range(30):
            package.writestr(zipfile.ZipInfo(f"f/{i}-ü"), b"y" * i * 5)
        package.comment = b"a comment with PK\5\6 in it, long enough to be taken for an end"
    data = out.getvalue()
    members = list(directory(reader(data), len(data)))
    assert [(m.name, m.size) for m in members] == [(f"f/{i}-ü", i * 5) for i in range(30)]
    for m in members:
        start = data_offset(reader(data), m)
        assert data[start : start + m.size] == b"y" * m.size


def test_many_entries_need_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        for i in range(66_000):
            package.writestr(zipfile.ZipInfo(str(i)), b"")
    data = out.getvalue()
    assert sum(1 for _ in directory(reader(data), len(data))) == 66_000


def test_broken_packages_are_refused():
    with pytest.raises(ValueError, match="central directory"):
        list(directory(reader(b"x" * 500), 500))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("a", b"z" * 1000)
    data = out.getvalue()
    (member,) = directory(reader(data), len(data))
    with pytest.raises(ValueError, match="compressed"):
        data_offset(reader(data), member)


def test_a_task_per_share_of_the_packages(spark, monkeypatch, tmp_path):
    """Places are small, what they stand for is not: reading is spread by bytes, whatever adaptive execution would join."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"{i} " * 4000) for i in range(300)], "page_id long, url string, html string")
    packages = zip_warc.write_packages(pages.repartition(2), folder=str(tmp_path))
    total = sum(r.bytes for r in packages.collect())
    monkeypatch.setattr(zip_warc, "TASK_BYTES", 10_000)
    monkeypatch.setattr(zip_warc, "RANGE_BYTES", 5_000)
    assert zip_warc.read_tasks(packages) == -(-total // 10_000) > 10
    records = zip_warc.read_records(packages)
    assert records.rdd.getNumPartitions() == zip_warc.read_tasks(packages)
    assert sorted(r.page_id for r in records.select("page_id").collect()) == list(range(300))
    assert zip_warc.read_tasks(packages.select("path")) >= 2
