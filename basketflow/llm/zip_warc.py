"""Web pages as WARC records in ZIP packages, and a reader that fetches records by range without extraction.

A package is a ZIP archive with stored (uncompressed) members: a WARC file
whose records are gzip members of their own, an index with the place of every
record, and a description.  The reader parses the end of a package, its ZIP64
records and its central directory, finds the stored archive and index, and
turns the index into byte ranges; Spark deals the ranges to tasks, and each
record is read from its range alone.

Packages are written below the shared folder under names that no other task
attempt uses; only what a finished task reported is read, so attempts lost
with an executor leave files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.llm.bitmap import bitmap, is_set
from basketflow.session import Scratch, fresh_path, settle

PACKAGE_RECORDS, PACKAGE_BYTES = 50_000, 512 << 20  # a package ends with the record that reaches either
BITMAP_BITS = 23  # of the payloads that several pages share: 1 MB, whatever the input
TASK_BYTES = 128 << 20  # of packages, read by one task
RANGE_BYTES = 4 << 20  # records that begin in one such stretch are fetched together
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ---------------------------------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(fields: list[tuple[str, str | None]], block: bytes, level: int = 1) -> bytes:
    """One WARC record as a gzip member; fields without a value are left out."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and the block of one gzip member."""
    data = zlib.decompress(raw, 31)
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    return fields, data[end + 4 : end + 4 + length]


# --- packages --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """A file in a package: compression method (0: stored), sizes, and where its local header stands."""

    name: str
    method: int
    packed: int
    size: int
    header: int


def _end_of_directory(read, size: int) -> tuple[int, int, int]:
    """(entries, length, offset) of the central directory, from the ZIP64 records where there are any."""
    tail_size = min(size, 22 + 0xFFFF + 20)
    tail = read(size - tail_size, tail_size)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)  # the signature may occur in the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package, or cut short")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = read(where, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("broken ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return entries, length, offset


def directory(read, size: int) -> Iterator[Member]:
    """The members of a package of ``size`` bytes; ``read(offset, length)`` fetches a range."""
    entries, length, offset = _end_of_directory(read, size)
    buffer, end = b"", offset + length
    for _ in range(entries):
        while True:  # a megabyte at a time: a directory may hold millions of entries
            whole = len(buffer) >= 46 and len(buffer) >= 46 + sum(struct.unpack_from("<HHH", buffer, 28))
            if whole or offset >= end:
                break
            more = read(offset, min(1 << 20, end - offset))
            buffer, offset = buffer + more, offset + len(more)
        if not whole or buffer[:4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, full = struct.unpack_from("<H", buffer, 10)[0], *struct.unpack_from("<II", buffer, 20)
        names, extras, comments = struct.unpack_from("<HHH", buffer, 28)
        header = struct.unpack_from("<I", buffer, 42)[0]
        name, extra = buffer[46 : 46 + names].decode("utf-8", "replace"), buffer[46 + names : 46 + names + extras]
        while len(extra) >= 4:
            kind, count = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values stand only for the fields that are full
                values = iter(struct.unpack_from(f"<{count // 8}Q", extra, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + count :]
        buffer = buffer[46 + names + extras + comments :]
        yield Member(name, method, packed, full, header)


def data_offset(read, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    local = read(member.header, 30)
    if local[:4] != b"PK\3\4":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def record_ranges(read, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of every record, by the indexes of its stored archives."""
    members = {m.name: m for m in directory(read, size)}
    starts = {name.rpartition("/")[2]: data_offset(read, m) for name, m in members.items() if name.startswith("archive/")}
    for name, member in members.items():
        if not name.startswith("indexes/"):
            continue
        at, left, rest = data_offset(read, member), member.size, b""
        while left:
            piece = read(at, min(left, 1 << 20))
            at, left = at + len(piece), left - len(piece)
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines:
                entry = json.loads(line[line.index(b"{") :])
                yield starts[entry["filename"]] + int(entry["offset"]), int(entry["length"])


class _Package:
    """A package being written, record by record, to a stream that cannot seek."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        system, path = pafs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.bytes = 0

    def add(self, key: str, raw: bytes) -> None:
        entry = {"offset": str(self.bytes), "length": str(len(raw)), "filename": ARCHIVE.rpartition("/")[2]}
        self.index.append(f"{key} {json.dumps(entry)}\n")
        self.archive.write(raw)
        self.bytes += len(raw)

    def full(self) -> bool:
        return len(self.index) >= PACKAGE_RECORDS or self.bytes >= PACKAGE_BYTES

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in sorted(self.index):
                index.write(line.encode())
        about = {"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": self.bytes}, {"path": INDEX}]}
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(about))
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return self.path, size, len(self.index)


def _uri(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, as Arrow reads it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def _writer(folder: str, run: str, date: str):
    def record_id(number: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{number}')}>"

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in range(batch.num_rows):
                number, page, url, html, target, target_url = (batch.column(i)[row].as_py() for i in range(6))
                payload = (html or "").encode("utf-8", "replace")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                block = head if target is not None else head + payload
                fields = [
                    ("WARC-Type", "response" if target is None else "revisit"), ("WARC-Record-ID", record_id(number)), ("WARC-Date", date),
                    ("WARC-Target-URI", None if url is None else _clean(url)), ("WARC-Page-ID", None if page is None else str(page)),
                    ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                    ("WARC-Profile", None if target is None else REVISIT_PROFILE),
                    ("WARC-Refers-To", None if target is None else record_id(target)),
                    ("WARC-Refers-To-Target-URI", None if target is None or target_url is None else _clean(target_url)),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                package = package or _Package(folder)
                package.add(f"{_clean(url or '-')} {date}", record_bytes(fields, block))
                if package.full():
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "records"])

    return run_


def _marked(marks, wanted: bool):
    """The rows whose payload may, or cannot, belong to a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array(is_set(marks.value, slots) == wanted))

    return run


def write_packages(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Writes a WARC record for every row of ``pages`` (page_id, url, html); returns the packages (path, bytes, records).

    The payload is the html in UTF-8 (null: empty).  Of records with equal
    payloads of at least ``least_bytes`` bytes the one with the largest
    page_id is a response, the others are revisits of it; rows that repeat
    that page_id and payload revisit one of them.  A null page_id comes before
    all others, a null url leaves out its header.  Only the key, id and url of
    a payload are grouped; a payload that a third of all rows share is one
    group row, and the join back to the pages splits such a key.
    """
    spark = pages.sparkSession
    folder = _uri(spark, folder or fresh_path(spark, "packages"))
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    with Scratch(spark) as scratch:
        rows = scratch.settle(
            pages.select(
                F.monotonically_increasing_id().alias("number"), F.col("page_id").cast("long").alias("page_id"),
                F.col("url").cast("string").alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("key"),
            ).withColumn("slot", F.xxhash64("key"))
        )
        large = rows.where(F.octet_length("html") >= least_bytes)
        groups = large.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "number", "url")).alias("first"))
        groups = groups.where("n > 1").select("key", F.col("first.number").alias("target"), F.col("first.url").alias("target_url"))
        groups = scratch.settle(groups)
        # only pages whose payload others may share meet the groups; the rest stays without a shuffle
        marks = spark.sparkContext.broadcast(bitmap(groups.select(F.xxhash64("key").alias("slot")), "slot", BITMAP_BITS))
        alone = rows.mapInArrow(_marked(marks, False), rows.schema)
        shared = rows.mapInArrow(_marked(marks, True), rows.schema).join(groups, "key", "left")
        columns = ["number", "page_id", "url", "html"]
        none = [F.lit(None).cast("long").alias("target"), F.lit(None).cast("string").alias("target_url")]
        other = F.col("target") != F.col("number")
        records = alone.select(*columns, *none).union(
            shared.select(*columns, *[F.when(other, F.col(c)).alias(c) for c in ("target", "target_url")])
        )
        return settle(records.mapInArrow(_writer(folder, uuid.uuid4().hex, date), "path string, bytes long, records long"))


# --- reading ---------------------------------------------------------------------------------------------------------


def _opened(path: str):
    system, name = pafs.FileSystem.from_uri(path)
    file = system.open_input_file(name)
    return file, lambda offset, length: file.read_at(length, offset)


def _indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            file, read = _opened(path)
            with file:
                held: list[tuple[int, int]] = []
                for place in record_ranges(read, file.size()):
                    held.append(place)
                    if len(held) == 10_000:
                        yield _ranges_batch(path, held)
                        held = []
                yield _ranges_batch(path, held)


def _ranges_batch(path: str, held: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([path] * len(held), pa.string()), pa.array([o for o, _ in held], pa.int64()), pa.array([n for _, n in held], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "offset", "length"])


RECORD = "record_id string, record_type string, page_id long, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _records(with_payload: bool):
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, read = _opened(path)
                rows = []
                with file:
                    start = places[0]["offset"]
                    stretch = read(start, places[-1]["offset"] + places[-1]["length"] - start)
                for place in places:
                    at = place["offset"] - start
                    fields, block = parse_record(stretch[at : at + place["length"]])
                    kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    payload = None if kind == "revisit" else block[block.index(b"\r\n\r\n") + 4 :]
                    if payload is not None and digest(payload) != named:
                        raise ValueError(f"{fields['warc-record-id']} of {path}: payload and digest differ")
                    page = fields.get("warc-page-id")
                    rows.append((
                        fields["warc-record-id"], kind, None if page is None else int(page), fields.get("warc-target-uri"),
                        fields.get("warc-refers-to"), named, None if payload is None else len(payload), payload if with_payload else None,
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def read_tasks(packages: DataFrame) -> int:
    """A task per TASK_BYTES of packages, or per package where no bytes are given; not fewer than there are cores."""
    size = F.sum("bytes") if "bytes" in packages.columns else F.count(F.lit(1)) * TASK_BYTES
    total = packages.agg(size).first()[0] or 0
    return max(packages.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def read_records(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the packages (path, …): ids, types, headers, digest and length of the payload, the payload.

    Revisits have no payload of their own.  Indexes are read a package per
    row; their ranges are dealt anew, so a large package is read by many tasks.
    What is dealt are places, which are small, so the number of tasks follows
    from the bytes that they stand for, not from their own size.
    """
    tasks = read_tasks(packages)
    spread = packages.select("path").repartition(tasks, "path")
    ranges = spread.mapInArrow(_indexes, "path string, offset long, length long")
    ranges = ranges.withColumn("stretch", F.floor(F.col("offset") / RANGE_BYTES)).repartition(tasks, "path", "stretch")
    together = ranges.groupBy("path", "stretch").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    return together.select("path", "places").mapInArrow(_records(with_payload), RECORD)


def page_records(packages: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), one per record.

    A revisit takes the payload's length and the page it refers to from its
    response.  A response that many records revisit is a join key that
    adaptive execution splits.  The result is settled.
    """
    with Scratch(packages.sparkSession) as scratch:
        records = scratch.settle(read_records(packages, with_payload=False).drop("payload", "url"))
        responses = records.where("record_type = 'response'").select(
            F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"),
            F.col("payload_digest").alias("_digest"),
        )
        joined = records.join(responses, "refers_to", "left")
        same = F.col("_digest") == F.col("payload_digest")
        return settle(
            joined.select(
                "page_id", F.coalesce("payload_bytes", F.when(same, F.col("_bytes"))).alias("payload_bytes"), "payload_digest",
                "record_type", F.col("_page").alias("refers_to"),
            )
        )
