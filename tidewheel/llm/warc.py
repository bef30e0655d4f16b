"""WARC records in ZIP packages: written by tasks, read back by ranges without extraction.

A package holds archive/data.warc.gz, one gzip member per record, and indexes/index.cdxj, one line
per record with its range; both are stored, so that a range of the member is a range of the file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean_batches, partitions, quoted

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ID_PREFIX = "urn:tidewheel:page:"
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """The file system of a URI (local, HDFS, S3, ...) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def delete_folder(uri: str) -> None:
    from pyarrow import fs

    files, path = filesystem(uri)
    if files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)


# --- ZIP -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    compressed: int
    header: int


class ZipError(ValueError):
    """The file is no ZIP package, or a damaged one."""


def _end(stream, size: int) -> tuple[int, int, int]:
    """Offset, size and entries of the central directory, from the ZIP64 records if there are any."""
    tail_size = min(size, 22 + 65_535 + 20)
    stream.seek(size - tail_size)
    tail = stream.read(tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0 or at + 22 > len(tail):
        raise ZipError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        if at < 20 or tail[at - 20 : at - 16] != b"PK\x06\x07":
            raise ZipError("no ZIP64 locator")
        (where,) = struct.unpack_from("<Q", tail, at - 20 + 8)
        stream.seek(where)
        record = stream.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ZipError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, entries


def members(stream, size: int) -> dict[str, Member]:
    """The central directory of a package; ZIP64 sizes and offsets taken from the extra fields."""
    offset, length, entries = _end(stream, size)
    stream.seek(offset)
    directory = stream.read(length)
    found, at = {}, 0
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ZipError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        compressed, full, n, extra, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        x, end = at + 46 + n, at + 46 + n + extra
        while x + 4 <= end:
            tag, width = struct.unpack_from("<HH", directory, x)
            if tag == 1:
                y = x + 4
                if full == 0xFFFFFFFF:
                    (full,), y = struct.unpack_from("<Q", directory, y), y + 8
                if compressed == 0xFFFFFFFF:
                    (compressed,), y = struct.unpack_from("<Q", directory, y), y + 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack_from("<Q", directory, y)
            x += 4 + width
        found[name] = Member(name, method, full, compressed, header)
        at = end + comment
    return found


def data_offset(stream, member: Member) -> int:
    """Where a stored member's bytes begin; ZipError if it is compressed."""
    if member.method != 0 or member.size != member.compressed:
        raise ZipError(f"{member.name} is not stored")
    stream.seek(member.header)
    local = stream.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ZipError("damaged local header")
    n, extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n + extra


# --- WARC ------------------------------------------------------------------------------------


def warc_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit holds the HTTP header only, with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    ValueError if the record is damaged, lengths or the digest of a payload that is there included.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    whole = fields["warc-type"] != "revisit"
    if whole and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't fit its digest")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(ID_PREFIX)) else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload": payload if whole else None,
        "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
    }


# --- operators -------------------------------------------------------------------------------


def revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, digest, refers_to: of equal payloads of least_bytes or more, the smallest page_id is
    referred to by the others. Digests only; a group of any size meets in partial aggregates."""
    marks = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    large = marks.filter(F.col("size") >= least_bytes)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = large.join(first, "digest").filter("first <> page_id OR page_id IS NULL AND first IS NOT NULL")
    return later.groupBy("page_id", "digest").agg(F.first("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, most_bytes: int = 256 << 20, least_bytes: int = 100) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html) into ZIP packages below folder.

    Each task streams its rows to packages of about most_bytes, memory being that of a record and
    of a package's index. A package appears under its name when it is complete; a task that runs
    again writes the same names. Returns path, records, bytes, materialised: the packages are there.

    Null html counts as empty; a null url is about:blank; a null page_id has the empty id. Repeated
    rows of one page_id and payload are alike: all of them responses, or all revisits.
    """
    lean_batches(pages.sparkSession)
    same = revisits(pages, least_bytes)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    same = same.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    rows = rows.join(same, rows.page_id.eqNullSafe(F.col("__id")) & (rows.digest == F.col("__digest")), "left")
    rows = rows.select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, attempt, number = f"{root}/part-{task.partitionId():06d}", task.taskAttemptId(), 0
        done: list[tuple[str, int, int]] = []
        package = None
        for batch in batches:
            for row in batch.to_pylist():
                if package is None:
                    package = _Package(files, f"{stem}-{number:04d}.wacz", attempt)
                package.add(**row)
                if package.offset >= most_bytes:
                    done.append(package.close())
                    package, number = None, number + 1
        if package is not None:
            done.append(package.close())
        for path, n, size in done:
            name = path.rsplit("/", 1)[1]
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "records": [n], "bytes": [size]})

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


class _Package:
    def __init__(self, files, path: str, attempt: int) -> None:
        self.files, self.path, self.draft = files, path, f"{path}.{attempt}"
        self.stream = files.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.offset, self.index = 0, []

    def add(self, page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> None:
        kind = "response" if refers_to is None else "revisit"
        raw = gzip.compress(warc_record(kind, page_id, url, html.encode(), digest, refers_to), 6, mtime=0)
        self.data.write(raw)
        entry = {"url": url or "about:blank", "offset": self.offset, "length": len(raw), "digest": f"sha256:{digest}"}
        self.index.append(f"{quote(url or 'about:blank', safe='/:')} {DATE[:10].replace('-', '')} {json.dumps(entry)}\n")
        self.offset += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.index)))
        self.zip.close()
        self.stream.close()
        self.files.move(self.draft, self.path)
        return self.path, len(self.index), self.offset


class _Sink:
    """A stream that can't seek, for zipfile."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, path_col: str = "path", range_bytes: int = 4 << 20, payloads: bool = False) -> DataFrame:
    """The records of the packages whose paths are in archives.

    First each package's directories and index are read, which gives ranges of about range_bytes
    of its stored WARC member; then these are dealt out and read. The payload column is there if
    payloads. No package is unpacked or read whole. Null paths give nothing, a path given twice is
    read twice; a package without records gives none.
    """
    spark = archives.sparkSession

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, local = filesystem(path)
                with files.open_input_file(local) as stream:
                    found = members(stream, stream.size())
                    base = data_offset(stream, found[DATA])
                    stream.seek(data_offset(stream, found[INDEX]))
                    lines = stream.read(found[INDEX].size).decode().splitlines()
                entries = sorted((e["offset"], e["length"]) for e in (json.loads(x.split(" ", 2)[2]) for x in lines))
                starts, lengths, end = [], [], -1
                for offset, length in entries:
                    if offset == end and end - (starts[-1] - base) < range_bytes:
                        lengths[-1].append(length)
                    else:
                        starts.append(base + offset)
                        lengths.append([length])
                    end = offset + length
                for i in range(0, len(starts), 100):
                    some = {"path": [path] * len(starts[i : i + 100]), "start": starts[i : i + 100], "lengths": lengths[i : i + 100]}
                    yield pa.RecordBatch.from_pydict(some, pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), *([("payload", pa.binary())] if payloads else []), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            for row in batch.to_pylist():
                files, local = filesystem(row["path"])
                with files.open_input_file(local) as stream:
                    stream.seek(row["start"])
                    raw = stream.read(sum(row["lengths"]))
                records, at = [], 0
                for length in row["lengths"]:
                    record = parse_record(zlib.decompress(raw[at : at + length], 31))
                    records.append(record if payloads else {k: v for k, v in record.items() if k != "payload"})
                    at += length
                yield pa.RecordBatch.from_pylist(records, schema)

    paths = archives.select(F.col(quoted(path_col)).alias("path")).filter("path IS NOT NULL")
    ranges = paths.mapInArrow(locate, "path string, start long, lengths array<long>").repartition(partitions(spark))
    fields = RECORD if payloads else RECORD.replace("payload binary, ", "")
    return ranges.mapInArrow(read, fields)

