import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import warc


def package(members, method=zipfile.ZIP_STORED, comment=b"", zip64=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members.items():
            with z.open(zipfile.ZipInfo(name) if method == 0 else name, "w", force_zip64=zip64) as f:
                f.write(data)
        z.comment = comment
    return out.getvalue()


def as_zip64(raw):
    """The same package with its end and entries in ZIP64 form."""
    at = raw.rfind(b"PK\x05\x06")
    n, size, offset = struct.unpack_from("<HII", raw, at + 10)
    directory, entries = raw[offset : offset + size], b""
    x = 0
    for _ in range(n):
        compressed, full, name, extra, comment = struct.unpack_from("<IIHHH", directory, x + 20)
        header = struct.unpack_from("<I", directory, x + 42)[0]
        more = struct.pack("<HHB", 0x9999, 1, 7) + struct.pack("<HHQQQ", 1, 24, full, compressed, header)
        entries += directory[x : x + 20] + b"\xff" * 8 + struct.pack("<HHH", name, len(more), 0) + directory[x + 34 : x + 42] + b"\xff" * 4 + directory[x + 46 : x + 46 + name] + more
        x += 46 + name + extra + comment
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(entries), offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, offset + len(entries), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return raw[:offset] + entries + end64 + locator + end


@pytest.mark.parametrize("form", ["plain", "comment", "zip64", "forced"])
def test_members_are_located(form):
    data = {"a/é.bin": bytes(range(256)) * 40, "b": b"", "indexes/x": b"PK\x05\x06 not the end"}
    raw = package(data, comment=b"PK\x05\x06 in a comment, padded" * 3 if form == "comment" else b"", zip64=form == "forced")
    raw = as_zip64(raw) if form == "zip64" else raw
    stream = io.BytesIO(raw)
    found = warc.members(stream, len(raw))
    assert set(found) == set(data)
    for name, content in data.items():
        at = warc.data_offset(stream, found[name])
        assert raw[at : at + found[name].size] == content


def test_damage_is_noticed():
    raw = package({"a": b"x" * 100})
    with pytest.raises(warc.ZipError):
        warc.members(io.BytesIO(raw[:-30]), len(raw) - 30)
    squeezed = package({"a": b"x" * 100}, zipfile.ZIP_DEFLATED)
    with pytest.raises(warc.ZipError):
        warc.data_offset(io.BytesIO(squeezed), warc.members(io.BytesIO(squeezed), len(squeezed))["a"])
    digest = hashlib.sha256(b"body").hexdigest()
    record = warc.warc_record("response", 1, "http://x/ y\r\n", b"body", digest, None)
    assert warc.parse_record(record)["payload"] == b"body" and b"\r\ny" not in record
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"body", b"bodz"))
    with pytest.raises(ValueError):
        warc.parse_record(record[:-8])


def test_round_trip(spark, tmp_path):
    long = "<p>é𝄞\r\n\r\n</p>" * 20
    rows = [(3, "u", long), (1, None, long), (2, "http://h/ü ?q#f", long), (4, "x", "short"), (5, "y", "short"), (6, "z", None), (7, None, ""), (8, "big", "b" * 3_000_000), (9, "u", long + "!"), (3, "u", long), (None, "n", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", most_bytes=2_000)
    files = archives.collect()
    assert sum(f.records for f in files) == len(rows) and len(files) > 1 and all(f.path.endswith(".wacz") for f in files)
    for f in files:
        with zipfile.ZipFile(f.path.removeprefix("file://")) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
    got = warc.read_archives(archives, payloads=True, range_bytes=500).collect()
    expect = sorted((i, (h or "").encode()) for i, _, h in rows if i is not None)
    assert sorted(r.page_id for r in got if r.page_id is not None) == [i for i, _ in expect]
    texts = dict(expect)
    for r in got:
        body = texts.get(r.page_id, long.encode())
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
        first = 1 if body == long.encode() and r.page_id != 1 else None
        assert (r.record_type, r.refers_to) == (("revisit", 1) if first else ("response", None))
    warc.delete_folder(f"file://{tmp_path}/w")
    warc.delete_folder(f"file://{tmp_path}/w")
    assert not (tmp_path / "w").exists()


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    assert warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).count() == 0
