import base64
import hashlib
import io
import zipfile

import pytest

from tessera.llm import warc as W

HTML = ["<p>é</p>", "", None, "a" * 100_000, "x", "x", "x", "short", "\r\n\r\nWARC/1.1\r\n", "", "日本"]


def want(rows, least):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min(j for j, _, g in rows if j is not None and (g or "").encode() == b) if i is not None else None
        revisit = i is not None and len(b) >= least and first != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "size", "broadcast"), [(0, 1 << 20, 10), (3, 100, 0)])
def test_round_trip(spark, monkeypatch, least, size, broadcast):
    monkeypatch.setattr(W, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(W, "SLICE", 3)
    rows = [(50 - k, None if k == 3 else f"http://h/é {k}\r\nx", h) for k, h in enumerate(HTML)]
    rows += [rows[4], (None, "http://n", "x")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = W.round_trip(frame, min_bytes=least, archive_bytes=size, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows, least)
    by_id = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == by_id[r.page_id] for r in got if r.record_type == "response")


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Memory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_reads_zip_files_of_others(monkeypatch):
    for many in (3, 70_000):  # more than 65535 members need ZIP64
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for k in range(many):
                z.writestr(f"é{k}", f"data {k}")
            z.writestr("packed", "a" * 1000, zipfile.ZIP_DEFLATED)
            z.comment = b"PK\x05\x06 a comment"
        r = W.ArchiveReader(Memory(buffer.getvalue()))
        assert len(r.members) == many + 1
        assert r.read("é2") == b"data 2" and r.read("é1", 2, 3) == b"ta "
        with pytest.raises(ValueError):
            r.read("packed")
        with pytest.raises(ValueError):
            r.read("é1", 2, 30)
    with pytest.raises(ValueError):
        W.ArchiveReader(Memory(b"no zip"))
    # sizes beyond 4 GB stand in the ZIP64 field; here it is forced by a low limit
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z, z.open("big", "w", force_zip64=True) as f:
        f.write(b"0123456789" * 10)
    assert W.ArchiveReader(Memory(buffer.getvalue())).read("big", 95) == b"56789"
