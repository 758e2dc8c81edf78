import base64
import hashlib

import pytest

from cellweave.llm import warc

NASTY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\n"


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_round_trip(spark, tmp_path, monkeypatch, piece):
    rows = [(3, "u3", "x"), (1, "u1", "x"), (2, None, None), (4, "u4", ""), (5, "u\r\n5", NASTY), (6, "u6", "é" * 70000), (7, "u7", NASTY), (None, "u8", "x"), (1, "u1", "x")]
    monkeypatch.setattr(warc, "PIECE_BYTES", piece)
    odd = "page_id long, url string, html string, id string, payload int, digest string, key string, size string, http int"
    df = spark.createDataFrame([(*x, "x", 1, "x", "x", "x", 1) for x in rows], odd)
    warc.write_archives(df, f"file://{tmp_path}/a", file_bytes=60_000)
    assert len(list((tmp_path / "a").glob("*.gz"))) > 1
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect())
    want = []
    for i, _, h in rows:
        h = h or ""
        first = min(j for j, _, g in rows if (g or "") == h and j is not None)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        revisit = i != first
        want.append((i or -1, "revisit" if revisit else "response", first if revisit else None, len(h.encode()), digest, None if revisit else h))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("least, revisits", [(0, 2), (2, 1), (99, 0)])
def test_small_payloads_stay(spark, tmp_path, least, revisits):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long"), (4, "u", "long")], "page_id long, url string, html string")
    assert warc.resolved(df, least_bytes=least).where("refers_to IS NOT NULL").count() == revisits


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_several_members_and_broken_archives():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    raw = gzip.compress(record) + gzip.compress(record * 2)
    assert [b for _, b in warc.cut_records(warc.unpacked(memoryview(raw)))] == [b"abc"] * 3
    for bad in (record[:-8], b"x" + record, b"WARC/1.1\r\nx"):
        with pytest.raises(ValueError):
            list(warc.cut_records(iter([bad])))
