"""Byte ranges, their check sums, what is put together of them, and stored archives."""

import hashlib
import os
import random
import zipfile
import zlib

import pytest

from cellweave.sources import archive


def blob(n, seed=1):
    return random.Random(seed).randbytes(n)


@pytest.mark.parametrize("a, b", [(0, 0), (0, 5), (5, 0), (1, 1), (1000, 77), (3, 70000)])
def test_combined_sum(a, b):
    x, y = blob(a), blob(b, 2)
    assert archive.crc_combined(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


@pytest.mark.parametrize("n, size", [(10_000, 999), (10_000, 10_000), (0, 10), (1, 1), (4096, 1024)])
def test_parts_of_a_file(spark, tmp_path, n, size):
    raw = blob(n)
    (tmp_path / "f").write_bytes(raw)
    rows = sorted(archive.part_facts(spark, str(tmp_path / "f"), size).collect())
    assert [(r.offset, r.length) for r in rows] == ([(k, min(size, n - k)) for k in range(0, n, size)] or [(0, 0)])
    assert all(r.crc == zlib.crc32(raw[r.offset : r.offset + r.length]) and r.sha256 == hashlib.sha256(raw[r.offset : r.offset + r.length]).hexdigest() for r in rows)
    whole = archive.whole_crc(archive.part_facts(spark, str(tmp_path / "f"), size)).first()
    assert (whole.length, whole.crc) == (n, zlib.crc32(raw))


def test_split_and_joined(spark, tmp_path):
    raw = blob(100_000)
    (tmp_path / "f").write_bytes(raw)
    manifest = archive.split_file(spark, str(tmp_path / "f"), str(tmp_path / "parts"), 7_777)
    assert sorted(os.listdir(tmp_path / "parts")) == [f"part-{k:06d}" for k in range(13)]
    assert archive.bad_parts(spark, str(tmp_path / "parts"), manifest).collect() == []
    got = archive.joined_file(spark, str(tmp_path / "parts"), manifest, str(tmp_path / "back"))
    assert (tmp_path / "back").read_bytes() == raw and got == {"length": 100_000, "crc": zlib.crc32(raw), "sha256": hashlib.sha256(raw).hexdigest()}
    part = tmp_path / "parts" / "part-000003"
    own = part.read_bytes()
    for change, problem in ((own[:-1], "other length"), (own[:-1] + bytes([own[-1] ^ 1]), "other content"), (None, "missing")):
        part.write_bytes(change) if change is not None else part.unlink()
        assert [tuple(r) for r in archive.bad_parts(spark, str(tmp_path / "parts"), manifest).collect()] == [("part-000003", problem)]
        with pytest.raises(ValueError, match=f"part-000003: {problem}"):
            archive.joined_file(spark, str(tmp_path / "parts"), manifest, str(tmp_path / "no"))
    part.write_bytes(own)
    with pytest.raises(ValueError, match="begins at"):
        archive.joined_file(spark, str(tmp_path / "parts"), manifest.where("part <> 5"), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_stored_archive(spark, tmp_path):
    for name, n in (("a", 50_000), ("b", 0), ("c", 3)):
        (tmp_path / name).write_bytes(blob(n, n))
    members = [("grid/a.tif", str(tmp_path / "a")), ("b.txt", str(tmp_path / "b")), ("é.txt", str(tmp_path / "c"))]
    first = archive.stored_archive(spark, members, str(tmp_path / "one.zip"), 7_000)
    assert archive.stored_archive(spark, members, str(tmp_path / "two.zip"), 1 << 20) == first
    assert (tmp_path / "one.zip").read_bytes() == (tmp_path / "two.zip").read_bytes()
    with zipfile.ZipFile(tmp_path / "one.zip") as z:
        assert z.testzip() is None and [(i.filename, i.date_time, i.compress_type) for i in z.infolist()] == [(n, (2020, 1, 1, 0, 0, 0), zipfile.ZIP_STORED) for n, _ in members]
        assert z.read("grid/a.tif") == blob(50_000, 50_000) and z.read("é.txt") == blob(3, 3)
    with pytest.raises(ValueError, match="name twice"):
        archive.stored_archive(spark, [members[0], members[0]], str(tmp_path / "no.zip"))


def test_sums_of_texts_in_order(spark):
    rows = [("x", 2, "second"), ("x", 1, "first é"), ("x", 3, None), ("x", 4, ""), ("y", 1, "漢字")]
    got = {r.k: (r.length, r.crc) for r in archive.crc_in_order(spark.createDataFrame(rows, "k string, n int, t string"), "t", ["n"], "k").collect()}
    assert got == {"x": (len("first ésecond".encode()), zlib.crc32("first ésecond".encode())), "y": (6, zlib.crc32("漢字".encode()))}
