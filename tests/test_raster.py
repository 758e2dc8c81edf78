"""Rasters: round trips of written files, what is read of them, and a file made by hand."""

import struct
import zlib

import numpy as np
import pytest

from cellweave.sources import raster

META = {"height": 150, "width": 37, "transform": (100.0, 0.0, 5000.0, 0.0, -100.0, 9000.0), "epsg": 32611}


def grid(seed, kind="float32"):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(2, 150, 37)).astype(np.float32) if kind == "float32" else rng.integers(-500, 500, (2, 150, 37))
    gone = rng.random((150, 37)) < 0.2
    gone[64:96] = True  # a strip without cells
    rows = [(y, x, *(None if gone[y, x] and b else float(a[b, y, x]) for b in range(2))) for y in range(150) for x in range(37) if not (64 <= y < 96)]
    return a, gone, rows


@pytest.mark.parametrize("kind, predictor, compression", [("float32", 1, raster.DEFLATE), ("float32", 3, raster.DEFLATE), ("int16", 2, raster.DEFLATE), ("float64", 1, raster.NONE)])
def test_round_trip(spark, tmp_path, kind, predictor, compression):
    a, gone, rows = grid(1, "int" if kind == "int16" else "float32")
    df = spark.createDataFrame(rows, "r int, c int, u double, v double").repartition(4)
    meta = META | ({"nodata": -9999} if kind == "int16" else {})
    files = raster.write_raster(df, str(tmp_path / "g"), ["u", "v"], meta, 32, 64, kind, compression, predictor).collect()
    assert [f.file for f in sorted(files)] == ["part-00000000.tif", "part-00000064.tif", "part-00000128.tif"]
    got = {(x.r, x.c): (x.u, x.v) for x in raster.read_raster(spark, str(tmp_path / "g")).collect()}
    assert len(got) == 150 * 37
    for (y, x), (u, v) in got.items():
        if 64 <= y < 96:
            assert u is None and v is None
        else:
            assert u == a[0, y, x] and (v is None if gone[y, x] else v == a[1, y, x])
    again = raster.write_raster(df, str(tmp_path / "h"), ["u", "v"], meta, 32, 64, kind, compression, predictor).collect()
    assert sorted((f.file, f.sha256) for f in again) == sorted((f.file, f.sha256) for f in files)
    h = raster.read_header(str(tmp_path / "g" / "part-00000064.tif"))
    assert (h.height, h.width, h.bands, h.epsg, h.apart, h.block) == (64, 37, 2, 32611, True, (32, 37)) and h.transform == (100.0, 0.0, 5000.0, 0.0, -100.0, 9000.0 - 6400.0)


def test_only_blocks_asked_for_are_read(spark, tmp_path):
    _, _, rows = grid(2)
    df = spark.createDataFrame(rows, "r int, c int, u double, v double")
    path = str(tmp_path / "g")
    raster.write_raster(df, path, ["u", "v"], META, 32, 64)
    # the strips of other rows, and those of the other band, are overwritten: reading them would fail
    for name, strips in (("part-00000000.tif", [0, 2, 3]), ("part-00000064.tif", [0, 1, 2, 3]), ("part-00000128.tif", [0, 1])):
        h = raster.read_header(f"{path}/{name}")
        with open(f"{path}/{name}", "r+b") as f:
            for s in strips:
                f.seek(h.offsets[s])
                f.write(b"x" * h.sizes[s])
    want = sorted((y, x) for y in range(32, 64) for x in range(37))
    asked = raster.read_raster(spark, path, [1], (32, 64))
    assert asked.columns == ["r", "c", "u"] and sorted((x.r, x.c) for x in asked.collect()) == want
    pushed = raster.read_raster(spark, path, [1]).where("r >= 32 AND r < 64")
    assert sorted((x.r, x.c) for x in pushed.collect()) == want
    with pytest.raises(Exception, match="incorrect header check|invalid"):
        raster.read_raster(spark, path, [2], (32, 64)).collect()


def test_reader_chooses_partitions(tmp_path, spark):
    _, _, rows = grid(3)
    raster.write_raster(spark.createDataFrame(rows, "r int, c int, u double, v double"), str(tmp_path / "g"), ["u"], META, 32, 64)
    files = [(str(tmp_path / "g" / f"part-{k:08d}.tif"), k) for k in (0, 64, 128)]
    r = raster.RasterReader(files, [0], (0, 1 << 31), ["u"])
    assert [len(p.blocks) for p in r.partitions()] == [2, 2, 1]
    assert len(list(r.pushFilters([raster.GreaterThan(("r",), 63), raster.LessThanOrEqual(("r",), 64), raster.EqualTo(("c",), 3)]))) == 3
    assert [(p.first_row, p.blocks) for p in r.partitions()] == [(64, [(0, 0)])]


def test_tiles_bands_together_and_the_other_byte_order(spark, tmp_path):
    """A file put together by hand: tiles of 16 by 16, two bands beside each other, predictor 2, big-endian."""
    a = np.arange(20 * 24 * 2, dtype=np.int64).reshape(20, 24, 2) * 7 % 1000
    wide = np.zeros((32, 32, 2), ">u2")
    wide[:20, :24] = a
    tiles = [zlib.compress(np.diff(wide[i : i + 16, j : j + 16].astype(np.uint16), axis=1, prepend=np.zeros((16, 1, 2), np.uint16)).astype(">u2").tobytes()) for i in (0, 16) for j in (0, 16)]
    tags = [(256, 3, [24]), (257, 3, [20]), (258, 3, [16, 16]), (259, 3, [8]), (277, 3, [2]), (284, 3, [1]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, None), (325, 4, [len(t) for t in tiles]), (339, 3, [1, 1])]
    n = len(tags)
    where = 8 + 2 + 12 * n + 4
    starts, at = [], where + 32
    for t in tiles:
        starts.append(at)
        at += len(t)
    out = struct.pack(">2sHIH", b"MM", 42, 8, n)
    for tag, kind, values in tags:
        values = starts if values is None else values
        if len(values) * (2 if kind == 3 else 4) > 4:
            out += struct.pack(">HHII", tag, kind, len(values), where + (0 if tag == 324 else 16))
        else:
            out += struct.pack(">HHI", tag, kind, len(values)) + struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values).ljust(4, b"\0")
    out += b"\0" * 4 + struct.pack(">4I", *starts) + struct.pack(">4I", *(len(t) for t in tiles)) + b"".join(tiles)
    (tmp_path / "t.tif").write_bytes(out)
    got = raster.read_raster(spark, str(tmp_path / "t.tif")).collect()
    assert len(got) == 480 and all((x.b01, x.b02) == tuple(a[x.r, x.c]) for x in got)
    assert {(x.r, x.c) for x in raster.read_raster(spark, str(tmp_path / "t.tif"), [2]).where("r >= 16 AND c >= 16").collect()} == {(y, x) for y in range(16, 20) for x in range(16, 24)}


def test_what_is_no_raster(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no raster at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        raster.read_header(str(tmp_path / "x.tif"))
    with pytest.raises(Exception, match="no raster at"):
        raster.read_raster(spark, str(tmp_path)).collect()


def test_rules_of_a_raster(spark, tmp_path):
    rows = [(y, x, 0.25 + x / 100) for y in range(150) for x in range(37) if x != 5]
    field = spark.createDataFrame(rows, "r int, c int, p double")

    def written(name, df, meta=META, bands=("p",), **more):
        raster.write_raster(df, str(tmp_path / name), list(bands), meta, 32, 64, **more)
        return str(tmp_path / name)

    template = written("t", field)
    of = lambda path, **more: raster.failed_raster(spark, path, 32611, 100.0, template, **more)
    assert of(template) == ([], [])
    assert of(written("a", field.where("r <> 3"))) == (["inside"], [])
    assert of(written("b", field.unionByName(field.where("c = 6").selectExpr("r", "5 AS c", "p")))) == (["outside"], [])
    assert of(written("c", field.selectExpr("r", "c", "p * 3 AS p"))) == (["range"], []) and of(str(tmp_path / "c"), slack=5.0) == ([], [])
    assert of(written("d", field.selectExpr("r", "c", "0.0D AS p"))) == ([], ["zero"])
    assert of(written("e", field, META | {"epsg": 4326})) == (["crs"], ["template_crs"])
    assert of(written("f", field, META | {"transform": (50.0, 0.0, 5000.0, 0.0, -50.0, 9000.0)})) == (["resolution"], ["template_transform"])
    assert of(written("g", field.selectExpr("r", "c", "p", "p AS q"), bands=("p", "q"))) == (["bands"], [])
    assert of(written("h", field, META | {"nodata": -1.0})) == (["nodata"], [])
    assert of(written("i", field, META | {"height": 140})) == (["size"], [])
    assert of(written("j", field.where("r < 9"), dtype="float64"))[0] == ["dtype", "inside", "missing"]
    assert raster.describe_raster(template)["height"] == 150
