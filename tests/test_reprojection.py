"""Bilinear gathers against a loop over cells, UTM there and back, touched cells against sampled lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import reprojection as rp
from cellweave.sources import vectors


def loop(cells, shape, places):
    """The plain gather: cells maps (r, c) to a value or None."""
    known = [v for v in cells.values() if v is not None]
    mean, out = (sum(known) / len(known) if known else 0.0), {}
    for key, (y, x) in places.items():
        if not (0 <= y < shape[0] and 0 <= x < shape[1]):
            out[key] = 0.0
            continue
        if cells.get((math.floor(y), math.floor(x))) is None:
            out[key] = None
            continue
        y0, x0, total, weight = math.floor(y - 0.5), math.floor(x - 0.5), 0.0, 0.0
        for dy in (0, 1):
            for dx in (0, 1):
                r, c = y0 + dy, x0 + dx
                if 0 <= r < shape[0] and 0 <= c < shape[1]:
                    w = (1 - abs(y - 0.5 - r)) * (1 - abs(x - 0.5 - c))
                    v = cells.get((r, c))
                    total, weight = total + w * (mean if v is None else v), weight + w
        out[key] = total / weight
    return out


@pytest.mark.parametrize("target", [(0.7, 0.0, -1.0, 0.0, 0.9, -2.0), (0.6, 0.3, 1.0, -0.2, 0.8, 3.0)])
def test_bilinear(spark, target):
    r = random.Random(1)
    shape, source = (9, 11), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    cells = {(y, x): None if r.random() < 0.15 else r.uniform(-5, 5) for y in range(shape[0]) for x in range(shape[1]) if r.random() < 0.95}
    df = spark.createDataFrame([(y, x, v, float("nan") if v is None else v) for (y, x), v in cells.items()], "r int, c int, v double, w double")
    got = rp.bilinear(df, ["v", "w"], shape, rp.cells_of(spark, 14, 20), rp.positions(target, source)).collect()
    a, b, c, d, e, f = target
    want = loop(cells, shape, {(y, x): (d * (x + 0.5) + e * (y + 0.5) + f, a * (x + 0.5) + b * (y + 0.5) + c) for y in range(14) for x in range(20)})
    assert len(got) == 14 * 20
    for row in got:
        w = want[row.r, row.c]
        assert (row.v is None and row.w is None) if w is None else (row.v == pytest.approx(w) and row.w == pytest.approx(w))


def test_a_source_without_values(spark):
    df = spark.createDataFrame([(0, 0, None)], "r int, c int, v double")
    got = rp.bilinear(df, ["v"], (1, 1), rp.cells_of(spark, 1, 2), rp.positions((1, 0, 0, 0, 1, 0), (1, 0, 0, 0, 1, 0))).collect()
    assert {(x.r, x.c): x.v for x in got} == {(0, 0): None, (0, 1): 0.0}


def test_utm_there_and_back(spark):
    """Known places of zone 11 (metres), and back to degrees."""
    df = spark.createDataFrame([(-117.0, 40.0), (-119.5, 38.25), (-114.2, 41.9)], "lon double, lat double")
    e, n = vectors.utm(F.col("lon"), F.col("lat"), 11)
    rows = df.select("lon", "lat", e.alias("e"), n.alias("n"))
    assert [tuple(round(v, 1) for v in (x.e, x.n)) for x in rows.collect()][0] == (500000.0, 4427757.2)
    lon, lat = vectors.geographic(F.col("e"), F.col("n"), 11)
    for x in rows.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(x.lon - x.a) < 1e-8 and abs(x.lat - x.b) < 1e-8


def test_box_in_utm(spark):
    west, south, east, north = vectors.box_utm(-118.0, 39.0, -116.0, 40.0, 11, spark)
    assert west < 415000 and east > 585000 and east - 500000 == pytest.approx(500000 - west, abs=1)
    assert south == pytest.approx(4316776.6, abs=1) and north > 4427757.2 + 100  # the northern side bends up at its ends


def test_reprojected_from_degrees(spark):
    """A plane over degrees, read off on a UTM grid, is that plane."""
    step, west, north = 0.01, -117.2, 40.2
    cells = spark.createDataFrame([(y, x, 3.0 * (west + (x + 0.5) * step) - 2.0 * (north - (y + 0.5) * step)) for y in range(40) for x in range(40)], "r int, c int, v double")
    place = rp.positions((1000.0, 0.0, 490000.0, 0.0, -1000.0, 4435000.0), (step, 0.0, west, 0.0, -step, north), lambda x, y: vectors.geographic(x, y, 11))
    target = rp.cells_of(spark, 12, 12)
    lon, lat = vectors.geographic(490000.0 + 1000.0 * (F.col("c") + 0.5), 4435000.0 - 1000.0 * (F.col("r") + 0.5), 11)
    got = rp.bilinear(cells, ["v"], (40, 40), target, place).join(target.select("r", "c", (3.0 * lon - 2.0 * lat).alias("want")), ["r", "c"]).collect()
    assert len(got) == 144 and all(abs(x.v - x.want) < 1e-6 for x in got)


def test_touched_cells(spark):
    r = random.Random(2)
    parts = [(i, *(r.uniform(-6, 6) for _ in range(4))) for i in range(40)] + [(90, 1.5, 2.5, 4.5, 2.5), (91, 1.5, 2.5, 1.5, -2.5), (92, 0.25, 0.25, 0.25, 0.25)]
    got = {(x.feature, x.r, x.c) for x in rp.touched(spark.createDataFrame(parts, "feature int, x0 double, y0 double, x1 double, y1 double")).collect()}
    seen = {(i, math.floor(y0 + (y1 - y0) * t / 20000), math.floor(x0 + (x1 - x0) * t / 20000)) for i, x0, y0, x1, y1 in parts for t in range(20001)}
    assert seen <= got and len(got - seen) <= 2  # a corner that is cut by less than a sample's step


def test_reconstruction(spark):
    """A flat ramp rebuilt on its own grid: slope of one in ten everywhere but in the hole, which is 0, and its line."""
    cells = spark.createDataFrame([(y, x, None if (y, x) == (3, 4) else 10.0 * x, 1.0) for y in range(8) for x in range(9)], "r int, c int, v double, e double")
    shape, unit = (8, 9), (100.0, 0.0, 0.0, 0.0, -100.0, 800.0)
    lines = spark.createDataFrame([(1, 50.0, 750.0, 250.0, 750.0)], "feature int, x0 double, y0 double, x1 double, y1 double")
    sources = [{"cells": cells.select("r", "c", "v"), "bands": ["v"], "shape": shape, "transform": unit}, {"cells": cells.where("c < 2").select("r", "c", "e"), "bands": ["e"], "shape": shape, "transform": unit}]
    got = {(x.r, x.c): x for x in rp.reconstruct_grid(spark, sources, {"shape": shape, "transform": unit}, "v", lines, ("e",), 100.0, 1.0).collect()}
    assert len(got) == 72 and {k for k, x in got.items() if x.label} == {(0, 0), (0, 1), (0, 2)}
    assert got[3, 4].v is None and got[3, 4].dem_slope == 0 and got[3, 4].dem_detrended == 0
    assert got[6, 4].dem_slope == pytest.approx(math.degrees(math.atan(0.1))) and got[6, 4].dem_detrended == pytest.approx(0, abs=1e-3)
    assert [got[0, c].e for c in (0, 1, 2)] == [1, 1, 0]
