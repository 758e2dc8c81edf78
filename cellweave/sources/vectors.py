"""Vector lines (GeoJSON), their rasters, affine resampling and the projection to UTM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature, properties, paths (array of arrays of [x, y]) of line features; an empty collection is an error."""
    features = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    g = features.select("feature", "f.properties", "f.geometry.type", F.col("f.geometry.coordinates").alias("text"))
    line = F.array(F.from_json("text", "array<array<double>>"))
    paths = F.when(F.col("type") == "LineString", line).when(F.col("type") == "MultiLineString", F.from_json("text", "array<array<array<double>>>"))
    out = g.select("feature", "properties", F.filter(paths, lambda p: F.size(p) >= 2).alias("paths")).where("size(paths) > 0")
    if out.isEmpty():
        raise ValueError(f"no lines in {path}")
    return out


def segments(lines: DataFrame) -> DataFrame:
    """feature, x0, y0, x1, y1."""
    p = lines.select("feature", F.explode("paths").alias("p"))
    s = p.select("feature", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))).alias("s"))
    return s.select("feature", F.col("s.a")[0].alias("x0"), F.col("s.a")[1].alias("y0"), F.col("s.b")[0].alias("x1"), F.col("s.b")[1].alias("y1"))


def rasterised(parts: DataFrame) -> DataFrame:
    """feature, r, c: cells that segments in cell units pass, one for each step along the longer side."""
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))), F.lit(1)).cast("int")
    steps = parts.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n")).cast("int")
    return steps.select("feature", at("y0", "y1").alias("r"), at("x0", "x1").alias("c")).distinct()


def resampled(grid: DataFrame, factor: int) -> DataFrame:
    """The mean over blocks of factor by factor cells."""
    return grid.groupBy(F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(F.avg("v").alias("v"))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 (Krueger's series to the third order)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, x in enumerate(alpha, 1):
        east = east + x * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + x * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + k0 * big * east, k0 * big * north


def geographic(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude on WGS 84 of a UTM place north of the equator: the inverse of utm."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi0, eta0 = north / (k0 * big), (east - 500000) / (k0 * big)
    xi, eta = xi0, eta0
    for j, x in enumerate(beta, 1):
        xi = xi - x * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - x * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, x in enumerate(delta, 1):
        lat = lat + x * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(lat)


def box_utm(west: float, south: float, east: float, north: float, zone: int, spark: SparkSession, points: int = 21) -> tuple[float, float, float, float]:
    """The UTM box around a box of longitudes and latitudes: of points along each of its sides, so that bent sides lie within."""
    steps = spark.range(points).select((F.col("id") / (points - 1)).alias("t"))
    side = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    x, y = west + (east - west) * F.col("t"), south + (north - south) * F.col("t")
    edge = steps.select(F.explode(F.array(side(x, F.lit(south)), side(x, F.lit(north)), side(F.lit(west), y), side(F.lit(east), y))).alias("p"))
    e, n = utm(F.col("p.lon"), F.col("p.lat"), zone)
    row = edge.agg(F.min(e).alias("a"), F.min(n).alias("b"), F.max(e).alias("c"), F.max(n).alias("d")).first()
    return tuple(row)
