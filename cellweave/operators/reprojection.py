"""Grids put onto another grid: bilinear gathers that know holes, all cells that lines touch, and a whole stack rebuilt so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import focal, kernels, stats
from cellweave.sources.shared import stored

#: A transform is (a, b, c, d, e, f): x = a * column + b * row + c, y = d * column + e * row + f, of corners of cells.
Transform = tuple[float, float, float, float, float, float]
#: A point's place in other coordinates.
Projection = Callable[[Column, Column], tuple[Column, Column]]


def positions(target: Transform, source: Transform, project: Projection | None = None) -> Projection:
    """From a target cell (r, c) the place of its centre in the source, in rows and columns from its corner.

    project: from the target's coordinates to the source's, where they differ.
    """
    a, b, c, d, e, f = source
    size = a * e - b * d
    if not size:
        raise ValueError(f"a transform without an inverse: {source}")

    def place(r: Column, col: Column) -> tuple[Column, Column]:
        y, x = r + F.lit(0.5), col + F.lit(0.5)
        x, y = target[0] * x + target[1] * y + target[2], target[3] * x + target[4] * y + target[5]
        if project is not None:
            x, y = project(x, y)
        x, y = x - c, y - f
        return (F.lit(a) * y - F.lit(d) * x) / size, (F.lit(e) * x - F.lit(b) * y) / size

    return place


def cells_of(spark: SparkSession, height: int, width: int) -> DataFrame:
    """r, c of all cells of a grid."""
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))


def bilinear(source: DataFrame, bands: list[str], shape: tuple[int, int], target: DataFrame, place: Projection, outside: float | None = 0.0) -> DataFrame:
    """r, c and the bands of source (r, c, bands; of that shape) at the cells of target.

    A target cell takes the four source cells around its place, by nearness; at the border those that there are. Holes
    (cells that are missing, null or NaN) count as the band's mean (0 if it has no value) and make a hole of the target
    cells whose nearest source cell they are. Places beyond the source have the value outside.
    """
    height, width = shape
    clean = source.select("r", "c", *[F.when(~F.isnan(b), F.col(b).cast("double")).alias(b) for b in bands])
    means = clean.agg(*[F.coalesce(F.avg(b), F.lit(0.0)).alias(b) for b in bands]).first()
    y, x = place(F.col("r"), F.col("c"))
    at = target.select("r", "c", y.alias("__y"), x.alias("__x")).withColumns({"__y0": F.floor(F.col("__y") - 0.5), "__x0": F.floor(F.col("__x") - 0.5)})
    inside = (F.col("__y") >= 0) & (F.col("__y") < height) & (F.col("__x") >= 0) & (F.col("__x") < width)
    wy, wx = F.col("__y") - 0.5 - F.col("__y0"), F.col("__x") - 0.5 - F.col("__x0")
    corner = lambda dy, dx: F.struct((F.col("__y0") + dy).cast("int").alias("__r"), (F.col("__x0") + dx).cast("int").alias("__c"), ((wy if dy else 1 - wy) * (wx if dx else 1 - wx)).alias("__w"))
    each = at.where(inside).withColumn("__k", F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])))
    each = each.select("r", "c", "__k.*", ((F.col("__k.__r") == F.floor("__y")) & (F.col("__k.__c") == F.floor("__x"))).alias("__own"))
    each = each.where(F.col("__r").between(0, height - 1) & F.col("__c").between(0, width - 1) & ((F.col("__w") > 0) | F.col("__own")))
    met = each.join(clean.withColumnsRenamed({"r": "__r", "c": "__c"}), ["__r", "__c"], "left")
    values = [F.when(~F.bool_or(F.col("__own") & F.col(b).isNull()), F.sum(F.col("__w") * F.coalesce(b, F.lit(means[b]))) / F.sum("__w")).alias(b) for b in bands]
    found = met.groupBy("r", "c").agg(*values)
    if outside is None:
        return found
    return found.unionByName(at.where(~inside).select("r", "c", *[F.lit(float(outside)).alias(b) for b in bands]))


def touched(parts: DataFrame) -> DataFrame:
    """feature, r, c: all cells that segments (feature, x0, y0, x1, y1, in cell units) touch: in each row, from the column where
    a segment enters it to that where it leaves. A point is one cell."""
    down = F.col("y1") - F.col("y0")
    rows = F.sequence(F.floor(F.least("y0", "y1")).cast("int"), F.floor(F.greatest("y0", "y1")).cast("int"))
    cut = parts.withColumn("r", F.explode(rows))
    # where a segment meets the row's edges; multiplied before it is divided, as in SQL: a place on a cell's edge is in one cell
    met = lambda edge: F.greatest(F.least(edge, F.greatest("y0", "y1")), F.least("y0", "y1")) - F.col("y0")
    x = lambda edge: F.col("x0") + (F.col("x1") - F.col("x0")) * met(edge) / F.when(down != 0, down)
    flat = down == 0
    one, other = F.when(flat, F.col("x0")).otherwise(x(F.col("r").cast("double"))), F.when(flat, F.col("x1")).otherwise(x(F.col("r") + 1.0))
    columns = F.sequence(F.floor(F.least(one, other)).cast("int"), F.floor(F.greatest(one, other)).cast("int"))
    return cut.select("feature", "r", F.explode(columns).alias("c")).distinct()


def derivatives(dem: DataFrame, step: float, sigma: float, tile: int = 256) -> DataFrame:
    """r, c, dem_detrended (less its Gaussian mean), dem_slope (degrees) of a whole grid (r, c, v): holes count as the median and
    are 0 in the result."""
    dem = stored(dem.select("r", "c", F.col("v").cast("double").alias("v")), "dem")
    middle = stats.quantiles(stats.histogram(dem.select(F.lit("v").alias("band"), "v")), {"m": 0.5}).first()
    full = dem.select("r", "c", F.coalesce("v", F.lit(middle.m if middle else 0.0)).alias("v"))
    smooth = kernels.detrended(full, sigma, tile)
    slope = focal.slope(full.withColumn("valid", F.lit(True)), step)
    both = dem.join(smooth, ["r", "c"]).join(slope.select("r", "c", "slope"), ["r", "c"])
    hole = F.col("v").isNull()
    return both.select("r", "c", F.when(hole, 0.0).otherwise(F.col("x")).alias("dem_detrended"), F.when(hole, 0.0).otherwise(F.col("slope")).alias("dem_slope"))


def reconstruct_grid(
    spark: SparkSession, sources: list[dict], target: dict, dem: str, lines: DataFrame, zero: tuple[str, ...] = (), step: float = 100.0, sigma: float = 30.0
) -> DataFrame:
    """r, c, every band of the sources, dem_detrended and dem_slope (of the band dem), and label: a whole grid of features.

    sources: for each grid its cells (r, c, bands), bands, shape, transform and, where its coordinates differ from the target's,
    project (from those to its own). target: shape and transform. lines: segments (feature, x0, y0, x1, y1) in the target's
    coordinates; label is 1 in all cells that they touch. Bands named in zero are 0 where they have no value.
    """
    height, width = target["shape"]
    out = cells_of(spark, height, width)
    for s in sources:
        place = positions(target["transform"], s["transform"], s.get("project"))
        out = out.join(stored(bilinear(s["cells"], s["bands"], s["shape"], cells_of(spark, height, width), place), "resampled"), ["r", "c"])
    out = out.join(derivatives(out.select("r", "c", F.col(dem).alias("v")), step, sigma), ["r", "c"])
    a, b, c, d, e, f = target["transform"]
    size = a * e - b * d
    ends = {}
    for k in ("0", "1"):
        x, y = F.col("x" + k) - c, F.col("y" + k) - f
        ends |= {"x" + k: (e * x - b * y) / size, "y" + k: (a * y - d * x) / size}
    marks = touched(lines.withColumns(ends)).select("r", "c").distinct().withColumn("label", F.lit(1))
    out = out.join(marks, ["r", "c"], "left")
    return out.select("r", "c", *[F.coalesce(x, F.lit(0.0)).alias(x) if x in zero else F.col(x) for x in out.columns if x not in ("r", "c", "label")], F.coalesce("label", F.lit(0)).alias("label"))
