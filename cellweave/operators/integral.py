"""Sums over windows at any offset, by a summed-area table that is made and read by tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.sources.shared import stored

TILE = 256


def summed_area(cells: DataFrame, weights: list[str], shape: tuple[int, int], tile: int = TILE) -> DataFrame:
    """ti, tj, area (bytes of doubles: weights, tile, tile): of each tile of a grid the sums over all cells up to a cell and
    including it, whole grid counted. Cells (r, c, weights) that are missing count as 0; cells beyond the shape are not read.

    A tile's own prefix sums need its cells alone; its edges, summed along rows and columns of tiles, say what lies left of
    it and above. Tiles move once more than their edges, as bytes.
    """
    k, rows, columns = len(weights), -(-shape[0] // tile), -(-shape[1] // tile)

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((k, tile, tile))
        r, c = (pdf.r % tile).to_numpy(), (pdf.c % tile).to_numpy()
        for i, w in enumerate(weights):
            np.add.at(a[i], (r, c), pdf[w].to_numpy(float))
        a = a.cumsum(1).cumsum(2)
        return pd.DataFrame({"ti": [key[0]], "tj": [key[1]], "area": [a.tobytes()], "side": [a[:, :, -1].ravel().tolist()], "foot": [a[:, -1, :].ravel().tolist()], "whole": [a[:, -1, -1].tolist()]})

    inside = cells.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1)).select("r", "c", *[F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(w) for w in weights])
    dealt = inside.groupBy(F.floor(F.col("r") / tile).cast("int").alias("ti"), F.floor(F.col("c") / tile).cast("int").alias("tj"))
    made = stored(dealt.applyInPandas(own, "ti int, tj int, area binary, side array<double>, foot array<double>, whole array<double>"), "tiles")
    every = cells.sparkSession.range(rows * columns).select((F.col("id") / columns).cast("int").alias("ti"), (F.col("id") % columns).cast("int").alias("tj"))

    def before(edge: str, of: str, along: str) -> DataFrame:
        """Of every tile the sum of an edge (an array) of the tiles before it along of, tile by tile along it."""
        parts = every.join(made.select("ti", "tj", F.posexplode(edge).alias("at", "x")), ["ti", "tj"], "left")
        # a tile without cells asks for all places that any tile of its line has
        places = every.join(parts.where("at IS NOT NULL").select(along, "at").distinct(), along)
        full = places.join(parts.where("at IS NOT NULL"), ["ti", "tj", "at"], "left")
        sums = full.withColumn("x", F.sum("x").over(Window.partitionBy(along, "at").orderBy(of).rowsBetween(Window.unboundedPreceding, -1)))
        return sums.groupBy("ti", "tj").agg(F.collect_list(F.struct("at", F.coalesce("x", F.lit(0.0)).alias("x"))).alias(edge))

    left, above = before("side", "tj", "ti"), before("foot", "ti", "tj")
    # what lies both left and above: whole tiles, summed along columns of tiles, then along rows
    corner = above.select("ti", "tj", F.explode("foot").alias("e")).where(F.col("e.at") % tile == tile - 1).select("ti", "tj", (F.col("e.at") / tile).cast("int").alias("at"), F.col("e.x").alias("x"))
    corner = corner.withColumn("x", F.sum("x").over(Window.partitionBy("ti", "at").orderBy("tj").rowsBetween(Window.unboundedPreceding, -1)))
    corner = corner.groupBy("ti", "tj").agg(F.collect_list(F.struct("at", F.coalesce("x", F.lit(0.0)).alias("x"))).alias("whole"))

    def edges(found, n: int) -> np.ndarray:
        out = np.zeros(n)
        if found is not None:
            for e in found:
                out[e["at"]] = e["x"]
        return out

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        area, side, foot, whole = (pdf[x].iloc[0] for x in ("area", "side", "foot", "whole"))
        a = np.zeros((k, tile, tile)) if area is None else np.frombuffer(area, float).reshape(k, tile, tile).copy()
        a += edges(side, k * tile).reshape(k, tile, 1) + edges(foot, k * tile).reshape(k, 1, tile) + edges(whole, k).reshape(k, 1, 1)
        return pd.DataFrame({"ti": pdf.ti, "tj": pdf.tj, "area": [a.tobytes()]})

    both = every.join(made.select("ti", "tj", "area"), ["ti", "tj"], "left").join(left, ["ti", "tj"], "left").join(above, ["ti", "tj"], "left").join(corner, ["ti", "tj"], "left")
    # tile by tile: a batch of rows would hold as many tiles as a task has
    return both.groupBy("ti", "tj").applyInPandas(join, "ti int, tj int, area binary")


def window_sums(cells: DataFrame, weights: list[str], shape: tuple[int, int], size: int, step: int = 1, tile: int = TILE) -> DataFrame:
    """r0, c0 and the sum of each weight over every window of size by size cells that lies within the shape and begins at
    multiples of step: four corners of the summed-area table each, whatever the size."""
    k, (height, width) = len(weights), shape
    if size > min(shape):
        return cells.sparkSession.createDataFrame([], ", ".join(["r0 int", "c0 int", *[f"{w} double" for w in weights]]))
    area = stored(summed_area(cells, weights, shape, tile), "area")
    # a window that begins in tile t has its corners in rows t * tile - 1 to (t + 1) * tile + size - 2
    reach = lambda t: F.sequence(F.greatest(F.lit(0), F.floor((F.col(t) * tile - size + 1) / tile)).cast("int"), F.floor(((F.col(t) + 1) * tile) / tile).cast("int"))
    sent = area.withColumn("wi", F.explode(reach("ti"))).withColumn("wj", F.explode(reach("tj"))).where((F.col("wi") * tile <= height - size) & (F.col("wj") * tile <= width - size))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wi, wj = key
        top, left = wi * tile - 1, wj * tile - 1
        a = np.zeros((k, tile + size, tile + size))
        for ti, tj, raw in zip(pdf.ti, pdf.tj, pdf.area, strict=True):
            block = np.frombuffer(raw, float).reshape(k, tile, tile)
            y, x = ti * tile - top, tj * tile - left
            y0, y1, x0, x1 = max(0, y), min(tile + size, y + tile), max(0, x), min(tile + size, x + tile)
            if y0 < y1 and x0 < x1:
                a[:, y0:y1, x0:x1] = block[:, y0 - y : y1 - y, x0 - x : x1 - x]
        r = np.arange(-(-wi * tile // step) * step, min((wi + 1) * tile, height - size + 1), step)
        c = np.arange(-(-wj * tile // step) * step, min((wj + 1) * tile, width - size + 1), step)
        y, x = (r - top - 1)[:, None], (c - left - 1)[None]
        sums = a[:, y + size, x + size] - a[:, y, x + size] - a[:, y + size, x] + a[:, y, x]
        return pd.DataFrame({"r0": np.repeat(r, len(c)), "c0": np.tile(c, len(r)), **{w: sums[i].ravel() for i, w in enumerate(weights)}})

    return sent.groupBy("wi", "wj").applyInPandas(run, ", ".join(["r0 int", "c0 int", *[f"{w} double" for w in weights]]))


def best_window(cells: DataFrame, shape: tuple[int, int], size: int, step: int = 1, share: float = 0.95, tile: int = TILE) -> DataFrame:
    """The window with the most positive cells of those whose valid cells are this share of it at least; of equal ones the first.

    cells: r, c, positive and valid (numbers or booleans; positives count where valid). r0, c0, size, positives, valids,
    positive_share, valid_share; no row if no window has enough valid cells.
    """
    valid = F.coalesce(F.col("valid").cast("int"), F.lit(0))
    marked = cells.select("r", "c", (F.coalesce(F.col("positive").cast("int"), F.lit(0)) * valid).alias("positives"), valid.alias("valids"))
    found = window_sums(marked, ["positives", "valids"], shape, size, step, tile).where(F.col("valids") >= share * size * size)
    first = found.orderBy(F.desc("positives"), "r0", "c0").limit(1)
    return first.select("r0", "c0", F.lit(size).alias("size"), F.col("positives").cast("long").alias("positives"), F.col("valids").cast("long").alias("valids"), (F.col("positives") / (size * size)).alias("positive_share"), (F.col("valids") / (size * size)).alias("valid_share"))
