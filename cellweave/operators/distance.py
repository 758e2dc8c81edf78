"""Exact Euclidean distances to a set of cells, by tiles, however far and however dense the set is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.sources.shared import stored

#: Side of a tile, and truth cells up to which all cells look at all of them.
TILE, FEW = 128, 256
#: Squared distances that one pass of numpy holds.
AT_ONCE = 1 << 21


def nearest(r: np.ndarray, c: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The squared distance of each cell (r, c) to the nearest of the cells (y, x).

    By rows of cells: each column of truth cells counts with its nearest in the row (a parabola along the row), and columns
    that cannot be the nearest anywhere among the cells are left out first.
    """
    out = np.full(len(r), np.iinfo(np.int64).max)
    if not len(r) or not len(y):
        return out
    order = np.lexsort((y, x))
    y, x = y[order].astype(np.int64), x[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    last = np.r_[first[1:], len(x)] - 1
    columns = x[first]
    rows = np.unique(r).astype(np.int64)
    # the distance by column of each row: the truth cells of all columns are one sorted list
    span = int(max(y.max(), rows.max()) - min(y.min(), rows.min())) + 2
    base = min(y.min(), rows.min())
    at = np.repeat(np.arange(len(columns)), last - first + 1) * span + (y - base)
    c0, c1 = int(c.min()), int(c.max())
    gap = np.maximum(0, np.maximum(c0 - columns, columns - c1))
    far = np.maximum(np.abs(columns - c0), np.abs(columns - c1))
    down = {}
    lowest, highest = np.full(len(columns), np.iinfo(np.int64).max), np.zeros(len(columns), np.int64)
    for row in rows.tolist():
        place = np.searchsorted(at, np.arange(len(columns)) * span + (row - base))
        above = np.where(place > first, row - y[np.maximum(place - 1, 0)], 1 << 40)
        below = np.where(place <= last, y[np.minimum(place, len(y) - 1)] - row, 1 << 40)
        g = np.minimum(above, below) ** 2
        down[row] = g
        lowest, highest = np.minimum(lowest, g), np.maximum(highest, g)
    keep = gap**2 + lowest <= (far**2 + highest).min()
    columns = columns[keep]
    by_row = np.argsort(r, kind="stable")
    starts = np.searchsorted(r[by_row], rows)
    for row, start, stop in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(r)], strict=True):
        own, g = by_row[start:stop], down[row][keep]
        step = max(1, AT_ONCE // len(columns))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            out[part] = ((c[part][:, None] - columns[None]) ** 2 + g[None]).min(1)
    return out


def to_few(cells: DataFrame, truth: list[tuple[int, int]]) -> DataFrame:
    """r, c, d2 to a list of bounded length."""
    y, x = (np.array(v, np.int64) for v in zip(*truth, strict=True))

    def run(parts):
        for pdf in parts:
            r, c = pdf.r.to_numpy(np.int64), pdf.c.to_numpy(np.int64)
            out = np.full(len(r), np.iinfo(np.int64).max)
            step = max(1, AT_ONCE // len(y))
            for k in range(0, len(r), step):
                out[k : k + step] = ((r[k : k + step, None] - y) ** 2 + (c[k : k + step, None] - x) ** 2).min(1)
            yield pd.DataFrame({"r": pdf.r, "c": pdf.c, "d2": out})

    return cells.mapInPandas(run, "r int, c int, d2 long")


def squared(cells: DataFrame, truth: DataFrame, tile: int, few: int) -> DataFrame:
    """r, c, d2 of distinct cells to distinct truth cells (r, c), of which there is one at least."""
    sample = truth.limit(few + 1).collect()
    if len(sample) <= few:
        return to_few(cells, [(x.r, x.c) for x in sample])
    at = lambda x: F.floor(F.col(x) / tile).cast("int")
    mine = cells.select(at("r").alias("i"), at("c").alias("j"), "r", "c")
    theirs = truth.select(at("r").alias("i"), at("c").alias("j"), "r", "c")
    # how far, at most, any cell of a tile is from truth: by the same transform of tiles
    wanted = stored(mine.select(F.col("i").alias("r"), F.col("j").alias("c")).distinct(), "tiles")
    held = stored(theirs.select(F.col("i").alias("r"), F.col("j").alias("c")).distinct(), "held")
    far = squared(wanted, held, tile, few)
    reach = (F.sqrt(F.col("d2").cast("double")) + 1.4143) * tile
    side = F.floor((F.col("reach") - 1) / tile).cast("int") + 1
    asked = far.select(F.col("r").alias("i"), F.col("c").alias("j"), reach.alias("reach"))
    asked = asked.withColumn("k", F.explode(F.sequence(F.col("j") - side, F.col("j") + side)))
    columns = held.select(F.col("c").alias("k")).distinct()
    asked = stored(asked.join(columns, "k"), "asked")  # i, j: a tile; k: a tile of columns in its reach that holds truth
    # the nearest truth above and below a row of tiles, by column
    ends = theirs.groupBy(F.col("j").alias("k"), F.col("c").alias("x"), "i").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    ends = stored(ends, "ends")
    nothing = F.lit(None).cast("int")
    probes = asked.select("k", "i").distinct().join(ends.select("k", "x").distinct(), "k").select("k", "x", "i", nothing.alias("lo"), nothing.alias("hi"), F.lit(True).alias("probe"))
    both = probes.unionByName(ends.withColumn("probe", F.lit(False)))
    by = Window.partitionBy("k", "x").orderBy("i")
    before, after = by.rangeBetween(Window.unboundedPreceding, -1), by.rangeBetween(1, Window.unboundedFollowing)
    carried = both.withColumns({"up": F.max("hi").over(before), "down": F.min("lo").over(after)}).where("probe").select("k", "i", "x", F.explode(F.array("up", "down")).alias("y")).where("y IS NOT NULL")
    gap = F.greatest(F.col("i") * tile - F.col("y"), F.col("y") - (F.col("i") + 1) * tile + 1)
    inside = theirs.select("i", F.col("j").alias("k"), F.col("r").alias("y"), F.col("c").alias("x"))
    met = asked.join(inside, ["i", "k"]).select("i", "j", "y", "x").unionByName(asked.join(carried, ["i", "k"]).where(gap <= F.col("reach")).select("i", "j", "y", "x"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"r": [], "c": [], "d2": []})
        d2 = nearest(left.r.to_numpy(np.int64), left.c.to_numpy(np.int64), right.y.to_numpy(), right.x.to_numpy())
        return pd.DataFrame({"r": left.r, "c": left.c, "d2": d2})

    return mine.groupBy("i", "j").cogroup(met.groupBy("i", "j")).applyInPandas(run, "r int, c int, d2 long")


def distance_to(cells: DataFrame, truth: DataFrame, tile: int = TILE, few: int = FEW) -> DataFrame:
    """r, c, d: the exact distance of each cell to the nearest truth cell, however far (null without truth).

    A separable transform by tiles. The same transform of tiles, which hold truth or not, bounds how far a tile's cells can
    be from truth, and so which columns they can meet. Of a column a tile meets the truth in its own rows and the nearest
    above and below them alone; in the tile columns are parabolas along each row, and the least one counts. So a task
    gets a bounded number of cells, and no more truth than two cells a column and its rows' own. With up to few truth
    cells all are looked at.
    """
    own, truth = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct(), stored(truth.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct(), "truth")
    if truth.isEmpty():
        return own.withColumn("d", F.lit(None).cast("double"))
    few = max(few, 4)  # the tiles around the origin, which never become fewer
    return squared(own, truth, tile, few).select("r", "c", F.sqrt(F.col("d2").cast("double")).alias("d"))
