"""Sliding windows over a grid, their stitching, and the eight symmetries of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_starts(n: int, size: int, step: int) -> list[int]:
    """Starts every step; the last window is flush with the edge."""
    if n <= size:
        return [0]
    return [*range(0, n - size, step), n - size]


def in_windows(cells: DataFrame, height: int | Column, width: int | Column, size: int, step: int) -> DataFrame:
    """cells with win_r, win_c of every window that holds them: starts are met by division, the flush ones by test."""

    def starts(x: str, n: int | Column) -> Column:
        last = F.greatest(F.lit(0), F.lit(n) - size)
        low = F.greatest(F.lit(0), F.floor((F.col(x) - size) / step).cast("int") + 1)
        high = F.floor(F.col(x) / step).cast("int")
        regular = F.filter(F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * step), lambda s: (s < last) & (s <= F.col(x)))
        return F.concat(regular, F.when(F.col(x) >= last, F.array(last)).otherwise(F.array().cast("array<int>")))

    return cells.withColumn("win_r", F.explode(starts("r", height))).withColumn("win_c", F.explode(starts("c", width)))


def gaussian_weight(size: int, share: float = 0.25) -> Column:
    """The weight of a cell in its window, by its distance to the window's middle."""
    mid, s = (size - 1) / 2, size * share
    y, x = F.col("r") - F.col("win_r") - mid, F.col("c") - F.col("win_c") - mid
    return F.exp(-(y * y + x * x) / (2 * s * s))


def stitched(scores: DataFrame, size: int) -> DataFrame:
    """r, c, p: the weighted mean over the windows that scored a cell (win_r, win_c, r, c, p)."""
    w = gaussian_weight(size)
    return scores.groupBy("r", "c").agg((F.sum(w * F.col("p")) / F.sum(w)).alias("p"))


def in_tiles(cells: DataFrame, size: int) -> DataFrame:
    """cells with win_r, win_c, the corner of the tile of size by size that holds them, and r, c within it."""
    r, c = F.col("r"), F.col("c")
    return cells.withColumns({"win_r": r - r % size, "win_c": c - c % size, "r": r % size, "c": c % size})


def symmetries(cells: DataFrame, size: int) -> DataFrame:
    """Each cell of a window under the eight symmetries of the square: view 0..7, r, c within 0..size-1."""
    r, c, n = F.col("r"), F.col("c"), size - 1
    pairs = [(r, c), (c, n - r), (n - r, n - c), (n - c, r), (r, n - c), (c, r), (n - r, c), (n - c, n - r)]
    views = F.explode(F.array(*[F.struct(F.lit(i).alias("view"), y.cast("int").alias("y"), x.cast("int").alias("x")) for i, (y, x) in enumerate(pairs)]))
    keep = [x for x in cells.columns if x not in ("r", "c")]
    return cells.withColumn("v", views).select(*keep, F.col("v.view").alias("view"), F.col("v.y").alias("r"), F.col("v.x").alias("c"))


def noisy(cells: DataFrame, column: str, scale: float, seed: int) -> DataFrame:
    """column with seeded normal noise; rows keep their noise if the partitioning does."""
    return cells.withColumn(column, F.col(column) + scale * F.randn(seed))

