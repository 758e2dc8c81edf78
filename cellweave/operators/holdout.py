"""Windows for training and test without leaks: test windows first, then training windows that do not know them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.kernel import RADIUS
from cellweave.operators.integral import window_sums
from cellweave.operators.scoring import spread
from cellweave.sources.shared import stored

#: The share of a training window that test windows may cover where these are drawn.
MOST_COVERED = 0.25


def padded(shape: tuple[int, int], patch: int) -> tuple[int, int]:
    return -(-shape[0] // patch) * patch, -(-shape[1] // patch) * patch


def drawn_windows(cells: DataFrame, shape: tuple[int, int], patch: int, share: float, order: Column) -> DataFrame:
    """r0, c0 of a seeded share of the windows of the plain grid of windows that hold any of cells: the first in order."""
    at = lambda x: (F.floor(F.col(x) / patch) * patch).cast("int")
    valid = stored(cells.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1)).select(at("r").alias("r0"), at("c").alias("c0")).distinct(), "grid")
    return valid.orderBy(order, "r0", "c0").limit(round(share * valid.count()))


def blocks_met(windows: DataFrame, patch: int, block: int, shape: tuple[int, int], collar: int) -> DataFrame:
    """r0, c0, block_row, block_col: the blocks that a window, wider by a collar, has cells in."""
    span = lambda x, n: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(x) - collar) / block).cast("int"), F.floor(F.least(F.lit(n - 1), F.col(x) + patch - 1 + collar) / block).cast("int")))
    inside = windows.select("r0", "c0").where((F.col("r0") - collar < shape[0]) & (F.col("c0") - collar < shape[1]))
    return inside.withColumn("block_row", span("r0", shape[0])).withColumn("block_col", span("c0", shape[1]))


def windows_in_blocks(cells: DataFrame, held: DataFrame, shape: tuple[int, int], patch: int, block: int) -> DataFrame:
    """r0, c0 of the windows of the plain grid that lie in held blocks (block_row, block_col) as a whole, and hold any of cells."""
    at = lambda x: (F.floor(F.col(x) / patch) * patch).cast("int")
    valid = cells.select(at("r").alias("r0"), at("c").alias("c0")).distinct()
    valid = valid.where((F.col("r0") >= 0) & (F.col("c0") >= 0) & (F.col("r0") + patch <= shape[0]) & (F.col("c0") + patch <= shape[1]))
    met = blocks_met(valid, patch, block, shape, 0).join(held.select("block_row", "block_col").distinct().withColumn("held", F.lit(1)), ["block_row", "block_col"], "left")
    return met.groupBy("r0", "c0").agg(F.count("*").alias("n"), F.count("held").alias("k")).where("n = k").select("r0", "c0")


def covered_share(windows: DataFrame, test: DataFrame, patch: int) -> DataFrame:
    """r0, c0, share of windows that any of the test windows (of the plain grid, so none covers another) covers."""
    lap = lambda a, b: F.greatest(F.lit(0), patch - F.abs(F.col(a) - F.col(b)))
    near = lambda x: F.explode(F.array_distinct(F.array(*[(f(F.col(x) / patch) * patch).cast("int") for f in (F.floor, F.ceil)])))
    each = windows.select("r0", "c0").withColumn("tr", near("r0")).withColumn("tc", near("c0"))
    met = each.join(test.select(F.col("r0").alias("tr"), F.col("c0").alias("tc")), ["tr", "tc"])
    return met.groupBy("r0", "c0").agg((F.sum(lap("r0", "tr") * lap("c0", "tc")) / (patch * patch)).alias("share")).where("share > 0")


def train_windows(
    cells: DataFrame, shape: tuple[int, int], patch: int, step: int, held: DataFrame | None = None, block: int = 512, share: float = 0.3, collar: int = RADIUS,
    least: int = 3, negatives: float = 0.35, seed: int = 0, order: Column | None = None,
) -> DataFrame:
    """r0, c0, use, truth of windows over cells (r, c: those with data; t: whether truth); use is test, positive, negative, spare
    (a negative that is not kept) or dropped.

    Test windows come first, none over another: a seeded share of those with data, or, with held (blocks that are held out:
    block_row, block_col), all that lie in held blocks. Their truth, or all of the held blocks', is then unknown. Training
    windows begin at multiples of step in the grid filled up to whole windows. Where test windows are drawn, one that they
    cover by more than MOST_COVERED is dropped; where blocks are held, one that comes within collar cells of any. truth is
    what is known of a window; from least cells on it is positive. As many negatives are kept as make up their share
    of all, the first in order (by default a hash of seed and place). Rows repeat without effect.
    """
    order = F.xxhash64(F.lit(seed), "r0", "c0") if order is None else order
    height, width = padded(shape, patch)
    own = stored(cells.groupBy("r", "c").agg(F.max(F.col("t").cast("int")).alias("t")), "cells")
    at = lambda x, n: (F.floor(F.col(x) / n) * n).cast("int")
    truth = own.where("t = 1").select("r", "c")
    if held is None:
        test = stored(drawn_windows(own, shape, patch, share, order), "test")
        known = truth.withColumns({"r0": at("r", patch), "c0": at("c", patch)}).join(test, ["r0", "c0"], "left_anti").select("r", "c")
    else:
        blocks = held.select("block_row", "block_col").distinct()
        test = stored(windows_in_blocks(own, blocks, shape, patch, block), "test")
        known = truth.withColumns({"block_row": F.floor(F.col("r") / block).cast("int"), "block_col": F.floor(F.col("c") / block).cast("int")}).join(blocks, ["block_row", "block_col"], "left_anti").select("r", "c")
    windows = stored(window_sums(known.withColumn("truth", F.lit(1)), ["truth"], (height, width), patch, step), "windows")
    if held is None:
        gone = covered_share(windows, test, patch).where(F.col("share") > MOST_COVERED)
    else:
        gone = blocks_met(windows, patch, block, shape, collar).join(blocks, ["block_row", "block_col"], "left_semi")
    judged = windows.join(gone.select("r0", "c0").distinct().withColumn("gone", F.lit(True)), ["r0", "c0"], "left")
    use = F.when(F.col("gone"), "dropped").when(F.col("truth") >= least, "positive").otherwise("negative")
    judged = stored(judged.select("r0", "c0", use.alias("use"), F.col("truth").cast("long").alias("truth")), "judged")
    n = judged.where("use = 'positive'").count()
    keep = judged.where("use = 'negative'").select("r0", "c0").orderBy(order, "r0", "c0").limit(round(negatives * n / max(1e-6, 1 - negatives)) if negatives > 0 else 0)
    marked = judged.join(keep.withColumn("kept", F.lit(True)), ["r0", "c0"], "left")
    out = marked.select("r0", "c0", F.when((F.col("use") == "negative") & F.col("kept").isNull(), "spare").otherwise(F.col("use")).alias("use"), "truth")
    seen = truth.select(at("r", patch).alias("r0"), at("c", patch).alias("c0")).groupBy("r0", "c0").agg(F.count("*").alias("truth"))
    return test.join(seen, ["r0", "c0"], "left").select("r0", "c0", F.lit("test").alias("use"), F.coalesce("truth", F.lit(0)).cast("long").alias("truth")).unionByName(out)


def training_weights(truth: DataFrame, unknown: DataFrame, radius: int = RADIUS) -> DataFrame:
    """r, c, w of cells near truth that is known: 1 less its kernel, what a false positive there weighs; all others weigh 1.

    unknown: r, c of truth's test region, whose truth counts for nothing and whose cells all weigh 1.
    """
    known = truth.select("r", "c").distinct().join(unknown, ["r", "c"], "left_anti")
    near = spread(known, radius).groupBy(F.col("nr").alias("r"), F.col("nc").alias("c")).agg((1 - F.max("k")).alias("w"))
    return near.join(unknown, ["r", "c"], "left_anti")
