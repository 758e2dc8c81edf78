"""Emission shaping: floors, bands, closing, votes, shifts, template conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.kernel import clean_probability
from cellweave.operators import kernels
from cellweave.operators.scoring import spread


def at_floors(pred: DataFrame, floors: list[float]) -> DataFrame:
    """fi, t0, r, c: cells strictly above each floor, numbered from 0."""
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("fi"), F.lit(t).alias("t0")) for i, t in enumerate(floors)]))
    return pred.withColumn("f", levels).where(F.col("p") > F.col("f.t0")).select(F.col("f.fi").alias("fi"), F.col("f.t0").alias("t0"), "r", "c")


def bands(mask: DataFrame, widths: list[int], keys: list[str]) -> DataFrame:
    """keys, width, r, c, d: cells within each width of the mask and their distance; one spread serves all widths."""
    near = spread(mask.select(*keys, "r", "c"), max(1, *widths), positive=False).groupBy(*keys, F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.min("d").alias("d"))
    return near.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]))).where("d <= width")


def soft_values(band: DataFrame, gamma: float = 1.0) -> DataFrame:
    """band with p = (1 - d / (width + 1)) ** gamma: the support is that of the hard band."""
    return band.withColumn("p", F.pow(1 - F.col("d") / (F.col("width") + 1), F.lit(gamma)))


def dilate_square(mask: DataFrame, half: int) -> DataFrame:
    step = F.sequence(F.lit(-half), F.lit(half))
    return mask.select("r", "c").withColumn("y", F.explode(step)).withColumn("x", F.explode(step)).select((F.col("r") + F.col("y")).alias("r"), (F.col("c") + F.col("x")).alias("c")).distinct()


def erode_square(mask: DataFrame, half: int) -> DataFrame:
    """Cells all of whose square lies in the mask: those met (2 half + 1) squared times."""
    step = F.sequence(F.lit(-half), F.lit(half))
    met = mask.select("r", "c").withColumn("y", F.explode(step)).withColumn("x", F.explode(step)).groupBy((F.col("r") + F.col("y")).alias("r"), (F.col("c") + F.col("x")).alias("c")).count()
    return met.where(F.col("count") == (2 * half + 1) ** 2).select("r", "c")


def close_square(mask: DataFrame, size: int = 3) -> DataFrame:
    return kernels.closed_square(mask, size)


def vote(members: DataFrame, k: int) -> DataFrame:
    """r, c of cells that at least k members (member, r, c) have; k of 1 or less is the union."""
    return members.groupBy("r", "c").agg(F.count_distinct("member").alias("n")).where(F.col("n") >= max(1, k)).select("r", "c", "n")


def union_max(pred: DataFrame) -> DataFrame:
    return pred.groupBy("r", "c").agg(F.max("p").alias("p"))


def weighted_mean(pred: DataFrame, weights: DataFrame) -> DataFrame:
    """r, c, p: the mean over the members (candidate, r, c, p) that have the cell, weighted by (candidate, w)."""
    return pred.where(F.col("p").isNotNull() & ~F.isnan("p")).join(F.broadcast(weights), "candidate").groupBy("r", "c").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))


def softmax_weights(scores: DataFrame, sharpness: float = 8.0) -> DataFrame:
    """candidate, w: exp(sharpness * (dti - the greatest)), over their sum."""
    top = scores.agg(F.max("dti").alias("top"))
    raw = scores.crossJoin(F.broadcast(top)).select("candidate", F.exp(sharpness * (F.col("dti") - F.col("top"))).alias("x"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("x").alias("all")))).select("candidate", (F.col("x") / F.col("all")).alias("w"))


def shifted(pred: DataFrame, radius: int, width: int) -> DataFrame:
    """pred at the identity and eight compass shifts: shift, dy, dx, r, c, p; what leaves the columns is lost."""
    steps = [(0, 0), *[(y * radius, x * radius) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0)]]
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("shift"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for i, (y, x) in enumerate(steps)]))
    out = pred.withColumn("m", moves).select(F.col("m.shift").alias("shift"), (F.col("r") + F.col("m.dy")).alias("r"), (F.col("c") + F.col("m.dx")).alias("c"), "p")
    return out.where((F.col("r") >= 0) & F.col("c").between(0, width - 1))


def conform(pred: DataFrame, footprint: DataFrame) -> DataFrame:
    """r, c, p on the template: missing or NaN inside is 0, values outside go, the rest is clipped; with a reason."""
    both = footprint.withColumn("inside", F.lit(True)).join(pred.withColumn("had", F.lit(True)), ["r", "c"], "full")
    why = F.when(F.col("inside").isNull(), "outside").when(F.col("had").isNull() | F.isnan("p") | F.col("p").isNull(), "filled").when((F.col("p") < 0) | (F.col("p") > 1), "clipped").otherwise("kept")
    return both.select("r", "c", F.when(F.col("inside").isNotNull(), clean_probability(F.col("p"))).alias("p"), why.alias("reason"))


def eligible(sweep: DataFrame, footprint_px: Column, least: int, share: float) -> DataFrame:
    """sweep with eligible and reason; rows that fail stay."""
    reason = F.when(F.col("pred_px") < least, "too few cells").when(F.col("pred_px") > share * footprint_px, "too many cells")
    return sweep.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def failed_format(field: DataFrame, template: DataFrame, slack: float = 0.01, most_missing: float = 0.9) -> DataFrame:
    """failed: the names of the rules that a field (r, c, p) breaks against a template (r, c, of its footprint), in one row.

    type (p is a float), cells (a cell twice), range (0 to 1, with slack), mask (a value outside, or none inside), missing
    (more than this share of cells without a value), empty (no value above 0).
    """
    kind = field.schema["p"].dataType.simpleString()
    value = F.when(~F.isnan("p"), F.col("p"))
    own = field.groupBy("r", "c").agg(F.count("*").alias("k"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.count(value).alias("has"))
    both = own.join(template.select("r", "c").distinct().withColumn("inside", F.lit(1)), ["r", "c"], "full")
    has = F.coalesce("has", F.lit(0)) > 0
    sums = both.agg(
        F.max("k").alias("k"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.count_if(has != F.col("inside").isNotNull()).alias("off"),
        F.count("*").alias("n"), F.count_if(~has).alias("none"),
    )
    rules = {
        "type": F.lit(kind in ("float", "double")),
        "cells": F.coalesce("k", F.lit(1)) == 1,
        "range": (F.coalesce("lo", F.lit(0.0)) >= -slack) & (F.coalesce("hi", F.lit(0.0)) <= 1 + slack),
        "mask": F.col("off") == 0,
        "missing": F.col("none") <= most_missing * F.col("n"),
        "empty": F.coalesce("hi", F.lit(0.0)) > 0,
    }
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return sums.select(broken.alias("failed"))
