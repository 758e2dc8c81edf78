"""Closed forms and small literal tables of the distance-weighted Tversky index (DTI)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the metric.
RADIUS = 3
ALPHA = 0.2
BETA = 0.8
EPS = 1e-7


def offset_rows(radius: int = RADIUS) -> list[tuple[int, int, float, float]]:
    """(dy, dx, d, k) of the disk d <= radius with k = max(1 - d / radius, 0)."""
    span = range(-radius, radius + 1)
    return [(y, x, math.sqrt(y * y + x * x), max(1 - math.sqrt(y * y + x * x) / radius, 0.0)) for y in span for x in span if math.sqrt(y * y + x * x) <= radius + 1e-12]


def kernel_offsets(spark: SparkSession, radius: int = RADIUS) -> DataFrame:
    return spark.createDataFrame(offset_rows(radius), "dy int, dx int, d double, k double")


def clean_probability(p: Column) -> Column:
    """The input contract: null and NaN are 0, infinities 1 and 0, all else clipped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(p.cast("double"), F.lit(0.0)), F.lit(0.0))))


def dti(tp: Column, fp: Column, n_gt: Column, alpha: float = ALPHA, beta: float = BETA, eps: float = EPS) -> Column:
    """The index; without truth 1 if nothing was predicted and else 0."""
    score = tp / (tp + alpha * fp + beta * (n_gt - tp) + eps)
    return F.when(n_gt > 0, score).otherwise(F.when(fp == 0, 1.0).otherwise(0.0))


def hard_floor(p: Column, t0: Column | float) -> Column:
    """Strictly above the floor."""
    return F.when(p > t0, 1.0).otherwise(0.0)


def soft_floor(p: Column, t0: float, gamma: float = 1.0) -> Column:
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p - t0) / max(1e-6, 1.0 - t0)))
    return F.when(p <= t0, 0.0).otherwise(F.pow(scaled, F.lit(gamma)))


def floors(n: int = 15, low: float = 1e-4, high: float = 0.9) -> list[float]:
    """0 and n log-spaced floors, each to six significant digits."""
    n = max(2, n)
    steps = [low * (high / low) ** (i / (n - 1)) for i in range(n)]
    return sorted({0.0, *(float(f"{x:.6g}") for x in steps)})


def required_coverage(target: Column, ratio: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Coverage of truth needed for a target at a false-positive ratio: t (a r + b) / (1 - a t)."""
    return F.when(1 - alpha * target > 0, target * (alpha * ratio + beta) / (1 - alpha * target))


def allowed_ratio(target: Column, coverage: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """The false-positive ratio a coverage can bear at a target; null if none."""
    r = (coverage / target - coverage - beta * (1 - coverage)) / alpha
    return F.when((target > 0) & (r >= 0), r)


def ceiling(ratio: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """The index at full coverage of truth."""
    return 1 / (alpha * (1 + ratio) + beta)


def projected(coverage: Column, fp: Column, truth: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    tp = coverage * truth
    return F.when(truth > 0, tp / (tp + alpha * fp + beta * (truth - tp)))


def tversky_loss(p: Column, y: Column, alpha: float = ALPHA, beta: float = BETA, smooth: float = 1e-6) -> Column:
    """An aggregate: 1 - tp / (tp + alpha fp + beta fn) of probabilities p and labels y."""
    tp, fp, fn = F.sum(p * y), F.sum(p * (1 - y)), F.sum((1 - p) * y)
    return 1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)


def focal_tversky_loss(p: Column, y: Column, gamma: float = 0.75, alpha: float = ALPHA, beta: float = BETA) -> Column:
    return F.pow(tversky_loss(p, y, alpha, beta), F.lit(gamma))


def cross_entropy(p: Column, y: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def distance_weighted_loss(tp: Column, fp: Column, n_gt: Column, background: Column | float = 0.0) -> Column:
    """1 - the index of a patch; without truth a price for false mass, background times its share within 0..1 (none by default)."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fp))
    return F.when(n_gt > 0, 1 - tp / (tp + ALPHA * fp + BETA * (n_gt - tp) + EPS)).otherwise(background * share)


def combined_loss(entropy: Column, weighted: Column, focal: Column, weights: tuple[float, float, float] = (0.3, 0.5, 0.2)) -> Column:
    return weights[0] * entropy + weights[1] * weighted + weights[2] * focal
