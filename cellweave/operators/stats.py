"""Band statistics, normalisation, quantisation, run lengths, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.sources.shared import stored


def long_bands(grid: DataFrame, bands: list[str]) -> DataFrame:
    """r, c, band, v."""
    return grid.unpivot(["r", "c"], [F.col(b).cast("double").alias(b) for b in bands], "band", "v")


#: Buckets of a band's range; one bucket's distinct values are what a task ranks.
BUCKETS = 4096


def histogram(bands: DataFrame) -> DataFrame:
    """band, v, n: how often each value is met; null and NaN are not. Written, as all statistics come from it."""
    fine = bands.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return stored(fine.groupBy("band", "v").agg(F.count("*").alias("n")), "histogram")


def quantiles(hist: DataFrame, names: dict[str, float]) -> DataFrame:
    """band and, for each name, the exact quantile of hist (band, v, n), linear between ranks.

    Counts of the buckets of a band's range say in which bucket a rank lies; only such buckets are put in order.
    """
    edges = hist.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    span = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (BUCKETS - 1))).otherwise(0).cast("int")
    placed = hist.join(F.broadcast(edges), "band").withColumn("bucket", span)
    sums = placed.groupBy("band", "bucket", "total").agg(F.sum("n").alias("k"))
    before = F.sum("k").over(Window.partitionBy("band").orderBy("bucket")) - F.col("k")
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("total") - 1)).alias("at")) for name, q in names.items()]))
    asked = sums.withColumn("before", before).withColumn("q", ranks).select("band", "bucket", "before", "k", "q.name", "q.at")
    low, high = F.floor("at").cast("long"), F.ceil("at").cast("long")
    asked = asked.withColumns({"low": low, "high": high}).where("(low >= before AND low < before + k) OR (high >= before AND high < before + k)")
    upto = F.sum("n").over(Window.partitionBy("band", "bucket", "name").orderBy("v"))
    inside = placed.select("band", "bucket", "v", "n").join(F.broadcast(asked), ["band", "bucket"]).withColumn("upto", F.col("before") + upto)
    at_low = F.min(F.when(F.col("upto") > F.col("low"), F.col("v")))
    at_high = F.min(F.when(F.col("upto") > F.col("high"), F.col("v")))
    found = inside.where("upto > low OR upto > high").groupBy("band", "name", "at", "low", "high").agg(at_low.alias("a"), at_high.alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low"))
    return found.groupBy("band").agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in names])


def moments(hist: DataFrame) -> DataFrame:
    """band, n, low, high, mean, std (population), n_distinct of hist."""
    first = hist.groupBy("band").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.count("*").alias("n_distinct"))
    off = F.col("v") - F.col("mean")
    var = hist.join(F.broadcast(first.select("band", "mean")), "band").groupBy("band").agg((F.sum(off * off * F.col("n")) / F.sum("n")).alias("var"))
    return first.join(var, "band").withColumn("std", F.sqrt("var")).drop("var")


def norm_stats(bands: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """band, lo, hi (percentiles, linear), mean and population std of the values between them; std below 1e-8 is 1."""
    hist = histogram(bands)
    edges = quantiles(hist, {"lo": low, "hi": high})
    inside = hist.join(F.broadcast(edges), "band").where("v BETWEEN lo AND hi").select("band", "v", "n")
    out = edges.join(moments(inside).select("band", "mean", "std"), "band")
    return out.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def apply_norm(bands: DataFrame, stats: DataFrame, mode: str = "clip_zscore") -> DataFrame:
    """bands with z in 0..1: clipped to lo..hi, then scaled to that range or 0.5 + 0.25 z-scores; missing is 0."""
    v = F.least("hi", F.greatest("lo", "v"))
    if mode == "minmax":
        z = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    else:
        z = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.25 * (v - F.col("mean")) / F.col("std")))
    return bands.join(F.broadcast(stats), "band").select("r", "c", "band", F.coalesce(F.when(~F.isnan("v"), z), F.lit(0.0)).alias("z"))


def profile(bands: DataFrame) -> DataFrame:
    """band, n, low, high, mean, std, p01, p50, p99, n_distinct."""
    hist = histogram(bands)
    return moments(hist).join(quantiles(hist, {"p01": 0.01, "p50": 0.5, "p99": 0.99}), "band")


def quantised(bands: DataFrame, levels: int = 32000, offset: int = -16000) -> DataFrame:
    """bands with q, a whole number of levels from offset over the band's range, and back, the value it stands for."""
    edges = bands.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / levels).otherwise(1.0)
    q = (F.floor((F.col("v") - F.col("lo")) / F.col("step") + 0.5) + offset).cast("int")
    return bands.join(F.broadcast(edges), "band").withColumn("step", step).withColumn("q", q).withColumn("back", (F.col("q") - offset) * F.col("step") + F.col("lo"))


def run_lengths(cells: DataFrame, code: Column) -> DataFrame:
    """r, run (from 0), start, length, code: runs of equal code along each row."""
    w = Window.partitionBy("r").orderBy("c")
    new = cells.withColumn("code", code)
    new = new.withColumn("run", F.sum(F.coalesce((F.col("code") != F.lag("code").over(w)).cast("int"), F.lit(0))).over(w))
    return new.groupBy("r", "run").agg(F.min("c").alias("start"), F.count("*").alias("length"), F.first("code").alias("code"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """r, c, code: the cells that runs stand for."""
    return runs.select("r", F.explode(F.sequence("start", F.col("start") + F.col("length").cast("int") - 1)).alias("c"), "code")


def fingerprint(cells: DataFrame, *keys: str) -> DataFrame:
    """A number for each set of cells that no order changes: sum and xor of their hashes."""
    h = F.xxhash64("r", "c")
    return cells.groupBy(*keys).agg(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s"), F.count("*").alias("n"))


def content(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n, s, x: number of rows, and sum (modulo 2**62) and xor of the hashes of whole rows; no order changes them.

    A row's hash is the first 60 bits of the md5 of all its columns as text, each behind its length; null is '-'.
    DuckDB's text is the same for whole numbers, strings, timestamps (in UTC) and doubles from 1e-3 up to 1e7.
    """
    texts = [F.col(c).cast("string") for c in rows.columns]
    row = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    total = (F.sum(h.cast("decimal(20,0)")) % F.lit(1 << 62).cast("decimal(20,0)")).cast("long")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), total.alias("s"), F.bit_xor(h).alias("x"))
