"""The exact distance-weighted index: neighbourhood credit, additive components, scopes, bootstrap.

Neighbourhoods are never band joins: the side with truth is spread over the kernel's offsets and joined on (r, c).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.kernel import ALPHA, BETA, EPS, RADIUS, dti, offset_rows
from cellweave.sources.shared import stored


def spread(cells: DataFrame, radius: int, positive: bool = True) -> DataFrame:
    """Each cell at all offsets of the disk: the columns of cells, nr, nc, d, k. positive: only where k > 0.

    Joins merge it: its size is taken for that of cells, and broadcast it would not fit the driver.
    """
    rows = [o for o in offset_rows(radius) if o[3] > 0 or not positive]
    offsets = F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx"), F.lit(d).alias("d"), F.lit(k).alias("k")) for y, x, d, k in rows]))
    out = cells.withColumn("o", offsets)
    return out.select(*cells.columns, (F.col("r") + F.col("o.dy")).alias("nr"), (F.col("c") + F.col("o.dx")).alias("nc"), F.col("o.d").alias("d"), F.col("o.k").alias("k")).hint("merge")


def credit(truth: DataFrame, pred: DataFrame, radius: int = RADIUS) -> DataFrame:
    """candidate, r, c, credit: for truth cells with credit, the best k * p around. pred: candidate, r, c, p."""
    near = spread(truth.select("r", "c"), radius)
    hit = near.join(pred.select("candidate", F.col("r").alias("nr"), F.col("c").alias("nc"), "p"), ["nr", "nc"])
    return hit.groupBy("candidate", "r", "c").agg(F.max(F.col("k") * F.col("p")).alias("credit"))


def nearness(truth: DataFrame, radius: int = RADIUS) -> DataFrame:
    """r, c, m: the largest k of a truth cell around, where there is one."""
    return spread(truth.select("r", "c"), radius).groupBy(F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.max("k").alias("m"))


def penalties(truth: DataFrame, pred: DataFrame, radius: int = RADIUS) -> DataFrame:
    """pred with fp = p * (1 - m)."""
    return pred.join(nearness(truth, radius), ["r", "c"], "left").withColumn("fp", F.col("p") * (1 - F.coalesce("m", F.lit(0.0)))).drop("m")


def facts(truth: DataFrame, pred: DataFrame, by: Column, radius: int = RADIUS) -> DataFrame:
    """candidate, part, tp, fp, pred_px for parts that have any: truth is spread once, and met once by pred.

    A cell of pred meets the truth cells around it as one row (as many as the disk has); it gives each of them a
    credit, and pays by the nearest.
    """
    near = spread(truth.select("r", "c").withColumn("part", by), radius)
    around = near.groupBy("nr", "nc").agg(F.max("k").alias("m"), F.collect_list(F.struct("r", "c", "part", "k")).alias("ts"))
    met = pred.select("candidate", "r", "c", "p").withColumn("part", by).join(around.withColumnsRenamed({"nr": "r", "nc": "c"}), ["r", "c"], "left")
    none = F.lit(None).cast("int")
    price = F.struct("part", none.alias("r"), none.alias("c"), F.lit(0.0).alias("credit"), (F.col("p") * (1 - F.coalesce("m", F.lit(0.0)))).alias("fp"), F.lit(1).alias("px"))
    credits = F.transform("ts", lambda t: F.struct(t["part"].alias("part"), t["r"].alias("r"), t["c"].alias("c"), (t["k"] * F.col("p")).alias("credit"), F.lit(0.0).alias("fp"), F.lit(0).alias("px")))
    rows = met.select("candidate", F.explode(F.concat(F.array(price), F.coalesce(credits, F.array().cast("array<struct<part:int,r:int,c:int,credit:double,fp:double,px:int>>")))).alias("x"))
    best = rows.select("candidate", "x.*").groupBy("candidate", "part", "r", "c").agg(F.max("credit").alias("tp"), F.sum("fp").alias("fp"), F.sum("px").alias("px"))
    return best.groupBy("candidate", "part").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("px").alias("pred_px"))


def components(truth: DataFrame, pred: DataFrame, by: Column, radius: int = RADIUS) -> DataFrame:
    """candidate, part, tp, fp, fn, n_gt, pred_px: sums of the global geometry by part (a whole number, of r and c).

    Parts without truth or prediction are there for every candidate; the sums over parts are those of the whole. Both the
    facts and the result, a row for each candidate and part, are written: what is asked of them several times (contrasts,
    folds left out) does not plan or make them again.
    """
    by = by.cast("int")
    gt = truth.select("r", "c").withColumn("part", by).groupBy("part").agg(F.count("*").alias("n_gt"))
    own = stored(facts(truth, pred, by, radius), "facts")
    whole = gt.select(F.lit(None).cast(own.schema["candidate"].dataType).alias("candidate"), "part", F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"), F.lit(0).cast("long").alias("pred_px"), "n_gt")
    rows = own.withColumn("n_gt", F.lit(0).cast("long")).unionByName(whole)
    # a row for each part, with what each candidate has there; then each candidate of any part at every part
    by_part = rows.groupBy("part").agg(F.sum("n_gt").alias("n_gt"), F.collect_list(F.when(F.col("candidate").isNotNull(), F.struct("candidate", "tp", "fp", "pred_px"))).alias("own"))
    names = own.select("candidate").distinct().agg(F.collect_list("candidate").alias("names"))
    grid = by_part.crossJoin(F.broadcast(names)).select("part", "n_gt", "own", F.explode("names").alias("candidate"))
    mine = F.get(F.filter("own", lambda x: x["candidate"] == F.col("candidate")), F.lit(0))
    out = grid.select("candidate", "part", "n_gt", mine.alias("x"))
    zero = {"tp": F.lit(0.0), "fp": F.lit(0.0), "pred_px": F.lit(0).cast("long")}
    out = out.select("candidate", "part", "n_gt", *[F.coalesce(F.col(f"x.{c}"), z).alias(c) for c, z in zero.items()])
    return stored(out.withColumn("fn", F.col("n_gt") - F.col("tp")), "components")


def score(parts: DataFrame, *keys: str) -> DataFrame:
    """Sums of components by keys with dti, null where there is no truth if there are keys beside the candidate."""
    g = parts.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "n_gt", "pred_px")])
    value = dti(F.col("tp"), F.col("fp"), F.col("n_gt"))
    return g.withColumn("dti", F.when(F.col("n_gt") > 0, value) if len(keys) > 1 else value)


def global_score(truth: DataFrame, pred: DataFrame, radius: int = RADIUS) -> DataFrame:
    """candidate, n_gt, tp, fp, fn, pred_px, dti over the whole grid."""
    return score(components(truth, pred, F.lit(0), radius), "candidate")


def bootstrap(parts: DataFrame, reference: str, draws: int, draw: Column) -> DataFrame:
    """Paired block bootstrap: percentiles of the index and of its contrast to the reference, and how often that is above 0.

    parts: candidate, slot (0.. of blocks), tp, fp, fn. draw: the slot drawn for (boot, place, n), the same for all candidates.
    """
    spark = parts.sparkSession
    n = parts.agg(F.count_distinct("slot").alias("n"))
    drawn = spark.range(draws).select(F.col("id").alias("boot")).crossJoin(F.broadcast(n)).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("slot", draw)
    sums = drawn.select("boot", "slot").join(parts, "slot").groupBy("boot", "candidate").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    sums = sums.withColumn("dti", F.col("tp") / (F.col("tp") + ALPHA * F.col("fp") + BETA * F.col("fn") + EPS))
    ref = sums.where(F.col("candidate") == reference).select("boot", F.col("dti").alias("ref"))
    both = sums.join(ref, "boot").withColumn("diff", F.round(F.col("dti") - F.col("ref"), 12))
    pct = [F.percentile(x, F.lit(q)).alias(f"{a}_p{name}") for x, a in (("dti", "dti"), ("diff", "contrast")) for q, name in ((0.025, "2_5"), (0.5, "50"), (0.975, "97_5"))]
    return both.groupBy("candidate").agg(*pct, F.avg(F.when(F.col("candidate") != reference, (F.col("diff") > 0).cast("double"))).alias("prob_beats"))
