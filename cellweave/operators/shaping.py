"""From a probability field to emissions: the policy grid, full shaping, the pruned sweep, post-processing."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import emission, kernels, regions, scoring
from cellweave.sources.shared import stored

POLICY = "candidate int, t0 double, thin boolean, width int, soft boolean, gamma double, votes int"


def policies(spark: SparkSession, floors: list[float], thins=(True, False), widths=(0, 1, 2), softs=(False,), gammas=(1.0,), votes=(1,)) -> DataFrame:
    """The grid of candidates in the order of its parameters, numbered from 0: candidate, t0, thin, width, soft, gamma, votes."""
    grid = product(floors, thins, widths, softs, gammas, votes)
    return spark.createDataFrame([(i, float(t), n, w, s, float(g), v) for i, (t, n, w, s, g, v) in enumerate(grid)], POLICY)


def support(field: DataFrame, footprint: DataFrame, floors: list[float]) -> DataFrame:
    """fi, t0, r, c: cells of the footprint at each floor or above it. The floor itself counts, unlike in emission.at_floors."""
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("fi"), F.lit(t).alias("t0")) for i, t in enumerate(floors)]))
    above = field.join(footprint.select("r", "c").distinct(), ["r", "c"], "left_semi").withColumn("f", levels).where(F.col("p") >= F.col("f.t0"))
    return above.select("f.fi", "f.t0", "r", "c")


def bases(field: DataFrame, policy: DataFrame, radius: int = 3) -> DataFrame:
    """base, r, c: what each floor keeps, whole and thinned; base is the number of the floor's first candidate, doubled,
    and one more if thinned. Each is made once, however many widths it serves."""
    kinds = policy.groupBy("t0", "thin").agg(F.min("candidate").alias("least"))
    first = policy.groupBy("t0").agg(F.min("candidate").alias("first"))
    kinds = kinds.join(first, "t0").select("t0", "thin", "first")
    above = field.select("r", "c", "p").join(F.broadcast(first), F.col("p") > F.col("t0")).select("first", "r", "c", "p")
    thin = above.join(F.broadcast(kinds.where("thin").select("first")), "first", "left_semi")
    kept = kernels.thin_cover(thin.withColumnRenamed("first", "k"), "k", radius).select((F.col("k") * 2 + 1).alias("base"), "r", "c")
    whole = above.join(F.broadcast(kinds.where("NOT thin").select("first")), "first", "left_semi").select((F.col("first") * 2).alias("base"), "r", "c")
    return stored(kept.unionByName(whole), "bases")


def grown(kept: DataFrame, policy: DataFrame, inside: Column | str) -> DataFrame:
    """candidate, r, c, p of each policy over its base (base, r, c): a hard band of its width, or with soft a ramp."""
    first = policy.groupBy("t0").agg(F.min("candidate").alias("first"))
    asked = policy.join(first, "t0").select("candidate", "width", "soft", "gamma", (F.col("first") * 2 + F.col("thin").cast("int")).alias("base"))
    widest = policy.agg(F.max("width").alias("w")).first().w or 0
    near = scoring.spread(kept, max(1, widest), positive=False).groupBy("base", F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.min("d").alias("d"))
    met = near.join(F.broadcast(asked), "base").where(F.col("d") <= F.col("width")).where(inside)
    ramp = F.pow(1 - F.col("d") / (F.col("width") + 1), F.col("gamma"))
    return met.select("candidate", "r", "c", F.when(F.col("soft"), ramp).otherwise(1.0).alias("p"))


def shaped(field: DataFrame, policy: DataFrame, inside: Column | str, radius: int = 3) -> DataFrame:
    """candidate, r, c, p: full shaping of a field (r, c, p): floor, thin, then band or ramp, cut to inside (of r, c)."""
    return grown(bases(field, policy, radius), policy, inside)


def pruned_sweep(field: DataFrame, truth: DataFrame, policy: DataFrame, inside: Column | str, cap: int, radius: int = 3) -> DataFrame:
    """policy with emitted_px, duplicate_of, skipped and the scores of each candidate; what need not be is not scored.

    Floors that keep as many cells keep the same ones: the later ones take the first's rows (duplicate_of, its t0). A
    floor that keeps more than cap cells is not scored unthinned (skipped): no band over it can be small enough; its
    emitted_px is what it keeps, for wider bands a lower bound.
    """
    above = field.join(F.broadcast(policy.select("t0").distinct()), F.col("p") > F.col("t0")).groupBy("t0").agg(F.count("*").alias("above"))
    counts = policy.select("t0").distinct().join(above, "t0", "left").na.fill(0, ["above"])
    twins = stored(counts.join(counts.groupBy("above").agg(F.min("t0").alias("twin")), "above"), "floors")
    marked = policy.join(F.broadcast(twins), "t0").withColumn("skipped", ~F.col("thin") & (F.col("above") > cap))
    todo = stored(marked.where((F.col("t0") == F.col("twin")) & ~F.col("skipped")).select(policy.columns), "todo")
    scores = stored(scoring.global_score(truth, shaped(field, todo, inside, radius)), "scores")
    kinds = ["thin", "width", "soft", "gamma", "votes"]
    own = todo.join(scores, "candidate", "left").select(F.col("t0").alias("twin"), *kinds, *[c for c in scores.columns if c != "candidate"])
    out = marked.join(own, ["twin", *kinds], "left")
    emitted = F.when(F.col("skipped"), F.col("above")).otherwise(F.coalesce("pred_px", F.lit(0))).cast("long")
    duplicate = F.when(F.col("t0") != F.col("twin"), F.col("twin"))
    return out.select("candidate", "t0", "thin", "width", emitted.alias("emitted_px"), duplicate.alias("duplicate_of"), "skipped", "tp", "fp", "n_gt", "dti")


def cross_dilated(mask: DataFrame) -> DataFrame:
    """The mask and its cells' four neighbours."""
    steps = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))]))
    return mask.select("r", "c").withColumn("o", steps).select((F.col("r") + F.col("o.y")).alias("r"), (F.col("c") + F.col("o.x")).alias("c")).distinct()


def postprocessed(field: DataFrame, inside: Column | str, threshold: float = 0.15, close: int = 3, least: int = 5, vessel_weight: float | None = None, boost: bool = True) -> DataFrame:
    """r, c, p, kept: ridges enhanced (with vessel_weight), cut at the threshold, closed, grown by four neighbours, small
    regions (of four neighbours, below least cells) dropped; p of what is kept is the threshold at least, if that is below 0.5."""
    field = field.select("r", "c", "p") if vessel_weight is None else kernels.vessel_blend(field, vessel_weight)
    mask = cross_dilated(emission.close_square(field.where(F.col("p") > threshold), close)).where(inside)
    kept = regions.drop_small(regions.regions(mask, neighbours=4), least).select("r", "c", F.lit(True).alias("kept"))
    both = field.join(kept, ["r", "c"], "full").select("r", "c", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("kept", F.lit(False)).alias("kept"))
    return both.withColumn("p", F.when(F.col("kept"), F.greatest("p", F.lit(threshold))).otherwise(F.col("p"))) if boost and threshold < 0.5 else both
