"""Candidate sweeps: ranking, selection, calibration, paired contrasts, decision rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(sweep: DataFrame, *order: Column) -> DataFrame:
    """Eligible rows that have a score, numbered by the order given (total, ties included)."""
    w = Window.orderBy(*order)
    return sweep.where(F.col("eligible") & F.col("dti").isNotNull()).withColumn("rank", F.row_number().over(w))


def winner(sweep: DataFrame, *order: Column) -> DataFrame:
    """The first row; a null score among the rows is an error, not a 0."""
    guarded = sweep.withColumn("dti", F.when(F.col("dti").isNull(), F.raise_error(F.lit("a candidate has no score"))).otherwise(F.col("dti")))
    return guarded.orderBy(*order).limit(1)


def best_by(sweep: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return sweep.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def matched_support(sweep: DataFrame, support: Column, tolerances: list[float], field: str = "field") -> DataFrame:
    """field, tol and the best row whose support is within tol of the target."""
    t = sweep.withColumn("support", support).withColumn("tol", F.explode(F.array(*[F.lit(x) for x in tolerances])))
    fit = t.where(F.abs(F.col("pred_px") - F.col("support")) <= F.col("tol") * F.col("support"))
    w = Window.partitionBy(field, "tol").orderBy(F.desc("dti"), "candidate")
    return fit.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def width_gain(sweep: DataFrame) -> DataFrame:
    """By floor the score at the widest band less that at the narrowest."""
    return sweep.groupBy("fi").agg((F.max_by("dti", "width") - F.min_by("dti", "width")).alias("gain"))


def marginal_gain(sweep: DataFrame) -> DataFrame:
    w = Window.partitionBy("fi").orderBy("width")
    return sweep.withColumn("step", F.lead("dti").over(w) - F.col("dti")).where("step IS NOT NULL")


def width_gains(sweep: DataFrame) -> DataFrame:
    """n, low, mean, high of width_gain over the floors."""
    return width_gain(sweep).agg(F.count("gain").alias("n"), F.min("gain").alias("low"), F.avg("gain").alias("mean"), F.max("gain").alias("high"))


def calibrated(folds: DataFrame, seed=None) -> DataFrame:
    """candidate, mean, best: the mean score over folds of each candidate (fold, candidate, dti), and which is chosen: the
    first of the greatest, by candidate; the candidate seed, the field as it is, where none is above it."""
    means = folds.groupBy("candidate").agg(F.avg("dti").alias("mean"))
    first = F.row_number().over(Window.orderBy(F.desc(F.round("mean", 9)), F.desc(F.col("candidate") == F.lit(seed)) if seed is not None else F.asc("candidate"), "candidate"))
    return means.withColumn("best", first == 1)


def leave_one_out(folds: DataFrame) -> DataFrame:
    """held, candidate (best mean on the other folds), dti on the held fold, oracle (the best there), regret.

    Fewer than three folds leave too little to learn from: then all but held is null.
    """
    held = folds.select(F.col("fold").alias("held")).distinct()
    n = held.agg(F.count("*").alias("folds"))
    others = folds.join(F.broadcast(held), F.col("fold") != F.col("held"))
    means = others.groupBy("held", "candidate").agg(F.avg("dti").alias("mean"))
    w = Window.partitionBy("held").orderBy(F.desc(F.round("mean", 9)), "candidate")
    pick = means.withColumn("n", F.row_number().over(w)).where("n = 1").select("held", "candidate")
    own = folds.withColumnRenamed("fold", "held")
    best = own.groupBy("held").agg(F.max("dti").alias("oracle"))
    out = pick.join(own, ["held", "candidate"]).join(best, "held").withColumn("regret", F.col("oracle") - F.col("dti"))
    every = held.join(out, "held", "left").crossJoin(F.broadcast(n))
    return every.select("held", *[F.when(F.col("folds") >= 3, F.col(c)).alias(c) for c in ("candidate", "dti", "oracle", "regret")])


def sign_agreement(scores: DataFrame, reference) -> DataFrame:
    """candidate, better, worse, equal, n: parts where a candidate is above or below the reference, both scored."""
    ref = scores.where(F.col("candidate") == reference).select("part", F.col("dti").alias("ref"))
    both = scores.where(F.col("candidate") != reference).join(ref, "part").where("dti IS NOT NULL AND ref IS NOT NULL")
    d = F.round(F.col("dti") - F.col("ref"), 9)
    return both.groupBy("candidate").agg(F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.count_if(d == 0).alias("equal"), F.count("*").alias("n"))


def cross_rank(sweeps: DataFrame, limit: int) -> DataFrame:
    """Candidates that every sweep has, by worst and then mean contrast: candidate, worst, mean, rank."""
    n = sweeps.agg(F.count_distinct("sweep").alias("all"))
    g = sweeps.groupBy("candidate").agg(F.min("contrast").alias("worst"), F.avg("contrast").alias("mean"), F.count_distinct("sweep").alias("n"))
    whole = g.crossJoin(F.broadcast(n)).where(F.col("n") == F.col("all"))
    w = Window.orderBy(F.desc(F.round("worst", 9)), F.desc(F.round("mean", 9)), "candidate")
    return whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("candidate", "worst", "mean", "rank")


def rank_of(ranked: DataFrame, candidate) -> DataFrame:
    """The rank of a candidate in a list, and its length; null where the list lacks it."""
    return ranked.agg(F.max(F.when(F.col("candidate") == candidate, F.col("rank"))).alias("rank"), F.count("*").alias("n"))


def reliability(n_scoreable: Column, least: int = 12) -> Column:
    return F.when(n_scoreable >= least, "readable").otherwise("too few blocks")


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, in order; null counts as not holding."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())


def decision(conditions: dict[str, Column]) -> Column:
    """ADOPT if all hold, KEEP if none does, else CONFLICT."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions.values()), F.lit(0))
    return F.when(n == len(conditions), "ADOPT").when(n == 0, "KEEP").otherwise("CONFLICT")


def exposure(members: DataFrame) -> DataFrame:
    """Difference in differences, halved: (treated - control) after less the same before, over members."""
    cell = lambda a, b: F.avg(F.when((F.col("treated") == a) & (F.col("exposed") == b), F.col("score")))
    return members.agg((((cell(True, True) - cell(False, True)) - (cell(True, False) - cell(False, False))) / 2).alias("effect"))
