"""Audits and contrasts over the facts of scoring.components: paired blocks, re-scores, controls, verdicts, fold algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.kernel import RADIUS
from cellweave.operators import regions, scoring

#: The least number of scoreable blocks whose bootstrap interval can be read.
LEAST_BLOCKS = 12


def same_parts(scores: DataFrame, others: DataFrame) -> None:
    """An error unless both tables (candidate, part) have each candidate's rows for the same parts."""
    a, b = (x.select("candidate", "part").distinct() for x in (scores, others))
    odd = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["candidate", "part"], "full").where("a IS NULL OR b IS NULL")
    if (row := odd.first()) is not None:
        raise ValueError(f"the two sides were not scored on the same blocks: {row.asDict()}")


def contrasts(scores: DataFrame, reference) -> DataFrame:
    """candidate, part, diff: a candidate's score less the reference's (rounded), where both have one."""
    ref = scores.where(F.col("candidate") == reference).select("part", F.col("dti").alias("ref"))
    both = scores.where(F.col("candidate") != reference).join(ref, "part").where("dti IS NOT NULL AND ref IS NOT NULL")
    return both.select("candidate", "part", F.round(F.col("dti") - F.col("ref"), 9).alias("diff"))


def population_agreement(labels: DataFrame, proxy: DataFrame, reference) -> DataFrame:
    """Do two populations prefer the same candidate in the same blocks? labels, proxy: candidate, part, dti (null where
    a block has no truth); for each candidate but the reference

    scoreable, gain (blocks of proxy, and those where it beats the reference), both (blocks of both populations), agree
    (of the same sign), labels_lose, conflict_lose_gain (labels lose and proxy gains), conflict_gain_lose, worst.
    """
    same_parts(labels, proxy)
    p, other = contrasts(proxy, reference), contrasts(labels, reference).withColumnRenamed("diff", "l")
    both = p.join(other, ["candidate", "part"], "left")
    d, e = F.col("diff"), F.col("l")
    known = e.isNotNull()
    return both.groupBy("candidate").agg(
        F.count("*").alias("scoreable"), F.count_if(d > 0).alias("gain"), F.count("l").alias("both"), F.count_if(known & ((d > 0) == (e > 0))).alias("agree"),
        F.count_if(e < 0).alias("labels_lose"), F.count_if((e < 0) & (d > 0)).alias("conflict_lose_gain"), F.count_if((e > 0) & (d < 0)).alias("conflict_gain_lose"), F.min("diff").alias("worst"),
    )


def majority_conflicts(agreement: DataFrame, whole: DataFrame, reference) -> DataFrame:
    """Every candidate with whether it gains in most blocks and loses over the whole: candidate, gain, scoreable, dti,
    reference_dti, conflict.

    agreement: of population_agreement; whole: candidate, dti of the same population.
    """
    ref = whole.where(F.col("candidate") == reference).select(F.col("dti").alias("reference_dti"))
    found = agreement.join(whole.select("candidate", "dti"), "candidate").crossJoin(F.broadcast(ref))
    conflict = (F.col("gain") > F.col("scoreable") / 2) & (F.col("dti") < F.col("reference_dti"))
    return found.select("candidate", "gain", "scoreable", "dti", "reference_dti", conflict.alias("conflict"))


def plain_score(truth: DataFrame, pred: DataFrame, radius: int = RADIUS) -> DataFrame:
    """global_score by another way: credit and price in two joins of their own. For audits."""
    names = pred.select("candidate").distinct()
    tp = scoring.credit(truth, pred, radius).groupBy("candidate").agg(F.sum("credit").alias("tp"))
    fp = scoring.penalties(truth, pred, radius).groupBy("candidate").agg(F.sum("fp").alias("fp"), F.count("*").alias("pred_px"))
    n = truth.agg(F.count("*").alias("n_gt"))
    out = names.join(tp, "candidate", "left").join(fp, "candidate", "left").na.fill(0).crossJoin(F.broadcast(n))
    return out.withColumn("fn", F.col("n_gt") - F.col("tp")).withColumn("dti", scoring.dti(F.col("tp"), F.col("fp"), F.col("n_gt")))


def rescored(expected: DataFrame, again: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """candidate, dti, again, ok: whether an independent score is within the tolerance; a missing one is not."""
    both = expected.select("candidate", "dti").join(again.select("candidate", F.col("dti").alias("again")), "candidate", "left")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("dti") - F.col("again")) <= tolerance, F.lit(False)))


#: How far a row of a sweep that was run again may be from the committed one.
TOLERANCES = {"dti": 1e-6, "tp": 1e-3, "fp": 1e-3, "fn": 1e-3, "pred_px": 0}


def crosschecked(local: DataFrame, committed: DataFrame, key: str = "candidate", tolerances: dict[str, float] | None = None) -> DataFrame:
    """key, status (reproduced, MISMATCH, or not_available without a committed row) and off, the columns that are."""
    tolerances = tolerances or TOLERANCES
    theirs = committed.select(key, F.lit(True).alias("there"), *[F.col(c).alias(f"their_{c}") for c in tolerances])
    bad = F.filter(F.array(*[F.when(~F.coalesce(F.abs(F.col(c) - F.col(f"their_{c}")) <= t, F.lit(False)), F.lit(c)) for c, t in tolerances.items()]), lambda x: x.isNotNull())
    both = local.join(theirs, key, "left").withColumn("off", F.when(F.col("there"), F.array_join(bad, ",")))
    status = F.when(F.col("there").isNull(), "not_available").when(F.col("off") == "", "reproduced").otherwise("MISMATCH")
    return both.select(key, status.alias("status"), "off")


def paired_folds(parts: DataFrame, a, b, identical: float = 1e-9) -> DataFrame:
    """part (-1: all), dti_a, dti_b, contrast (b less a) and identical, for two candidates of scoring.components."""
    whole = parts.where(F.col("candidate").isin(a, b))
    s = scoring.score(whole.unionByName(whole.withColumn("part", F.lit(-1))), "candidate", "part").select("candidate", "part", "dti")
    x, y = (s.where(F.col("candidate") == c).select("part", F.col("dti").alias(n)) for c, n in ((a, "dti_a"), (b, "dti_b")))
    return x.join(y, "part").withColumn("contrast", F.col("dti_b") - F.col("dti_a")).withColumn("identical", F.abs(F.col("contrast")) <= identical)


def arms_verdict(contrasts_by: DataFrame) -> DataFrame:
    """verdict of a two-arm contrast from one row for each population (population, contrast): labels, proxy, combined.

    The combined population decides where it was scored; else labels and proxy, if they agree; a contrast of 0 is a loss.
    """
    of = {p: F.max(F.when(F.col("population") == p, F.col("contrast"))) for p in ("labels", "proxy", "combined")}
    row = contrasts_by.agg(*[x.alias(p) for p, x in of.items()])
    up = {p: F.col(p) > 0 for p in of}
    way = (
        F.when(F.col("proxy").isNull() | F.col("labels").isNull(), "NOT_MEASURABLE")
        .when(F.col("combined").isNotNull(), F.when(up["combined"], "GAIN_ON_COMBINED").otherwise("LOSS_ON_COMBINED"))
        .when(up["proxy"] & up["labels"], "GAIN_ON_BOTH")
        .when(~up["proxy"] & ~up["labels"], "LOSS_ON_BOTH")
        .otherwise(F.when(up["proxy"], "PROXY_GAINS_LABELS_LOSE").otherwise("LABELS_GAIN_PROXY_LOSES"))
    )
    return row.withColumn("verdict", way)


def baselines(truth: DataFrame, footprint: DataFrame) -> DataFrame:
    """candidate, r, c, p of what costs nothing to make: the truth itself, and the whole footprint. An empty field has no cells
    (empty_score)."""
    copy = truth.select(F.lit("copy").alias("candidate"), "r", "c", F.lit(1.0).alias("p"))
    return copy.unionByName(footprint.select(F.lit("blanket").alias("candidate"), "r", "c", F.lit(1.0).alias("p")))


def empty_score(truth: DataFrame) -> DataFrame:
    """The score of a field without cells, as of global_score: 0, or 1 where there is no truth."""
    n, zero = F.col("n_gt"), F.lit(0.0)
    row = truth.agg(F.count("*").alias("n_gt")).select(F.lit("zeros").alias("candidate"), zero.alias("tp"), zero.alias("fp"), n.cast("double").alias("fn"), "n_gt", F.lit(0).cast("long").alias("pred_px"))
    return row.withColumn("dti", scoring.dti(F.col("tp"), F.col("fp"), n))


def transfer(model: DataFrame, other: DataFrame, labels: DataFrame, truth: DataFrame, widths: list[int], least_px: int = 100, least_gain: float = 0.0) -> DataFrame:
    """Does another catalogue's emission raise a model's score on faults that the labels lack?

    model: r, c, p; other, labels, truth: r, c, truth being beyond the radius of labels. One row for each control and
    width: kind, width, dti, ok. Controls: a copy of labels scores below 0.05, one of truth above 0.99. A union of
    the model and the other's band is ok if it gains more than least_gain and both controls hold. A truth of fewer than
    least_px cells is refused by an error.
    """
    from cellweave.operators.emission import bands

    if (n := truth.count()) < least_px:
        raise ValueError(f"the population has {n} cells, fewer than {least_px}: nothing can be read from it")
    one = F.lit(1.0).alias("p")
    fields = [("labels_copy", -1, labels.select("r", "c", one)), ("truth_copy", -1, truth.select("r", "c", one)), ("model", -1, model.select("r", "c", "p"))]
    for w in widths:
        band = bands(other, [w], []).select("r", "c", one)
        fields.append(("union", w, model.select("r", "c", "p").unionByName(band).groupBy("r", "c").agg(F.max("p").alias("p"))))
    every = None
    for k, (_, _, f) in enumerate(fields):
        own = f.select(F.lit(k).alias("candidate"), "r", "c", "p")
        every = own if every is None else every.unionByName(own)
    names = model.sparkSession.createDataFrame([(k, kind, w) for k, (kind, w, _) in enumerate(fields)], "candidate int, kind string, width int")
    scores = names.join(scoring.global_score(truth, every).select("candidate", "dti"), "candidate", "left")
    every_row = Window.partitionBy()
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("dti"))).over(every_row)
    held = (of("labels_copy") < 0.05) & (of("truth_copy") > 0.99)
    ok = F.when(F.col("kind") == "labels_copy", F.col("dti") < 0.05).when(F.col("kind") == "truth_copy", F.col("dti") > 0.99).when(F.col("kind") == "union", held & (F.col("dti") - of("model") > least_gain))
    return scores.select("kind", "width", "dti", ok.alias("ok"))


def discovery(pred: DataFrame, known: DataFrame, thresholds: list[float], radius: int = RADIUS, least: int = 3) -> DataFrame:
    """What a field (r, c, p) says beyond a catalogue (r, c), by threshold: px above it, regions of least cells or more,
    novel ones (no cell of which is nearer than radius to the catalogue), and recall, the share of the catalogue within
    radius of a cell above it."""
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("t")) for i, t in enumerate(thresholds)]))
    above = pred.withColumn("l", levels).where(F.col("p") > F.col("l.t")).select("l.k", "r", "c")
    found = regions.regions(above, "k")
    near = scoring.spread(known, radius).select(F.col("nr").alias("r"), F.col("nc").alias("c")).distinct().withColumn("near", F.lit(1))
    sizes = found.join(near, ["r", "c"], "left").groupBy("k", "region").agg(F.count("*").alias("px"), F.count("near").alias("near"))
    by = sizes.groupBy("k").agg(F.sum("px").alias("px"), F.count_if(F.col("px") >= least).alias("regions"), F.count_if((F.col("px") >= least) & (F.col("near") == 0)).alias("novel"))
    reach = scoring.spread(above.withColumnRenamed("k", "level"), radius, positive=False).select("level", F.col("nr").alias("r"), F.col("nc").alias("c")).distinct()
    hit = known.select("r", "c").distinct().join(reach, ["r", "c"]).groupBy(F.col("level").alias("k")).agg(F.count("*").alias("hit"))
    total = known.select("r", "c").distinct().agg(F.count("*").alias("n"))
    named = pred.sparkSession.createDataFrame(list(enumerate(thresholds)), "k int, threshold double").join(by, "k", "left").join(hit, "k", "left").na.fill(0).crossJoin(F.broadcast(total))
    return named.select("threshold", "px", "regions", "novel", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0).alias("recall"))


def class_accounting(drawn: DataFrame, coded: DataFrame) -> DataFrame:
    """class, features, px: of drawn (class, feature, r, c) the features, and the cells among coded (r, c). A cell that
    several classes draw counts for each."""
    features = drawn.groupBy("class").agg(F.count_distinct("feature").alias("features"))
    px = drawn.select("class", "r", "c").distinct().join(coded.select("r", "c").distinct(), ["r", "c"]).groupBy("class").agg(F.count("*").alias("px"))
    return features.join(px, "class", "left").na.fill(0)


def mask_boxes(bands: DataFrame) -> DataFrame:
    """band, px, r0, r1, c0, c1 of the valid cells of bands (r, c, band, v), and of cells valid in any (any) or in all (all)."""
    fine = bands.where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = bands.agg(F.count_distinct("band").alias("n"))
    by_cell = fine.groupBy("r", "c").agg(F.collect_set("band").alias("own")).crossJoin(F.broadcast(n))
    kinds = F.concat("own", F.array(F.lit("any")), F.when(F.size("own") == F.col("n"), F.array(F.lit("all"))).otherwise(F.array().cast("array<string>")))
    box = [F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")]
    return by_cell.select("r", "c", F.explode(kinds).alias("band")).groupBy("band").agg(F.count("*").alias("px"), *box)


def reach_shares(distances: DataFrame, radius: int = RADIUS) -> DataFrame:
    """n, within (share at radius or nearer), beyond, unreachable (share without any): of the distances d of missed truth."""
    d = F.col("d")
    return distances.agg(F.count("*").alias("n"), F.avg((d <= radius).cast("double") * d.isNotNull().cast("double")).alias("seen"), F.avg(F.coalesce((d <= radius).cast("double"), F.lit(0.0))).alias("within"), F.avg(F.coalesce((d > radius).cast("double"), F.lit(0.0))).alias("beyond"), F.avg(d.isNull().cast("double")).alias("unreachable")).drop("seen")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a or b) and the rows that one of two tables has and the other lacks, repeated rows counted; none if they agree."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def degraded(before: DataFrame, after: DataFrame) -> DataFrame:
    """Gates (name, status) that passed before and are MISSING or SKIPPED now: name, old, new. A failure is no degradation: it
    has to be told whatever was before."""
    both = before.where(F.col("status") == "PASS").select("name", F.col("status").alias("old")).join(after.select("name", F.col("status").alias("new")), "name")
    return both.where(F.col("new").isin("MISSING", "SKIPPED"))


def missing_folds(folds: DataFrame, n_folds: int) -> DataFrame:
    """fold: those of 0..n_folds-1 that folds (fold) lacks."""
    return folds.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold")).join(folds.select(F.col("fold").cast("int").alias("fold")), "fold", "left_anti")


def fold_list(text: str, n_folds: int) -> list[int]:
    """The folds that a comma-separated list names, in order. An empty entry, one that is no number, a fold named
    twice and one beyond the partition are errors: a fold silently lost would pool fewer blocks than asked for."""
    parts = [x.strip() for x in text.split(",")]
    if not all(x.isascii() and x.isdigit() for x in parts):
        raise ValueError(f"not a list of folds: {text!r}")
    folds = sorted(map(int, parts))
    if len(set(folds)) < len(folds) or folds[-1] >= n_folds:
        raise ValueError(f"a fold twice, or beyond {n_folds - 1}: {text!r}")
    return folds


def clean_members(members: DataFrame, selects: int, measures: int) -> DataFrame:
    """members (name, held: array of folds that a member did not see) with clean_selection, clean_measure, clean_pool.

    A member without held folds (null or empty) saw all and is never clean.
    """
    held = F.coalesce("held", F.array().cast("array<int>"))
    has = lambda *folds: F.size(F.array_except(F.array(*[F.lit(f) for f in folds]), held)) == 0
    return members.withColumns({"clean_selection": has(selects), "clean_measure": has(measures), "clean_pool": has(selects, measures)})


def supervision(fault: DataFrame, proxy: DataFrame, near: DataFrame, mode: str, corridor: int = 0) -> DataFrame:
    """r, c of the positive cells of a mode: union (all three), proxy_only or catalogue (fault); within corridor of them."""
    masks = {"union": (fault, proxy, near), "proxy_only": (proxy,), "catalogue": (fault,)}
    if mode not in masks:
        raise ValueError(f"unknown supervision: {mode!r}")
    cells = masks[mode][0].select("r", "c")
    for m in masks[mode][1:]:
        cells = cells.unionByName(m.select("r", "c"))
    if corridor:
        cells = scoring.spread(cells.distinct(), corridor, positive=False).select(F.col("nr").alias("r"), F.col("nc").alias("c"))
    return cells.distinct()


def effective_policy(explicit: Column, adopted: Column, calibrated: Column) -> tuple[Column, Column]:
    """The floor that counts and where it is from: an explicit one, else the adopted, else the in-domain calibration."""
    return F.coalesce(explicit, adopted, calibrated), F.when(explicit.isNotNull(), "explicit").when(adopted.isNotNull(), "adopted").when(calibrated.isNotNull(), "calibrated")


def is_hard(thin: Column, soft: Column) -> Column:
    """A thinned, hard candidate; null thin or soft counts as not set."""
    return F.coalesce(thin, F.lit(False)) & ~F.coalesce(soft, F.lit(False))


def is_adopted(t0: Column, width: Column, hard: Column, floor: float = 0.1) -> Column:
    return F.coalesce((F.abs(t0 - floor) < 1e-9) & (width == 0) & hard, F.lit(False))


def stable_top(sweep: DataFrame, window: str, field: str, score: str = "dti") -> DataFrame:
    """window, field, score, rank and stable: whether the same field is first in all windows. A field counts by its best
    score in the window, ties by its name."""
    best = sweep.where(F.col(score).isNotNull()).groupBy(window, field).agg(F.max(score).alias(score))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(window).orderBy(F.desc(score), F.asc(field))))
    tops = ranked.where("rank = 1").agg((F.count_distinct(field) == 1).alias("stable"))
    return ranked.crossJoin(F.broadcast(tops))


def gap_summary(gaps: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """n, mean, low, high, spread, positive, negative, near_zero over gaps (fold, gap), null gaps left out."""
    g = F.col("gap")
    return gaps.agg(F.count("gap").alias("n"), F.avg(g).alias("mean"), F.min(g).alias("low"), F.max(g).alias("high"), (F.max(g) - F.min(g)).alias("spread"), F.count_if(g > tolerance).alias("positive"), F.count_if(g < -tolerance).alias("negative"), F.count_if(F.abs(g) <= tolerance).alias("near_zero"))
