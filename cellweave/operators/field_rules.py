"""Decisions by rules stated beforehand: which field an adopted policy is applied to, and whether a measured policy ships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.kernel import ALPHA, BETA

#: Fixed values of the rules: margin of a contrast, least share of bootstrap draws, windows of support (the middle one
#: decides), least number of candidates in it.
MARGIN, LEAST_P, LEAST_CANDIDATES = 0.010, 0.95, 3
WINDOWS, PRIMARY = (0.15, 0.25, 0.40), 0.25
PASS, FAIL, UNVERIFIED, UNMEASURED, NOT_APPLICABLE = "PASS", "FAIL", "UNVERIFIED", "NOT_MEASURABLE_FROM_COMMITTED_BYTES", "NOT_APPLICABLE"
RULES = ("f1", "f2", "r1", "r2", "r3", "r4", "r5")


def status(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), PASS).otherwise(FAIL)


def fold_completeness(fields: DataFrame, evidence: DataFrame, pinned: dict | None = None) -> DataFrame:
    """field, f1 of fields (field, runs: an array, null or empty if not recorded) whose runs have evidence (run) of their folds.

    pinned: runs, live (folds found), reported (folds that the report names, or None), least (folds asked for, or None): a
    field of just these runs passes if live is known, not below least, and what is reported. Any other
    field passes if all its runs have evidence. Without it, or without recorded runs, it is UNVERIFIED, which is no pass.
    """
    runs = F.array_distinct(F.coalesce("runs", F.array().cast("array<string>")))
    own = fields.select("field", runs.alias("runs"))
    seen = own.select("field", F.explode("runs").alias("run")).join(evidence.select("run").distinct().withColumn("seen", F.lit(1)), "run", "left")
    own = own.join(seen.groupBy("field").agg(F.count("*").alias("n"), F.count("seen").alias("k")), "field", "left")
    out = F.when(F.size("runs") == 0, UNVERIFIED).when(F.col("n") == F.col("k"), PASS).otherwise(UNVERIFIED)
    if pinned and pinned["runs"]:
        live, reported, least = (pinned.get(x) for x in ("live", "reported", "least"))
        fine = live is not None and (least is None or live >= least) and (reported is None or reported == live)
        same = F.array_sort("runs") == F.array(*[F.lit(x) for x in sorted(set(pinned["runs"]))])
        out = F.when((F.size("runs") > 0) & same, PASS if fine else FAIL).otherwise(out)
    return own.select("field", out.alias("f1"))


def in_windows(sweep: DataFrame, support: float, windows: tuple[float, ...] = WINDOWS) -> DataFrame:
    """field, tol, n, best (dti, t0, width, px) of the candidates whose px is within tol of the support."""
    each = sweep.withColumn("tol", F.explode(F.array(*[F.lit(t) for t in windows]))).where(F.abs(F.col("px") - support) <= F.col("tol") * support)
    best = F.min(F.struct((-F.col("dti")).alias("m"), "t0", "width", "px")).alias("b")
    return each.groupBy("field", "tol").agg(F.count("*").alias("n"), best).select("field", "tol", "n", (-F.col("b.m")).alias("dti"), F.col("b.t0").alias("t0"), F.col("b.width").alias("width"), F.col("b.px").alias("px"))


def field_selection(sweep: DataFrame, facts: DataFrame, shipped: str, support: float, proposal: str | None = None, windows: tuple[float, ...] = WINDOWS, primary: float = PRIMARY) -> DataFrame:
    """field, f1, f2, r1 to r5, passes and verdict (the same in every row) of each field.

    sweep: field, t0, width, dti, px, adopted (whether the row is of the adopted policy): hard candidates. facts: field, f1,
    reference (the index of the field's own reference policy, null if it has none), p (how often a paired block bootstrap of
    its best candidate against the shipped field's is above 0; null if not measured). support: cells of the shipped policy.

    f2: a sweep with reference and adopted row; r1: best in the primary window above the shipped field's by more than MARGIN;
    r2: first of all fields in every window (ties to the first name); r3: p of LEAST_P and more, an unmeasured one never passes;
    r4: the adopted policy above the own reference by more than MARGIN; r5: LEAST_CANDIDATES in the primary window. For the
    shipped field r1 and r3 do not apply. The verdict adopts the only field that passes all, or the proposed one of
    them; several without end in CONFLICT, and all else keeps the shipped field.
    """
    found = in_windows(sweep, support, windows)
    here = found.where(F.col("tol") == primary).select("field", "n", F.col("dti").alias("best"))
    top = found.groupBy("tol").agg(F.min(F.struct((-F.col("dti")).alias("m"), "field")).alias("b")).select("tol", F.col("b.field").alias("field"))
    firsts = top.groupBy("field").agg(F.count("*").alias("firsts"))
    adopted = sweep.where("adopted").groupBy("field").agg(F.max("dti").alias("adopted"))
    ship = here.where(F.col("field") == shipped).agg(F.max("best").alias("ship"))  # one row, also without candidates
    own = facts.join(here, "field", "left").join(firsts, "field", "left").join(adopted, "field", "left").crossJoin(F.broadcast(ship))
    is_ship = F.col("field") == shipped
    own = own.select(
        "field",
        F.coalesce("f1", F.lit(UNVERIFIED)).alias("f1"),
        status(F.col("reference").isNotNull() & F.col("adopted").isNotNull()).alias("f2"),
        F.when(is_ship, NOT_APPLICABLE).otherwise(status(F.col("best") > F.col("ship") + MARGIN)).alias("r1"),
        status(F.col("firsts") == len(windows)).alias("r2"),
        F.when(is_ship, NOT_APPLICABLE).when(F.col("p").isNull(), UNMEASURED).otherwise(status(F.col("p") >= LEAST_P)).alias("r3"),
        status(F.col("adopted") - F.col("reference") > MARGIN).alias("r4"),
        status(F.col("n") >= LEAST_CANDIDATES).alias("r5"),
    )
    own = own.withColumn("passes", ~is_ship & F.forall(F.array(*RULES), lambda x: x == PASS))
    passed = own.where("passes").agg(F.array_sort(F.collect_list("field")).alias("passed"))
    verdict = F.when((F.size("passed") == 1) & F.lit(proposal is None), F.concat(F.lit("ADOPT "), F.col("passed")[0])).when(F.size("passed") > 1, "CONFLICT")
    if proposal is not None:
        verdict = verdict.when(F.array_contains("passed", proposal), f"ADOPT {proposal}")
    return own.crossJoin(F.broadcast(passed)).withColumn("verdict", verdict.otherwise(f"KEEP {shipped}")).drop("passed")


def projected(coverage: Column, wrong: Column, truth_px: Column) -> Column:
    """The index at another size of truth, for a policy that finds this share of it with this much wrong mass."""
    tp = coverage * truth_px
    return tp / (ALPHA * (tp + wrong) + BETA * truth_px + 1e-12)


def width_decision(sweep: DataFrame, others: DataFrame, anchors: DataFrame, shipped: tuple[float, int], truth_px: float) -> DataFrame:
    """One row: t0, width of the best candidate, gain, anchors, wins, ensembles, reproduced, failed (numbers of conditions), verdict.

    sweep: t0, width, dti, tp, fp of hard candidates; the best has the greatest dti, ties to the lower t0 and width. It ships if
    it beats the shipped policy (t0, width) by more than MARGIN (1), at every anchor (truth_px: sizes of truth that
    are plausible), both projected (2), and, in every other ensemble that has the policy (others: ensemble, t0, width,
    dti, reference), the ensemble's own reference policy by more than MARGIN (3). Without such an ensemble the third
    condition is unmet: NOT REPRODUCED.
    """
    best = sweep.orderBy(F.desc("dti"), "t0", "width").limit(1)
    known = lambda rows, p: rows.agg(*[F.max(x).alias(p + x) for x in ("t0", "width", "dti", "tp", "fp")])
    both = known(best, "").crossJoin(F.broadcast(known(sweep.where((F.col("t0") == shipped[0]) & (F.col("width") == shipped[1])), "s_")))
    share = lambda c: F.round(F.col(c) / truth_px, 6)
    at = anchors.select(F.col("truth_px").cast("double").alias("truth_px")).crossJoin(F.broadcast(both))
    here, there = projected(share("tp"), F.round("fp", 3), F.col("truth_px")), projected(share("s_tp"), F.round("s_fp", 3), F.col("truth_px"))
    wins = at.agg(F.count("*").alias("anchors"), F.count_if(here > there).alias("wins"))
    contrast = F.round(F.round("dti", 6) - F.round("reference", 6), 6)
    same = others.join(F.broadcast(best.select("t0", "width")), ["t0", "width"]).where("reference IS NOT NULL")
    repro = same.agg(F.count("*").alias("ensembles"), F.count_if((contrast > MARGIN) & (F.col("dti") > F.col("reference"))).alias("reproduced"))
    gain = F.round(F.round("dti", 6) - F.round("s_dti", 6), 6)
    whole = both.select("t0", "width", gain.alias("gain")).crossJoin(F.broadcast(wins)).crossJoin(F.broadcast(repro))
    conditions = {"1": F.col("gain") > MARGIN, "2": F.col("wins") == F.col("anchors"), "3": (F.col("ensembles") > 0) & (F.col("reproduced") == F.col("ensembles"))}
    failed = F.concat_ws("/", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in conditions.items()])
    verdict = F.when(F.col("failed") == "", "SHIP").when(F.col("ensembles") == 0, "NOT REPRODUCED").otherwise("NOT SHIPPED")
    return whole.withColumn("failed", failed).withColumn("verdict", verdict)
