"""Registered queries of shaping, audits, codecs and documents; see grid_queries for the grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import kernel
from cellweave.operators import audits, distance, emission, focal, kernels, partition, scoring, selection, shaping, stats, text, windows
from cellweave.plans.grid_queries import by_block, by_fold, footprint_of, in_cents, main_field, near_cells, query, rounded, ship_bands, slotted, sweep_of  # noqa: F401
from cellweave.sources import codec, grids
from cellweave.sources.shared import stored
from cellweave.sources.tables import COLUMNS, event_cells, field_of, fields, read, ship_grid, truth_of

INSIDE = f"r >= 0 AND c BETWEEN 0 AND {COLUMNS - 1}"


@query
def candidate_grid(spark, sf):
    return shaping.policies(spark, kernel.floors(4, 0.001, 1.0), widths=(0, 1), votes=(1, 2)).select("candidate", "t0", "thin", "width", "votes")


@query
def shape_full(spark, sf):
    """Floor, band or ramp, clip, over a grid of policies; unthinned, so that SQL can say the same."""
    policy = shaping.policies(spark, [0.1, 0.3, 0.5], thins=(False,), widths=(0, 1, 2), softs=(False, True), gammas=(2.0,))
    s = shaping.shaped(field_of(event_cells(spark, sf)), policy, INSIDE)
    return rounded(s.groupBy("candidate").agg(F.count("*").alias("px"), F.sum("p").alias("mass")))


def sweep_with(spark, sf, thins):
    cells = event_cells(spark, sf)
    cap = footprint_of(cells).count() // 8
    policy = shaping.policies(spark, [0.1, 0.3, 0.3000001, 0.5], thins=thins, widths=(0, 1))
    return rounded(shaping.pruned_sweep(field_of(cells), truth_of(cells), policy, INSIDE, cap))


@query
def sweep_pruned(spark, sf):
    return sweep_with(spark, sf, (False,))


@query
def sweep_thinned(spark, sf):
    """The pruned sweep with thinned floors too, ranked: by score, then the thinner and narrower first."""
    s = sweep_with(spark, sf, (True, False)).withColumn("eligible", ~F.col("skipped"))
    return selection.ranked(s, F.desc("dti"), F.asc("width"), F.desc("thin"), "candidate").select("rank", "candidate", "t0", "thin", "width", "dti")


@query
def inclusive_floor(spark, sf):
    cells = event_cells(spark, sf)
    above = shaping.support(field_of(cells), footprint_of(cells), [0.1, 0.3, 0.5])
    return above.groupBy("fi", "t0").agg(F.count("*").alias("px"))


@query
def postprocess(spark, sf):
    return rounded(shaping.postprocessed(field_of(event_cells(spark, sf)), INSIDE))


@query
def grid_alignment(spark, sf):
    """Extents of the grids of this engine, and whether each is aligned with the first."""
    names = {"events": event_cells(spark, sf), "purchases": field_of(event_cells(spark, sf)), "shipments": ship_grid(spark, sf)}
    size = [d.agg(F.lit(n).alias("grid"), (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width")) for n, d in names.items()]
    whole = size[0].unionByName(size[1]).unionByName(size[2])
    first = size[0].select(F.col("height").alias("h"), F.col("width").alias("w"))
    return whole.crossJoin(F.broadcast(first)).select("grid", "height", "width", ((F.col("height") == F.col("h")) & (F.col("width") == F.col("w"))).alias("aligned"))


@query
def discovery_report(spark, sf):
    cells = event_cells(spark, sf)
    return rounded(audits.discovery(field_of(cells), truth_of(cells), [0.1, 0.5, 0.9], least=2))


@query
def class_accounting(spark, sf):
    """Signups and clicks as two classes of features: their number, and their cells beyond the radius of labels."""
    cells = event_cells(spark, sf)
    e = cells.where(F.col("kind").isin("signup", "click")).select(F.col("kind").alias("class"), F.concat_ws("-", "r", "c", F.col("value").cast("int").cast("string")).alias("feature"), "r", "c")
    beyond = footprint_of(cells).join(near_cells(truth_of(cells), True), ["r", "c"], "left_anti")
    return audits.class_accounting(e, beyond)


@query
def mask_boxes(spark, sf):
    g = ship_grid(spark, sf).withColumn("q", F.when(F.col("q") > 10, F.col("q"))).withColumn("x", F.when(F.col("x") > 0.02, F.col("x")))
    return audits.mask_boxes(stats.long_bands(g, ["v", "q", "x"]))


@query
def miss_reach(spark, sf):
    cells = event_cells(spark, sf)
    d = distance.distance_to(truth_of(cells), field_of(cells).where("p > 0.5"))
    return rounded(audits.reach_shares(d))


@query
def row_predicates(spark, sf):
    """Which rows of the sweep are hard and which the adopted one; widths stand for soft bands, even floors for thinned."""
    s = sweep_of(event_cells(spark, sf)).withColumns({"t0": F.element_at(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7))), F.col("fi") + 1), "thin": F.col("fi") % 2 == 0, "soft": F.when(F.col("width") > 0, F.col("width") == 2)})
    hard = audits.is_hard(F.col("thin"), F.col("soft"))
    return s.select("candidate", hard.alias("hard"), audits.is_adopted(F.col("t0"), F.col("width"), hard).alias("adopted"))


@query
def supervision_modes(spark, sf):
    cells = event_cells(spark, sf)
    fault, proxy, near = truth_of(cells), truth_of(cells, "signup"), truth_of(cells, "click")
    out = None
    for mode in ("union", "proxy_only", "catalogue"):
        for corridor in (0, 2):
            own = audits.supervision(fault, proxy, near, mode, corridor).agg(F.lit(mode).alias("mode"), F.lit(corridor).alias("corridor"), F.count("*").alias("px"))
            out = own if out is None else out.unionByName(own)
    return out


@query
def policy_precedence(spark, sf):
    """The floor that counts for each month: an explicit one, one adopted from a record's name, or the calibrated."""
    o = read(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    adopted, _ = text.policy(F.when(F.col("m") % 2 == 0, F.concat(F.lit("t0_0."), F.col("m").cast("string"), F.lit("_width2px"))))
    value, source = audits.effective_policy(F.when(F.col("m") % 3 == 0, F.col("m") / 100), adopted, F.when(F.col("m") != 1, F.lit(0.3)))
    return rounded(o.select("m", value.alias("t0"), source.alias("source")))


def two_populations(spark, sf):
    cells = event_cells(spark, sf)
    of = lambda kind: scoring.components(truth_of(cells, kind), fields(cells), by_block())
    return of("error"), of("signup")


def by_part(parts):
    return scoring.score(parts, "candidate", "part")


@query
def population_agreement(spark, sf):
    labels, proxy = (stored(by_part(x), "scores") for x in two_populations(spark, sf))
    return rounded(audits.population_agreement(labels, proxy, "purchase"))


@query
def majority_conflict(spark, sf):
    """Every candidate, and whether it gains in most blocks of a population and loses over it; against click."""
    labels, proxy = two_populations(spark, sf)
    agreement = audits.population_agreement(by_part(labels), by_part(proxy), "click")
    whole = scoring.score(proxy, "candidate").withColumn("dti", F.round("dti", 6))
    return rounded(audits.majority_conflicts(agreement, whole, "click"))


@query
def rescore_audit(spark, sf):
    """Every candidate's score against one by another way."""
    cells = event_cells(spark, sf)
    expected = scoring.global_score(truth_of(cells), fields(cells))
    return rounded(audits.rescored(expected, audits.plain_score(truth_of(cells), fields(cells))).select("candidate", "dti", "ok"))


@query
def baselines(spark, sf):
    cells = event_cells(spark, sf)
    truth = truth_of(cells)
    s = scoring.global_score(truth, audits.baselines(truth, footprint_of(cells)))
    return rounded(s.select("candidate", "tp", "fp", "n_gt", "dti").unionByName(audits.empty_score(truth).select("candidate", "tp", "fp", "n_gt", "dti")))


@query
def transfer_verdict(spark, sf):
    """Do clicks help purchases to find the signups that lie beyond the radius of errors?"""
    cells = event_cells(spark, sf)
    labels = truth_of(cells)
    only = truth_of(cells, "signup").join(near_cells(labels, True), ["r", "c"], "left_anti")
    return rounded(audits.transfer(field_of(cells), truth_of(cells, "click"), labels, only, [1, 2]))


@query
def row_crosscheck(spark, sf):
    """The sweep against a committed one that lacks candidate 32 and has other scores at width 2."""
    s = sweep_of(event_cells(spark, sf))
    committed = s.where("candidate <> 32").withColumn("dti", F.when(F.col("width") == 2, F.col("dti") + 0.01).otherwise(F.col("dti"))).withColumn("pred_px", F.col("pred_px") + F.when(F.col("candidate") == 22, 1).otherwise(0))
    return audits.crosschecked(s, committed)


@query
def paired_contrast(spark, sf):
    cells = event_cells(spark, sf)
    return rounded(audits.paired_folds(scoring.components(truth_of(cells), fields(cells), by_fold()), "purchase", "click"))


@query
def arms_verdict(spark, sf):
    """Click against purchase as two arms, over both populations."""
    found = None
    for name, parts in zip(("labels", "proxy"), two_populations(spark, sf), strict=True):
        own = audits.paired_folds(parts.withColumn("part", F.lit(0)), "purchase", "click").where("part = -1").select(F.lit(name).alias("population"), F.round("contrast", 9).alias("contrast"))
        found = own if found is None else found.unionByName(own)
    return rounded(audits.arms_verdict(found))


@query
def gate_degradations(spark, sf):
    """Gates of a record, one for each part size, in two runs."""
    p = read(spark, sf, "part").groupBy(F.col("p_size").cast("string").alias("name")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("k"))
    status = lambda x: F.element_at(F.array(*map(F.lit, ("PASS", "FAIL", "MISSING", "SKIPPED"))), (x % 4).cast("int") + 1)
    return audits.degraded(p.select("name", status(F.col("n")).alias("status")), p.select("name", status(F.col("k")).alias("status")))


@query
def artifact_differences(spark, sf):
    """A field against one made anew with another floor: cells that only one of them has."""
    f = field_of(event_cells(spark, sf))
    return audits.differences(f.where("p > 0.3").select("r", "c"), f.where("p > 0.32 OR p < 0.01").select("r", "c"))


@query
def fold_complement(spark, sf):
    """Folds of eight that the occupied blocks lack, and members that saw neither of the folds that a union selects on and measures."""
    cells = event_cells(spark, sf)
    folds = footprint_of(cells).select(by_fold().alias("fold")).distinct()
    return audits.missing_folds(folds, 8)


@query
def clean_members(spark, sf):
    m = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 > 0, F.array(*[(F.col("n_nationkey") % k).cast("int") for k in (2, 3, 4)])).alias("held"))
    return audits.clean_members(m, 0, 1).drop("held")


@query
def run_bytes(spark, sf):
    """The rows of the shipping mask as run-length bytes: 1 above a price, 0 below, null where there is none."""
    d = focal.dense(ship_grid(spark, sf)).select("r", "c", F.when(F.col("valid"), (F.col("v") > 50_000).cast("double")).alias("p"))
    return codec.encode_rows(d).select("r", "cells", F.lower(F.hex("blob")).alias("blob"))


@query
def run_bytes_back(spark, sf):
    d = focal.dense(ship_grid(spark, sf)).select("r", "c", F.when(F.col("valid"), (F.col("v") > 50_000).cast("double")).alias("p"))
    return codec.value_histogram(codec.decode_rows(codec.encode_rows(d)))


@query
def json_fallbacks(spark, sf):
    """A number under one of several names: props of events, half of them renamed."""
    e = read(spark, sf, "events").withColumn("doc", F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", '"k"', '"old_k"')).otherwise(F.col("props")))
    return e.groupBy("event_type").agg(F.count(text.json_first(F.col("doc"), ["$.missing", "$.k", "$.old_k"])).alias("found"), F.sum(text.json_first(F.col("doc"), ["$.missing", "$.k", "$.old_k"]).cast("long")).alias("total"), F.count(text.json_first(F.col("doc"), ["$.k"])).alias("first_only"))


@query
def document_audits(spark, sf):
    """Links of pages whose host is not of the list, and local ones that name no page."""
    p = read(spark, sf, "pages")
    return text.link_audit(p.select("page_id", "url", "html"), ["example.com", "example.org"]).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query
def entity_repair(spark, sf):
    """Addresses with letters for digits put right; what still is none is counted as rejected."""
    d = read(spark, sf, "documents").select("source", "text")
    return text.repaired_addresses(d)


def dem(spark, sf):
    return in_cents(ship_grid(spark, sf)).select("r", "c", "v")


@query
def dem_stack(spark, sf):
    s = focal.dem_stack(dem(spark, sf))
    return rounded(s.select("r", "c", F.round("slope", 5).alias("slope"), F.round("curvature", 5).alias("curvature"), F.round("tpi", 3).alias("tpi"), F.round("tri", 3).alias("tri"), F.round("hillshade", 5).alias("hillshade")), 6)


@query
def feature_matrix(spark, sf):
    """Bands, ridges, coherence and window statistics of every cell, in the order of the matrix."""
    g = in_cents(ship_grid(spark, sf)).select("r", "c", F.col("v").alias("b01"), F.col("q").alias("b02"), F.col("x").alias("b03"))
    return rounded(kernels.feature_matrix(g, {"ridge": ["b01"], "coher": ["b02"], "window": ["b01", "b03"]}), 4)


@query
def combined_losses(spark, sf):
    cells = event_cells(spark, sf)
    truth, field = truth_of(cells), main_field(cells)
    whole = scoring.global_score(truth, field).select(kernel.distance_weighted_loss(F.col("tp"), F.col("fp"), F.col("n_gt")).alias("weighted"))
    d = field.join(truth.withColumn("y", F.lit(1.0)), ["r", "c"], "left").na.fill(0.0, ["y"])
    p, y = F.col("p"), F.col("y")
    other = d.agg(kernel.focal_tversky_loss(p, y).alias("focal"), kernel.cross_entropy(p, y).alias("entropy"))
    both = whole.crossJoin(F.broadcast(other))
    return rounded(both.withColumn("combined", kernel.combined_loss(F.col("entropy"), F.col("weighted"), F.col("focal"))))


@query
def ensemble_softmax(spark, sf):
    """Members weighted by their score."""
    cells = event_cells(spark, sf)
    s = scoring.global_score(truth_of(cells), fields(cells)).select("candidate", F.round("dti", 9).alias("dti"))
    return rounded(emission.weighted_mean(fields(cells), emission.softmax_weights(s)))


@query
def width_gains(spark, sf):
    return rounded(selection.width_gains(sweep_of(event_cells(spark, sf))))


@query
def rank_of_shipped(spark, sf):
    s = sweep_of(event_cells(spark, sf)).withColumn("eligible", F.lit(True))
    return selection.rank_of(selection.ranked(s, F.desc("dti"), F.asc("width"), F.asc("candidate")), 11)


@query
def stable_top(spark, sf):
    """Floors as fields and widths as windows: is the same floor first at every width?"""
    s = sweep_of(event_cells(spark, sf))
    return audits.stable_top(s.select("width", "fi", "dti"), "width", "fi").select("width", "fi", "dti", "rank", "stable")


@query
def calibrated_means(spark, sf):
    """Mean scores over folds; the candidate that is kept unless another is above it is 30."""
    from cellweave.plans.grid_queries import emissions

    cells = event_cells(spark, sf)
    s = by_part(scoring.components(truth_of(cells), emissions(cells), by_fold()))
    return rounded(selection.calibrated(s.select(F.col("part").alias("fold"), "candidate", "dti"), 30))


@query
def fold_gap_signs(spark, sf):
    """Gaps between purchase and click over blocks, with their signs."""
    cells = event_cells(spark, sf)
    s = by_part(scoring.components(truth_of(cells), fields(cells), by_block())).where("dti IS NOT NULL")
    a, b = (s.where(F.col("candidate") == c).select("part", F.col("dti").alias(n)) for c, n in (("purchase", "a"), ("click", "b")))
    return rounded(audits.gap_summary(a.join(b, "part").select(F.col("part").alias("fold"), F.round(F.col("a") - F.col("b"), 9).alias("gap"))))


@query
def field_format(spark, sf):
    """What is wrong with a field, with twice its values, and with its upper half alone, against the cells of purchases."""
    f = field_of(event_cells(spark, sf))
    forms = {"whole": f, "doubled": f.withColumn("p", F.col("p") * 2), "half": f.where("p > 0.5"), "twice": f.unionByName(f)}
    found = [emission.failed_format(d, f).select(F.lit(n).alias("form"), F.array_join("failed", ",").alias("failed")) for n, d in forms.items()]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query
def class_ids_appended(spark, sf):
    """Numbers of event types: two are known, the others follow in the order of their first event."""
    known = spark.createDataFrame([("view", 3), ("click", 5)], "class string, id int")
    return text.class_ids(read(spark, sf, "events").select(F.col("event_type").alias("class"), F.col("event_id").alias("at")), known)
