"""Registered queries over the grids of sources.tables: each composes operators and rounds what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import kernel
from cellweave.operators import distance, emission, focal, integral, kernels, partition, regions, scoring, selection, stats, text, windows
from cellweave.sources import grid_source, vectors
from cellweave.sources.tables import BLOCK, COLUMNS, event_cells, field_of, fields, footprint_of, read, ship_grid, truth_of

FLOORS = [0.1, 0.3, 0.5, 0.7]
WIDTHS = [0, 1, 2]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 0.0, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def main_field(cells: DataFrame) -> DataFrame:
    return field_of(cells).withColumn("candidate", F.lit("purchase"))


def by_block():
    return partition.block_id(COLUMNS, BLOCK)


def by_fold():
    return (by_block() % 4).cast("int")


@query
def kernel_offsets(spark, sf):
    return rounded(kernel.kernel_offsets(spark))


@query
def dti_global(spark, sf):
    cells = event_cells(spark, sf)
    return rounded(scoring.global_score(truth_of(cells), main_field(cells)))


@query
def dti_by_block(spark, sf):
    cells = event_cells(spark, sf)
    return rounded(scoring.score(scoring.components(truth_of(cells), main_field(cells), by_block()), "candidate", "part"))


@query
def dti_scopes(spark, sf):
    """Folds, and all of them (-1), for three candidates."""
    cells = event_cells(spark, sf)
    parts = scoring.components(truth_of(cells), fields(cells), by_fold())
    both = parts.unionByName(parts.withColumn("part", F.lit(-1)))
    return rounded(scoring.score(both, "candidate", "part"))


def blocks(cells):
    return partition.block_table(footprint_of(cells), truth_of(cells), F.max("r") + 1, COLUMNS, BLOCK)


@query
def block_table(spark, sf):
    return rounded(blocks(event_cells(spark, sf)))


@query
def fold_balanced(spark, sf):
    return partition.balanced_folds(blocks(event_cells(spark, sf)))


@query
def fold_contiguous(spark, sf):
    return partition.contiguous_folds(blocks(event_cells(spark, sf)))


@query
def collar_mask(spark, sf):
    cells = event_cells(spark, sf)
    zones = partition.collar(footprint_of(cells), partition.contiguous_folds(blocks(cells)), COLUMNS, BLOCK, 3)
    return zones.groupBy("fold", "zone").agg(F.count("*").alias("px"))


@query
def partition_report(spark, sf):
    table = blocks(event_cells(spark, sf))
    return rounded(partition.describe(table, partition.contiguous_folds(table)))


@query
def floor_profile(spark, sf):
    f = fields(event_cells(spark, sf)).withColumn("t0", F.explode(F.array(*[F.lit(x) for x in (0.0, *FLOORS)])))
    above = F.col("p") > F.col("t0")
    return rounded(f.groupBy("candidate", "t0").agg(F.count_if(above).alias("px"), F.sum(F.when(above, F.col("p")).otherwise(0.0)).alias("mass")))


@query
def soft_floors(spark, sf):
    f = main_field(event_cells(spark, sf))
    return rounded(f.groupBy().agg(F.sum(kernel.soft_floor(F.col("p"), 0.3, 2.0)).alias("soft"), F.sum(kernel.hard_floor(F.col("p"), F.lit(0.3))).alias("hard")))


@query
def floor_grid(spark, sf):
    return spark.createDataFrame([(i, x) for i, x in enumerate(kernel.floors(4, 0.001, 1.0))], "i int, t0 double")


def emissions(cells) -> DataFrame:
    out = emission.bands(emission.at_floors(field_of(cells), FLOORS), WIDTHS, ["fi", "t0"])
    return out.where((F.col("r") >= 0) & F.col("c").between(0, COLUMNS - 1)).select((F.col("fi") * 10 + F.col("width")).alias("candidate"), "r", "c", F.lit(1.0).alias("p"))


def sweep_of(cells) -> DataFrame:
    s = scoring.global_score(truth_of(cells), emissions(cells))
    return rounded(s.withColumn("fi", F.floor(F.col("candidate") / 10).cast("int")).withColumn("width", (F.col("candidate") % 10).cast("int")))


@query
def sweep_floor_width(spark, sf):
    return sweep_of(event_cells(spark, sf))


def judged(cells) -> DataFrame:
    n = footprint_of(cells).agg(F.count("*").alias("foot"))
    return emission.eligible(sweep_of(cells).crossJoin(F.broadcast(n)), F.col("foot"), 20, 0.5)


ORDER = (F.desc, F.asc)


@query
def sweep_eligible(spark, sf):
    return judged(event_cells(spark, sf)).select("candidate", "pred_px", "eligible", "reason")


@query
def rank_candidates(spark, sf):
    return selection.ranked(judged(event_cells(spark, sf)), F.desc("dti"), F.asc("width"), F.asc("candidate")).select("rank", "candidate", "dti")


@query
def select_winner(spark, sf):
    return selection.winner(judged(event_cells(spark, sf)).where("eligible"), F.desc("dti"), F.asc("width"), F.asc("candidate")).select("candidate", "dti", "pred_px")


@query
def best_per_width(spark, sf):
    return selection.best_by(sweep_of(event_cells(spark, sf)), "width", F.desc("dti"), F.asc("candidate")).select("width", "candidate", "dti")


@query
def matched_support(spark, sf):
    cells = event_cells(spark, sf)
    support = truth_of(cells).agg(F.count("*").alias("target"))
    s = sweep_of(cells).withColumn("field", (F.col("fi") % 2).cast("int")).crossJoin(F.broadcast(support))
    return selection.matched_support(s, F.col("target"), [0.25, 0.5, 1.0]).select("field", "tol", "candidate", "dti", "pred_px")


@query
def width_gain(spark, sf):
    return rounded(selection.width_gain(sweep_of(event_cells(spark, sf))))


@query
def marginal_gain(spark, sf):
    return rounded(selection.marginal_gain(sweep_of(event_cells(spark, sf))).select("fi", "width", "step"))


@query
def projection_best(spark, sf):
    """The best candidate of the sweep for each size of truth."""
    s = sweep_of(event_cells(spark, sf)).withColumn("size", F.explode(F.array(F.lit(500.0), F.lit(5000.0), F.lit(50000.0))))
    s = s.withColumn("value", F.round(kernel.projected(F.col("tp") / F.col("n_gt"), F.col("fp"), F.col("size")), 6))
    return selection.best_by(s, "size", F.desc("value"), F.asc("candidate")).select("size", "candidate", "value")


@query
def crossover(spark, sf):
    """The size of truth at which two neighbouring widths of a floor score the same."""
    s = sweep_of(event_cells(spark, sf)).select("fi", "width", (F.col("tp") / F.col("n_gt")).alias("c"), "fp")
    b = s.select("fi", (F.col("width") - 1).alias("width"), F.col("c").alias("c2"), F.col("fp").alias("f2"))
    g = kernel.ALPHA * (F.col("c2") * F.col("fp") - F.col("c") * F.col("f2")) / (kernel.BETA * (F.col("c") - F.col("c2")))
    return rounded(s.join(b, ["fi", "width"]).select("fi", "width", F.when(F.col("c") != F.col("c2"), g).alias("size")), 2)


@query
def budget_table(spark, sf):
    t = spark.createDataFrame([(float(a) / 10, float(b) / 2) for a in range(1, 10) for b in range(5)], "target double, ratio double")
    t = t.withColumn("coverage", kernel.required_coverage(F.col("target"), F.col("ratio"))).withColumn("allowed", kernel.allowed_ratio(F.col("target"), F.lit(0.9))).withColumn("ceiling", kernel.ceiling(F.col("ratio")))
    return rounded(t)


def members(cells) -> DataFrame:
    return cells.where(F.col("kind").isin("click", "view", "purchase")).select(F.col("kind").alias("member"), "r", "c").distinct()


@query
def vote_k_of_n(spark, sf):
    v = emission.vote(members(event_cells(spark, sf)), 1)
    return v.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("n >= k").groupBy("k").agg(F.count("*").alias("px"))


@query
def union_max_field(spark, sf):
    return rounded(emission.union_max(fields(event_cells(spark, sf))))


@query
def ensemble_mean(spark, sf):
    w = spark.createDataFrame([("purchase", 1.0), ("click", 2.0), ("view", 1.0)], "candidate string, w double")
    return rounded(emission.weighted_mean(fields(event_cells(spark, sf)), w))


def near_cells(truth, inclusive):
    return kernels.near_cells(truth, kernel.RADIUS, positive=not inclusive)


@query
def overlap_recall_precision(spark, sf):
    """Shares of two catalogues within the radius of each other."""
    cells = event_cells(spark, sf)
    a, b = truth_of(cells), truth_of(cells, "signup")
    share = lambda x, y: x.join(near_cells(y, True).withColumn("near", F.lit(1)), ["r", "c"], "left").agg(F.avg(F.coalesce("near", F.lit(0))).alias("s"))
    return rounded(share(a, b).select(F.col("s").alias("recall")).crossJoin(share(b, a).select(F.col("s").alias("precision"))))


@query
def proxy_codes(spark, sf):
    """A second catalogue: code 1 within the radius of a label, 2 beyond."""
    cells = event_cells(spark, sf)
    near = near_cells(truth_of(cells), True).withColumn("near", F.lit(True))
    return truth_of(cells, "signup").join(near, ["r", "c"], "left").select("r", "c", F.when(F.col("near"), 1).otherwise(2).alias("code"))


@query
def novel_mass(spark, sf):
    cells = event_cells(spark, sf)
    p = scoring.penalties(truth_of(cells), fields(cells))
    g = p.groupBy("candidate").agg(F.sum("p").alias("mass"), F.sum("fp").alias("novel"))
    return rounded(g.withColumn("share", F.try_divide("novel", "mass")))


@query
def components(spark, sf):
    return regions.region_sizes(regions.regions(truth_of(event_cells(spark, sf))))


@query
def novel_components(spark, sf):
    cells = event_cells(spark, sf)
    found = regions.regions(truth_of(cells, "signup"))
    return regions.novel_regions(found, near_cells(truth_of(cells), False), 2)


@query
def drop_small(spark, sf):
    return regions.drop_small(regions.regions(truth_of(event_cells(spark, sf))), 2).select("r", "c")


@query
def component_stats(spark, sf):
    s = regions.region_sizes(regions.regions(truth_of(event_cells(spark, sf))))
    return rounded(s.agg(F.count("*").alias("n"), F.sum("px").alias("px"), F.max("px").alias("largest"), F.max("extent").alias("extent"), F.percentile("px", F.lit(0.5)).alias("median")))


@query
def edt(spark, sf):
    cells = event_cells(spark, sf)
    return rounded(distance.distance_to(truth_of(cells, "signup"), truth_of(cells)))


@query
def miss_distance(spark, sf):
    """How far truth is from where the field is above a floor."""
    cells = event_cells(spark, sf)
    d = distance.distance_to(truth_of(cells), field_of(cells).where("p > 0.5"))
    shares = [F.avg((F.col("d") <= k).cast("double")).alias(f"within_{k}") for k in (3, 6, 12)]
    pct = [F.percentile("d", F.lit(q / 100)).alias(f"p{q}") for q in (50, 75, 90, 95)]
    return rounded(d.agg(F.count("*").alias("n"), *shares, *pct, F.max("d").alias("most")))


@query
def dilate_band(spark, sf):
    cells = event_cells(spark, sf)
    return emission.bands(truth_of(cells), [1, 2, 3], []).groupBy("width").agg(F.count("*").alias("px"))


@query
def soft_band(spark, sf):
    cells = event_cells(spark, sf)
    s = emission.soft_values(emission.bands(truth_of(cells), [1, 2, 3], []), 2.0)
    return rounded(s.groupBy("width").agg(F.count("*").alias("px"), F.sum("p").alias("mass")))


@query
def closing(spark, sf):
    return emission.close_square(footprint_of(event_cells(spark, sf)), 3)


@query
def shift_robustness(spark, sf):
    cells = event_cells(spark, sf)
    hard = field_of(cells).where("p > 0.3").select("r", "c", F.lit(1.0).alias("p"))
    s = [emission.shifted(hard, radius, COLUMNS).withColumn("candidate", F.col("shift") + 100 * radius).drop("shift") for radius in (1, 2)]
    scored = scoring.global_score(truth_of(cells), s[0].unionByName(s[1]))
    scored = scored.withColumn("radius", F.floor(F.col("candidate") / 100).cast("int")).where("candidate % 100 > 0")
    return rounded(scored.groupBy("radius").agg(F.avg("dti").alias("mean"), F.min("dti").alias("worst")))


def slotted(cells):
    parts = scoring.components(truth_of(cells), fields(cells), by_block())
    slots = parts.select("part").distinct().withColumn("slot", F.row_number().over(Window.orderBy("part")) - 1)
    return parts.join(F.broadcast(slots), "part")


@query
def bootstrap_paired(spark, sf):
    """200 draws; an arithmetic draw stands for a random one, so that other engines agree."""
    draw = ((F.col("boot") * 7919 + F.col("place") * 104729 + 17) % F.col("n")).cast("int")
    return rounded(scoring.bootstrap(slotted(event_cells(spark, sf)), "purchase", 200, draw))


@query
def sign_agreement(spark, sf):
    cells = event_cells(spark, sf)
    s = scoring.score(scoring.components(truth_of(cells), fields(cells), by_block()), "candidate", "part")
    return selection.sign_agreement(s, "purchase").withColumn("reading", selection.reliability(F.col("n")))


@query
def cross_ensemble_rank(spark, sf):
    cells = event_cells(spark, sf)
    f = fields(cells).withColumn("fi", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("t0", F.element_at(F.array(*[F.lit(x) for x in FLOORS]), F.col("fi") + 1))
    f = f.where("p > t0").select(F.concat("candidate", F.lit("-"), F.col("fi").cast("string")).alias("candidate"), "r", "c", F.lit(1.0).alias("p"))
    s = scoring.global_score(truth_of(cells), f)
    s = s.select(F.substring_index("candidate", "-", 1).alias("sweep"), F.substring_index("candidate", "-", -1).cast("int").alias("candidate"), "dti")
    base = s.where("candidate = 0").select("sweep", F.col("dti").alias("base"))
    return rounded(selection.cross_rank(s.join(base, "sweep").withColumn("contrast", F.col("dti") - F.col("base")), 3))


@query
def loo_calibration(spark, sf):
    cells = event_cells(spark, sf)
    s = scoring.score(scoring.components(truth_of(cells), emissions(cells), by_fold()), "candidate", "part")
    return rounded(selection.leave_one_out(s.select(F.col("part").alias("fold"), "candidate", "dti")))


@query
def fold_gap(spark, sf):
    """Monthly gaps between urgent and other orders: their spread and signs."""
    o = read(spark, sf, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    m = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg((F.avg(F.when(urgent, F.col("o_totalprice"))) - F.avg(F.when(~urgent, F.col("o_totalprice")))).alias("gap"))
    g = F.col("gap")
    return rounded(m.agg(F.count("gap").alias("n"), F.avg(g).alias("mean"), F.min(g).alias("low"), F.max(g).alias("high"), (F.max(g) - F.min(g)).alias("spread"), F.count_if(g > 0).alias("positive"), F.count_if(g < 0).alias("negative")), 4)


@query
def did_exposure(spark, sf):
    both = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    m = both.select((F.col("quality") == 1).alias("treated"), (F.col("doc_id") % 2 == 1).alias("exposed"), F.col("n_chars").cast("double").alias("score"))
    return rounded(selection.exposure(m), 4)


def ship_bands(spark, sf):
    return stats.long_bands(ship_grid(spark, sf), ["v", "q", "x"])


@query
def norm_stats(spark, sf):
    return rounded(stats.norm_stats(ship_bands(spark, sf)), 4)


@query
def apply_norm(spark, sf):
    b = ship_bands(spark, sf)
    return rounded(stats.apply_norm(b, stats.norm_stats(b)).groupBy("band").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("low"), F.max("z").alias("high")), 4)


@query
def band_profile(spark, sf):
    return rounded(stats.profile(ship_bands(spark, sf)), 4)


@query
def value_top20(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(20)


@query
def quantise_roundtrip(spark, sf):
    q = stats.quantised(ship_bands(spark, sf))
    return rounded(q.groupBy("band").agg(F.min("q").alias("q0"), F.max("q").alias("q1"), F.sum("q").alias("total"), F.max(F.abs(F.col("v") - F.col("back"))).alias("error")), 6)


def ship_dense(spark, sf):
    return focal.dense(ship_grid(spark, sf))


def in_cents(grid):
    """Whole cents: sums are exact, whatever their order."""
    return grid.withColumn("v", F.round(F.col("v") * 100))


@query
def window_stats(spark, sf):
    return rounded(focal.window_stats(in_cents(ship_dense(spark, sf)), 5), 4)


@query
def slope(spark, sf):
    return rounded(focal.slope(ship_dense(spark, sf)).select("r", "c", "slope"), 5)


@query
def curvature(spark, sf):
    return rounded(focal.curvature(ship_dense(spark, sf)).select("r", "c", "curvature"), 9)


@query
def hillshade(spark, sf):
    return rounded(focal.hillshade(ship_dense(spark, sf)).select("r", "c", "shade"), 5)


@query
def tpi(spark, sf):
    return rounded(focal.tpi(ship_dense(spark, sf)).select("r", "c", "tpi"), 3)


@query
def tri(spark, sf):
    return rounded(focal.tri(ship_dense(spark, sf)), 3)


@query
def rle_encode(spark, sf):
    return stats.run_lengths(ship_dense(spark, sf), F.col("valid").cast("int"))


@query
def rle_roundtrip(spark, sf):
    d = ship_dense(spark, sf)
    back = stats.expand_runs(stats.run_lengths(d, F.col("valid").cast("int")))
    return back.groupBy("r").agg(F.sum("code").alias("valid"), F.count("*").alias("n"))


@query
def best_window(spark, sf):
    cells = event_cells(spark, sf)
    marked = footprint_of(cells).join(truth_of(cells).withColumn("t", F.lit(1)), ["r", "c"], "left").na.fill(0, ["t"])
    edge = marked.agg((F.max("r") + 32).alias("r"), (F.max("c") + 32).alias("c")).first()  # windows may begin in the last cell
    found = integral.window_sums(marked.withColumn("n", F.lit(1)), ["t", "n"], (edge.r, edge.c), 32, 16).where("n > 0")
    return found.select("r0", "c0", F.col("t").cast("long").alias("total"), F.col("n").cast("long").alias("n")).orderBy(F.desc("total"), "r0", "c0").limit(10)


@query
def compact_windows(spark, sf):
    """The three consecutive occupied blocks with truth whose rows span least."""
    return partition.compact_runs(blocks(event_cells(spark, sf)), 3).where("rank = 1 AND faults > 0").drop("rank")


@query
def train_windows(spark, sf):
    """Windows of 32, every 16: cells, truth and cells in the held-out fold or its collar, and what each is for."""
    cells = event_cells(spark, sf)
    foot = footprint_of(cells)
    zone = partition.collar(foot, partition.contiguous_folds(blocks(cells)), COLUMNS, BLOCK, 3).where("fold = 0").select("r", "c", F.lit(1).alias("held"))
    marked = foot.join(zone, ["r", "c"], "left").join(truth_of(cells).withColumn("t", F.lit(1)), ["r", "c"], "left").na.fill(0, ["held", "t"])
    return partition.window_purposes(marked, 32, 16, 3)


@query
def neg_sample(spark, sf):
    """All truth cells and three other cells for each, first by a hash."""
    cells = event_cells(spark, sf)
    return partition.training_sample(truth_of(cells), footprint_of(cells))


@query
def conform_template(spark, sf):
    cells = event_cells(spark, sf)
    p = cells.where("kind = 'purchase'").groupBy("r", "c").agg((F.max("value") / 300.0).alias("p"))
    out = emission.conform(p, footprint_of(cells.where("kind <> 'purchase'")))
    return rounded(out.groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("mass")))


@query
def validate_rules(spark, sf):
    f = fields(event_cells(spark, sf))
    s = f.groupBy("candidate").agg(F.max("p").alias("hi"), F.min("p").alias("lo"), F.count("*").alias("n"), F.count_if(F.col("c") >= COLUMNS).alias("wide"))
    rules = {"range": (F.col("lo") >= 0) & (F.col("hi") <= 1), "columns": F.col("wide") == 0, "saturated": F.col("hi") < 1, "size": F.col("n") >= 100}
    return s.select("candidate", F.array_join(selection.failed_rules(rules), ",").alias("failed"))


@query
def duplicate_candidates(spark, sf):
    """Floors whose cells are the same, under the first of them."""
    f = emission.at_floors(field_of(event_cells(spark, sf)), [0.1, 0.3, 0.3000001, 0.5, 0.5000001])
    s = stats.fingerprint(f, "fi")
    return s.select(F.col("fi").alias("candidate"), F.min("fi").over(Window.partitionBy("x", "s", "n")).alias("first"), "n")


@query
def decision_rule(spark, sf):
    s = sweep_of(event_cells(spark, sf))
    base = s.where("candidate = 0").select(F.col("dti").alias("base"), F.col("pred_px").alias("px0"))
    d = s.crossJoin(F.broadcast(base))
    rule = selection.decision({"better": F.col("dti") - F.col("base") >= 0.01, "small": F.col("pred_px") <= 5 * F.col("px0"), "covers": F.col("tp") / F.col("n_gt") >= 0.2})
    return d.select("candidate", rule.alias("verdict"))


@query
def text_norm(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.normalised(F.col("text"))).alias("digest"))


@query
def quote_check(spark, sf):
    return text.quoted(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query
def entity_extract(spark, sf):
    d = read(spark, sf, "documents").select("source", F.explode(text.entities(F.col("text"), "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}")).alias("e"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("e").alias("n_distinct"))


@query
def link_classify(spark, sf):
    p = read(spark, sf, "pages").select(text.host(F.col("url")).alias("host"), F.col("url").startswith("https:").alias("secure"), (F.col("page_id") % 4 * 101 + 200).alias("status"))
    return p.groupBy("host", text.link_class(F.col("status"), F.col("secure")).alias("class")).agg(F.count("*").alias("n"))


@query
def page_links(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query
def fuzzy_match(spark, sf):
    n = read(spark, sf, "part").select(F.col("p_name").alias("name"))
    g = n.select(F.lower("name").alias("guess")).unionByName(n.select(F.concat(F.substring("name", 1, 6), F.substring("name", 8, 50)).alias("guess")))
    return text.fuzzy(g, n)


@query
def page_furniture(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("page"), F.concat(F.lit("12\n"), F.col("turn").cast("string"), F.col("text")).alias("text"))
    return text.without_page_numbers(c).select("key", "page", F.md5("body").alias("digest"))


@query
def class_vocabulary(spark, sf):
    """Stable numbers for event types."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("class")).distinct()
    return e.withColumn("id", F.row_number().over(Window.orderBy("class")))


@query
def table_fingerprint(spark, sf):
    """Rows and content of orders, all columns, by status: count, sum and xor of row hashes."""
    return stats.content(read(spark, sf, "orders"), "o_orderstatus")


@query
def resample_mean(spark, sf):
    return rounded(vectors.resampled(in_cents(ship_grid(spark, sf)), 4), 4)


@query
def rasterize_lines(spark, sf):
    """Lines between each supplier's first and last week, as cells."""
    g = ship_grid(spark, sf).groupBy("r").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    seg = g.select(F.col("r").alias("feature"), F.col("a").cast("double").alias("x0"), F.col("r").cast("double").alias("y0"), F.col("b").cast("double").alias("x1"), (F.col("r") + 4.0).alias("y1"))
    return vectors.rasterised(seg).groupBy("feature").agg(F.count("*").alias("px"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def main_windows(cells) -> DataFrame:
    """The whole field in windows of 64, every 48; its height is that of its last row."""
    f = field_of(cells)
    high = f.agg((F.max("r") + 1).alias("h"))
    return windows.in_windows(f.crossJoin(F.broadcast(high)), F.col("h"), COLUMNS, 64, 48).drop("h")


@query
def window_stitch(spark, sf):
    """A field cut into windows of 64, every 48, and put together again."""
    return rounded(windows.stitched(main_windows(event_cells(spark, sf)), 64))


@query
def window_counts(spark, sf):
    return main_windows(event_cells(spark, sf)).groupBy("win_r", "win_c").agg(F.count("*").alias("px"))


@query
def losses(spark, sf):
    cells = event_cells(spark, sf)
    d = field_of(cells).join(truth_of(cells).withColumn("y", F.lit(1.0)), ["r", "c"], "left").na.fill(0.0, ["y"])
    p, y = F.col("p"), F.col("y")
    return rounded(d.agg(kernel.tversky_loss(p, y).alias("tversky"), kernel.focal_tversky_loss(p, y).alias("focal"), kernel.cross_entropy(p, y).alias("entropy")))


@query
def symmetry_views(spark, sf):
    """The eight symmetries inside each of the windows of 64 that the whole field is cut into."""
    cells = windows.in_tiles(field_of(event_cells(spark, sf)), 64)
    return rounded(windows.symmetries(cells, 64).groupBy("view").agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("p")).alias("moment")), 4)


@query
def bad_dates(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0")).alias("day"))
    return text.bad_dates(o, "day", F.lit("2100-01-01").cast("date"))


@query
def sato(spark, sf):
    return rounded(kernels.over_tiles(ship_grid(spark, sf).select("r", "c", "v"), kernels.ridgeness, 128, kernels.hessian_halo(3.0)), 3)


@query
def structure_coherence(spark, sf):
    return rounded(kernels.over_tiles(ship_grid(spark, sf).select("r", "c", "v"), kernels.coherence, 128, 8), 4)


@query
def gaussian_detrend(spark, sf):
    return rounded(kernels.detrended(ship_grid(spark, sf).select("r", "c", "v"), 8.0, 128), 3)


@query
def frangi(spark, sf):
    return rounded(kernels.vessel_blend(field_of(event_cells(spark, sf))), 5)


@query
def thin(spark, sf):
    cells = event_cells(spark, sf)
    return kernels.thin_cover(field_of(cells).where("p > 0.05").withColumn("k", F.lit(0)), "k").select("r", "c")


@query
def grid_scan(spark, sf):
    grid_source.register(spark)
    g = spark.read.format("grid").options(height=200, width=100, bands=2, seed=3).load()
    return g.groupBy("label").agg(F.count("*").alias("n"))
