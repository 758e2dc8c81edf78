"""Operators on small grids against definitions in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import kernel
from cellweave.operators import distance, emission, focal, kernels, partition, regions, scoring, selection, stats, text
from cellweave.sources import files, grid_source, vectors

TRUTH, PRED = "r int, c int", "candidate string, r int, c int, p double"


def brute(truth, pred, radius=3):
    k = lambda a, b: max(1 - math.dist(a, b) / radius, 0)
    tp = sum(max((p * k(g, x) for x, p in pred.items() if math.dist(g, x) <= radius), default=0) for g in truth)
    fp = sum(p * (1 - max((k(g, x) for g in truth), default=0)) for x, p in pred.items())
    n = len(truth)
    return tp, fp, (tp / (tp + 0.2 * fp + 0.8 * (n - tp) + 1e-7) if n else float(fp == 0))


def frames(spark, truth, pred):
    return spark.createDataFrame(sorted(truth), TRUTH), spark.createDataFrame([("x", *cell, p) for cell, p in pred.items()], PRED)


@pytest.mark.parametrize("shift, dti", [(0, 1), (1, 2 / 3), (2, 1 / 3), (3, 0), (4, 0)])
def test_a_shifted_line(spark, shift, dti):
    truth = {(r, 20) for r in range(10, 30)}
    row = scoring.global_score(*frames(spark, truth, {(r, 20 + shift): 1.0 for r, _ in truth})).first()
    assert row.dti == pytest.approx(dti, abs=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_score_and_its_parts(spark, seed):
    r = random.Random(seed)
    truth = {(r.randrange(24), r.randrange(20)) for _ in range(30)}
    pred = {(r.randrange(24), r.randrange(20)): r.random() for _ in range(60)}
    t, p = frames(spark, truth, pred)
    tp, fp, dti = brute(truth, pred)
    whole = scoring.global_score(t, p).first()
    assert (whole.tp, whole.fp, whole.dti) == pytest.approx((tp, fp, dti), abs=1e-9)
    parts = scoring.components(t, p, partition.block_id(20, 8)).agg(F.sum("tp"), F.sum("fp"), F.sum("fn"), F.sum("n_gt")).first()
    assert tuple(parts) == pytest.approx((tp, fp, len(truth) - tp, len(truth)), abs=1e-9)


def test_probability_contract(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (float("inf"), 1.0), (float("-inf"), 0.0), (None, 0.0), (-2.0, 0.0), (0.25, 0.25), (7.0, 1.0)], "p double, want double")
    assert df.where(kernel.clean_probability(F.col("p")) != F.col("want")).count() == 0


def test_no_truth_and_closed_forms(spark):
    row = spark.range(1).select(kernel.dti(F.lit(3.0), F.lit(1.89), F.lit(5.0)).alias("a"), kernel.dti(F.lit(0.0), F.lit(0.0), F.lit(0)).alias("b"), kernel.dti(F.lit(0.0), F.lit(1.0), F.lit(0)).alias("c")).first()
    assert row.a == pytest.approx(0.6016, abs=2e-3) and (row.b, row.c) == (1.0, 0.0)
    assert kernel.floors()[0] == 0.0 and len(kernel.floors()) == 16 and kernel.floors()[1] == 1e-4


def dealt(table, n):
    full = sorted((b for b in table if b[2] > 0), key=lambda b: (-b[1], -b[2], b[0]))
    want = [max(1.0, sum(b[k] for b in full) / n) for k in (1, 2)]
    load, out = [[0, 0] for _ in range(n)], {b[0]: -1 for b in table}
    for b in full:
        f = min(range(n), key=lambda k: (load[k][0] / want[0] + load[k][1] / want[1], k))
        out[b[0]] = f
        load[f][0] += b[1]
        load[f][1] += b[2]
    return out


def test_folds(spark):
    r = random.Random(4)
    rows = [(i, i // 7, i % 7, r.choice([0, 0, 3, 50]), r.choice([0, 100, 200])) for i in range(56)]
    t = spark.createDataFrame(rows, "block int, block_row int, block_col int, fault_px long, valid_px long")
    assert {x.block: x.fold for x in partition.balanced_folds(t).collect()} == dealt([(b, f, v) for b, _, _, f, v in rows], 4)
    row_of = {v: i for i, g in enumerate(np.array_split(np.arange(8), 2)) for v in g}
    col_of = {v: i for i, g in enumerate(np.array_split(np.arange(7), 2)) for v in g}
    want = {b: row_of[y] * 2 + col_of[x] if v else -1 for b, y, x, _, v in rows}
    assert {x.block: x.fold for x in partition.contiguous_folds(t).collect()} == want
    assert partition.fold_shape(5, 8 / 7) == (5, 1) and partition.fold_shape(3, 3 / 9) == (1, 3) and partition.fold_shape(6, 1.0) == (2, 3) and partition.fold_shape(6, 3.0) == (3, 2)


def test_collar_is_a_square(spark):
    cells = [(y, x) for y in range(12) for x in range(12)]
    folds = spark.createDataFrame([(b, 0 if b == 4 else -1) for b in range(9)], "block int, fold int")
    got = {(x.r, x.c): x.zone for x in partition.collar(spark.createDataFrame(cells, TRUTH), folds, 12, 4, 2).collect()}
    want = {(y, x): "scored" if 4 <= y < 8 and 4 <= x < 8 else "collar" for y, x in cells if 2 <= y < 10 and 2 <= x < 10}
    assert got == want


def test_bands_and_closing(spark):
    r = random.Random(6)
    mask = {(r.randrange(15), r.randrange(15)) for _ in range(12)}
    m = spark.createDataFrame(sorted(mask), TRUTH)
    for w in (1, 2, 3):
        got = {(x.r, x.c) for x in emission.bands(m, [w], []).collect()}
        assert got == {(y, x) for y in range(-4, 20) for x in range(-4, 20) if min(math.dist((y, x), g) for g in mask) <= w}
    soft = emission.soft_values(emission.bands(m, [2], [])).collect()
    assert all(0 < x.p <= 1 for x in soft) and {(x.r, x.c) for x in soft if x.p == 1} == mask
    closed = {(x.r, x.c) for x in emission.close_square(m).collect()}
    assert mask <= closed


def test_regions(spark):
    r = random.Random(7)
    mask = {(r.randrange(20), r.randrange(20)) for _ in range(120)} | {(0, x) for x in range(30, 60)}
    got = {}
    for x in regions.regions(spark.createDataFrame(sorted(mask), TRUTH)).collect():
        got.setdefault(x.region, set()).add((x.r, x.c))
    left, want = set(mask), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            own.add((y, x))
            for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        want.append(own)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_focal(spark):
    a = np.random.default_rng(1).normal(size=(9, 11)).round(3)
    g = spark.createDataFrame([(y, x, float(a[y, x]), True) for y in range(9) for x in range(11)], "r int, c int, v double, valid boolean")
    gy, gx = np.gradient(a, 100)
    for x in focal.slope(g).collect():
        assert x.slope == pytest.approx(math.degrees(math.atan(math.hypot(gy[x.r, x.c], gx[x.r, x.c]))), abs=1e-9)
    gyy, gxx = np.gradient(gy, 100)[0], np.gradient(gx, 100)[1]
    assert all(x.curvature == pytest.approx(gyy[x.r, x.c] + gxx[x.r, x.c], abs=1e-12) for x in focal.curvature(g).collect())
    pad = np.pad(a, 3, mode="edge")
    assert all(x.tpi == pytest.approx(a[x.r, x.c] - pad[x.r : x.r + 7, x.c : x.c + 7].mean(), abs=1e-9) for x in focal.tpi(g).collect())
    pad = np.pad(a, 1, mode="edge")
    assert all(x.tri == pytest.approx(np.abs(pad[x.r : x.r + 3, x.c : x.c + 3] - a[x.r, x.c]).mean(), abs=1e-9) for x in focal.tri(g).collect())


def test_tiles_do_not_show(spark):
    a = np.random.default_rng(2).normal(size=(40, 37))
    g = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(40) for x in range(37)], "r int, c int, v double")
    for fn, halo in ((kernels.ridgeness, kernels.hessian_halo(3.0)), (kernels.coherence, 8)):
        want = fn(a)
        assert all(x.x == pytest.approx(want[x.r, x.c], abs=1e-9) for x in kernels.over_tiles(g, fn, 16, halo).collect())


def test_distances_and_thinning(spark):
    r = random.Random(3)
    truth = [(r.randrange(30), r.randrange(30)) for _ in range(9)]
    cells = [(y, x) for y in range(0, 30, 3) for x in range(0, 30, 4)]
    got = distance.distance_to(spark.createDataFrame(cells, TRUTH), spark.createDataFrame(truth, TRUTH)).collect()
    assert len(got) == len(cells) and all(x.d == pytest.approx(min(math.dist((x.r, x.c), t) for t in truth)) for x in got)
    masks = [np.zeros((70, 60), bool) for _ in range(3)]
    masks[0][10:17, 5:35] = True
    masks[1][3:66, 4:52] = True
    masks[1][20:30, 20:40] = False
    masks[2] |= np.random.default_rng(1).random((70, 60)) < 0.6
    rows = [(k, int(y), int(x), 0.5) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m), strict=True)]
    df = spark.createDataFrame(rows, "k int, r int, c int, p double")
    lines, cover = kernels.skeleton(df, "k", 24).collect(), kernels.thin_cover(df, "k", 3, 24).collect()
    for k, m in enumerate(masks):
        whole = kernels.zhang_suen(m, 1000)
        assert {(x.r, x.c) for x in lines if x.k == k} == set(zip(*(v.tolist() for v in np.nonzero(whole)), strict=True))
        kept = np.array([(x.r, x.c) for x in cover if x.k == k])
        assert m[kept[:, 0], kept[:, 1]].all() and (k == 2 or len(kept) < m.sum() / 2)  # noise has no lines to thin to
        assert all(((kept - [a, b]) ** 2).sum(1).min() <= 9 for a, b in zip(*np.nonzero(m), strict=True))


def test_runs_and_quanta(spark):
    cells = spark.createDataFrame([(0, i, int(c)) for i, c in enumerate("0011101000")] + [(1, 0, 1)], "r int, c int, k int")
    runs = stats.run_lengths(cells, F.col("k"))
    assert [(x.start, x.length, x.code) for x in runs.where("r = 0").orderBy("run").collect()] == [(0, 2, 0), (2, 3, 1), (5, 1, 0), (6, 1, 1), (7, 3, 0)]
    assert stats.expand_runs(runs).exceptAll(cells).count() == 0
    b = spark.createDataFrame([(0, i, "x", i * 0.37) for i in range(50)] + [(0, 0, "flat", 5.0)], "r int, c int, band string, v double")
    worst = stats.quantised(b).agg(F.max(F.abs(F.col("v") - F.col("back")))).first()[0]
    assert worst <= 49 * 0.37 / 64000 + 1e-12


def test_leave_one_out_and_rules(spark):
    rows = [(f, c, v) for f, vs in enumerate([(0.5, 0.6), (0.4, 0.1), (0.7, 0.9)]) for c, v in enumerate(vs)]
    got = {x.held: (x.candidate, x.oracle) for x in selection.leave_one_out(spark.createDataFrame(rows, "fold int, candidate int, dti double")).collect()}
    assert got == {0: (0, 0.6), 1: (1, 0.4), 2: (0, 0.9)}
    with pytest.raises(Exception, match="no score"):
        selection.winner(spark.createDataFrame([(1, None)], "candidate int, dti double"), F.desc("dti")).collect()


def test_text(spark):
    d = spark.createDataFrame([("‘a’ – “b”  c-\nd\n e",)], "t string").select(text.normalised(F.col("t")).alias("t")).first().t
    assert d == "'a' - \"b\" cd e"
    g = spark.createDataFrame([("Alpha River",), ("alpha river",), ("Alpha Rivet",), ("zzz",)], "guess string")
    got = {x.guess: (x.name, x.how) for x in text.fuzzy(g, spark.createDataFrame([("Alpha River",), ("Beta",)], "name string")).collect()}
    assert got == {"Alpha River": ("Alpha River", "exact"), "alpha river": ("Alpha River", "case"), "Alpha Rivet": ("Alpha River", "similar"), "zzz": (None, None)}
    r, names = random.Random(4), set()
    while len(names) < 60:
        names.add("".join(r.choice("abc -") for _ in range(r.randint(1, 24))))
    asked = {*names, *("".join(r.choice("abcd") if r.random() < 0.08 else x for x in n)[r.randint(0, 1) :] for n in names), ""}
    fold = lambda x: "".join(c for c in x.lower() if c.isalnum())

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = step(row, i, x, b)
        return row[-1]

    def step(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    got = {x.guess: x for x in text.fuzzy(spark.createDataFrame([(x,) for x in asked], "guess string"), spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    for q in asked:
        like = {n: 3 if n == q else 2 if n.lower() == q.lower() else 1 - edits(fold(q), fold(n)) / max(len(fold(q)), len(fold(n))) if fold(q) or fold(n) else 0 for n in names}
        best = max(like.values())
        assert got[q].name == (min(n for n in names if like[n] == best) if best >= 0.9 - 1e-12 else None)


def test_quotes_and_their_ends(spark):
    docs = spark.createDataFrame([(1, "He said: “one\u00a0two — three” and ﬁne cut-\n ting."), (2, "onetwo three"), (3, None), (4, "")], "doc_id int, text string")
    quotes = spark.createDataFrame([("a", "two - three"), ("b", "fine cutting."), ("c", "one"), ("d", ""), ("e", None), ("f", "He said: \"one two"), ("g", "three\" and")], "item_id string, text string")
    want = {("b", 1), ("f", 1), ("g", 1)}
    assert {tuple(x) for x in text.quoted(docs, quotes).collect()} == want
    d = text.divergence(F.col("q"), F.col("t"), 5)
    got = spark.createDataFrame([("abcdef", "xxabcxyz"), ("q", "abc"), ("", "abc")], "q string, t string").select(d.alias("d")).collect()
    assert [tuple(x.d) for x in got] == [(3, "def", "xyz"), (0, "q", None), (0, "", None)]


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"F","properties":{"id":"7"},"geometry":{"type":"LineString","coordinates":[[0,0],[4,2],[4,6]]}},{"type":"F","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[9,9]],[[1,1],[1,5]]]}}]}')
    lines = vectors.read_geojson(spark, f"file://{tmp_path}/g.json")
    assert vectors.segments(lines).count() == 3
    cells = {(x.feature, x.r, x.c) for x in vectors.rasterised(vectors.segments(lines)).collect()}
    assert {(0, 0, 0), (0, 2, 4), (0, 6, 4), (1, 1, 1), (1, 5, 1)} <= cells
    grid_source.register(spark)
    g = spark.read.format("grid").options(height=70, width=9, bands=2, seed=1, block=16).load()
    assert g.count() == 630 and g.where("label = 1").count() == 70 and g.columns == ["r", "c", "b01", "b02", "label"]
    assert files.clean_cells(spark.createDataFrame([(0, 0, -1e35), (0, 1, 2.0), (0, 2, float("nan"))], "r int, c int, b double"), ["b"]).where("b IS NOT NULL").count() == 1
    with pytest.raises(ValueError):
        files.coded(spark.createDataFrame([(0, 0, 1)], "r int, c int, code int"), 2)
    f = spark.createDataFrame([(0, 0, 0.5)], "r int, c int, p double")
    assert files.write_field(f, f"file://{tmp_path}/field").count() == 1
    with pytest.raises(ValueError):
        files.write_field(f.withColumn("p", F.lit(0.0)), f"file://{tmp_path}/zero")
    e, n = (spark.range(1).select(x.alias("x")).first().x for x in vectors.utm(F.lit(-117.0), F.lit(40.0), 11))
    assert (e, n) == (pytest.approx(500000), pytest.approx(4427757.2, abs=0.5))


def test_stream_and_batch_agree(spark, tmp_path):
    from cellweave.streaming.live_scores import hourly

    rows = [(f"2024-01-01 0{i % 3}:1{i % 6}:00", "k", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    q = hourly(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly(df).collect()))


def test_windows_and_views(spark):
    from cellweave.operators import windows

    cells = spark.createDataFrame([(y, x, float(y * 10 + x)) for y in range(10) for x in range(7)], "r int, c int, p double")
    got = {(x.r, x.c, x.win_r, x.win_c) for x in windows.in_windows(cells, 10, 7, 4, 3).collect()}
    starts = [(a, b) for a in windows.window_starts(10, 4, 3) for b in windows.window_starts(7, 4, 3)]
    assert got == {(y, x, a, b) for y in range(10) for x in range(7) for a, b in starts if a <= y < a + 4 and b <= x < b + 4}
    back = windows.stitched(windows.in_windows(cells, 10, 7, 4, 3), 4).collect()
    assert len(back) == 70 and all(x.p == pytest.approx(x.r * 10 + x.c) for x in back)
    a = np.arange(16.0).reshape(4, 4)
    small = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(4) for x in range(4)], "r int, c int, p double")
    seen = {}
    for x in windows.symmetries(small, 4).collect():
        seen.setdefault(x.view, np.zeros((4, 4)))[x.r, x.c] = x.p
    want = {b.tobytes() for k in range(4) for b in (np.rot90(a, k).copy(), np.rot90(a.T, k).copy())}
    assert {v.tobytes() for v in seen.values()} == want


def test_policy_and_classes(spark):
    t, w = text.policy(F.col("n"))
    got = spark.createDataFrame([("sweep_t0_0.25_width3px",), ("none",)], "n string").select(t.alias("t"), w.alias("w")).collect()
    assert [tuple(x) for x in got] == [(0.25, 3), (None, None)]
    c = spark.createDataFrame([(1, "Normal FAULT"), (2, "Lineament"), (3, "Fold")], "id int, name string")
    assert [x.id for x in text.named_classes(c, extra=("Lineament",)).orderBy("id").collect()] == [1, 2]
