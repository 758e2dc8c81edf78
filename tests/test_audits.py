"""Audits, codecs, described grids and shaping on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import audits, emission, kernels, partition, selection, shaping
from cellweave.sources import codec, grids, shared

CELLS = "r int, c int"


def test_blocks_of_both_sides_must_be_the_same(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.2), ("b", 1, 0.6), ("b", 2, 0.1)]
    labels = spark.createDataFrame(rows, "candidate string, part int, dti double")
    proxy = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("b", 1, 0.4), ("b", 2, 0.9)], "candidate string, part int, dti double")
    got = audits.population_agreement(labels, proxy, "a").collect()
    assert [(x.candidate, x.scoreable, x.gain, x.both, x.agree, x.labels_lose, x.conflict_lose_gain, x.conflict_gain_lose) for x in got] == [("b", 1, 0, 1, 0, 0, 0, 1)]
    with pytest.raises(ValueError, match="same blocks"):
        audits.population_agreement(labels, proxy.where("part = 1"), "a")


def test_verdicts(spark):
    for rows, want in (
        ([("labels", 0.1), ("proxy", 0.2)], "GAIN_ON_BOTH"),
        ([("labels", -0.1), ("proxy", 0.2)], "PROXY_GAINS_LABELS_LOSE"),
        ([("labels", 0.1), ("proxy", -0.2)], "LABELS_GAIN_PROXY_LOSES"),
        ([("labels", -0.1), ("proxy", 0.0)], "LOSS_ON_BOTH"),
        ([("labels", -0.1), ("proxy", -0.2), ("combined", 0.1)], "GAIN_ON_COMBINED"),
        ([("labels", -0.1)], "NOT_MEASURABLE"),
    ):
        assert audits.arms_verdict(spark.createDataFrame(rows, "population string, contrast double")).first().verdict == want
    with pytest.raises(ValueError, match="fewer than"):
        cells = spark.createDataFrame([(0, 0)], CELLS)
        audits.transfer(cells.withColumn("p", F.lit(1.0)), cells, cells, cells, [1])


def test_gates_and_rows(spark):
    gate = "name string, status string"
    before = spark.createDataFrame([("a", "PASS"), ("b", "FAIL"), ("c", "PASS"), ("d", "PASS")], gate)
    after = spark.createDataFrame([("a", "FAIL"), ("b", "MISSING"), ("c", "SKIPPED"), ("d", "PASS")], gate)
    assert [tuple(x) for x in audits.degraded(before, after).collect()] == [("c", "PASS", "SKIPPED")]
    row = "candidate int, dti double, tp double, fp double, fn double, pred_px long"
    local = spark.createDataFrame([(1, 0.5, 1.0, 2.0, 3.0, 4), (2, 0.5, 1.0, 2.0, 3.0, 4), (3, 0.5, 1.0, 2.0, 3.0, 4)], row)
    there = spark.createDataFrame([(1, 0.5 + 5e-7, 1.0009, 2.0, 3.0, 4), (2, 0.5, 1.0, 2.01, None, 5)], row)
    got = {x.candidate: (x.status, x["off"]) for x in audits.crosschecked(local, there).collect()}
    assert got == {1: ("reproduced", ""), 2: ("MISMATCH", "fp,fn,pred_px"), 3: ("not_available", None)}
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], CELLS)
    assert sorted(tuple(x) for x in audits.differences(a, spark.createDataFrame([(1, 1), (3, 3)], CELLS)).collect()) == [(1, 1, "a"), (2, 2, "a"), (3, 3, "b")]


def test_fold_lists():
    assert audits.fold_list("2, 0", 4) == [0, 2]
    for bad in ("", "1,", "1,,2", "x", "1,1", "4", "-1", "1.5"):
        with pytest.raises(ValueError):
            audits.fold_list(bad, 4)


def test_supervision(spark):
    one = lambda *xs: spark.createDataFrame([(x, 0) for x in xs], CELLS)
    of = lambda mode, corridor=0: {(x.r, x.c) for x in audits.supervision(one(1), one(1, 5), one(9), mode, corridor).collect()}
    assert of("union") == {(1, 0), (5, 0), (9, 0)} and of("proxy_only") == {(1, 0), (5, 0)} and of("catalogue") == {(1, 0)}
    assert of("catalogue", 2) == {(1 + y, x) for y in range(-2, 3) for x in range(-2, 3) if y * y + x * x <= 4}
    with pytest.raises(ValueError):
        of("all")


def test_few_folds_and_seeds(spark):
    rows = [(f, c, 0.1 * c) for f in range(2) for c in range(3)]
    df = spark.createDataFrame(rows, "fold int, candidate int, dti double")
    assert {tuple(x) for x in selection.leave_one_out(df).collect()} == {(0, None, None, None, None), (1, None, None, None, None)}
    assert [x.candidate for x in selection.calibrated(df).where("best").collect()] == [2]
    flat = df.withColumn("dti", F.lit(0.3))
    assert [x.candidate for x in selection.calibrated(flat, 1).where("best").collect()] == [1]
    assert [x.candidate for x in selection.calibrated(flat).where("best").collect()] == [0]
    w = emission.softmax_weights(spark.createDataFrame([("a", 0.5), ("b", 0.25)], "candidate string, dti double"))
    got = {x.candidate: x.w for x in w.collect()}
    assert got["b"] / got["a"] == pytest.approx(math.exp(-2)) and sum(got.values()) == pytest.approx(1)


def test_run_bytes(spark):
    r = random.Random(1)
    rows = [(y, x, r.choice([0.0, 1.0, None, 1.0])) for y in range(3) for x in range(300)] + [(5, x, 0.0) for x in range(20_000)]
    df = spark.createDataFrame(rows, "r int, c int, p double")
    coded = codec.encode_rows(df)
    assert codec.decode_rows(coded).exceptAll(df).count() == 0 == df.exceptAll(codec.decode_rows(coded)).count()
    assert bytes(coded.where("r = 5").first().blob) == bytes([0xA0, 0x9C, 0x01, 0])
    assert codec.value_histogram(df.withColumn("p", F.when(F.col("c") == 7, 0.5).otherwise(F.col("p")))).first().others == 4
    with pytest.raises(Exception, match="not a field"):
        codec.encode_rows(spark.createDataFrame([(0, 0, 0.5)], "r int, c int, p double")).collect()
    fine = codec.write_length(5) + b"\x01"
    assert codec.read_runs(fine, 5) == [{"length": 5, "code": 1}]
    for bad, n in ((b"\x80", 5), (b"\x05", 5), (b"\x00\x01" + fine, 5), (b"\x05\x03", 5), (fine, 4), (fine, 6), (fine + b"\x01\x01", 5), (b"\x80" * 9 + b"\x01\x00", 5), (b"", 1)):
        with pytest.raises(ValueError):
            codec.read_runs(bad, n)


def test_described_grids(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0, -9.0), (0, 1, float("nan"), 2.0), (1, 0, -1e35, -9.0)], "r int, c int, b01 double, label double")
    meta = {"height": 2, "width": 2, "crs": "EPSG:32611", "transform": [100.0, 0.0, 5.0, 0.0, -100.0, 7.0], "nodata": -9.0, "tags": {"b01": "anomaly"}}
    grids.write_grid(cells, f"{tmp_path}/a", meta)
    grids.write_grid(cells.withColumn("p", F.lit(0.5)), f"{tmp_path}/b", meta)
    grids.write_grid(cells, f"{tmp_path}/c", meta | {"transform": [100.0, 0.0, 6.0, 0.0, -100.0, 7.0], "width": 3})
    got = {(x.r, x.c): (x.b01, x.valid) for x in grids.read_grid(spark, f"{tmp_path}/a", ["b01"]).collect()}
    assert got == {(0, 0): (1.0, True), (0, 1): (None, False), (1, 0): (None, False)}
    assert grids.read_grid(spark, f"{tmp_path}/a").where("valid").count() == 2
    sample = spark.createDataFrame([(0, 1), (9, 9), (0, 1)], CELLS)
    assert [(x.r, x.c, x.label) for x in grids.read_grid(spark, f"{tmp_path}/a", sample=sample).collect()] == [(0, 1, 2.0)]
    assert {(x.r, x.c): (x.fault, x.valid) for x in grids.read_labels(spark, f"{tmp_path}/a").collect()} == {(0, 0): (False, False), (0, 1): (True, True), (1, 0): (False, False)}
    assert grids.aligned(spark, f"{tmp_path}/a", f"{tmp_path}/b")["tags"] == {"b01": "anomaly"}
    with pytest.raises(ValueError, match="width, transform"):
        grids.aligned(spark, f"{tmp_path}/a", f"{tmp_path}/c")
    assert grids.read_folds(spark, {3: f"{tmp_path}/b"}).where("fold = 3 AND p = 0.5").count() == 3


def test_paths_settings_reports_and_pins(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "recon_x.tif").write_text("")
    assert grids.resolve_path(None, ["x.tif"], [str(tmp_path), f"{tmp_path}/deep"]).endswith("deep/recon_x.tif")
    for explicit in (None, f"{tmp_path}/y"):
        with pytest.raises(FileNotFoundError):
            grids.resolve_path(explicit, ["z"], [str(tmp_path)])
    base = {"a": {"b": 1}}
    assert grids.with_overrides(base, ["a.b=2", "a.c=[1]", "d.e=text", "f=null"]) == {"a": {"b": 2, "c": [1]}, "d": {"e": "text"}, "f": None} and base == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        grids.with_overrides({}, ["a"])
    rows = spark.createDataFrame([("x", 1.5), ("y", float("nan")), (None, float("inf"))], "name string, v double")
    assert sorted((x.name or "", x.v) for x in grids.write_report(rows, f"{tmp_path}/report").collect()) == [("", None), ("x", 1.5), ("y", None)]
    pin = "name string, sha256 string, length long"
    got = grids.pinned(spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3), ("d", "4", 4)], pin), spark.createDataFrame([("a", "1", 1), ("b", "x", 2), ("c", "3", 9), ("e", "5", 5)], pin))
    assert {(x.name, x.problem) for x in got.collect()} == {("b", "other content"), ("c", "other length"), ("d", "missing"), ("e", "not pinned")}


def test_shaping_with_thinned_floors(spark):
    rows = [(y, x, 0.2 if x % 9 else 0.8) for y in range(12, 40) for x in range(10, 50)]
    field = spark.createDataFrame(rows, "r int, c int, p double")
    policy = shaping.policies(spark, [0.1, 0.5], widths=(0, 1))
    got = shaping.shaped(field, policy, "r >= 0 AND c BETWEEN 0 AND 99").collect()
    by = {}
    for x in got:
        by.setdefault(x.candidate, set()).add((x.r, x.c))
    named = {(x.t0, x.thin, x.width): by[x.candidate] for x in policy.collect()}
    assert named[0.1, False, 0] == {(y, x) for y, x, _ in rows} and named[0.5, False, 0] == {(y, x) for y, x, p in rows if p > 0.5}
    for t in (0.1, 0.5):
        thin, whole = named[t, True, 0], named[t, False, 0]
        assert thin <= whole and len(thin) <= len(whole) and all(min((y - a) ** 2 + (x - b) ** 2 for a, b in thin) <= 9 for y, x in whole)
        assert named[t, True, 1] == {(y + a, x + b) for y, x in thin for a, b in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))}


def test_samples(spark):
    foot = spark.createDataFrame([(y, x) for y in range(30) for x in range(30)], CELLS)
    truth = foot.where("r < 2")
    s = partition.training_sample(truth, foot, 3.0)
    assert {(x.y, x["count"]) for x in s.groupBy("y").count().collect()} == {(0, 180), (1, 60)}
    assert partition.training_sample(truth, foot, 3.0, most=50).where("y = 0").count() == 50
    assert partition.training_sample(truth, foot, 1000.0).where("y = 0").count() == 840
    assert s.join(truth, ["r", "c"], "left_semi").where("y = 0").count() == 0


def test_wanted_cells_classes_and_runs(spark):
    from cellweave.operators import text

    a = np.random.default_rng(5).normal(size=(50, 30))
    g = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(50) for x in range(30)], "r int, c int, v double")
    wanted = spark.createDataFrame([(0, 0), (17, 29), (49, 3)], CELLS)
    got = {(x.r, x.c): x.x for x in kernels.over_tiles(g, kernels.coherence, 8, 8, wanted=wanted).collect()}
    whole = kernels.coherence(a)
    assert set(got) == {(0, 0), (17, 29), (49, 3)} and all(v == pytest.approx(whole[k], abs=1e-9) for k, v in got.items())
    seen = spark.createDataFrame([("x", 5), ("b", 2), ("x", 1), ("a", 2), (None, 0)], "class string, at int")
    known = spark.createDataFrame([("k", 4), ("a", 9)], "class string, id int")
    assert {tuple(x) for x in text.class_ids(seen, known).collect()} == {("k", 4), ("a", 9), ("x", 10), ("b", 11)}
    table = spark.createDataFrame([(0, 0, 0, 5, 0), (1, 0, 1, 5, 2), (2, 0, 2, 0, 0), (3, 1, 0, 5, 0), (4, 1, 1, 5, 1)], "block int, block_row int, block_col int, valid_px long, fault_px long")
    assert [(x.block, x.area, x.faults) for x in partition.compact_runs(table, 2).orderBy("rank").collect()] == [(0, 2, 2), (3, 2, 1), (1, 4, 2)]
    assert partition.compact_runs(table, 5).count() == 0


def test_kernels_on_literal_arrays():
    line = np.zeros((41, 41))
    line[20] = 1.0
    ridge = kernels.ridgeness(line)
    assert ridge[20, 20] == ridge.max() and ridge[5].max() < 1e-6 and np.allclose(ridge[20], ridge[20, 0])  # mirrored borders leave a line as it is
    assert kernels.ridgeness(-line)[20, 20] == 0
    assert kernels.ridgeness(line, (3.0,))[20, 20] == pytest.approx(1 / (math.sqrt(2 * math.pi) * 3), rel=0.01)  # of a Gaussian's middle
    coherence = kernels.coherence(np.add.outer(np.arange(41.0), np.zeros(41)))
    assert coherence[20, 20] == pytest.approx(1) and kernels.coherence(np.ones((41, 41)))[20, 20] == 0
    wavy = line * (1 + 0.1 * np.cos(np.arange(41) / 3))
    assert kernels.vesselness(-wavy, sigmas=(1.0,), gamma=0.1)[20, 20] > 0.9 and kernels.vesselness(wavy, sigmas=(1.0,), gamma=0.1)[20, 20] < 1e-6
    y, x = np.mgrid[-20:21, -20:21]
    blob = np.exp(-(y**2 + x**2) / 8.0)
    assert kernels.coherence(blob)[20, 20] == pytest.approx(0, abs=1e-6)


def test_run_folder_goes(spark, tmp_path, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(shared, "shared_root", lambda _: f"file://{tmp_path}")
        with shared.run_folder(spark) as path:
            assert shared.stored(spark.range(3), "x").count() == 3 and list((tmp_path / path.rsplit("/", 1)[1]).iterdir())
        assert not list(tmp_path.iterdir())

    class Cluster:
        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.master": "spark://x:7077"}.get(name, default)

    with pytest.raises(ValueError, match="share"):
        shared.shared_root(Cluster)
