"""Steps of queries that findings of round 3 say grow faster than their input."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import boosting, dominating, emission, focal, kernels, regions, scoring, text
from cellweave.operators.components import star
from cellweave.sources import archive, raster


def no_broadcast(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan, plan


def test_cells_and_their_neighbours_are_merged_not_broadcast(spark):
    """Files of cells and links are small, the tables read from them are not."""
    cells = spark.range(40).select((F.col("id") % 7).cast("int").alias("r"), (F.col("id") % 11).cast("int").alias("c"))
    edges = spark.range(1, 30).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    no_broadcast(star(edges, True))
    no_broadcast(star(edges, False))
    no_broadcast(cells.join(scoring.spread(cells, 3).select(F.col("nr").alias("r"), F.col("nc").alias("c")).distinct(), ["r", "c"], "left_anti"))
    found = regions.regions(cells)
    no_broadcast(found)
    no_broadcast(regions.drop_small(found, 2))
    no_broadcast(kernels.thin_cover(cells.select(F.lit(0).alias("k"), "r", "c", F.lit(0.5).alias("p")), "k"))
    own = cells.select(F.lit(0).alias("of"), "r", "c", F.lit(0.5).alias("p"))
    no_broadcast(dominating.scores(own.select("of", "r", "c"), own, 3))


def test_sums_of_texts_meet_in_ranges_and_null_keys_stay(spark):
    """each distinct place took a matrix of its own in Python, and a key's rows one task."""
    words = [(k, n, ["ab", None, "é" * (n % 7)][n % 3]) for k in ("x", "y", None) for n in range(60)]
    got = {r.k: (r.length, r.crc) for r in archive.crc_in_order(spark.createDataFrame(words, "k string, n int, t string").repartition(5), "t", ["n"], "k").collect()}
    whole = {k: "".join(t or "" for own, _, t in words if own == k).encode() for k in ("x", "y", None)}
    assert got == {k: (len(b), zlib.crc32(b)) for k, b in whole.items()}
    n = np.array([0, 1, 5, 255, 10**9, 3 * 10**11])
    crcs = np.array([zlib.crc32(bytes([i])) for i in range(6)])
    assert archive.shifted(crcs, n).tolist() == [archive.applied(archive.times_x8(int(k)), int(c)) for k, c in zip(n, crcs)]


def test_masks_grow_and_close_by_tiles(spark):
    """Cells moved once for each neighbour, and all of them were in one aggregate of a task."""
    cells = spark.range(90).select((F.col("id") * 37 % 19 - 5).cast("int").alias("r"), (F.col("id") * 53 % 23 - 6).cast("int").alias("c"))
    rows = lambda df: sorted(map(tuple, df.select("r", "c").collect()))
    for size in (3, 5):
        assert rows(kernels.closed_square(cells, size, 4)) == rows(emission.erode_square(emission.dilate_square(cells, size // 2), size // 2))
    for positive in (True, False):
        plain = scoring.spread(cells, 3, positive).select(F.col("nr").alias("r"), F.col("nc").alias("c")).distinct()
        assert rows(kernels.near_cells(cells, 3, positive, 4)) == rows(plain)


def test_feature_matrix_moves_cells_once_and_makes_all_columns_of_a_tile(spark):
    """every band and filter had a shuffle and a join of its own, and windows moved each cell once for each neighbour."""
    n = spark.range(0, 900, 1, 3).where("id % 7 <> 3")
    g = n.select((F.col("id") / 31).cast("int").alias("r"), (F.col("id") % 31 - 4).cast("int").alias("c"), F.when(F.col("id") % 11 > 0, F.col("id") * 37 % 101 + 0.0).alias("a"), (F.col("id") % 9).cast("decimal(5,2)").alias("b"))
    found = kernels.feature_matrix(g, {"ridge": ["a"], "coher": ["b"], "window": ["a", "b"]}, tile=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan, plan
    assert found.columns == ["r", "c", "a", "b", "ridge_a", "coher_b", *(f"{w}{k}_{b}" for b in "ab" for k in (5, 11) for w in ("mean", "std"))]
    got = {(x.r, x.c): x for x in found.collect()}
    assert {k: (x.a, x.b) for k, x in got.items()} == {(x.r, x.c): (x.a, x.b) for x in g.collect()}
    for b in "ab":
        cells = focal.dense(g.select("r", "c", F.col(b).cast("double").alias("v")))
        for k in (5, 11):
            want = {(x.r, x.c): (x["mean"], x["std"]) for x in focal.window_stats(cells, k).collect()}
            for at, x in got.items():
                assert (x[f"mean{k}_{b}"], x[f"std{k}_{b}"]) == (pytest.approx(want[at], rel=1e-9) if x[b] is not None else (None, None))
    whole = {"a": np.zeros((29, 31)), "b": np.zeros((29, 31))}
    for (r, c), x in got.items():
        for b in "ab":
            whole[b][r, c + 4] = x[b] or 0
    ridge, coher = kernels.ridgeness(whole["a"]), kernels.coherence(whole["b"])
    for (r, c), x in got.items():
        assert x.ridge_a is None if x.a is None else math.isclose(x.ridge_a, ridge[r, c + 4], abs_tol=1e-9)
        assert math.isclose(x.coher_b, coher[r, c + 4], abs_tol=1e-9)
    one = kernels.feature_matrix(g.where("r = 3 AND c = 2"), {"window": ["b"]}).first()
    assert one.mean5_b == float(one.b) and one.std11_b == 0
    assert kernels.feature_matrix(g.where("r < -5"), {"window": ["b"]}).count() == 0


def test_rows_of_equal_bins_are_one_row_with_their_number(spark):
    """each of some thirty passes read every row."""
    rows = [(float(i % 5), None if i % 3 == 0 else float("nan") if i % 3 == 1 else 2.0, i % 2 if i < 80 else None) for i in range(90)]
    few = spark.createDataFrame(rows, "a double, b double, y int")
    table = boosting.binned(few.unionByName(few), ["a", "b"], [[0.0, 2.0], []], "y")
    got = {(tuple(x.codes), x.y): x.n for x in table.collect()}
    want: dict = {}
    for a, b, y in rows:
        if y is not None:
            key = (0 if a <= 0 else 1 if a <= 2 else 2, 0 if b == 2.0 else None), float(y)
            want[key] = want.get(key, 0) + 2
    assert got == want
    once, twice = (boosting.fit(d, ["a", "b"], "y", trees=2, bins=4, leaves=4, depth=2, least=k) for d, k in ((few, 2), (few.unionByName(few), 4)))
    assert [str(t) for t in once.trees] == [str(t) for t in twice.trees]


def test_rasters_are_compared_window_by_window(spark, tmp_path, monkeypatch):
    """all cells of a raster and of its template were read as rows and joined."""
    meta = {"height": 50, "width": 7, "transform": (100.0, 0.0, 0.0, 0.0, -100.0, 0.0), "epsg": 32611}
    cells = spark.range(350).select((F.col("id") / 7).cast("int").alias("r"), (F.col("id") % 7).cast("int").alias("c"), (F.col("id") % 9 / 8).alias("p")).where("(r * 7 + c) % 5 > 0")
    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    raster.write_raster(cells.where("r < 20 OR c > 2"), one, ["p"], meta, 4, 12)
    raster.write_raster(cells.where("r <> 30"), other, ["p"], meta, 5, 20)
    (tmp_path / "other" / "part-00000000.tif").unlink()  # cells that one of them has no file for are not compared
    joined = raster.read_raster(spark, one).join(raster.read_raster(spark, other).withColumnRenamed("p", "q"), ["r", "c"]).collect()
    known = [x.p for x in joined if x.p is not None]
    want = (len(joined), len(joined) - len(known), min(known), max(known), *(sum((x.p is None) is a and (x.q is None) is not a for x in joined) for a in (True, False)))
    monkeypatch.setattr(raster, "PARTITION_BYTES", 1000)
    s = raster.compared(spark, one, other, (50, 7))
    assert (s.n, s.none, s.low, s.high, s.inside, s.outside) == want and s.inside and s.outside
    monkeypatch.setattr(raster, "read_raster", None)
    assert raster.failed_raster(spark, one, 32611, 100.0, other)[0] == ["inside", "outside"]
    assert raster.failed_raster(spark, other, 32611, 100.0)[0] == []


def test_quotes_are_looked_up_by_runs_of_words(spark, monkeypatch):
    """an automaton of all letters of all quotes took some fifty bytes a letter in every task."""
    r = random.Random(3)
    some = lambda most: " ".join(r.choice(["a", "b", "cd", "é"]) for _ in range(r.randrange(1, most)))
    docs, quotes = [(i, some(60)) for i in range(150)] + [(998, " "), (999, None)], [(i, some(11)) for i in range(120)] + [(500, ""), (501, None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(quotes, "item_id int, text string")
    want = sorted((i, d) for i, q in quotes if q for d, t in docs if t and f" {q} " in f" {t} ")
    assert sorted(map(tuple, text.quoted(*frames).collect())) == want
    monkeypatch.setattr(text, "QUOTE_BYTES", 700)  # several passes
    assert sorted(map(tuple, text.quoted(*frames).collect())) == want
    many = [f" {' '.join(str(r.random()) for _ in range(20))} " for _ in range(3000)]
    tracemalloc.start()
    index = text.Quotes(many)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 3 * sum(map(len, many)) and index.found([" x" + many[7], many[8]]) == [(7, 0), (8, 1)]
