"""Small worlds on which findings of round 3 showed."""

import datetime

import pytest

import __spark_entry__ as entry
from cellweave.operators import reprojection
from cellweave.plans.field_oracles import TOUCHED


def events(spark, tmp_path, rows):
    """events of (user, hour, type, value) as a table of a folder."""
    start = datetime.datetime(2024, 1, 1)
    full = [(i, start + datetime.timedelta(hours=h), u, k, float(v), "{}") for i, (u, h, k, v) in enumerate(rows)]
    spark.createDataFrame(full, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def same_as_sql(spark, folder, name):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    df = entry.queries()[name](spark, folder)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(got.fetchall())
    return df


def test_cells_above_the_grid_belong_to_its_first_blocks(spark, tmp_path):
    rows = [(0, 383, "error", 1), (0, 400, "error", 1), (200, 10, "error", 1), (200, 719, "view", 1)]
    df = same_as_sql(spark, events(spark, tmp_path, rows), "training_weights")
    assert df.where("r = -1 AND c = 383").count() == 1 and df.where("r = -1 AND c = 384").isEmpty()


def test_lines_through_corners_touch_the_cells_that_sql_says(spark):
    """a line's share of a row was divided first, so some that pass a corner came out in the next column."""
    con = pytest.importorskip("duckdb").connect()
    own = "SELECT id AS feature, ((id * 37 % 700) / 8 + 0.5 - 3.5) / 2.25 AS x0, (id / 16 + 0.25 - 0.75) / 1.5 AS y0, ((id * 91 % 719 + 1) / 8 + 0.5 - 3.5) / 2.25 AS x1, (id / 16 + 2.0 - 0.75) / 1.5 AS y1 FROM {}"
    got = reprojection.touched(spark.sql(own.format("range(3000)"))).select("feature", "r", "c").collect()
    con.execute("CREATE TABLE seg AS " + own.format("range(3000) t(id)"))
    per_line = TOUCHED.replace("SELECT DISTINCT r,", "SELECT DISTINCT feature, r,").replace("ends AS (SELECT r,", "ends AS (SELECT feature, r,")
    want = con.execute(f"WITH {per_line} SELECT feature, r, c FROM mark").fetchall()
    assert len(want) > 10000 and sorted(map(tuple, got)) == sorted(want)
