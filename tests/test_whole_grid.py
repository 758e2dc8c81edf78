"""Queries that once read a corner of the grid, against SQL over the whole of it."""

import duckdb
import pytest

from cellweave.plans import grid_queries as Q
from cellweave.plans.grid_oracles import EV

STARTS = "(SELECT unnest(list_distinct(range(0, greatest(0, {n} - 64), 48) || [greatest(0, {n} - 64)])) AS w{from_})"
WINDOWS = f"""WITH {EV}, size AS (SELECT CAST(max(r) + 1 AS BIGINT) AS h FROM main),
inw AS (SELECT r, c, p, a.w AS win_r, b.w AS win_c FROM main JOIN {STARTS.format(n='h', from_=' FROM size')} a ON r BETWEEN a.w AND a.w + 63 JOIN {STARTS.format(n='720', from_='')} b ON c BETWEEN b.w AND b.w + 63)"""


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    """Events of 400 users over 30 days."""
    root = tmp_path_factory.mktemp("tall")
    duckdb.sql(f"""COPY (SELECT i AS event_id, (i * 7919) % 400 AS user_id, TIMESTAMP '2024-01-01' + to_hours(CAST((i * 104729) % 720 AS INT)) AS ts,
        ['purchase', 'click', 'error'][1 + i % 3] AS event_type, CAST((i * 31) % 499 + 1 AS DOUBLE) AS value FROM range(6000) t(i)) TO '{root}/events.parquet'""")
    return str(root)


def rows(root, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{root}/events.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_all_rows_are_windowed(spark, tall):
    got = sorted(map(tuple, Q.window_counts(spark, tall).select("win_r", "win_c", "px").collect()))
    assert got == rows(tall, f"{WINDOWS} SELECT win_r, win_c, count(*) FROM inw GROUP BY ALL")
    assert max(x[0] for x in got) > 160


def test_all_rows_are_stitched(spark, tall):
    got = sorted(map(tuple, Q.window_stitch(spark, tall).select("r", "c", "p").collect()))
    want = rows(tall, f"WITH {EV} SELECT r, c, round(p, 6) FROM main")
    assert [x[:2] for x in got] == [x[:2] for x in want] and max(x[0] for x in got) == 399
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_all_tiles_have_views(spark, tall):
    got = sorted((x["view"], x.n, x.moment) for x in Q.symmetry_views(spark, tall).collect())
    sides = ", ".join(f"{{'view': {i}, 'y': {y}}}" for i, y in enumerate(["y", "x", "63 - y", "63 - x"] * 2))
    want = rows(tall, f"WITH {EV}, v AS (SELECT p, unnest([{sides}]) AS s FROM (SELECT r % 64 AS y, c % 64 AS x, p FROM main)) SELECT s.view, count(*), sum(s.y * p) FROM v GROUP BY 1")
    assert [x[:2] for x in got] == [x[:2] for x in want] and got[0][1] == rows(tall, f"WITH {EV} SELECT count(*) FROM main")[0][0]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-3)


def test_tiles(spark):
    from cellweave.operators import windows

    got = windows.in_tiles(spark.createDataFrame([(0, 0), (5, 9), (12, 3)], "r int, c int"), 4).collect()
    assert sorted((x.win_r, x.win_c, x.r, x.c) for x in got) == [(0, 0, 0, 0), (4, 8, 1, 1), (12, 0, 0, 3)]


def test_any_change_of_a_table_shows(spark, tmp_path):
    from pyspark.sql import functions as F

    duckdb.sql(f"""COPY (SELECT i AS o_orderkey, i * 37 % 90 AS o_custkey, ['F', 'O', NULL][1 + i % 3] AS o_orderstatus, CASE WHEN i % 7 > 0 THEN 900 + i * 1001 / 100 END AS o_totalprice,
        TIMESTAMP '1995-01-01' + to_hours(CAST(i * 5 AS INT)) AS o_orderdate, CASE WHEN i % 5 > 0 THEN '1-URGENT' ELSE '' END AS o_orderpriority FROM range(3000) t(i)) TO '{tmp_path}/orders.parquet'""")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    text = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in names)
    con = duckdb.connect()
    want = con.execute(f"""SELECT o_orderstatus, count(*), CAST(sum(h) % 4611686018427387904 AS BIGINT), bit_xor(h)
        FROM (SELECT o_orderstatus, CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) AS h FROM '{tmp_path}/orders.parquet') GROUP BY 1""").fetchall()
    got = {tuple(x) for x in Q.table_fingerprint(spark, str(tmp_path)).select("o_orderstatus", "n", "s", "x").collect()}
    assert got == set(want) and len(got) == 3
    orders = spark.read.parquet(f"{tmp_path}/orders.parquet")
    one = F.col("o_orderkey") == 1501
    for i, (c, v) in enumerate([("o_totalprice", F.lit(0.5)), ("o_orderdate", F.lit("2001-01-01").cast("timestamp")), ("o_custkey", F.lit(91)), ("o_orderpriority", F.lit(None))]):
        orders.withColumn(c, F.when(one, v).otherwise(F.col(c))).write.parquet(f"{tmp_path}/{i}/orders.parquet")
        assert len(got - {tuple(x) for x in Q.table_fingerprint(spark, f"{tmp_path}/{i}").select("o_orderstatus", "n", "s", "x").collect()}) == 1
