"""The driver's contract, and queries against their SQL on the smallest data where it is there."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = entry.SMALL
CHECKED = "training_weights holdout_drawn width_decision window_sums dti_global dti_by_block block_table fold_balanced sweep_floor_width components edt window_stats bootstrap_paired rle_encode".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    return "-" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v + 0.0) if isinstance(v, float) else str(v)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() == 1


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    got = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want
