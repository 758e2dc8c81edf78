"""Gates on literal tables, and records that measured less."""

import pytest

from cellweave.operators import gates as g

PIN = "name string, sha256 string, length long"


def status(df):
    (row,) = df.collect()
    return row.status, row.note


def test_files(spark):
    pins = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], PIN)
    of = lambda rows: status(g.files_gate("f", pins, spark.createDataFrame(rows, PIN)))
    assert of([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)]) == ("PASS", "")
    assert of([("a", "x", 1)]) == ("MISSING", "b: missing")
    assert of([("a", "q", 1)]) == ("FAIL", "a: other content; b: missing")
    assert of([("a", "x", 1), ("b", "y", 3)]) == ("FAIL", "b: other length")
    assert status(g.files_gate("f", pins.limit(0), pins))[0] == "MISSING"


def test_hashes_and_rules(spark):
    assert status(g.hash_gate(spark, "h", "x", "x"))[0] == "PASS" and status(g.hash_gate(spark, "h", "x", None))[0] == "MISSING"
    assert status(g.hash_gate(spark, "h", None, "x"))[0] == status(g.hash_gate(spark, "h", "y", "x"))[0] == "FAIL"
    of = lambda rows: status(g.rules_gate("r", spark.createDataFrame(rows, "failed array<string>")))
    assert of([([],)]) == ("PASS", "") and of([(["range", "mask"],)]) == ("FAIL", "range, mask") and of([])[0] == "MISSING"


def test_summary_and_record(spark, tmp_path):
    own = lambda *rows: g.readiness([g.gate(spark, n, s) for n, s in rows])
    now = own(("a", "PASS"), ("b", "FAIL"), ("c", "HUMAN"), ("d", "SKIPPED"), ("e", "MISSING"))
    (s,) = g.summary(now).collect()
    assert (s.total, s.passed, s.failed, s.human, s.missing, s.failing, s.ready) == (5, 1, 1, 1, 2, "b", False)
    assert g.summary(own(("a", "PASS"), ("c", "HUMAN"))).first().ready
    before = own(("a", "PASS"), ("b", "PASS"), ("d", "PASS"), ("e", "FAIL"))
    with pytest.raises(ValueError, match="d PASS -> SKIPPED"):
        g.recorded(now, before, str(tmp_path / "r"))
    assert g.recorded(now, before, str(tmp_path / "r"), allow=True).count() == 5
    assert g.recorded(now, None, str(tmp_path / "s")).count() == 5
    with pytest.raises(ValueError, match="two gates named a"):
        own(("a", "PASS"), ("a", "FAIL"))
