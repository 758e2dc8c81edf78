"""Verdicts of the rules on literal tables."""

import pytest

from cellweave.operators import field_rules as fr

SWEEP = "field string, t0 double, width int, dti double, px int, adopted boolean"


def rows(field, adopted, best, n=3, px=1000):
    """n candidates in the primary window (the best of them with best), one outside, and the adopted policy."""
    out = [(field, 0.1 + i / 100, 1, best - i / 1000, px + i, False) for i in range(n)]
    return [*out, (field, 0.9, 0, 0.9, 10 * px, False), (field, 0.3, 0, adopted, px + 500, True)]


def judged(spark, f, facts, proposal=None):
    sweep = spark.createDataFrame(f, SWEEP)
    got = fr.field_selection(sweep, spark.createDataFrame(facts, "field string, f1 string, reference double, p double"), "ship", 1000.0, proposal).collect()
    assert len({r.verdict for r in got}) == 1
    return got[0].verdict, {r.field: r for r in got}


GOOD = [("ship", "PASS", 0.1, None), ("new", "PASS", 0.1, 0.97)]


@pytest.mark.parametrize(
    "facts, new, verdict, rule",
    [
        (GOOD, (0.2, 0.30), "ADOPT new", None),
        ([GOOD[0], ("new", "UNVERIFIED", 0.1, 0.97)], (0.2, 0.30), "KEEP ship", ("f1", "UNVERIFIED")),
        ([GOOD[0], ("new", "PASS", None, 0.97)], (0.2, 0.30), "KEEP ship", ("f2", "FAIL")),
        (GOOD, (0.2, 0.21), "KEEP ship", ("r1", "FAIL")),  # by the margin, not more
        ([GOOD[0], ("new", "PASS", 0.1, None)], (0.2, 0.30), "KEEP ship", ("r3", fr.UNMEASURED)),
        ([GOOD[0], ("new", "PASS", 0.1, 0.9499)], (0.2, 0.30), "KEEP ship", ("r3", "FAIL")),
        ([GOOD[0], ("new", "PASS", 0.195, 0.97)], (0.2, 0.30), "KEEP ship", ("r4", "FAIL")),
    ],
)
def test_one_rule_decides(spark, facts, new, verdict, rule):
    got, by = judged(spark, rows("ship", 0.15, 0.2) + rows("new", *new), facts)
    assert got == verdict and by["ship"].r1 == by["ship"].r3 == "NOT_APPLICABLE" and not by["ship"].passes
    if rule:
        assert getattr(by["new"], rule[0]) == rule[1] and not by["new"].passes
    else:
        assert all(getattr(by["new"], x) == "PASS" for x in fr.RULES)


def test_too_few_candidates_and_other_windows(spark):
    got, by = judged(spark, rows("ship", 0.15, 0.2) + rows("new", 0.2, 0.3, 2), GOOD)
    assert got == "KEEP ship" and by["new"].r5 == "FAIL" and by["new"].r2 == "PASS"
    wide = [("third", 0.2, 2, 0.5, 1380, False)]  # first in the widest window alone
    got, by = judged(spark, rows("ship", 0.15, 0.2) + rows("new", 0.2, 0.3) + wide, GOOD)
    assert got == "KEEP ship" and by["new"].r2 == "FAIL"


def test_several_pass(spark, monkeypatch):
    """Only one field can be first in all windows, so two that pass need a rule that does not rank."""
    f = rows("ship", 0.15, 0.2) + rows("new", 0.2, 0.3) + rows("other", 0.2, 0.3)
    facts = [*GOOD, ("other", "PASS", 0.1, 0.99)]
    assert judged(spark, f, facts)[0] == "ADOPT new"
    assert judged(spark, f, facts, "new")[0] == "ADOPT new" and judged(spark, f, facts, "other")[0] == "KEEP ship"


def test_without_candidates(spark):
    got, by = judged(spark, [("ship", 0.3, 0, 0.1, 5000, True)], GOOD)
    assert got == "KEEP ship" and by["new"].r1 == "FAIL" and by["new"].f2 == "FAIL"


def test_fold_completeness(spark):
    own = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1", "9"]), ("c", []), ("d", None), ("e", ["7", "8"])], "field string, runs array<string>")
    seen = spark.createDataFrame([("1",), ("2",), ("1",)], "run string")
    of = lambda pinned: {r.field: r.f1 for r in fr.fold_completeness(own, seen, pinned).collect()}
    assert of(None) == {"a": "PASS", "b": "UNVERIFIED", "c": "UNVERIFIED", "d": "UNVERIFIED", "e": "UNVERIFIED"}
    pinned = {"runs": ["8", "7"], "live": 6, "reported": 6, "least": 6}
    assert of(pinned)["e"] == "PASS" and of(pinned)["a"] == "PASS"
    for odd in ({"live": None}, {"live": 5}, {"reported": 5}):
        assert of(pinned | odd)["e"] == "FAIL"
    assert of(pinned | {"reported": None, "least": None, "live": 1})["e"] == "PASS"


def decided(spark, others, best=0.25, fp=50.0):
    sweep = spark.createDataFrame([(0.3, 0, 0.20, 40.0, 10.0), (0.1, 2, best, 60.0, fp), (0.5, 1, 0.1, 20.0, 5.0)], "t0 double, width int, dti double, tp double, fp double")
    o = spark.createDataFrame(others, "ensemble string, t0 double, width int, dti double, reference double")
    anchors = spark.createDataFrame([(50,), (100,), (400,)], "truth_px int")
    (row,) = fr.width_decision(sweep, o, anchors, (0.3, 0), 100).collect()
    return row


def test_width_decision(spark):
    second = ("two", 0.1, 2, 0.3, 0.25)
    assert decided(spark, [second]).verdict == "SHIP" and decided(spark, [second]).wins == 3
    row = decided(spark, [])
    assert row.verdict == "NOT REPRODUCED" and row.failed == "3"
    row = decided(spark, [second, ("three", 0.1, 2, 0.26, 0.255)])
    assert row.verdict == "NOT SHIPPED" and row.failed == "3" and (row.ensembles, row.reproduced) == (2, 1)
    row = decided(spark, [second], best=0.21)
    assert row.failed == "1" and row.gain == pytest.approx(0.01)
    row = decided(spark, [second], fp=400.0)  # more found, but more wrong: small truths favour the shipped policy
    assert row.failed == "2" and 0 < row.wins < 3
    assert decided(spark, [("two", 0.2, 2, 0.3, 0.1)]).ensembles == 0
