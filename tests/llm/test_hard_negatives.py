"""Operator 13 against all pairs, on few and on many waves, and its index by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import hard_negatives as hn

KINDS = "vec_id long, embedding array<float>, label int, row string, anchor string, wave string, d string"


def brute(rows, every=4, positives=5, negatives=10, window=(30, 90), factor=256):
    ok = [(i, x, lab) for i, x, lab in rows if i is not None and lab is not None and x is not None and len(x) == 8 and all(v is not None and np.isfinite(v) for v in x)]
    v = np.array([np.floor(np.float32(x).astype(float) * factor) for _, x, _ in ok])
    out = []
    for a, (aid, _, lab) in enumerate(ok):
        if aid % every:
            continue
        score = v @ v[a]
        order = sorted((j for j in range(len(ok)) if j != a), key=lambda j: (-score[j], ok[j][0]))
        for p in [j for j in order if ok[j][2] == lab][:positives]:
            fit = [j for j in order if ok[j][2] != lab and window[0] * score[p] <= 100 * score[j] <= window[1] * score[p]]
            out += [(aid, ok[p][0], k, ok[j][0], int(score[p]), int(score[j])) for k, j in enumerate(fit[:negatives], 1)]
    return sorted(out)


def vectors(n, seed, centres=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 8))
    x = c[rng.integers(centres, size=n)] + rng.normal(size=(n, 8)) * 0.7
    x *= np.exp(rng.normal(size=(n, 1)) * 0.5) / 4
    return [(i, [float(v) for v in np.float32(x[i])], int(rng.integers(3))) for i in range(n)]


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], KINDS).repartition(3)
    return sorted(tuple(r) for r in hn.mine(df, F.expr("id % 4 = 0"), 8).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    rows = vectors(240, seed)
    assert mined(spark, rows) == brute(rows)


def test_waves_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(hn, "WAVE", 8)
    rows = vectors(80, 3)
    assert mined(spark, rows) == brute(rows)


def test_ties_copies_and_bad_rows(spark):
    rows = vectors(40, 4)
    rows += [(100 + i, rows[8][1], i % 3) for i in range(40)]  # copies of an anchor: ties of every kind
    rows += [(200, None, 1), (204, [1.0] * 7 + [None], 1), (208, [float("nan")] * 8, 1), (212, [1.0] * 7, 0), (216, [0.5] * 8, None), (None, [0.5] * 8, 1), (220, [0.0] * 8, 1)]
    assert mined(spark, rows) == brute(rows)


def test_repeated_ids_are_rows(spark):
    rows = [(4, [1.0] + [0.0] * 7, 0), (4, [1.0] + [0.0] * 7, 0), (5, [0.5] + [0.0] * 7, 1), (5, [0.5] + [0.0] * 7, 1)]
    got = mined(spark, rows)
    assert len(got) == 4 and {r[:2] for r in got} == {(4, 4)} and [r[3] for r in got] == [5] * 4


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5] * 8, 1)]) == []
    assert mined(spark, [(4, [0.5] * 8, 1)]) == []


def test_index_omits_dimensions_and_misses_nothing():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(700, 40)) * 50 * np.linspace(2, 0.1, 40))
    anchors = v[::10]
    length = np.linalg.norm(v, axis=1)
    least = 0.4 * np.linalg.norm(anchors, axis=1) * length.max()
    index = hn.Index(anchors, least, length.max())
    assert index.posted.max() < 40 and (np.diff(index.posted) <= 0).all()
    found = set()
    for part in index.parts():
        i, j, score = index.reaching(v, part)
        found |= {(a, int(index.order[b]), s) for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)}
    full = v @ anchors.T
    assert found == {(a, b, full[a, b]) for a, b in zip(*(x.tolist() for x in np.nonzero(full >= least)), strict=True)} and found
