"""Boosted trees against plain loops over rows, and what they learn of missing values."""

import math
import random

import numpy as np
import pytest

from cellweave.operators import boosting as bo

FEATURES = ["a", "b", "c"]


def table(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = r.gauss(0, 1), r.randrange(6), r.random()
        a = None if r.random() < 0.2 else a
        y = int(r.random() < 1 / (1 + math.exp(-((2.0 if a is None else a) + (b > 3) - 1.5 * (c > 0.7)))))
        out.append((a, float(b), float("nan") if r.random() < 0.1 else c, y))
    return out


def goes_left(tree, row):
    v = row[tree[0]]
    return tree[2] if v is None or math.isnan(v) else v <= tree[1]


def value_of(tree, row):
    while len(tree) > 1:
        tree = tree[3] if goes_left(tree, row) else tree[4]
    return tree[0]


def plain_fit(rows, cuts, trees, leaves, depth, rate, l2, least):
    """Trees as tuples: (value,) or (feature, cut, left_missing, left, right)."""
    n, pos = len(rows), sum(r[3] for r in rows)
    base = math.log(pos / (n - pos))
    score, out = [base] * n, []
    for _ in range(trees):
        g = [1 / (1 + math.exp(-s)) - r[3] for s, r in zip(score, rows, strict=True)]
        h = [1 / (1 + math.exp(-s)) * (1 - 1 / (1 + math.exp(-s))) for s in score]

        def gain_of(left, right, g=g, h=h):
            if min(len(left), len(right)) < max(1, least) or min(sum(h[i] for i in left), sum(h[i] for i in right)) < 1e-3:
                return None
            one = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + l2)
            return round(one(left) + one(right) - one(left + right), 9)

        def split(members, gain_of=gain_of):
            best = None
            for f in range(3):
                gone = [i for i in members if rows[i][f] is None or math.isnan(rows[i][f])]
                here = [i for i in members if i not in set(gone)]
                for cut in cuts[f]:
                    low, high = [i for i in here if rows[i][f] <= cut], [i for i in here if rows[i][f] > cut]
                    for left_missing in (True, False) if gone else (len(low) >= len(high),):
                        left, right = (low + gone, high) if left_missing else (low, high + gone)
                        gain = gain_of(left, right)
                        if gain is not None and gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, f, cut, left_missing, left, right)
            return best

        nodes = {1: list(range(n))}
        done, level, count = {}, [1], 1
        for d in range(depth + 1):
            splits = {k: split(nodes[k]) for k in level} if d < depth else {}
            chosen = sorted((k for k in splits if splits[k]), key=lambda k: (-splits[k][0], level.index(k)))[: leaves - count]
            count += len(chosen)
            nxt = []
            for k in level:
                if k in chosen:
                    done[k] = splits[k]
                    nodes[2 * k], nodes[2 * k + 1] = splits[k][4:]
                    nxt += [2 * k, 2 * k + 1]
            level = nxt

        def build(k, nodes=nodes, done=done, g=g, h=h):
            if k not in done:
                return (-rate * sum(g[i] for i in nodes[k]) / (sum(h[i] for i in nodes[k]) + l2),)
            _, f, cut, left_missing, *_ = done[k]
            return (f, cut, left_missing, build(2 * k), build(2 * k + 1))

        tree = build(1)
        out.append(tree)
        score = [s + value_of(tree, r) for s, r in zip(score, rows, strict=True)]
    return [1 / (1 + math.exp(-s)) for s in score]


@pytest.mark.parametrize("leaves, depth", [(4, 3), (31, 2)])
def test_same_as_loops(spark, leaves, depth):
    rows = table(260, leaves)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double, y int").repartition(3)
    model = bo.fit(df, FEATURES, "y", trees=3, bins=8, leaves=leaves, depth=depth, rate=0.3, l2=0.5, least=5)
    assert all(len(c) <= 7 for c in model.cuts) and model.cuts[1] == [0.0, 1.0, 2.0, 3.0, 4.0]
    want = plain_fit(rows, model.cuts, 3, leaves, depth, 0.3, 0.5, 5)
    got = {r.id: r.p for r in bo.predicted(df, model).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(rows))], want, rtol=1e-9)


def test_direction_of_missing_values_is_learnt(spark):
    rows = [(float(i % 10), 0) for i in range(60)] + [(None, 1)] * 30 + [(float("nan"), 1)] * 10
    model = bo.fit(spark.createDataFrame(rows, "a double, y int"), ["a"], "y", trees=8, bins=4, leaves=4, depth=2, rate=0.5, least=5)
    got = {r.a: r.p for r in bo.predicted(spark.createDataFrame([(None, 0), (3.0, 0)], "a double, y int"), model).collect()}
    assert got[None] > 0.8 and got[3.0] < 0.2


def test_nothing_to_learn(spark):
    kind = "a double, y int"
    for rows in ([], [(1.0, None)], [(1.0, 0), (2.0, 0)], [(None, 1), (None, 0)]):
        model = bo.fit(spark.createDataFrame(rows, kind), ["a"], "y", trees=2, least=1)
        p = [r.p for r in bo.predicted(spark.createDataFrame([(1.0, 0), (None, 0)], kind), model).collect()]
        assert len(set(p)) == 1 and 0 <= p[0] <= 1
