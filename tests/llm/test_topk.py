import math
import random

from pyspark.sql import functions as F

from cellweave.llm import topk


def brute(rows, is_query, k, factor=64):
    ok = [(i, [math.floor(factor * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {i: min(v for j, v in ok if j == i) for i, _ in ok if is_query(i)}
    for i, q in queries.items():
        s = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i))[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_same_as_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLAB", 40)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "LEADS", (1, 2))
    monkeypatch.setattr(topk, "STEP", 3)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1 + i % 3) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.5, 0.25, -0.5, 1.0]) for i in range(300, 420)]  # ties
    rows += [(i, [40_000.0 * r.gauss(0, 1) for _ in range(4)]) for i in range(420, 424)]  # beyond small whole numbers
    rows += [(40, [0.1, 0.2, 0.3, 0.9]), (41, [2.0, 1.0, 0.0, 1.0]), (41, [2.0, 1.0, 0.0, 1.0]), (60, [0.0, 0.0, 0.0, 0.0])]  # repeated ids
    rows += [(500, None), (None, [1.0, 1.0, 1.0, 1.0]), (520, [1.0, None, 1.0, 1.0]), (540, [1.0, float("nan"), 1.0, 1.0]), (560, [1.0, float("inf"), 0.0, 0.0]), (580, [1.0])]
    odd = "embedding array<double>, id string, norm2 string, slab string, v string, s int, d int, score string, need int, block int, floor int"
    df = spark.createDataFrame([(*x, *["x"] * 4, 1, 1, "x", 1, 1, 1) for x in rows], f"vec_id long, {odd}")
    got = topk.search(df, F.expr("id % 20 = 0"), 4, k=5).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute(rows, lambda i: i % 20 == 0, 5)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = topk.search(df, F.expr("id % 20 = 0"), 2, k=5).collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in got] == [(0, 1, 1, 0)]
    assert topk.search(df.limit(0), F.expr("id % 20 = 0"), 2).count() == 0
