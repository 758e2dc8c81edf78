"""Histogram gradient boosting of two classes with missing values: sums by node, feature and bin on Spark, trees as expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.sources.shared import stored

#: Trees whose scores are recomputed before the rows' scores are written anew.
KEEP = 8
#: The least sum of second derivatives of a leaf, and the least gain of a split.
LEAST_H, LEAST_GAIN = 1e-3, 1e-9
#: Digits to which gains are compared, so that the order of sums decides nothing.
DIGITS = 9


@dataclass
class Node:
    """A leaf's value, or a split: values of at most cut go left, missing ones left if left_missing."""

    value: float = 0.0
    feature: int = -1
    bin: int = -1
    cut: float = 0.0
    left_missing: bool = False
    left: Node | None = None
    right: Node | None = None


@dataclass
class Model:
    """features, the cut points of each, the score without trees, and trees."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Node] = field(default_factory=list)

    def score(self, value) -> Column:
        """The log-odds as an expression; value: from a feature's number the column that holds it (missing: null)."""
        return sum((tree_value(t, lambda n: value(n.feature) <= n.cut, lambda n: value(n.feature).isNull()) for t in self.trees), F.lit(self.base))


def tree_value(node: Node, low, missing) -> Column:
    if node.left is None:
        return F.lit(node.value)
    goes_left = F.when(missing(node), F.lit(node.left_missing)).otherwise(low(node))
    return F.when(goes_left, tree_value(node.left, low, missing)).otherwise(tree_value(node.right, low, missing))


def leaf_number(node: Node, numbers: dict[int, int], low, missing) -> Column:
    """The number of the open leaf that a row is in; null in leaves that are done."""
    if node.left is None:
        return F.lit(numbers.get(id(node))).cast("int")
    goes_left = F.when(missing(node), F.lit(node.left_missing)).otherwise(low(node))
    return F.when(goes_left, leaf_number(node.left, numbers, low, missing)).otherwise(leaf_number(node.right, numbers, low, missing))


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Values between bins of about equal counts, by feature: at most bins - 1, each a value of the table."""
    shares = [i / bins for i in range(1, bins)]
    fine = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    row = rows.select(*fine).agg(*[F.percentile_approx(f, shares, 100_000).alias(f) for f in features], *[F.max(f).alias("max_" + f) for f in features]).first()
    return [sorted({x for x in (row[f] or []) if x < row["max_" + f]}) for f in features]


def binned(rows: DataFrame, features: list[str], cuts: list[list[float]], label: str) -> DataFrame:
    """codes (the bin of each feature, null if missing), y and n: how many rows with a label have them."""
    edges = [np.array(own) for own in cuts]

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(edges))], axis=1)
            codes = np.stack([np.searchsorted(own, x[:, i]) for i, own in enumerate(edges)], axis=1).astype(np.int16)
            values = pa.array(codes.ravel(), mask=np.isnan(x).ravel())
            yield pa.record_batch([pa.ListArray.from_arrays(np.arange(0, len(values) + 1, len(edges), dtype=np.int32), values), batch.column("y")], ["codes", "y"])

    known = rows.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))
    return known.mapInArrow(run, "codes array<short>, y double").groupBy("codes", "y").agg(F.count("*").alias("n"))


def histograms(rows: DataFrame, leaves: int, features: int, bins: int) -> np.ndarray:
    """Sums of first and second derivatives and of rows by leaf, feature and bin (the last one: missing). rows: leaf, g, h, n, codes.

    Every task adds up its own; as many numbers as leaves * features * (bins + 1) * 3 reach the driver, whatever the rows.
    """

    def run(batches):
        total = np.zeros((3, leaves * features * (bins + 1)))
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, g, h, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "g", "h", "n"))
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, features)
            codes = np.where(np.isnan(codes), bins, codes).astype(np.int64)
            at = ((leaf[:, None] * features + np.arange(features)) * (bins + 1) + codes).ravel()
            for k, w in enumerate((g, h, n)):
                total[k] += np.bincount(at, weights=np.repeat(w, features), minlength=total.shape[1])
        met = np.flatnonzero(total[2])
        yield pa.record_batch([pa.array(met), *(pa.array(t[met]) for t in total)], ["at", "g", "h", "n"])

    found = rows.select("leaf", "g", "h", "n", "codes").mapInArrow(run, "at long, g double, h double, n double").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n"))).toArrow()
    out = np.zeros((3, leaves * features * (bins + 1)))
    at = found.column("at").to_numpy()
    for k, c in enumerate(("g", "h", "n")):
        out[k, at] = found.column(c).to_numpy()
    return out.reshape(3, leaves, features, bins + 1)


def best_split(sums: np.ndarray, l2: float, least: int) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, left_missing) of a leaf's histograms (3, features, bins + 1); of equal gains the first."""
    own = lambda g, h: g * g / (h + l2)
    best = None
    for f in range(sums.shape[1]):
        g, h, n = sums[:, f, :-1].cumsum(1)
        mg, mh, mn = sums[:, f, -1]
        tg, th, tn = g[-1] + mg, h[-1] + mh, n[-1] + mn
        for b in range(sums.shape[2] - 2):
            for left_missing in (True, False) if mn else (bool(n[b] >= tn - n[b]),):
                lg, lh, ln = (x + m * left_missing for x, m in ((g[b], mg), (h[b], mh), (n[b], mn)))
                rg, rh, rn = tg - lg, th - lh, tn - ln
                if min(ln, rn) < max(1, least) or min(lh, rh) < LEAST_H:
                    continue
                gain = round(own(lg, lh) + own(rg, rh) - own(tg, th), DIGITS)
                if gain > LEAST_GAIN and (best is None or gain > best[0]):
                    best = (gain, f, b, left_missing)
    return best


def grown(histogram, cuts: list[list[float]], leaves: int, depth: int, rate: float, l2: float, least: int) -> Node:
    """A tree, level by level; of a level the splits with most gain first, while leaves are left. histogram: from a tree
    and its open leaves their histograms."""
    root = Node()
    open_, n = [root], 1
    for level in range(depth + 1):
        if not open_:
            break
        sums = histogram(root, open_)
        for i, leaf in enumerate(open_):
            g, h = sums[0, i, 0].sum(), sums[1, i, 0].sum()
            leaf.value = -rate * g / (h + l2) if h + l2 else 0.0
        if level == depth:
            break
        found = [(split, i) for i in range(len(open_)) if (split := best_split(sums[:, i], l2, least)) is not None]
        found = sorted(found, key=lambda x: (-x[0][0], x[1]))[: leaves - n]
        n += len(found)
        nxt = []
        for (_, f, b, left_missing), i in sorted(found, key=lambda x: x[1]):
            if b >= len(cuts[f]):
                continue
            leaf = open_[i]
            leaf.feature, leaf.bin, leaf.cut, leaf.left_missing, leaf.left, leaf.right = f, b, cuts[f][b], left_missing, Node(), Node()
            nxt += [leaf.left, leaf.right]
        open_ = nxt
    return root


def fit(rows: DataFrame, features: list[str], label: str, trees: int = 100, bins: int = 64, leaves: int = 31, depth: int = 8, rate: float = 0.1, l2: float = 0.0, least: int = 20) -> Model:
    """Boosted trees for label (0 or 1; rows without one are left out). Missing values (null, NaN) go where they gain more.

    Rows are read and binned once; those of equal bins and label are one row with their number from then on, since all trees
    treat them alike. Scores are written after every few trees; a level of a tree is one pass that moves only sums. Without
    rows, or of one class, no tree is grown.
    """
    cuts = cut_points(rows, features, bins)
    table = stored(binned(rows, features, cuts, label), "binned")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0.0)).alias("y")).first()
    if not total.n or total.y in (0, total.n):
        return Model(features, cuts, 0.0 if not total.n else math.copysign(20.0, total.y - 0.5))
    model = Model(features, cuts, math.log(total.y / (total.n - total.y)))
    code = lambda f: F.get("codes", F.lit(f))
    low, missing = lambda n: code(n.feature) <= n.bin, lambda n: code(n.feature).isNull()
    scored = table.withColumn("score", F.lit(model.base))
    for k in range(trees):
        p = 1 / (1 + F.exp(-F.col("score")))
        now = scored.select("codes", "n", (F.col("n") * (p - F.col("y"))).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))

        def histogram(root: Node, open_: list[Node], now=now) -> np.ndarray:
            numbers = {id(leaf): i for i, leaf in enumerate(open_)}
            return histograms(now.withColumn("leaf", leaf_number(root, numbers, low, missing)).where("leaf IS NOT NULL"), len(open_), len(features), bins)

        tree = grown(histogram, cuts, leaves, depth, rate, l2, least)
        model.trees.append(tree)
        scored = scored.withColumn("score", F.col("score") + tree_value(tree, low, missing))
        if k % KEEP == KEEP - 1 and k + 1 < trees:
            scored = stored(scored, "scored")
    return model


def predicted(rows: DataFrame, model: Model, name: str = "p") -> DataFrame:
    """rows with the probability of label 1: whole-stage code, no Python."""
    value = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in model.features]
    return rows.withColumn(name, 1 / (1 + F.exp(-model.score(lambda f: value[f]))))
