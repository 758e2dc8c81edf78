"""Operators that no join expresses well: Arrow kernels over haloed tiles, or over whole columns and rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.kernel import offset_rows
from cellweave.operators.scoring import spread
from cellweave.sources.shared import stored


def tiles(grid: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each cell in its own tile and in those whose halo it lies in: grid with ty, tx. A tile and its halo are bounded."""
    span = lambda x: F.sequence(F.floor((F.col(x) - halo) / tile).cast("int"), F.floor((F.col(x) + halo) / tile).cast("int"))
    return grid.withColumn("ty", F.explode(span("r"))).withColumn("tx", F.explode(span("c")))


def over_tiles(grid: DataFrame, fn, tile: int, halo: int, fill: float = 0.0, wanted: DataFrame | None = None) -> DataFrame:
    """r, c, x: fn of each tile's dense array (holes filled), read off at the tile's own cells.

    An array ends where the data's bounding box does, so fn sees the border there and treats it as it would that of the
    whole grid; elsewhere it has halo cells more than it needs. With wanted (r, c), its cells alone, and only tiles that
    hold any are made.
    """
    box = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")).first()
    if box.r0 is None:
        return grid.select("r", "c", F.lit(0.0).alias("x"))
    r0, r1, c0, c1 = box.r0, box.r1, box.c0, box.c1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        top, left = max(r0, ty * tile - halo), max(c0, tx * tile - halo)
        down, right = min(r1, (ty + 1) * tile + halo - 1), min(c1, (tx + 1) * tile + halo - 1)
        own = pdf[(pdf.r // tile == ty) & (pdf.c // tile == tx)]
        if down < top or right < left or own.empty:
            return pd.DataFrame({"r": [], "c": [], "x": []})
        a = np.full((down - top + 1, right - left + 1), fill)
        a[pdf.r - top, pdf.c - left] = pdf.v
        return pd.DataFrame({"r": own.r, "c": own.c, "x": fn(a)[own.r - top, own.c - left]})

    dealt = tiles(grid.select("r", "c", F.col("v").cast("double").alias("v")), tile, halo)
    if wanted is None:
        return dealt.groupBy("ty", "tx").applyInPandas(run, "r int, c int, x double")
    asked = wanted.select("r", "c").distinct()
    own = asked.select(F.floor(F.col("r") / tile).cast("int").alias("ty"), F.floor(F.col("c") / tile).cast("int").alias("tx")).distinct()
    return dealt.join(own, ["ty", "tx"], "left_semi").groupBy("ty", "tx").applyInPandas(run, "r int, c int, x double").join(asked, ["r", "c"], "left_semi")


def over_masks(mask: DataFrame, fn, tile: int, halo: int) -> DataFrame:
    """r, c of the cells that fn gives for a mask (r, c) as an array, tile by tile: its cells reach no further than halo.

    Cells move once, not once for each neighbour, and a task holds a tile of them; rows are distinct.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = key[0] * tile - halo, key[1] * tile - halo
        m = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
        m[pdf.r - top, pdf.c - left] = True
        y, x = np.nonzero(fn(m)[halo : halo + tile, halo : halo + tile])
        return pd.DataFrame({"r": (y + top + halo).astype(np.int32), "c": (x + left + halo).astype(np.int32)})

    return tiles(mask.select("r", "c"), tile, halo).groupBy("ty", "tx").applyInPandas(run, "r int, c int")


def grown_mask(m: np.ndarray, offsets) -> np.ndarray:
    """Cells with a cell of m at one of the offsets (y, x)."""
    out, n = np.zeros_like(m), max(max(abs(y), abs(x)) for y, x in offsets)
    wide = np.pad(m, n)
    for y, x in offsets:
        out |= wide[n - y : n - y + m.shape[0], n - x : n - x + m.shape[1]]
    return out


def near_cells(cells: DataFrame, radius: int, positive: bool, tile: int = 128) -> DataFrame:
    """r, c within radius of any of cells (r, c), each once; positive: only nearer than radius. Joins merge them."""
    disk = [(y, x) for y, x, _, k in offset_rows(radius) if k > 0 or not positive]
    return over_masks(cells, lambda m: grown_mask(m, disk), tile, radius).hint("merge")


def closed_square(mask: DataFrame, size: int, tile: int = 128) -> DataFrame:
    """r, c of the mask closed by a square of size cells a side; beyond the grid lies nothing, and a mask grows into it."""
    half = size // 2
    square = [(y, x) for y in range(-half, half + 1) for x in range(-half, half + 1)]
    return over_masks(mask, lambda m: ~grown_mask(~grown_mask(m, square), square), tile, 2 * half)


def gauss(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    n = int(truncate * sigma + 0.5)
    x = np.arange(-n, n + 1)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    return g if order == 0 else -x / sigma**2 * g if order == 1 else (x**2 / sigma**4 - 1 / sigma**2) * g


def along(a: np.ndarray, k: np.ndarray, axis: int, border: str = "edge") -> np.ndarray:
    """The convolution of each line with k; border: as numpy pads lines (edge, symmetric, constant zeros)."""
    return np.apply_along_axis(lambda v: np.convolve(padded(v, len(k) // 2, border), k, mode="valid"), axis, a)


def padded(v: np.ndarray, n: int, border: str) -> np.ndarray:
    while n > len(v) and border == "symmetric":  # a short line is mirrored again and again
        v, n = np.pad(v, len(v), mode=border), n - len(v)
    return np.pad(v, n, mode=border)


def smooth(a: np.ndarray, sigma: float, orders: tuple[int, int] = (0, 0), border: str = "edge", truncate: float = 4.0) -> np.ndarray:
    return along(along(a, gauss(sigma, orders[0], truncate), 0, border), gauss(sigma, orders[1], truncate), 1, border)


#: Weights of a filter up to which sums of shifted arrays are faster than line by line.
WIDEST = 51


def whole_lines(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    """along with mirrored borders, for all lines at once: a sum of shifted arrays, weight by weight, so equal lines stay equal."""
    if len(k) > WIDEST:
        return along(a, k, axis, "symmetric")
    lines = a if axis == 0 else np.ascontiguousarray(a.T)
    n, half = len(lines), len(k) // 2
    at = np.arange(-half, n + half) % (2 * n)
    wide = lines[np.where(at < n, at, 2 * n - 1 - at)]
    out, part = np.zeros_like(lines, float), np.empty(lines.shape)
    for i, weight in enumerate(k[::-1]):
        np.multiply(wide[i : i + n], weight, out=part)
        out += part
    return out if axis == 0 else out.T


def hessian(a: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second derivatives (by rows, mixed, by columns): two first derivatives, each of the image smoothed at sigma over
    the root of 2, with mirrored borders."""
    s = sigma / math.sqrt(2)
    k = [gauss(s, o, 8.0) for o in (0, 1)]
    once = lambda m, down, across: whole_lines(whole_lines(m, k[down], 0), k[across], 1)
    by_row, by_column = once(a, 1, 0), once(a, 0, 1)
    return once(by_row, 1, 0), once(by_row, 0, 1), once(by_column, 0, 1)


def hessian_halo(sigma: float) -> int:
    return 2 * int(8 * sigma / math.sqrt(2) + 0.5)


def eigenvalues(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the symmetric matrices ((a, b), (b, c)), the larger first."""
    mid, rad = (a + c) / 2, np.sqrt(((a - c) / 2) ** 2 + b**2)
    return mid + rad, mid - rad


def ridgeness(a: np.ndarray, sigmas=(1.0, 2.0, 3.0)) -> np.ndarray:
    """Bright ridges over several scales (Sato): the most negative Hessian eigenvalue, scaled and turned, 0 at least."""
    return np.maximum.reduce([np.maximum(0, -eigenvalues(*hessian(a, s))[1]) * s * s for s in sigmas])


def sobel(a: np.ndarray, axis: int) -> np.ndarray:
    """Difference along axis, weights 1, 2, 1 across; beyond the border lies 0."""
    return along(along(a, np.array([1.0, 0.0, -1.0]), axis, "constant"), np.array([1.0, 2.0, 1.0]), 1 - axis, "constant")


def coherence(a: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """How far one direction leads in the structure tensor: the difference of its eigenvalues over their sum, 0 to 1.

    Both come from trace t and determinant d: the root of t * t - 4 * d over t; flat places have none.
    """
    y, x = sobel(a, 0), sobel(a, 1)
    yy, yx, xx = (smooth(m, sigma, border="constant") for m in (y * y, y * x, x * x))
    t, d = yy + xx, yy * xx - yx * yx
    out = np.zeros_like(t)
    np.divide(np.sqrt(np.maximum(t * t - 4 * d, 0)), t, out=out, where=t > 0)
    return np.minimum(out, 1)


def detrended(grid: DataFrame, sigma: float = 50.0, tile: int = 256) -> DataFrame:
    """r, c, x: the value less its Gaussian mean."""
    return over_tiles(grid, lambda a: a - smooth(a, sigma), tile, int(4 * sigma + 0.5))


def vesselness(a: np.ndarray, sigmas=(1.0, 3.0, 5.0, 7.0, 9.0), beta: float = 0.5, gamma: float = 15.0) -> np.ndarray:
    """Dark ridges over several scales (Frangi): not blob-like, and of some structure."""
    out = np.zeros_like(a)
    for s in sigmas:
        both = np.stack(eigenvalues(*hessian(a, s)))
        weak, strong = np.take_along_axis(both, np.abs(both).argsort(0, kind="stable"), 0)
        blob = np.abs(weak) / np.maximum(strong, 1e-10)
        out = np.maximum(out, np.exp(-(blob**2) / (2 * beta**2)) * (1 - np.exp(-(weak**2 + strong**2) / (2 * gamma**2))))
    return out


def vessel_blend(pred: DataFrame, weight: float = 0.4, tile: int = 256) -> DataFrame:
    """r, c, p: (1 - weight) p + weight times the vesselness scaled to the whole grid's range."""
    grid = pred.select("r", "c", F.col("p").alias("v"))
    v = over_tiles(grid, vesselness, tile, hessian_halo(9.0))
    edge = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("x"))
    both = pred.join(v, ["r", "c"]).crossJoin(F.broadcast(edge))
    return both.select("r", "c", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - weight) * F.col("p") + weight * scaled)).alias("p"))


def zhang_suen(mask: np.ndarray, rounds: int) -> np.ndarray:
    """A boolean array after so many rounds of thinning (Zhang and Suen), or as many as change it; beyond it lies nothing."""
    wide = np.pad(mask, 1).astype(np.uint8)
    m = wide[1:-1, 1:-1]
    h, w = m.shape
    for _ in range(rounds):
        before = np.count_nonzero(m)
        for stays in STAYS:
            code = np.zeros((h, w), np.uint8)
            for i, (y, x) in enumerate(RING):
                code |= wide[1 + y : 1 + y + h, 1 + x : 1 + x + w] << i
            m &= stays.take(code)
        if np.count_nonzero(m) == before:
            break
    return m.astype(bool)


#: Neighbours of a cell, clockwise from the one above.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def staying(ends) -> np.ndarray:
    """For each set of neighbours (a bit each, in the order of RING) whether a cell stays; ends: one of each must be empty for it to go."""
    ring = (np.arange(256) >> np.arange(8)[:, None] & 1).astype(bool)
    count, turns = ring.sum(0), (~ring & np.roll(ring, -1, 0)).sum(0)
    free = np.logical_and.reduce([~ring[list(e)].all(0) for e in ends])
    return (~((count >= 2) & (count <= 6) & (turns == 1) & free)).astype(np.uint8)


#: The two halves of a round.
STAYS = [staying(ends) for ends in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6)))]
#: Rounds of thinning that a task does at once; each reaches two cells far.
ROUNDS = 8


def skeleton(mask: DataFrame, key: str, tile: int = 128) -> DataFrame:
    """key, r, c: each key's mask (key, r, c), thinned till nothing changes; what the whole array would give.

    A task does ROUNDS rounds on a tile with a halo that they cannot reach across; then all tiles start from the result.
    """
    halo = 2 * ROUNDS

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, ty, tx = keys
        top, left = ty * tile - halo, tx * tile - halo
        m = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
        m[pdf.r - top, pdf.c - left] = True
        y, x = np.nonzero(zhang_suen(m, ROUNDS)[halo:-halo, halo:-halo])
        return pd.DataFrame({"k": k, "r": (y + top + halo).astype(np.int32), "c": (x + left + halo).astype(np.int32)})

    now = stored(mask.select(F.col(key).cast("int").alias("k"), "r", "c").distinct(), "mask")
    n = now.count()
    while True:
        now = stored(tiles(now, tile, halo).groupBy("k", "ty", "tx").applyInPandas(run, "k int, r int, c int"), "thinned")
        before, n = n, now.count()
        if n == before:
            return now.withColumnRenamed("k", key)


def thin_cover(mask: DataFrame, key: str, radius: int = 3, tile: int = 128) -> DataFrame:
    """key, r, c: cells of each key's mask (key, r, c, p) such that each of its cells has one of them within radius.

    The skeleton, and where it is too far away (in wide blobs) a cell of each small square of the mask that is: the one
    with the greatest p, then the first. No two cells of such a square are further apart than radius. Unlike a greedy
    choice with a budget this covers every cell, and each square by itself.
    """
    own = mask.select(F.col(key).cast("int").alias("of"), "r", "c", "p")
    lines = skeleton(own, "of", tile)
    near = spread(lines, radius, positive=False).select("of", F.col("nr").alias("r"), F.col("nc").alias("c")).distinct()
    side = int(radius / math.sqrt(2)) + 1
    far = own.join(near, ["of", "r", "c"], "left_anti").withColumns({"y": F.floor(F.col("r") / side), "x": F.floor(F.col("c") / side)})
    best = far.groupBy("of", "y", "x").agg(F.min(F.struct((-F.col("p")).alias("p"), "r", "c")).alias("m"))
    return lines.unionByName(best.select("of", F.col("m.r").alias("r"), F.col("m.c").alias("c"))).withColumnRenamed("of", key)


def window_stats(a: np.ndarray, known: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the known cells of each square window, as focal.window_stats defines them: the border
    repeated, 0 where half of a window or more is missing."""
    half = size // 2

    def total(m: np.ndarray) -> np.ndarray:
        wide = np.pad(m, half, mode="edge")
        across = sum(wide[:, i : i + m.shape[1]] for i in range(size))
        return sum(across[i : i + m.shape[0]] for i in range(size))

    v = np.where(known, a, 0.0)
    n, s1, s2 = total(known.astype(float)), total(v), total(v * v)
    enough = n / (size * size) > 0.5
    n = np.where(enough, n, 1.0)
    mean = s1 / n
    std = np.sqrt(np.maximum(0.0, s2 / n - mean * mean))
    return np.where(enough, mean, 0.0), np.where(enough, std, 0.0)


def feature_matrix(grid: DataFrame, bands: dict[str, list[str]], sizes=(5, 11), tile: int = 256) -> DataFrame:
    """r, c and the columns of the model matrix in their order: every band of grid (r, c, bands); ridge_b of the bands under
    ridge; coher_b of those under coher; mean5_b, std5_b, mean11_b, std11_b of those under window. Null where the band is.

    A missing value counts as 0 while a filter passes over it. The grid is written once and its cells move once, with the
    halo of the widest filter; a task makes all columns of a tile. Tiles beyond the grid's bounding box are not made.
    """
    own = [c for c in grid.columns if c not in ("r", "c")]
    made = [(prefix, b, fn) for prefix, fn in (("ridge", ridgeness), ("coher", coherence)) for b in bands.get(prefix, [])]
    windows = bands.get("window", [])
    names = [f"{prefix}_{b}" for prefix, b, _ in made] + [f"{what}{n}_{b}" for b in windows for n in sizes for what in ("mean", "std")]
    used = list(dict.fromkeys([b for _, b, _ in made] + windows))
    halo = max([hessian_halo(3.0)] * bool(bands.get("ridge")) + [8] * bool(bands.get("coher")) + [n // 2 for n in sizes] * bool(windows), default=0)
    grid = stored(grid.where("r IS NOT NULL AND c IS NOT NULL"), "grid")
    box = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")).first()
    r0, r1, c0, c1 = box

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ty, tx = (x.as_py() for x in key)
        top, left = max(r0, ty * tile - halo), max(c0, tx * tile - halo)
        shape = min(r1, (ty + 1) * tile + halo - 1) - top + 1, min(c1, (tx + 1) * tile + halo - 1) - left + 1
        y, x = table.column("r").to_numpy() - top, table.column("c").to_numpy() - left
        arrays, known = {}, {}
        for i, b in enumerate(used):
            column = table.column(f"u{i}")
            arrays[b], known[b] = np.zeros(shape), np.zeros(shape, bool)
            arrays[b][y, x] = column.fill_null(0.0).to_numpy()
            known[b][y, x] = column.is_valid().to_numpy()
        found = [(b, fn(arrays[b])) for _, b, fn in made] + [(b, m) for b in windows for n in sizes for m in window_stats(arrays[b], known[b], n)]
        mine = table.column("own").is_valid().to_numpy()
        y, x, rest = y[mine], x[mine], table.filter(pa.array(mine)).select(["r", "c", "own"])
        for name, (b, m) in zip(names, found, strict=True):
            rest = rest.append_column(name, pa.array(m[y, x], mask=~known[b][y, x]))
        return rest

    def span(x: str, low: int | None, high: int | None):
        at = lambda shift, edge, pick: pick(F.floor((F.col(x) + shift) / tile), F.floor(F.lit(edge) / tile)).cast("int")
        return F.sequence(at(-halo, low, F.greatest), at(halo, high, F.least))

    dealt = grid.select("r", "c", *[F.col(b).cast("double").alias(f"u{i}") for i, b in enumerate(used)], F.struct(*own).alias("own"))
    dealt = dealt.withColumn("ty", F.explode(span("r", r0, r1))).withColumn("tx", F.explode(span("c", c0, c1)))
    inside = (F.floor(F.col("r") / tile) == F.col("ty")) & (F.floor(F.col("c") / tile) == F.col("tx"))
    dealt = dealt.withColumn("own", F.when(inside, F.col("own")))
    kinds = T.StructType([*(dealt.schema[x] for x in ("r", "c", "own")), *(T.StructField(x, T.DoubleType()) for x in names)])
    return dealt.groupBy("ty", "tx").applyInArrow(run, kinds).select("r", "c", "own.*", *names)
