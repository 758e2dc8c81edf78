"""Operator 13, hard negatives by threshold joins over an inverted index of the anchors.

Anchors form waves of bounded size. A wave is indexed by dimension: dimensions are taken in order of their energy in the
whole table, and an anchor is posted for the leading ones alone, as many as leave a suffix whose norm, times the
longest row's, lies below the anchor's threshold. No row can reach the threshold by omitted dimensions only. Rows
stream past the index, nothing of them moves: postings add up partial scores, and after every few dimensions a pair
whose partial score plus the product of both remaining norms is below the threshold goes. What is left is scored
exactly, in whole numbers.

First the positives of each anchor are sought, then the rows within its windows. Each search starts at a high
threshold and is done again at lower ones by those anchors that have not enough, the last at one that covers all
that counts. A task keeps no more rows of an anchor than the answer may have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, stored, table
from .topk import LOOSE, narrow, scaled, second_moments, vectors_of

#: Anchors of a wave, which is sent to all tasks: at most WAVE * (8 * width + 130) bytes, 11 MB at 64 dimensions.
WAVE = 1 << 14
#: Rows and anchors that meet in one matrix, and dimensions between two tests of the bounds.
ROWS, ANCHORS, GROUP = 2048, 512, 16
#: Share of pairs below which they are scored one by one.
SPARSE = 0.05
POSITIVES, NEGATIVES = 5, 10
#: Thresholds of the searches: of the product of lengths for positives, of a window's upper end for negatives.
POSITIVE_STEPS = (0.5, 0.25)
NEGATIVE_STEPS = (0.8, 0.55)
#: Percent of a positive's score between which a negative's lies.
WINDOW = (30, 90)

FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "anchor long, slot int, id long, row long, score long"


class Index:
    """Anchors with thresholds, by dimension: for each group of dimensions those that are posted there.

    vectors: a row for each anchor, dimensions in order of energy; longest: the greatest length of a row.
    """

    def __init__(self, vectors: np.ndarray, least: np.ndarray, longest: float):
        squares = np.cumsum(vectors[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate([squares, np.zeros((len(vectors), 1))], axis=1))  # rest[:, j]: norm of dimensions j and on
        reach = self.rest * longest * (1 + 1e-9) + LOOSE
        #: Dimensions that an anchor is posted for: the suffix from there on cannot reach the threshold by itself.
        self.posted = (reach >= least[:, None]).sum(1).clip(0, vectors.shape[1])
        self.order = np.argsort(-self.posted, kind="stable")
        self.vectors, self.least, self.posted, self.rest = vectors[self.order], least[self.order], self.posted[self.order], self.rest[self.order]
        self.width = vectors.shape[1]

    def parts(self):
        """Slices of the anchors, those with most postings first."""
        for start in range(0, len(self.order), ANCHORS):
            yield slice(start, min(start + ANCHORS, len(self.order)))

    def reaching(self, rows: np.ndarray, own: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (row, place of an anchor in order) whose product is at least the anchor's threshold, and the products."""
        least, posted, vectors, rest = self.least[own], self.posted[own], self.vectors[own], self.rest[own]
        row_rest = np.sqrt(np.concatenate([np.cumsum(rows[:, ::-1] ** 2, axis=1)[:, ::-1], np.zeros((len(rows), 1))], axis=1))
        partial = np.zeros((len(rows), len(vectors)))
        alive_rows, at = np.arange(len(rows)), 0
        open_ = np.ones(partial.shape, bool)
        while at < self.width:
            stop = min(at + GROUP, self.width)
            n = int((posted > at).sum())  # anchors are in order of their postings
            if not n:
                break
            values = vectors[:n, at:stop] * (np.arange(at, stop) < posted[:n, None])
            partial[:, :n] += rows[alive_rows, at:stop] @ values.T
            # an anchor's omitted dimensions are part of what is left
            left = np.minimum(stop, posted)
            bound = partial + row_rest[alive_rows][:, left] * rest[np.arange(len(vectors)), left] * (1 + 1e-9) + LOOSE
            open_ &= bound >= least
            keep = open_.any(1)
            alive_rows, partial, open_ = alive_rows[keep], partial[keep], open_[keep]
            if not len(alive_rows) or open_.mean() < SPARSE:
                break
            at = stop
        i, j = np.nonzero(open_)
        i = alive_rows[i]
        if len(i) < SPARSE * len(rows) * len(vectors):
            score = np.concatenate([np.einsum("ij,ij->i", rows[i[k : k + 65536]], vectors[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        else:
            score = (rows @ vectors.T)[i, j]
        fine = score >= least[j]
        return i[fine], j[fine] + own.start, score[fine]


def leading(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each anchor: higher scores first, then smaller ids, then smaller rows."""
    order = np.lexsort((rows, ids, -score, anchor))
    a = anchor[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[place < k]


class Best:
    """The k best rows of each (anchor, slot) so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.held = k, [[np.zeros(0, np.int64)] * 4 for _ in range(slots)]
        self.fresh = [[[] for _ in range(4)] for _ in range(slots)]
        self.waiting = 0

    def add(self, slot: int, anchor, score, ids, rows) -> None:
        top = leading(anchor, score, ids, rows, self.k)
        for column, x in zip(self.fresh[slot], (anchor, score, ids, rows), strict=True):
            column.append(x[top])
        self.waiting += len(top)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        for s, fresh in enumerate(self.fresh):
            columns = [np.concatenate([h, *f]) for h, f in zip(self.held[s], fresh, strict=True)]
            top = leading(*columns, self.k)
            self.held[s], self.fresh[s] = [c[top] for c in columns], [[] for _ in range(4)]
        self.waiting = 0

    def batches(self, numbers: np.ndarray):
        self.settle()
        for s, (anchor, score, ids, rows) in enumerate(self.held):
            if len(anchor):
                yield pa.record_batch([pa.array(numbers[anchor]), pa.array(np.full(len(anchor), s, np.int32)), pa.array(ids), pa.array(rows), pa.array(score.astype(np.int64))], schema=FOUND)


def met(rows: DataFrame, wave: dict, longest: float, order: np.ndarray, negatives: bool, k: int) -> DataFrame:
    """anchor (its row), slot, id, row, score: rows that reach their anchor's threshold, the k best of each slot by task.

    wave: number, label, vectors (in order), least and, for negatives, lo and hi of each slot, by anchor.
    """
    sent = rows.sparkSession.sparkContext.broadcast(wave)
    width = len(order)
    slots = wave["lo"].shape[1] if negatives else 1

    def run(batches):
        w = sent.value
        index, best = Index(w["vectors"], w["least"], longest), Best(slots, k)
        number, label = w["number"][index.order], w["label"][index.order]
        lo, hi = (w["lo"][index.order], w["hi"][index.order]) if negatives else (None, None)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                t = pa.Table.from_batches([batch.slice(start, ROWS)])
                v = vectors_of(t, width)[:, order]
                ids, own_row, own_label = (t.column(c).to_numpy() for c in ("id", "row", "label"))
                for part in index.parts():
                    i, j, score = index.reaching(v, part)
                    same = own_label[i] == label[j]
                    if not negatives:
                        keep = same & (own_row[i] != number[j])
                        best.add(0, j[keep], score[keep], ids[i[keep]], own_row[i[keep]])
                        continue
                    i, j, score = i[~same], j[~same], score[~same]
                    for s in range(slots):
                        keep = (score >= lo[j, s]) & (score <= hi[j, s])
                        best.add(s, j[keep], score[keep], ids[i[keep]], own_row[i[keep]])
        yield from best.batches(number)
        release()

    return rows.select("id", "row", "label", "s", "d").mapInArrow(run, FOUND_SQL)


def top_of(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def wave_of(anchors: DataFrame, number: int, order: np.ndarray) -> dict:
    """The anchors of a wave as arrays; at most about WAVE of them."""
    t = anchors.where(F.col("wave") == number).select("row", "label", "s", "d").toArrow()
    return {"number": t.column("row").to_numpy(), "label": t.column("label").to_numpy(), "vectors": vectors_of(t, len(order))[:, order]}


def some(wave: dict, chosen: np.ndarray) -> dict:
    return {c: x[chosen] for c, x in wave.items()}


def positives_of(rows: DataFrame, wave: dict, longest: float, order: np.ndarray, k: int) -> DataFrame | None:
    """The k best rows of the same label of every anchor of the wave."""
    length, whole = np.linalg.norm(wave["vectors"], axis=1), None
    for step in (*POSITIVE_STEPS, None):
        least = np.full(len(length), -np.inf) if step is None else length * longest * step
        found = stored(top_of(met(rows, wave | {"least": least}, longest, order, False, k), k), "positives")
        full = {r.anchor for r in found.where(F.col("rank") == k).select("anchor").collect()} if step is not None else None
        open_ = np.array([x not in full for x in wave["number"].tolist()], bool) if full is not None else np.zeros(len(length), bool)
        done = found if full is None else found.join(found.where(F.col("rank") == k).select("anchor"), "anchor", "left_semi")
        whole = done if whole is None else whole.unionByName(done)
        if not open_.any():
            break
        wave, length = some(wave, open_), length[open_]
    return whole


def negatives_of(rows: DataFrame, wave: dict, scores: np.ndarray, longest: float, order: np.ndarray, k: int, window: tuple[int, int]) -> DataFrame:
    """The k best rows of another label within each anchor's windows (slot: which of its positives).

    scores: of the anchor's positives, a column for each, nan where there is none.
    """
    low, high = (np.where(np.isnan(scores), 0, scores).astype(np.int64) * p for p in window)
    lo, hi = -(-low // 100), high // 100
    lo = np.where(np.isnan(scores), 1, lo)
    hi = np.where(np.isnan(scores), 0, hi)
    whole = None
    for step in (*NEGATIVE_STEPS, None):
        real = lo <= hi
        used = real.any(1)
        if not used.any():
            break
        wave, lo, hi, real = some(wave, used), lo[used], hi[used], real[used]
        floor = np.where(real, lo, np.inf).min(1)
        least = floor if step is None else np.maximum(floor, np.where(real, hi, np.inf).min(1) * step)
        found = stored(top_of(met(rows, wave | {"least": least.astype(float), "lo": lo, "hi": hi}, longest, order, True, k), k), "negatives")
        place = {x: i for i, x in enumerate(wave["number"].tolist())}
        full = np.zeros(lo.shape, bool)
        full[least <= floor] = True
        for r in found.where(F.col("rank") == k).select("anchor", "slot").collect():
            full[place[r.anchor], r.slot] = True
        # a window that lacks rows is sought again from the start at the lower threshold: its rows so far do not count
        again = rows.sparkSession.createDataFrame([(wave["number"][i].item(), int(s)) for i, s in zip(*np.nonzero(~full & real), strict=True)], "anchor long, slot int")
        done = found if (full | ~real).all() else found.join(stored(again, "again"), ["anchor", "slot"], "left_anti")
        whole = done if whole is None else whole.unionByName(done)
        lo = np.where(full, 1, lo)
        hi = np.where(full, 0, hi)
    return whole


def mine(
    vectors: DataFrame, is_anchor, width: int, factor: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label=None
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of whole components floor(factor * x), exact up to 2**53. Anchors are the rows for which
    is_anchor (a condition on id) holds; their positives the best other rows of their label; the negatives of a positive
    the best rows of other labels with a score between window percent of the positive's. Ties go to the smaller id; rows
    that repeat an id are rows of their own, as anchors too. label: an expression over id and label in its place.
    Rows with a null id, label or vector, with a component that is null or not finite, or of another width take no part.
    Other columns are not read. Without anchors, positives or rows within a window, no rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].alias("vector"))
    known = own.where("label IS NOT NULL AND id IS NOT NULL").select("id", (label if label is not None else F.col("label")).alias("label"), "vector")
    whole = scaled(known.select(F.struct("id", "label").alias("key"), "vector"), "key", "vector", factor, width, "struct<id:bigint,label:bigint>")
    rows = stored(narrow(whole.select("id.id", "id.label", "v", "norm2")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(is_anchor)
    waves = max(1, -(-anchors.count() * 5 // (WAVE * 4)))  # by a hash: a wave has four fifths of WAVE on average
    anchors = stored(anchors.withColumn("wave", F.pmod(F.xxhash64("row"), F.lit(waves))), "anchors")
    longest = float(np.sqrt(rows.agg(F.coalesce(F.max("norm2"), F.lit(0.0)).alias("x")).first().x))
    order = np.argsort(-np.diag(second_moments(rows, width)), kind="stable")
    found, mates = None, None
    for number in range(waves):
        wave = wave_of(anchors, number, order)
        if not len(wave["number"]):
            continue
        best = positives_of(rows, wave, longest, order, positives).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        best = stored(best, "mates")
        scores = np.full((len(wave["number"]), positives), np.nan)
        place = {x: i for i, x in enumerate(wave["number"].tolist())}
        for r in best.collect():
            scores[place[r.anchor], r.slot] = r.positive_score
        got = negatives_of(rows, wave, scores, longest, order, negatives, window)
        mates = best if mates is None else mates.unionByName(best)
        if got is not None:
            found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = found.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(mates, ["anchor", "slot"])
    named = named.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.expr("id % 100 = 0"), 64, label=moved)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(generate_series(1, 64), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r
), p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS k FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id, s.cr) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score WHERE p.k <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
