"""Operator 2, exact inner-product search over norm-sorted vectors.

Vectors are sorted by length, longest first, and cut into slabs; all are rotated to the axes of their second-moment
matrix (SVD), so that the leading coordinates hold most of each product. Slabs are met in rounds, each GROWTH times as
many as the round before: after a round every query's floor is its k-th score so far. A query goes only to rounds and
slabs whose longest vector can reach its floor (Cauchy-Schwarz), and within a slab only candidates count whose partial
sum plus the product of what is left of both lengths can. Products that count are of whole numbers, so exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 20
#: Vectors of a slab, queries of a block; a task holds one of each at a time. Slabs of a round over those of the one before.
SLAB = 8192
QUERIES = 2048
GROWTH = 4
#: Queries that one product of matrices takes, and leading coordinates after which bounds are tested.
STEP = 256
LEADS = (16, 32)
LAST_ID = (1 << 63) - 1
#: What rounding may take from a bound.
LOOSE = 1e-6


def scaled(vectors: DataFrame, id_col: str, vector_col: str, factor: int, width: int, kind: str = "long") -> DataFrame:
    """id (of a kind), v (whole components), norm2. Vectors of another width, null ones and such with parts that are
    null or not finite are left out; so are rows without an id."""
    x = F.col("x")
    d = vectors.select(vectors[id_col].cast(kind).alias("id"), vectors[vector_col].alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    d = d.where((F.size(x) == width) & fine)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * factor).cast("double"))
    return d.select("id", whole.alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))


def narrow(rows: DataFrame) -> DataFrame:
    """rows with v as small numbers (s) where they allow it, else as doubles (d)."""
    fits = F.forall("v", lambda x: F.abs(x) < 1 << 15)
    others = [c for c in rows.columns if c != "v"]
    return rows.select(*others, F.when(fits, F.col("v").cast("array<short>")).alias("s"), F.when(~fits, F.col("v")).alias("d"))


def vectors_of(t: pa.Table, width: int) -> np.ndarray:
    out = np.zeros((t.num_rows, width))
    for name in ("s", "d"):
        column = t.column(name).combine_chunks()
        out[~column.is_null().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def second_moments(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of v v' over all rows: width * width numbers from each task."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                m = vectors_of(pa.Table.from_batches([batch]), width)
                total += m.T @ m
        yield pa.record_batch([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(width * width)
    for r in rows.select("s", "d").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(width, width)


def rotation(moments: np.ndarray) -> np.ndarray:
    """Axes of the second moments, largest first."""
    return np.linalg.svd(moments)[0]


NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best_of(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, ids: np.ndarray, v: np.ndarray, axes: np.ndarray, k: int):
    """For each query its k best candidates of those that can still reach its floor: rows of (query, id, score).

    A score equal to the floor counts for ids below floor_id; ties go to the smaller id.
    """
    if not len(q) or not len(v):
        return NOTHING
    length, longest = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(length > 0, floor / length, np.where(floor > 0, np.inf, -np.inf)).min()
    near = longest * (1 + 1e-9) + LOOSE >= least
    ids, v, longest = ids[near], v[near], longest[near]
    qr, vr = q @ axes, v @ axes
    slack = LOOSE * (1 + length[:, None] * longest[None, :])
    partial, at = np.zeros((len(q), len(v))), 0
    for lead in LEADS:
        if not len(ids):
            return NOTHING
        partial += qr[:, at:lead] @ vr[:, at:lead].T
        at = min(lead, q.shape[1])
        q_rest, v_rest = (np.sqrt(np.maximum(0, (m[:, at:] ** 2).sum(1))) for m in (qr, vr))
        bound = partial + q_rest[:, None] * v_rest[None, :] + slack
        open_ = (bound >= floor[:, None]).any(0)
        bound, partial, slack, ids, v, vr = bound[:, open_], partial[:, open_], slack[:, open_], ids[open_], v[open_], vr[open_]
    if not len(ids):
        return NOTHING
    order = np.argsort(ids, kind="stable")
    ids, v, bound = ids[order], v[order], bound[:, order]
    score = np.where(bound >= floor[:, None], np.rint(q @ v.T), -np.inf)
    score[q_ids[:, None] == ids[None, :]] = -np.inf
    top = np.argsort(-score, axis=1, kind="stable")[:, :k] if score.shape[1] <= 4 * k else partial_top(score, k)
    rows = np.repeat(np.arange(len(q)), top.shape[1])
    got = score[rows, top.ravel()]
    own = ids[top.ravel()]
    keep = np.isfinite(got) & ((got > floor[rows]) | ((got == floor[rows]) & (own < floor_id[rows])))
    return q_ids[rows[keep]], own[keep], got[keep]


def partial_top(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row; of equal ones the first."""
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    out = np.empty((len(score), k), np.int64)
    for i, (row, t) in enumerate(zip(score, least, strict=True)):
        above = np.flatnonzero(row > t)
        level = np.flatnonzero(row == t)[: k - len(above)]
        at = np.concatenate([above, level])
        out[i] = at[np.lexsort((at, -row[at]))]
    return out


def in_ranges(df: DataFrame, count: int, name: str, *order) -> DataFrame:
    """df, written, with the number (name) of the range of order that a row lies in, of count ranges of about equal size.

    Sorted partitions make the ranges, however many the session deals rows to.
    """
    cut = df.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id())
    cut = stored(cut, name)
    parts = (cut.agg(F.max("part").alias("n")).first().n or 0) + 1
    return cut.withColumn(name, F.floor(F.col("part") * min(count, parts) / parts).cast("int")).drop("part")


def reached(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """block and the last slab (last) whose longest vector reaches the block's least need.

    blocks: block, need; tops: slab, m. Both are summaries, a row for thousands of vectors, put in one order.
    """
    both = tops.select(F.col("m").alias("x"), F.col("slab"), F.lit(None).cast("int").alias("block"))
    both = both.unionByName(blocks.select(F.col("need").alias("x"), F.lit(None).cast("int").alias("slab"), "block"))
    before = Window.orderBy(F.desc("x"), F.asc_nulls_last("slab")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.max("slab").over(before)).where("block IS NOT NULL AND last IS NOT NULL").select("block", "last")


def scan(asked: DataFrame, slabs: DataFrame, pairs: DataFrame, axes: np.ndarray, width: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the queries of blocks against the slabs that pairs (block, slab) name; each pair is a
    group of bounded size."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return OUT.empty_table()
        ids, v, found = right.column("id").to_numpy(), vectors_of(right, width), []
        for at in range(0, left.num_rows, STEP):
            own = left.slice(at, STEP)
            found.append(best_of(own.column("id").to_numpy(), vectors_of(own, width), own.column("floor").to_numpy(), own.column("floor_id").to_numpy(), ids, v, axes, k))
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.array(a), pa.array(b), pa.array(s.astype(np.int64))], schema=OUT)

    mine = asked.join(pairs, "block").select("slab", "block", "id", "s", "d", "floor", "floor_id")
    theirs = slabs.join(pairs, "slab").select("slab", "block", "id", "s", "d")
    return mine.groupBy("slab", "block").cogroup(theirs.groupBy("slab", "block")).applyInArrow(pair, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query, width: int, factor: int = 64, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score (integer inner products).

    Components count as floor(factor * x); products are exact up to 2**53. Queries are the rows for which is_query (a
    condition on id) holds, candidates all rows but those with the query's own id; ties go to the smaller id; fewer than k
    if there are not more. Null vectors, other widths (they have no product with the rest) and parts that are null or not
    finite take no part, nor do null ids; rows that repeat an id are each a candidate of the others, and one query, by
    the least vector. Other columns are not read. Without rows, none.
    """
    rows = scaled(vectors, id_col, vector_col, factor, width)
    rows = stored(narrow(rows), "vectors")
    slabs = max(1, -(-rows.count() // SLAB))
    axes = rotation(second_moments(rows, width))
    slabbed = in_ranges(rows.withColumn("row", F.monotonically_increasing_id()), slabs, "slab", F.desc("norm2"), F.asc("id"), F.asc("row")).drop("row")
    tops = stored(slabbed.groupBy("slab").agg((F.sqrt(F.max("norm2")) * (1 + 1e-9) + LOOSE).alias("m")), "tops")
    queries = slabbed.where(is_query).groupBy("id").agg(F.min(F.struct("s", "d", "norm2")).alias("q"))
    queries = stored(queries.select("id", "q.s", "q.d", "q.norm2"), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    last = slabbed.agg(F.max("slab").alias("n")).first().n
    best, start, n = None, 0, 1
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    while last is not None and start <= last:
        own = F.col("slab").between(start, start + n - 1)
        floors = {"floor": F.lit(float("-inf")), "floor_id": F.lit(LAST_ID)}
        asked = queries
        if best is not None:
            full = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"), F.col("vec_id").alias("floor_id"))
            asked = queries.join(full, "id", "left")
            floors = {c: F.coalesce(c, x) for c, x in floors.items()}
        asked = asked.withColumns(floors)
        need = F.when(F.col("norm2") > 0, F.col("floor") / F.sqrt("norm2")).when(F.col("floor") > 0, float("inf")).otherwise(float("-inf"))
        asked = asked.withColumn("need", need).drop("norm2")
        longest = tops.where(own).agg(F.max("m").alias("m")).first().m
        if longest is not None:
            asked = in_ranges(asked.where(F.col("need") <= longest), blocks, "block", F.asc("need"), F.asc("id"))
            if asked.isEmpty():  # nor will it reach the shorter vectors of later rounds
                break
            by_block = reached(asked.groupBy("block").agg(F.min("need").alias("need")), tops.where(own))
            pairs = stored(by_block.select("block", F.explode(F.sequence(F.lit(start), "last")).alias("slab")), "pairs")
            found = scan(asked, slabbed.where(own), pairs, axes, width, k)
            found = found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)
            best = stored(found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), "best")
        start, n = start + n, n * GROWTH
    if best is None:
        best = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.expr("id % 20 = 0"), 64)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, 64), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
