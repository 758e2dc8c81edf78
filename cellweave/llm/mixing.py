"""Operator 9, mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to. Each pattern offers its
words once, twice, ... up to REPEATS times, and each repetition costs more than the one before, so the flow to
the sources' quotas repeats as little as it can. The flow of a pattern is then met by documents, drawn by a seeded
hash: all of them as often as the flow fills whole rounds, and, up to the rest, once more those that in order of
the hash fit what is left. Rows that repeat an id and a text have one hash; as many of them are drawn as fit.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

REPEATS = 3
WEIGHTS = (5, 2, 1)
SEED = 17
#: Hash classes by which the documents of a pattern are summed; only one of them is put in order.
SLICES = 4096
#: Up to so many patterns their bounds are sent to all tasks; beyond, a shuffled join takes its place.
FEW_PATTERNS = 50_000
#: So many of a pattern's next rows, and of all patterns' together, come to the driver at once.
NEXT, NEXT_OF_ALL = 1000, 200_000
#: Up to so many rows drawn beyond the prefixes are sent to all tasks.
MANY_PICKS = 1_000_000


def n_words(text: str | Column = "text") -> Column:
    """Words of a text, runs of other than white space (20, 09 to 0D); null has none."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.translate(marked, " \t\n\x0b\f\r", "")).cast("long")


def quotas(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Targets that share the sum of sizes by weight; one above repeats times its source's size stops there and
    the excess is shared again among the others, until none is above."""
    total, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        rest = total - sum(out.values())
        share = sum(weights[s] for s in open_)
        above = [s for s in open_ if rest * weights[s] / share > repeats * sizes[s]]
        if not above:
            return out | {s: rest * weights[s] / share for s in open_}
        out |= {s: float(repeats * sizes[s]) for s in above}
        open_ -= set(above)
    return out


def by_name(source: str | None) -> tuple[bool, str]:
    """The order of sources, null last."""
    return source is None, source or ""


def parts_of(patterns: list[tuple[frozenset, int]]) -> list[list[int]]:
    """The patterns of each part of the graph: patterns that share a source, or are joined by such, are one part."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for p, _ in patterns:
        first = None
        for s in p:
            if first is None:
                first = find(("s", s))
            root[find(("s", s))] = first
    parts: dict = {}
    for i, (p, _) in enumerate(patterns):
        if p:
            parts.setdefault(find(("s", next(iter(p)))), []).append(i)
    return list(parts.values())


def min_cost_flow(patterns: list[tuple[frozenset, int]], demand: dict, repeats: int = REPEATS, steps: list | None = None) -> list[dict]:
    """Whole words that each pattern (sources, size) sends to each source, at least cost: round k costs k a word.

    Successive shortest paths over the graph of patterns and sources, each part of it by itself; each augmentation fills
    a round of a pattern, a quota, or an edge's flow back. What patterns cannot give stays unmet, as do the parts of
    words in demand. steps: takes the words of every augmentation.
    """
    flow = [dict.fromkeys(sorted(p, key=by_name), 0) for p, _ in patterns]  # in order, so that reruns agree
    for part in parts_of(patterns):
        augment(part, patterns, {s: int(demand[s]) for s in {s for i in part for s in patterns[i][0]}}, flow, repeats, steps)
    return flow


def augment(part: list[int], patterns: list[tuple[frozenset, int]], left: dict, flow: list[dict], repeats: int, steps: list | None) -> None:
    """Fill the flow of a part of the graph; left: the words that its sources want."""
    users: dict = {s: [] for s in left}
    for i in part:
        for s in patterns[i][0]:
            users[s].append(i)
    sent = dict.fromkeys(part, 0)

    def price(i: int) -> int | None:
        size = patterns[i][1]
        return None if not size or sent[i] >= repeats * size else sent[i] // size + 1

    while True:
        best: dict = {}
        heap, order, done, goal = [], 0, set(), None
        for s in sorted(left, key=by_name):
            if left[s] > 0:
                order += 1
                best["s", s] = (0, None)
                heapq.heappush(heap, (0, order, ("s", s)))
        while heap:
            cost, _, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            kind, at = node
            if kind == "end":
                goal = node
                break
            if kind == "s":
                ways = [(("p", i), 0) for i in users[at]]
            else:
                ways = [(("s", s), 0) for s, f in flow[at].items() if f > 0]
                if (p := price(at)) is not None:
                    ways.append((("end", at), p))
            for to, c in ways:
                if to not in done and cost + c < best.get(to, (float("inf"),))[0]:
                    order += 1
                    best[to] = (cost + c, node)
                    heapq.heappush(heap, (cost + c, order, to))
        if goal is None:
            return
        path = [goal]
        while path[-1] is not None:
            path.append(best[path[-1]][1])
        path = path[:-1][::-1]
        last = path[-1][1]
        size = patterns[last][1]
        amount = min((sent[last] // size + 1) * size - sent[last], left[path[0][1]])
        pairs = [(a, b) for a, b in zip(path, path[1:], strict=False) if b[0] != "end"]
        for a, b in pairs:
            if a[0] == "p":
                amount = min(amount, flow[a[1]][b[1]])
        for a, b in pairs:
            if a[0] == "s":
                flow[b[1]][a[1]] += amount
            else:
                flow[a[1]][b[1]] -= amount
        sent[last] += amount
        left[path[0][1]] -= amount
        if steps is not None:
            steps.append(amount)


#: The columns that mix adds.
OWN = ("__size", "__pattern", "__times", "__source_size", "__target")


def with_pattern(docs: DataFrame, sources: Column, id_col: str, text_col: str, seed: int) -> DataFrame:
    """row (all columns of docs, a struct: no name clashes), __size, __pattern (its sources, sorted, as text) and __u, a
    seeded hash of id and text."""
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return docs.select(row.alias("row"), n_words(docs[text_col]).alias("__size"), pattern.alias("__pattern"), F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]).alias("__u"))


def plan(slim: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> dict:
    """For each pattern: size, words to take, and the target of each of its sources. Only sums by pattern reach
    the driver: as many as there are sources and combinations of them, not documents."""
    sums = slim.groupBy("__pattern").agg(F.sum(F.col("__size") * F.col("__k")).alias("n")).collect()
    patterns = sorted(((frozenset(json.loads(r["__pattern"])), r["__pattern"], int(r.n or 0)) for r in sums), key=lambda x: x[1])
    names = sorted({s for p, _, _ in patterns for s in p}, key=by_name)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size = {s: sum(n for p, _, n in patterns if s in p) for s in names}
    target = quotas(size, weight, repeats)
    flow = min_cost_flow([(p, n) for p, _, n in patterns], target, repeats)
    return {text: {"size": n, "take": float(sum(f.values())), "targets": {s: target[s] for s in p}, "sizes": {s: size[s] for s in p}} for (p, text, n), f in zip(patterns, flow, strict=True)}


def fitting(slices: DataFrame, ends: list[tuple]) -> list[tuple]:
    """pattern, __u and number of the rows beyond each pattern's prefix that in hash order fit what is left of its words.

    ends: pattern, slice and __u where its prefix stops (null: before the slice) and words left. Each turn brings the next
    rows that are no longer than what is left, until a pattern has none.
    """
    picked, spark = [], slices.sparkSession
    ends = [x for x in ends if x[3] >= 1]
    while ends:
        n = max(1, min(NEXT, NEXT_OF_ALL // len(ends)))
        at = spark.createDataFrame(ends, "__pattern string, __edge long, __last long, __left double")
        beyond = (F.col("__slice") > F.col("__edge")) | ((F.col("__slice") == F.col("__edge")) & (F.col("__last").isNull() | (F.col("__u") > F.col("__last"))))
        rest = slices.join(F.broadcast(at) if len(ends) <= FEW_PATTERNS else at, "__pattern").where(beyond & (F.col("__size") > 0) & (F.col("__size") <= F.col("__left")))
        order = Window.partitionBy("__pattern").orderBy("__slice", "__u", "__size")
        found = rest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("__pattern", "n", "__slice", "__u", "__size", "__k").collect()
        by: dict = {}
        for x in sorted(found, key=lambda x: x.n):
            by.setdefault(x["__pattern"], []).append(x)
        left = {p: rest for p, _, _, rest in ends}
        for p, own in by.items():
            for x in own:
                if k := min(x["__k"], int(left[p] // x["__size"])):
                    picked.append((p, x["__u"], k))
                    left[p] -= k * x["__size"]
        ends = [(p, own[-1]["__slice"], own[-1]["__u"], left[p]) for p, own in by.items() if len(own) == n and left[p] >= 1]
    return picked


def numbered_ties(rows: DataFrame) -> DataFrame:
    """rows with __nth, from 0, among those of one __pattern and __u, in some order: such rows have equal ids and texts.

    Rows are numbered within each part of the input, after all those of the parts before it, so no task gets all ties.
    Both passes read the input, so that it must be read alike twice.
    """
    parts = rows.withColumn("__part", F.spark_partition_id())
    sums = parts.groupBy("__pattern", "__u", "__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__pattern", "__u").orderBy("__part")) - F.col("n")
    sums = sums.select("__pattern", "__u", "__part", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__pattern", "__u", "__part").orderBy(F.lit(0))) - 1
    return parts.withColumn("__nth", nth).join(sums, ["__pattern", "__u", "__part"]).withColumn("__nth", F.col("__nth") + F.col("__before")).drop("__part", "__before")


def mix(docs: DataFrame, sources: Column | None = None, id_col: str = "doc_id", text_col: str = "text", weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """docs with __size, __pattern, __times (how often the mix takes the row) and __source_size, __target (sums
    over the row's sources). sources: an array of the row's sources; by default the column source alone.

    Every row is taken whole, as often as its pattern's flow has whole rounds, and once more if, in order of a hash of
    seed, id and text, it fits what the rows before it leave of the flow; one that does not is passed over. So
    reruns agree, no row is taken more than repeats times, and no row without an extra time would fit
    what a pattern's words fall short of its flow by. Rows that repeat an id and a text tie: as many of them as fit
    have an extra time, whichever they are.
    A null source is a source, last in order; null and empty texts have size 0 and are taken 0 times.
    Columns of docs with one of the five names give way to them (mixture keeps them). Without rows, none.

    The driver holds one sum for each pattern: sources and their combinations, not documents.
    """
    mixed = mixed_rows(docs, F.array(docs["source"]) if sources is None else sources, id_col, text_col, weights, repeats, seed)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in OWN]
    return mixed.select(*kept, *OWN)


def mixed_rows(docs: DataFrame, sources: Column, id_col: str, text_col: str, weights: tuple, repeats: int, seed: int) -> DataFrame:
    """row (a struct of all columns of docs) and the columns of mix."""
    rows = with_pattern(docs, sources, id_col, text_col, seed)
    slim = stored(rows.groupBy("__pattern", "__u", "__size").agg(F.count("*").alias("__k")), "sizes")
    chosen = plan(slim, weights, repeats)
    spark = docs.sparkSession
    told = [(p, int(x["take"] // x["size"]) if x["size"] else 0, x["take"] - x["size"] * (x["take"] // x["size"]) if x["size"] else 0.0, sum(x["sizes"].values()), sum(x["targets"].values(), 0.0)) for p, x in chosen.items()]
    told = [(p, r if r < repeats else repeats, e if r < repeats else 0.0, s, t) for p, r, e, s, t in told]
    plan_df = spark.createDataFrame(told, "__pattern string, __rounds int, __extra double, __source_size long, __target double")
    slice_ = F.pmod(F.shiftrightunsigned("__u", 20), F.lit(SLICES))
    slices = slim.withColumn("__slice", slice_)
    sums = slices.groupBy("__pattern", "__slice").agg(F.sum(F.col("__size") * F.col("__k")).alias("n"))
    order = Window.partitionBy("__pattern").orderBy("__slice")
    sums = sums.withColumn("before", F.sum("n").over(order) - F.col("n")).join(plan_df.select("__pattern", "__extra"), "__pattern")
    edge = sums.where("before <= __extra AND before + n > __extra")
    inner = Window.partitionBy("__pattern").orderBy("__u", "__size")
    cut = slices.join(edge, ["__pattern", "__slice"]).withColumn("upto", F.col("before") + F.sum(F.col("__size") * F.col("__k")).over(inner))
    cut = cut.where("upto <= __extra").groupBy("__pattern").agg(F.max(F.struct("__u", "upto")).alias("m"))
    ends = edge.join(cut, "__pattern", "left").select("__pattern", F.col("__slice").alias("__edge"), F.col("m.__u").alias("__last"), (F.col("__extra") - F.coalesce("m.upto", "before")).alias("__left"))
    ends = [tuple(x) for x in ends.collect()]
    edges = spark.createDataFrame([x[:3] for x in ends], "__pattern string, __edge long, __last long")
    bounds = plan_df.join(edges, "__pattern", "left")
    joined = rows.join(F.broadcast(bounds) if len(told) <= FEW_PATTERNS else bounds, "__pattern")
    picked = fitting(slices, ends)
    few = spark.createDataFrame(picked, "__pattern string, __u long, __fits long")
    joined = joined.join(F.broadcast(few) if len(picked) <= MANY_PICKS else few, ["__pattern", "__u"], "left")
    tied = slim.where("__k > 1").join(few.withColumnRenamed("__fits", "__some"), ["__pattern", "__u"]).where("__some < __k").select("__pattern", "__u").collect()
    if tied:  # groups of repeated rows of which a part fits
        some = F.broadcast(spark.createDataFrame([tuple(x) for x in tied], "__pattern string, __u long"))
        part = numbered_ties(joined.join(some, ["__pattern", "__u"], "left_semi"))
        part = part.withColumn("__fits", (F.col("__nth") < F.col("__fits")).cast("long")).drop("__nth")
        joined = joined.join(some, ["__pattern", "__u"], "left_anti").unionByName(part)
    more = F.when(F.col("__extra") <= 0, 0).when(F.col("__edge").isNull() | (slice_ < F.col("__edge")), 1).when((slice_ == F.col("__edge")) & (F.col("__u") <= F.col("__last")), 1).otherwise(F.least(F.coalesce("__fits", F.lit(0)), F.lit(1)))
    times = F.when(F.col("__size") == 0, 0).otherwise(F.col("__rounds") + more).cast("long")
    return joined.withColumn("__times", times).select("row", *OWN)


def mixture(docs: DataFrame, sources: Column | None = None, id_col: str = "doc_id", text_col: str = "text", weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns as they are, whatever their names, each as often as the mix takes it (see mix)."""
    taken = mixed_rows(docs, F.array(docs["source"]) if sources is None else sources, id_col, text_col, weights, repeats, seed)
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int"))).alias("copy")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__times") * F.col("__size")).alias("taken"))
