"""Operator 5, exact n-gram Jaccard join by a token-group matrix.

Texts with equal shingle sets are one class. Classes that could link at all are found by counting which of their
shingles any other text has (counting.py). Their shingles are ordered by rarity; two linked classes share one of
their rarest ones (the prefix). Similar classes form groups of bounded size: a class goes with the class of its
prefix's shingles that has the fewest shingles of its own (their pivot). A row of the matrix holds a group: the
union of its shingles, and its members as places in that union. A query class is sent to groups with which its
prefix says that it may share enough; there its overlap with the union bounds what it can share with any member, and
only a group that reaches the query's bound is opened. All links come out of opened groups.

Queries go out twice: first each class to its own group and to its pivots' groups, which links most near copies; then,
where a shingle is met by classes of several components, those of the smaller ones to all groups with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.components import components

from . import counting
from .common import map_arrow, passes, stored, table
from .row_map import RowMap, bit_of, hits, keyed
from .words import grams, raw_texts, word_hashes

SHINGLE = 5
#: Percent of the union that two linked sets share at least.
PERCENT = 80
#: Text that one pass packs together; shingles of a group of classes, and of the queries that a task sends to one.
PACK_BYTES = 2 << 20
GROUP_SHINGLES = 1 << 15
QUERY_SHINGLES = 1 << 16


def need(n, percent: int):
    """Shingles that a set of n shares with any set that it links to, at least."""
    return -(-percent * n // 100)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without none."""
    raw, ends = raw_texts(column)
    words, counts = word_hashes(raw, ends, fold=True)
    every, out, start = grams(words, size), [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(every[start : start + n - size + 1]))
        else:
            out.append(grams(words[start : start + n], n) if n else words[:0])
        start += n
    return out


def class_key(s: np.ndarray) -> tuple[int, int]:
    """A hash of a set, of 128 bits: equal ones are equal sets."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(raw, np.int64).tolist())


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all sets end to end, and the set of each."""
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def packed_sets(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """Texts (k1, k2, id, text) by packs (PACKS): their rows as arrays, and what the pack asks of each bucket. known: the number
    of shingles of a set that another set of the pack has too. Written once: rows and requests are of one reading."""

    def one(batch: pa.RecordBatch):
        for part in passes(batch, "text", PACK_BYTES):
            sets = shingle_sets(part.column("text"), size)
            k1, k2 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            name, (tokens, owner) = counting.pack_id(k1, k2), flat(sets)
            keys = counting.Keys(tokens, buckets)
            asks = counting.requests(name, len(sets), keys, owner=owner)
            known = np.bincount(owner[keys.others()], minlength=len(sets)).tolist()
            c = [class_key(s) for s in sets]
            own = {"pack": name, "ids": part.column("id").to_pylist(), "k1": k1.tolist(), "k2": k2.tolist(), "c1": [x for x, _ in c], "c2": [x for _, x in c], "sizes": [len(s) for s in sets], "known": known}
            own |= {f: asks.column(f).to_pylist() for f in ASKS}
            yield pa.RecordBatch.from_pylist([own], PACKS)

    whole = "pack long, ids array<long>, k1 array<long>, k2 array<long>, c1 array<long>, c2 array<long>, sizes array<int>, known array<int>"
    return map_arrow(rows, whole + ", bucket array<int>, asked array<int>, keys array<binary>, counts array<binary>", one)


#: What a pack asks, by bucket.
ASKS = ("bucket", "asked", "keys", "counts")
ROWS = [("pack", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids", "k1", "k2", "c1", "c2")), *((c, pa.list_(pa.int32())) for c in ("sizes", "known"))]
PACKS = pa.schema([*ROWS, ("bucket", pa.list_(pa.int32())), ("asked", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])
JUDGED = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()), ("may", pa.bool_())])


def asked_of(packs: DataFrame) -> DataFrame:
    """The packs' requests, a row for each bucket."""
    each = packs.select("pack", F.size("sizes").alias("size"), F.explode(F.arrays_zip(*ASKS)).alias("x"))
    return each.select("pack", "size", *(f"x.{c}" for c in ASKS), F.lit(None).cast("binary").alias("times"))


def judged(packs: DataFrame, replies: DataFrame, percent: int) -> DataFrame:
    """Every row's id, k1, k2, class (c1, c2), n, and may: whether any other text has enough of its shingles.

    A pack whose buckets have not all answered is an error: its rows would lose links.
    """

    def one(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            if sorted(r["bucket"] or []) != sorted(r["buckets"] or []):
                raise RuntimeError("a pack lacks answers")
            sizes, met = np.array(r["sizes"]), np.array(r["known"], np.int64)
            for x in r["answers"] or []:
                met = met + counting.unpacked(x, len(sizes))
            may = (sizes > 0) & (met >= need(sizes, percent))
            columns = [r["ids"], r["k1"], r["k2"], r["c1"], r["c2"], r["sizes"], may.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, JUDGED, strict=True)], schema=JUDGED)

    own = packs.drop("asked", "keys", "counts")
    return map_arrow(own.join(replies, "pack", "left"), "id long, k1 long, k2 long, c1 long, c2 long, n int, may boolean", one)


def class_sets(rows: DataFrame, found: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """c, n, tokens (sorted shingles) of each candidate class, once."""
    sent = RowMap(found.select("k1", "k2")).sent

    def run(batches):
        seen = set()
        for batch in batches:
            for part in passes(batch.filter(pa.array(hits(sent.value, batch))), "text"):
                out = []
                for s in shingle_sets(part.column("text"), size):
                    c = class_key(s)
                    if len(s) and c not in seen:
                        seen.add(c)
                        out.append({"c1": c[0], "c2": c[1], "n": len(s), "tokens": s.tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, SETS)

    sets = rows.select("text", bit_of().alias("__bit")).mapInArrow(run, "c1 long, c2 long, n int, tokens binary")
    return sets.join(classes, ["c1", "c2"]).groupBy("c").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


SETS = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """h, c, own: the rarest shingles of each class, as many as must hold one that it shares with a linked class.

    own: the share of its shingles that no other class has. Shingles are ordered by count, then hash.
    """
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = counting.bucket_count(sets.sparkSession, total)

    def in_packs(batch: pa.RecordBatch):
        for part in passes(batch, "tokens", PACK_BYTES):
            own = [np.frombuffer(t, np.uint64) for t in part.column("tokens").to_pylist()]
            yield part, own, counting.pack_id(part.column("c").to_numpy(zero_copy_only=False))

    def ask(batch: pa.RecordBatch):
        for _, own, name in in_packs(batch):
            yield counting.requests(name, len(own), counting.Keys(flat(own)[0], buckets), totals=True)

    def keep(batch: pa.RecordBatch):
        for part, own, name in in_packs(batch):
            yield pa.record_batch([pa.array([name], pa.int64()), pa.array([part.column("c").to_pylist()], pa.list_(pa.int64())), pa.array([[x.tobytes() for x in own]], pa.list_(pa.binary()))], ["pack", "cs", "sets"])

    def choose(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            sets = [np.frombuffer(t, np.uint64) for t in r["sets"]]
            keys = counting.Keys(flat(sets)[0], buckets)
            sizes = np.bincount(keys.bucket)
            if np.flatnonzero(sizes).tolist() != (r["buckets"] or []):
                raise RuntimeError("a pack lacks answers")
            totals = np.concatenate([counting.unpacked(x, int(sizes[b])) for b, x in zip(r["buckets"], r["answers"], strict=True)])
            met = np.empty(len(keys.order), np.uint32)
            met[keys.order] = totals[keys.run]
            hs, cs, owns, stop = [], [], [], 0
            for c, s in zip(r["cs"], sets, strict=True):
                part, stop = met[stop : stop + len(s)], stop + len(s)
                shared = part > 1
                left = len(s) - need(len(s), percent) + 1 - int((~shared).sum())
                if left > 0:
                    h, n = s[shared], part[shared]
                    h = h[np.lexsort((h, n))[:left]]
                    hs.append(h)
                    cs.append(np.full(len(h), c))
                    owns.append(np.full(len(h), 1 - shared.mean()))
            if hs:
                yield pa.record_batch([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(owns))], ["h", "c", "own"])

    replies = counting.answers(map_arrow(sets, counting.ASKED, ask), "totals")
    packs = map_arrow(sets, "pack long, cs array<long>, sets array<binary>", keep)
    return map_arrow(packs.join(replies, "pack", "left"), "h long, c long, own double", choose)


def grouped(prefix: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """meets (h, c, pivot) for shingles that prefixes of several classes hold, and members (c, n, g): the group of each.

    A shingle's pivot is the class with the least share of own shingles; a group's classes have one pivot, and
    as many groups share a pivot as its classes' shingles need.
    """
    pivots = prefix.groupBy("h").agg(F.min(F.struct("own", "c")).alias("p"), F.count("*").alias("k")).where("k > 1")
    pivots = stored(pivots.select("h", F.col("p.c").alias("pivot"), F.col("p.own").alias("rank")), "pivots")
    meets = stored(prefix.select("h", "c").join(pivots, "h"), "meets")
    top = meets.groupBy("c").agg(F.min(F.struct("rank", "pivot")).alias("top")).select("c", F.col("top.pivot").alias("pivot"))
    top = stored(top.join(sets.select("c", "n"), "c"), "tops")
    parts = stored(top.groupBy("pivot").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("long").alias("m")), "sizes")
    return meets.select("h", "c", "pivot"), stored(top.join(parts, "pivot").select("c", "n", F.xxhash64("pivot", F.pmod(F.xxhash64("c"), "m")).alias("g")), "members")


def matrix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each group: g, union (its sorted shingles), cs, sizes, places (of all members' shingles in the union)."""

    def one(t: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        tokens = np.concatenate(own)
        union = np.unique(tokens)
        row = {"g": t.column("g")[0].as_py(), "union": union.tobytes(), "cs": t.column("c").to_pylist(), "sizes": [len(x) for x in own], "places": np.searchsorted(union, tokens).astype(np.uint32).tobytes()}
        return pa.Table.from_pylist([row], MATRIX)

    return members.select("c", "g").join(sets.select("c", "tokens"), "c").groupBy("g").applyInArrow(one, "g long, union binary, cs array<long>, sizes array<int>, places binary")


MATRIX = pa.schema([("g", pa.int64()), ("union", pa.binary()), ("cs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def opened(queries: list[tuple[int, np.ndarray]], union: np.ndarray, cs: np.ndarray, sizes: np.ndarray, places: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between queries (class, sorted shingles) and a group's members, as a forest: a link of two classes that
    links found here before already join is left out. A query whose overlap with the union is too small opens nothing."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    starts, out = np.cumsum(sizes) - sizes, []
    for c, q in queries:
        where = np.searchsorted(union, q)
        inside = where[union[np.minimum(where, len(union) - 1)] == q]
        if len(inside) < need(len(q), percent):
            continue
        mark = np.zeros(len(union), np.int64)
        mark[inside] = 1
        both = np.add.reduceat(mark[places], starts)
        for other in cs[(100 * both >= percent * (len(q) + sizes - both)) & (cs != c)].tolist():
            a, b = find(c), find(other)
            if a != b:
                root[a] = b
                out.append((c, other))
    return out


def links(asked: DataFrame, members: DataFrame, sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that queries asked (c, g) find in their groups. rows: the matrix.

    Pairs whose sizes exclude a link go first. The queries of a group are dealt out by parts of bounded size.
    """
    span = members.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    fit = asked.join(members.select("c", "n"), "c").join(span, "g").where((F.col("n") * 100 >= F.col("lo") * percent) & (F.col("hi") * 100 >= F.col("n") * percent))
    fit = stored(fit.select("g", "c", "n"), "asked")
    parts = stored(fit.groupBy("g").agg(F.ceil(F.sum("n") / QUERY_SHINGLES).cast("int").alias("m")), "parts")
    queries = fit.select("g", "c").join(parts, "g").select("g", "c", F.pmod(F.xxhash64("c"), "m").cast("int").alias("part")).join(sets.select("c", "tokens"), "c")
    theirs = rows.join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).drop("m")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return LINKS.empty_table()
        own = [(c, np.frombuffer(x, np.uint64)) for c, x in zip(left.column("c").to_pylist(), left.column("tokens").to_pylist(), strict=True)]
        r = right.slice(0, 1).to_pylist()[0]
        found = opened(own, np.frombuffer(r["union"], np.uint64), np.array(r["cs"], np.int64), np.array(r["sizes"], np.int64), np.frombuffer(r["places"], np.uint32), percent)
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=LINKS)

    return queries.groupBy("g", "part").cogroup(theirs.groupBy("g", "part")).applyInArrow(pair, "a long, b long")


def still_open(meets: DataFrame, members: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """Queries (c, g) beyond those asked, where a shingle is met by classes of several known components (node, root).

    At each such shingle the classes of the component that most of its classes are of ask nothing; the others ask
    every group with the shingle that has a class of another component. So each two classes of two components meet.
    """
    labels = members.select("c", "g").join(known.select(F.col("node").alias("c"), "root"), "c", "left").select("c", "g", F.coalesce("root", "c").alias("label"))
    rows = stored(meets.select("h", "c").join(labels, "c"), "labelled")
    several = stored(rows.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h"), "several")
    rows = stored(rows.join(several, "h"), "mixed")
    by_label = rows.groupBy("h", "label").agg(F.count("*").alias("k"))
    most = stored(by_label.groupBy("h").agg(F.max(F.struct("k", "label")).alias("m")).select("h", F.col("m.label").alias("most")), "most")
    askers = rows.join(most, "h").where("label <> most").select("h", "c", "label")
    groups = stored(rows.groupBy("h", "g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "met_groups")
    pairs = askers.join(groups, "h").where("NOT (lo = hi AND lo = label)").select("c", "g").distinct()
    return pairs.join(asked, ["c", "g"], "left_anti")


def linked_rows(rows: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """near_duplicates by row, for rows (id, text, k1, k2): id, k1, k2, n, c1 (of the class), component_id."""
    spark = rows.sparkSession
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = counting.bucket_count(spark, chars // 6)
    packs = stored(packed_sets(rows, shingle, buckets), "packs")
    every = stored(judged(packs, counting.answers(asked_of(packs), "sets"), percent), "judged")
    found = every.where("may")
    classes = stored(found.select("c1", "c2").distinct().select("c1", "c2", F.monotonically_increasing_id().alias("c")), "classes")
    sets = stored(class_sets(rows, found, classes, shingle), "sets")
    meets, members = grouped(stored(prefixes(sets, percent), "prefixes"), sets)
    groups = stored(matrix(members, sets), "matrix")
    first = members.select("c", "g").unionByName(meets.select("c", F.col("pivot").alias("p")).distinct().join(members.select(F.col("c").alias("p"), "g"), "p").select("c", "g")).distinct()
    first = stored(first, "first")
    known = components(links(first, members, sets, groups, percent))
    rest = links(still_open(meets, members, known, first), members, sets, groups, percent)
    roots = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))
    rooted = found.join(classes, ["c1", "c2"]).join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted = stored(rooted.select("id", "k1", "k2", "n", "c1", "root"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    whole = rooted.join(least, "root").select("id", "k1", "k2", "n", "c1", "component_id")
    return whole.unionByName(every.where("NOT may").select("id", "k1", "k2", "n", "c1", F.col("id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components of texts that link: id_col, n_shingles, class_id (64 bits of a hash of the set), component_id.

    Two texts link if 100 times their common shingles are at least percent times those of either. The id
    of a component is the least id of its rows. Texts without words (null, empty) link with nothing. Rows with
    a null id take part and have the component of their text, null if none of its rows has an id; repeated
    rows stay. Ids are whole numbers; other columns are not read; a table without rows gives none.
    """
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    rows = keyed(own, "id", "text").select("k1", "k2", "row.id", F.coalesce("row.text", F.lit("")).alias("text"))
    found = linked_rows(rows, shingle, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("c1").alias("class_id"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns as they are, whatever their names, but only those with the least id of each component.

    Of rows that repeat that id and text one stays. Texts without words stay, as do all texts of a component without
    any id. Texts move only where a bitmap of fixed size says that their row may go.
    """
    whole = keyed(docs, id_col, text_col)
    rows = whole.select("k1", "k2", F.col("row").getField(id_col).cast("long").alias("id"), F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text"))
    rows = linked_rows(rows, shingle, percent).where("n > 0")
    goes = rows.where("NOT (id <=> component_id)").select("k1", "k2").distinct()
    again = rows.where("id <=> component_id").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    found = stored(goes.withColumn("goes", F.lit(True)).unionByName(again.withColumn("goes", F.lit(False))), "goes")
    stay, some = RowMap(found.select("k1", "k2")).split(whole)
    left = some.join(found, ["k1", "k2"], "left").where("NOT coalesce(goes, false)")
    single = left.where("goes IS NULL").select("row.*")
    return stay.select("row.*").unionByName(single).unionByName(left.where("goes IS NOT NULL").dropDuplicates(["k1", "k2"]).select("row.*"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
