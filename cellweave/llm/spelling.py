"""Operator 12, spelling variants by k-d trees over letter counts.

A word is a point: how often it has each letter. One replaced letter moves it by one up and one down (an L1 distance of
two), one more letter by one up. So near words are sought by pairs of lengths: each length with itself and with the next.
Words of a length form a k-d tree whose upper part, fitted to a bounded sample, deals them to leaves; a word visits the
leaves whose box it can reach with what one edit may move it by. A leaf is searched by one task: its own tree goes down
to small buckets, and what meets there is compared letter by letter. Leaves with many words or visitors are dealt
to several tasks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
#: Words of a leaf, about; the sample that the upper trees are fitted to, of all lengths together.
LEAF_WORDS = 1 << 14
SAMPLE_WORDS = 1 << 16
#: The least sample that a leaf is made for.
LEAF_SAMPLE = 24
#: Points and visitors of a leaf that one task takes; points of a bucket, pairs that are compared at once.
POINTS, VISITORS = 1 << 16, 1 << 17
BUCKET, PAIRS = 24, 1 << 18

#: How far a near point lies up and down: for words of one length, and for a point that has one letter more.
SAME, LONGER = (1, 1), (1, 0)


def words_of(docs: DataFrame, id_col: str, text_col: str, least: int, every: int) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased; a run whose check sum (of id and run) every divides has lost a letter."""
    low = F.translate(docs[text_col], UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    k = F.expr("int(h % length(run))")
    less = F.concat(F.expr("substring(run, 1, int(h % length(run)))"), F.col("run").substr(k + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def codes_of(words: list[str], size: int) -> np.ndarray:
    """The letters of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, size)


@functools.cache
def place_of_letter() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[np.frombuffer(LETTERS.encode("latin-1"), np.uint8)] = np.arange(len(LETTERS))
    return out


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """A row for each word: how often it has each of LETTERS."""
    n, width = len(codes), len(LETTERS)
    if not n:
        return np.zeros((0, width), np.int32)
    at = np.arange(n)[:, None] * width + place_of_letter()[codes]
    return np.bincount(at.ravel(), minlength=n * width).reshape(n, width).astype(np.int32)


def split_of(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter with the widest spread and its median: points with more of it go right. None if all points are alike."""
    spread = counts.var(axis=0)
    for letter in np.argsort(-spread, kind="stable").tolist():
        if not spread[letter]:
            return None
        own = np.sort(counts[:, letter])
        middle = own[(len(own) - 1) // 2]
        cut = int(middle) if middle < own[-1] else int(own[own < middle][-1])
        return letter, cut
    return None


class Tree:
    """The upper part of a length's k-d tree: letter and cut of each node, leaves numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaves = 0
        self.root = self.grown(sample, leaves)

    def grown(self, sample: np.ndarray, leaves: int):
        found = split_of(sample) if leaves > 1 and len(sample) >= 2 * LEAF_SAMPLE else None
        if found is None:
            self.leaves += 1
            return self.leaves - 1
        letter, cut = found
        right = sample[:, letter] > cut
        more = min(leaves - 1, max(1, round(leaves * right.mean())))
        return letter, cut, self.grown(sample[~right], leaves - more), self.grown(sample[right], more)


ONE_LEAF = 0


def reached(root, counts: np.ndarray, reach: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, leaf): the leaves of a tree whose boxes a word reaches by going up and down by so much at most."""
    words, leaves = [], []
    zero = np.zeros(len(counts), np.int32)
    stack = [(root, np.arange(len(counts)), zero, zero, {})]
    while stack:
        node, own, up, down, box = stack.pop()
        if not len(own):
            continue
        if isinstance(node, int):
            words.append(own)
            leaves.append(np.full(len(own), node))
            continue
        letter, cut, left, right = node
        for child, side in ((left, 0), (right, 1)):
            stack.append((child, *entered(counts, own, up, down, box, letter, cut, side, reach)))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(leaves)


def entered(counts, own, up, down, box, letter: int, cut: int, side: int, reach: tuple[int, int]):
    """Those of own that reach the box of a child, how far each has to go up and down for it, and the box."""
    low, high = box.get(letter, (0, 1 << 30))
    have = counts[own, letter]
    if side:
        up = up + np.maximum(0, cut + 1 - have) - np.maximum(0, low - have)
        low = cut + 1
    else:
        down = down + np.maximum(0, have - cut) - np.maximum(0, have - high)
        high = cut
    keep = (up <= reach[0]) & (down <= reach[1])
    return own[keep], up[keep], down[keep], box | {letter: (low, high)}


def near_of(points: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point, visitor) one edit apart, of all points and visitors; a visitor has as many letters or one less."""
    n, size = points.shape
    less = visitors.shape[1] < size
    found = []
    step = max(1, PAIRS // max(1, n))
    for at in range(0, len(visitors), step):
        own = visitors[at : at + step]
        if less:
            ahead = points[:, None, :-1] != own[None]
            behind = (points[:, None, 1:] != own[None])[:, :, ::-1]
            first = np.where(ahead.any(2), ahead.argmax(2), size - 1)
            last = np.where(behind.any(2), behind.argmax(2), size - 1)
            ok = first + last >= size - 1
        else:
            ok = (points[:, None] != own[None]).sum(2) == 1
        i, j = np.nonzero(ok)
        found.append((i, j + at))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def range_search(points: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point, visitor) one edit apart, by a k-d tree of the points that visitors descend."""
    reach = LONGER if visitors.shape[1] < points.shape[1] else SAME
    p_counts, v_counts = letter_counts(points), letter_counts(visitors)
    zero = np.zeros(len(visitors), np.int32)
    stack, found = [(np.arange(len(points)), np.arange(len(visitors)), zero, zero, {})], []
    while stack:
        own, guests, up, down, box = stack.pop()
        if not len(own) or not len(guests):
            continue
        split = split_of(p_counts[own]) if len(own) > BUCKET and len(own) * len(guests) > 2048 else None
        if split is None:
            i, j = near_of(points[own], visitors[guests])
            found.append((own[i], guests[j]))
            continue
        letter, cut = split
        right = p_counts[own, letter] > cut
        for side, part in ((0, own[~right]), (1, own[right])):
            stack.append((part, *entered(v_counts, guests, up, down, box, letter, cut, side, reach)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Kinds of rows at a leaf: a word that lies there, the same as a visitor of its own leaf, visitors of its length, shorter ones.
POINT, OWN, PEER, SHORT = 0, 1, 2, 3
VISITS = pa.schema([("size", pa.int32()), ("leaf", pa.int32()), ("kind", pa.int8()), ("word", pa.string()), ("n", pa.int64())])
VISITS_SQL = "size int, leaf int, kind byte, word string, n long"


def visits(words: DataFrame, trees: dict) -> DataFrame:
    """A row for each leaf that a word lies in or visits. Of two leaves of a length the words of the left one visit the right."""

    def run(batches):
        for batch in batches:
            texts = np.array(batch.column("word").to_pylist(), dtype=object)
            n = batch.column("n").to_numpy()
            sizes = np.array([len(t) for t in texts], np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own_texts = texts[at]
                counts = letter_counts(codes_of(own_texts.tolist(), size))
                home = np.zeros(len(at), np.int64)
                w, leaf = reached(trees.get(size, ONE_LEAF), counts, (0, 0))
                home[w] = leaf
                every = np.arange(len(at))
                parts = [(size, POINT, every, home), (size, OWN, every, home)]
                w, leaf = reached(trees.get(size, ONE_LEAF), counts, SAME)
                later = leaf > home[w]
                parts.append((size, PEER, w[later], leaf[later]))
                parts.append((size + 1, SHORT, *reached(trees.get(size + 1, ONE_LEAF), counts, LONGER)))
                for to, kind, w, leaf in parts:
                    if len(w):
                        columns = [np.full(len(w), to, np.int32), leaf.astype(np.int32), np.full(len(w), kind, np.int8), own_texts[w], n[at][w]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, VISITS, strict=True)], schema=VISITS)

    return words.select("word", "n").mapInArrow(run, VISITS_SQL)


HITS = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def best_near(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """For each word that has near ones (pairs a, b of places): their number, and the most frequent one, ties to the smaller."""
    a, b = np.r_[a, b], np.r_[b, a]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    how = np.diff(np.r_[first, len(a)])
    return pa.table([pa.array([words[i] for i in a[first].tolist()], pa.string()), pa.array(how, pa.int64()), pa.array(n[b[first]], pa.int64()), pa.array([words[i] for i in b[first].tolist()], pa.string())], schema=HITS)


def at_leaf(t: pa.Table) -> pa.Table:
    """The near words that meet at a leaf: a row for each word that has some there."""
    kind, words, n = t.column("kind").to_numpy(), t.column("word").to_pylist(), t.column("n").to_numpy()
    size = t.column("size")[0].as_py()
    points = np.flatnonzero(kind == POINT)
    if not len(points):
        return HITS.empty_table()
    lying = codes_of([words[i] for i in points.tolist()], size)
    firsts, seconds = [], []
    for k in (OWN, PEER, SHORT):
        guests = np.flatnonzero(kind == k)
        if not len(guests):
            continue
        i, j = range_search(lying, codes_of([words[g] for g in guests.tolist()], size - (k == SHORT)))
        i, j = points[i], guests[j]
        if k == OWN:  # each pair once; both are at home here
            once = np.array([words[x] < words[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            i, j = i[once], j[once]
        firsts.append(i)
        seconds.append(j)
    if not firsts:
        return HITS.empty_table()
    # a word is at its leaf twice, as a point and as a visitor: one place stands for both
    place: dict[str, int] = {}
    at = np.array([place.setdefault(w, i) for i, w in enumerate(words)])
    return best_near(words, n, at[np.concatenate(firsts)], at[np.concatenate(seconds)])


def upper_trees(words: DataFrame) -> dict:
    """The tree of each length that has more words than a leaf takes."""
    sizes = words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("k")).where(F.col("k") > LEAF_WORDS).collect()
    total = sum(r.k for r in sizes)
    if not total:
        return {}
    share = min(1.0, SAMPLE_WORDS / total)
    chosen = words.where(F.length("word").isin([r["size"] for r in sizes]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("word").toArrow()
    by_size: dict[int, list[str]] = {}
    for w in sorted(chosen.column("word").to_pylist()):
        by_size.setdefault(len(w), []).append(w)
    return {r["size"]: Tree(letter_counts(codes_of(by_size.get(r["size"], []), r["size"])), -(-r.k // LEAF_WORDS)).root for r in sizes}


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form: of each word that has near ones, how many, and the most frequent of them with its count."""
    found = stored(visits(words, upper_trees(words)), "visits")
    point = F.col("kind") == POINT
    parts = found.groupBy("size", "leaf").agg(F.ceil(F.count(F.when(point, 1)) / POINTS).cast("int").alias("mp"), F.ceil(F.count(F.when(~point, 1)) / VISITORS).cast("int").alias("mv"))
    parts = stored(parts.where("mp > 0 AND mv > 0"), "leaves")
    dealt = found.join(parts, ["size", "leaf"])
    own, every = F.pmod(F.xxhash64("word"), F.lit(1 << 30)), F.lit(0)
    p = F.when(point, F.array((own % F.col("mp")).cast("int"))).otherwise(F.sequence(every, F.col("mp") - 1))
    v = F.when(point, F.sequence(every, F.col("mv") - 1)).otherwise(F.array((own % F.col("mv")).cast("int")))
    dealt = dealt.select("size", "leaf", "kind", "word", "n", F.explode(p).alias("p"), "mv", v.alias("v")).select("size", "leaf", "kind", "word", "n", "p", F.explode("v").alias("v"))
    hits = dealt.groupBy("size", "leaf", "p", "v").applyInArrow(lambda t: at_leaf(t), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("b")
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form), by doubling. Chains are short: counts grow tenfold a step."""
    whole = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = whole.select(F.col("word").alias("root"), F.col("root").alias("next"))
        whole = stored(whole.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if whole.where("moved").isEmpty():
            return whole.select("word", "root")
        whole = whole.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31, seen: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least least letters that the texts have at least seen times.

    A run of letters (A-Z lower-cased) whose crc32 of `<id>:<run>` is divisible by every has lost the letter at that
    number modulo its length; a null id is empty there. Near words differ by one letter put in, left out or replaced; the form of a word is its most frequent near
    one, ties to the smaller, if that is times as frequent at least, else null; root is where forms lead, the word itself
    if it has none. Null and empty texts have no words; repeated rows count each; other columns are not read; a
    table without rows gives none.
    """
    words = stored(words_of(docs, id_col, text_col, least, every).where(F.col("n") >= seen), "words")
    near = words.join(near_words(words), "word", "left")
    has = F.col("form_n") >= times * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "near")
    roots = rooted(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE t AS (
  SELECT list_transform(generate_series(0, 255), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), x AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM r WHERE length(run) >= 7
), h AS (
  SELECT run, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(generate_series(1, length(b), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(b, i, 1)) - 1) + instr('0123456789ABCDEF', substr(b, i + 1, 1)) - 1 AS BIGINT))),
    lambda c, y: xor(c >> 8, crc[CAST(xor(c & 255, y) AS INTEGER) + 1])), 4294967295) AS h FROM x, t
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM h
), words AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN words b ON a.cut = b.word
), best AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n FROM pairs GROUP BY word
), top AS (SELECT p.word, min(near) AS form FROM pairs p JOIN best b ON p.word = b.word AND p.near_n = b.form_n GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN t.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN top t ON w.word = t.word
), chain AS (
  SELECT word, word AS root, form AS nxt FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.nxt = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.nxt IS NULL
"""
