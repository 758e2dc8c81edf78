"""Operator 11, language-model scores by context-tree weighting of binary-decomposed bytes.

A text counts as its lower-cased words, each with a space behind it, and an end byte. A byte is eight binary decisions, each
named by the bits before it. Each decision has a tree of contexts, the last DEPTH bytes, most recent first: a node's
Krichevsky-Trofimov estimate is mixed, half and half, with the product of its children's mixtures. A bit's probability, given
all that the trees learnt, is then a mixture of the estimates along its context's path, the weight of each node
being the posterior of the tree ending there. Nodes are one for each context that the training texts have: the
model grows with them, and no context is hashed away: a context and its next byte are a whole number of 8 * (DEPTH + 1) bits.

Texts are packed once (written). A pack asks each shard, a set of contexts of TOP bytes, what its grams get, each once and told
how often the training texts of the pack have it; shards are of a fixed number, so a row's size does not shrink
as the corpus grows, and a shard holds its distinct grams alone while packs stream past. Shards give the nodes
at TOP contexts to one small tree above them (at most 255 nodes for each of 65 536 contexts), which every task gets.
Words of the base score are counted the same way.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, passes, release, stored, table
from .counting import partitions
from .words import raw_texts, word_hashes

#: Bytes of context, six at most; bytes of it that name a shard.
DEPTH, TOP = 6, 3
#: Shards of grams, and of words behind them. Fixed: what a pack sends each does not shrink as packs grow in number.
SHARDS = 512
#: Text of a pack, and bytes that one pass of numpy looks at.
PACK_BYTES, STEP = 8 << 20, 1 << 22
SPACE, END = 0x20, 0x0A
HALF = math.log(0.5)
#: The key of the end token among words.
END_KEY = np.uint64(0)

PACKS = pa.schema(
    [("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("blob", pa.binary()), ("sizes", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))]
    + [("shard", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))]
)
PACKS_SQL = "pack long, ids array<long>, blob binary, sizes array<long>, held array<boolean>, shard array<int>, n array<int>, keys array<binary>, counts array<binary>"
#: What a pack asks, by shard.
ASKS = ("shard", "n", "keys", "counts")
#: A request, or a shard.
ASKED = pa.schema([("shard", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ASKED_SQL = "shard int, pack long, n int, keys binary, counts binary"


def compressed(raw: bytes) -> bytes:
    return pa.Codec("zstd", 4).compress(raw, asbytes=True)


def rounded(x: np.ndarray) -> np.ndarray:
    """x as floats of 16 significant bits, the nearest: their last byte is nothing."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def squeezed(x: np.ndarray) -> bytes:
    """An array of numbers as bytes, like places together, compressed."""
    return compressed(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def restored(raw: bytes, n: int, kind=np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their steps."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(restored(raw, n), dtype=np.uint64)


@functools.cache
def seen_bytes() -> np.ndarray:
    """A-Z as a-z, all white space as spaces."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[9:14] = SPACE
    return out


def plain_bytes(raw: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as the model sees them, and how long each is: depth end bytes of context, words with a space
    behind each (A-Z lower-cased), an end byte."""
    n = len(ends)
    sizes = np.diff(np.r_[0, ends]) + depth + 2
    out = np.full(int(sizes.sum()), END, np.uint8)
    starts = np.cumsum(sizes) - sizes
    body = np.ones(len(out), bool)
    for k in (*range(depth), -2, -1):
        body[(starts if k >= 0 else starts + sizes) + k] = False
    out[body] = seen_bytes()[raw]
    out[starts + sizes - 2] = SPACE
    keep = out != SPACE
    keep[1:] |= (out[:-1] != SPACE) & (out[:-1] != END)
    return out[keep], np.add.reduceat(keep.astype(np.int64), starts) if n else np.zeros(0, np.int64)


def grams(part: np.ndarray, depth: int) -> np.ndarray:
    """A number for each byte from part[depth] on: its context, most recent byte first, then the byte."""
    n = len(part) - depth
    key = np.zeros(max(0, n), np.uint64)
    for back in range(1, depth + 1):
        key = (key << np.uint64(8)) | part[depth - back : depth - back + n]
    return (key << np.uint64(8)) | part[depth:]


def scored(sizes: np.ndarray, depth: int) -> np.ndarray:
    """Which bytes of a pack have a score: all but the context that each text begins with."""
    out = np.ones(int(sizes.sum()), bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(depth):
        out[starts + k] = False
    return out


def stretches(blob: np.ndarray, sizes: np.ndarray, depth: int, texts: int = 1 << 30):
    """Parts of a pack, of so many texts at most: the numbers of the bytes that are scored, the text of each less the
    first, and the first."""
    ok, ends = scored(sizes, depth), np.cumsum(sizes)
    for first in range(0, len(sizes), texts):
        own = sizes[first : first + texts]
        begin, end = int(ends[first] - sizes[first]), int(ends[first + len(own) - 1])
        owner = np.repeat(np.arange(len(own), dtype=np.uint64), own)
        for start in range(begin + depth, end, STEP):
            stop = min(end, start + STEP)
            keep = ok[start:stop]
            yield grams(blob[start - depth : stop], depth)[keep], owner[start - begin : stop - begin][keep], first


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def shard_of(keys: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """The shard of a gram: a hash of the TOP most recent bytes of its context."""
    top = keys >> np.uint64(8 * (depth + 1 - TOP))
    with np.errstate(over="ignore"):
        return (((top * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def word_keys(blob: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token, the end of a text being END_KEY, and the text of each."""
    hashes, per_text = word_hashes(blob, np.cumsum(sizes))
    owner = np.repeat(np.arange(len(sizes)), per_text)
    return np.r_[hashes, np.full(len(sizes), END_KEY)], np.r_[owner, np.arange(len(sizes))]


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array(row["sizes"], np.int64)
    blob = np.frombuffer(pa.decompress(row["blob"], int(sizes.sum()), "zstd", asbytes=True), np.uint8)
    return blob, sizes, np.array(row["held"], bool)


def distinct(blob: np.ndarray, sizes: np.ndarray, held: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a pack, sorted, and how often its training texts have each (0 where only others do)."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    train = (~held).astype(np.uint64)
    for k, owner, first in stretches(blob, sizes, depth):
        k = (k << np.uint64(1)) | train[first:][owner]  # a gram has 56 bits
        k.sort()
        new = np.flatnonzero(np.r_[True, (k[1:] ^ k[:-1]) > 1]) if len(k) else np.zeros(0, np.int64)
        keys.append(k[new] >> np.uint64(1))
        counts.append(np.add.reduceat((k & np.uint64(1)).astype(np.int64), new) if len(k) else np.zeros(0, np.int64))
    return summed(keys, counts)


def grams_by_text(blob: np.ndarray, sizes: np.ndarray, depth: int):
    """The distinct grams of a pack, and parts of it: the grams of each part, sorted, how many times it has each, and
    the texts in that order. A part has 256 texts at most: a gram and a text are one number."""
    parts, every = [], [np.zeros(0, np.uint64)]
    for k, owner, first in stretches(blob, sizes, depth, 256):
        k = (k << np.uint64(8)) | owner
        k.sort()
        gram = k >> np.uint64(8)
        new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(k) else np.zeros(0, np.int64)
        parts.append((gram[new], np.diff(np.r_[new, len(k)]), (k & np.uint64(255)).astype(np.uint8), first))
        every.append(gram[new])
    return np.unique(np.concatenate(every)), parts


def log_sums(keys: np.ndarray, logs: np.ndarray, parts: list, texts: int) -> np.ndarray:
    """The sum of the logs of each text's grams; keys: those of the pack, sorted."""
    out = np.zeros(texts)
    for gram, times, owner, first in parts:
        found = np.bincount(owner, weights=np.repeat(logs[np.searchsorted(keys, gram)].astype(float), times))
        out[first : first + len(found)] += found
    return out


def in_shards(keys: np.ndarray, depth: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by shard, and where in it each shard ends."""
    shard = shard_of(keys, depth, shards)
    return np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))


def requests(blob: np.ndarray, sizes: np.ndarray, held: np.ndarray, depth: int, shards: int) -> dict[str, list]:
    """The grams and words of a pack by shard; those of words come behind those of grams."""
    out: dict[str, list] = {c: [] for c in ASKS}
    for words in (False, True):
        if words:
            w, owner = word_keys(blob, sizes)
            keys, counts = summed([w], [(~held[owner]).astype(np.int64)])
            shard = (keys % np.uint64(shards)).astype(np.int64)
            order, ends = np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))
        else:
            keys, counts = distinct(blob, sizes, held, depth)
            order, ends = in_shards(keys, depth, shards)
        keys, counts = keys[order], counts[order]
        for s, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if b > a:
                for c, x in zip(ASKS, (s + shards * words, b - a, packed_keys(keys[a:b]), squeezed(counts[a:b])), strict=True):
                    out[c].append(x)
    return out


def texts_of(docs: DataFrame, id_col: str, text_col: str, depth: int, every: int, shards: int) -> DataFrame:
    """PACKS: what the model sees of some texts, and what they ask of each shard, as one row."""

    def one(batch: pa.RecordBatch):
        for part in passes(batch, "text", PACK_BYTES):
            blob, sizes = plain_bytes(*raw_texts(part.column("text")), depth)
            ids = part.column("id").to_pylist()
            held = [i is None or zlib.crc32(str(i).encode()) % every == 0 for i in ids]
            raw = blob.tobytes()
            name = int.from_bytes(hashlib.blake2b(repr(ids).encode() + raw, digest_size=8).digest(), "little", signed=True)
            row = {"pack": name, "ids": ids, "blob": compressed(raw), "sizes": sizes.tolist(), "held": held}
            yield pa.RecordBatch.from_pylist([row | requests(blob, sizes, np.array(held, bool), depth, shards)], PACKS)

    own = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return map_arrow(own, PACKS_SQL, one)


def asked_of(packs: DataFrame) -> DataFrame:
    """The packs' requests, a row for each shard (ASKED)."""
    each = packs.select("pack", F.explode(F.arrays_zip(*ASKS)).alias("x"))
    return each.select("x.shard", "pack", "x.n", "x.keys", "x.counts")


class Sums:
    """Counts by key of a shard; what comes is merged in ever larger runs, so memory follows the distinct keys."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((keys, counts))
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            self.merge()

    def merge(self) -> None:
        (a, b), (c, d) = self.runs.pop(), self.runs.pop()
        self.runs.append(summed([c, a], [d, b]))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.runs) > 1:
            self.merge()
        return self.runs[0]


def by_shard(df: DataFrame, *then: str) -> DataFrame:
    parts = partitions(df.sparkSession)
    return df.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", *then)


def rows_of(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in ("shard", "pack", "n", "keys", "counts")), strict=True)


def model(asked: DataFrame) -> DataFrame:
    """ASKED with pack null: of each shard all keys that any pack asks, with the counts of all training texts."""

    def run(batches):
        at, sums = None, Sums()

        def done():
            keys, counts = sums.whole()
            return pa.RecordBatch.from_pylist([{"shard": at, "pack": None, "n": len(keys), "keys": packed_keys(keys), "counts": squeezed(counts)}], ASKED)

        for batch in batches:
            for shard, _, n, keys, counts in rows_of(batch):
                if shard != at:
                    if at is not None:
                        yield done()
                    at, sums = shard, Sums()
                sums.add(unpacked_keys(keys, n), restored(counts, n, np.int64))
        if at is not None:
            yield done()
        release()

    return by_shard(asked).mapInArrow(run, ASKED_SQL)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of one half and more."""
    y = x + 8
    low = np.log(x)
    for k in range(1, 8):
        low = low + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - low


@functools.cache
def small_gammas(more: float) -> np.ndarray:
    return log_gamma(np.arange(1 << 14) + more)


def log_gamma_of(counts: np.ndarray, more: float) -> np.ndarray:
    """log_gamma(counts + more): most counts are small and come from a table."""
    known = small_gammas(more)
    out = known[np.minimum(counts, len(known) - 1).astype(np.int64)]
    large = np.flatnonzero(counts >= len(known))
    out[large] = log_gamma(counts[large] + more)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov estimate of so many zeros and ones in a row."""
    return log_gamma_of(zeros, 0.5) + log_gamma_of(ones, 0.5) - math.log(math.pi) - log_gamma_of(zeros + ones, 1.0)


def mixed(estimate: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The log of a node's mixture, and the weight of its own estimate in it; at the last depth that is all."""
    if children is None:
        return estimate, np.ones(len(estimate))
    both = np.logaddexp(estimate, children) + HALF
    return both, np.exp(estimate + HALF - both)


class Level:
    """The distinct (context, byte) of a depth with their counts; part: the entry that each is part of, one byte above."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.part = keys, counts, None

    def above(self) -> Level:
        up = ((self.keys >> np.uint64(16)) << np.uint64(8)) | (self.keys & np.uint64(255))
        keys, self.part = np.unique(up, return_inverse=True)
        return Level(keys, np.bincount(self.part, weights=self.counts, minlength=len(keys)).astype(np.int64))

    def nodes(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a decision: the node of each entry, the first entry of each node, and its zeros and ones."""
        name = self.keys >> np.uint64(8 - bit)
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        node = np.cumsum(np.r_[False, name[1:] != name[:-1]])
        one = ((self.keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        ones = np.add.reduceat(np.where(one, self.counts, 0), first)
        return node, first, np.add.reduceat(self.counts, first) - ones, ones


def decision(keys: np.ndarray, first: np.ndarray, bit: int) -> np.ndarray:
    """The number of a decision, 1 to 255: the bits before it behind a leading one."""
    return (1 << bit) | ((keys[first] & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)


def levels_of(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """From depth TOP down to depth."""
    out = [Level(keys, counts)]
    for _ in range(depth - TOP):
        out.insert(0, out[0].above())
    return out


def walk(levels: list[Level], bit: int):
    """For each level, deepest first: (level, node of each entry, first entries, zeros, ones, log mixture, own weight)."""
    below = None
    for level in reversed(levels):
        node, first, zeros, ones = level.nodes(bit)
        children = None
        if below is not None:
            deeper, deep_first, logs = below
            children = np.bincount(node[deeper.part[deep_first]], weights=logs, minlength=len(first))
        logs, own = mixed(log_kt(zeros, ones), children)
        yield level, node, first, zeros, ones, logs, own
        below = (level, first, logs)


def shard_tops(keys: np.ndarray, counts: np.ndarray, depth: int):
    """For the tree above: context of TOP - 1 bytes, decision, zeros, ones, and the sum of the logs of the nodes below."""
    levels = levels_of(keys, counts, depth)
    for bit in range(8):
        for level, _, first, zeros, ones, logs, _ in walk(levels, bit):
            if level is levels[0]:
                context = (level.keys[first] >> np.uint64(16)).astype(np.int64)
                name = (context << 8) | decision(level.keys, first, bit)
                known, at = np.unique(name, return_inverse=True)
                yield known, *(np.bincount(at, weights=x, minlength=len(known)) for x in (zeros, ones, logs))


def shard_bits(keys: np.ndarray, counts: np.ndarray, depth: int):
    """For each decision of each gram's byte: its node among those of the tree above, whether it is a one, and the probability of
    a one by the contexts of TOP bytes and more."""
    levels = levels_of(keys, counts, depth)
    for bit in range(8):
        share, up = None, np.arange(len(keys))
        for level, node, first, zeros, ones, _, own in walk(levels, bit):
            estimate = (ones + 0.5) / (zeros + ones + 1.0)
            at = node[up]
            share = estimate[at] if share is None else own[at] * estimate[at] + (1 - own[at]) * share
            if level is levels[0]:
                name = ((level.keys[first] >> np.uint64(16)).astype(np.int64) << 8 | decision(level.keys, first, bit))[at]
            else:
                up = level.part[up]
        yield name, ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool), share


class TopTree:
    """The nodes of fewer than TOP bytes of context: for a context of TOP - 1 bytes and a decision, a one has the probability
    base + rest * what the deeper contexts say."""

    def __init__(self, name: np.ndarray, zeros: np.ndarray, ones: np.ndarray, logs: np.ndarray):
        order = np.argsort(name)
        self.name = name[order]
        tables = [(self.name, zeros[order], ones[order], logs[order])]
        steps: list[np.ndarray] = []
        nodes = []
        for _ in range(TOP):
            n, z, o, below = tables[-1]
            whole, own = mixed(log_kt(z, o), below)
            nodes.append((z, o, own))
            if len(nodes) < TOP:
                context, which = n >> 8, n & 255
                known, at = np.unique(((context >> 8) << 8) | which, return_inverse=True)
                steps.append(at)
                tables.append((known, *(np.bincount(at, weights=x, minlength=len(known)) for x in (z, o, whole))))
        at, places = np.arange(len(self.name)), []
        for k, (z, o, own) in enumerate(nodes):
            places.append((((o + 0.5) / (z + o + 1.0))[at], own[at]))
            if k < len(steps):
                at = steps[k][at]
        self.base, self.rest = np.zeros(len(self.name)), np.ones(len(self.name))
        for estimate, own in reversed(places):  # from the root down
            self.base += self.rest * own * estimate
            self.rest *= 1 - own

    def ones(self, name: np.ndarray, share: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.name, name)
        return self.base[at] + self.rest[at] * share


def gram_logs(keys: np.ndarray, counts: np.ndarray, depth: int, top: TopTree) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context."""
    out = np.zeros(len(keys))
    for name, one, share in shard_bits(keys, counts, depth):
        p = top.ones(name, share)
        out += np.log10(np.where(one, p, 1 - p))
    return out


TOPS = pa.schema([("name", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("logs", pa.float64())])


def top_tree(shards: DataFrame, depth: int, count: int) -> TopTree:
    """Gathers TOPS, at most 255 rows for each context of TOP - 1 bytes."""

    def one(batch: pa.RecordBatch):
        for _, _, n, keys, counts in rows_of(batch):
            for columns in shard_tops(unpacked_keys(keys, n), restored(counts, n, np.int64), depth):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TOPS, strict=True)], schema=TOPS)

    rows = map_arrow(shards.where(F.col("shard") < count), "name long, zeros double, ones double, logs double", one)
    t = rows.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "logs"))).toArrow()
    return TopTree(*(t.column(c).to_numpy() for c in ("name", "zeros", "ones", "logs")))


def totals(shards: DataFrame, count: int) -> tuple[int, int]:
    """Tokens of the training texts, and distinct ones."""

    def one(batch: pa.RecordBatch):
        for _, _, n, _, counts in rows_of(batch):
            c = restored(counts, n, np.int64)
            yield pa.record_batch([pa.array([int(c.sum())]), pa.array([int((c > 0).sum())])], ["tokens", "kinds"])

    r = map_arrow(shards.where(F.col("shard") >= count), "tokens long, kinds long", one).agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    return r.n or 0, r.v or 0


def answers(asked: DataFrame, shards: DataFrame, depth: int, count: int, top: TopTree) -> DataFrame:
    """pack, shard, answer: of each key asked, in order, log10 of its probability, or for words the count in training."""
    sent = asked.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        at, known, values = None, None, None
        for batch in batches:
            out: list[list] = [[], [], []]
            for shard, pack, n, keys, counts in rows_of(batch):
                own = unpacked_keys(keys, n)
                if pack is None:  # the shard itself comes before those who ask
                    c = restored(counts, n, np.int64)
                    at, known, values = shard, own, c if shard >= count else gram_logs(own, c, depth, sent.value)
                    continue
                if shard != at:
                    raise RuntimeError("a shard is missing")
                got = values[np.searchsorted(known, own)]
                raw = squeezed(got if shard >= count else rounded(got))
                for column, x in zip(out, (pack, shard, raw), strict=True):
                    column.append(x)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["pack", "shard", "answer"])
        release()

    both = by_shard(asked.drop("counts").withColumn("counts", F.lit(None).cast("binary")).unionByName(shards), "pack")  # nulls are first
    return both.mapInArrow(run, "pack long, shard int, answer binary")


SCORES = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_bytes", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_SQL = "id long, held_out boolean, n_tokens long, n_known long, n_bytes long, train_tokens long, base_score double, score double"


def scores(packs: DataFrame, replies: DataFrame, depth: int, count: int, tokens: int, kinds: int) -> DataFrame:
    """SCORES of every text of the packs."""
    floor = math.log10(0.1 * (kinds + 1) + tokens)

    def one(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            blob, sizes, held = unpacked(row)
            got = {r["shard"]: r["answer"] for r in row["a"] or []}
            keys, parts = grams_by_text(blob, sizes, depth)
            order, ends = in_shards(keys, depth, count)
            logs = np.empty(len(keys), np.float32)
            logs[order] = np.concatenate([restored(got[s], n, np.float32) for s, n in enumerate(np.diff(ends, prepend=0).tolist()) if n])
            score = log_sums(keys, logs, parts, len(sizes))
            del keys, parts, order, logs
            w, owner = word_keys(blob, sizes)
            known, at = np.unique(w, return_inverse=True)
            shard = (known % np.uint64(count)).astype(np.int64)
            order, per = np.argsort(shard, kind="stable"), np.bincount(shard, minlength=count).tolist()
            met = np.empty(len(known), np.int64)
            met[order] = np.concatenate([restored(got[s + count], n, np.int64) for s, n in enumerate(per) if n])
            met = met[at]
            base = np.bincount(owner, weights=np.log10(met + 0.1) - floor, minlength=len(sizes))
            per_text, seen = np.bincount(owner, minlength=len(sizes)), np.bincount(owner, weights=met > 0, minlength=len(sizes))
            columns = [row["ids"], held, per_text, seen.astype(np.int64), sizes - depth, np.full(len(sizes), tokens), base, score]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORES, strict=True)], schema=SCORES)

    by_pack = replies.groupBy("pack").agg(F.collect_list(F.struct("shard", "answer")).alias("a"))
    return map_arrow(packs.drop(*ASKS).join(by_pack, "pack", "left"), SCORES_SQL, one)


def log_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 10, depth: int = DEPTH, shards: int = SHARDS) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, n_bytes, train_tokens, base_score, score and bits_per_byte of every text.

    The model learns from the rows whose crc32 of the id as text every does not divide; the others, and rows without
    an id, are held out. score is log10 of the model's probability of the text as the model sees it (n_bytes long),
    base_score that of a unigram model of words. A byte's log counts with 16 significant bits. n_tokens counts words and the end, n_known those that training texts
    have. Null and empty texts are the end alone; repeated rows count each; ids are whole numbers; other columns are not
    read. Without training rows all estimates are even; a table without rows gives none.
    """
    packs = stored(texts_of(docs, id_col, text_col, depth, every, shards), "packs")
    asked = asked_of(packs)
    trained = stored(model(asked), "shards")
    tokens, kinds = totals(trained, shards)
    replies = answers(asked, trained, depth, shards, top_tree(trained, depth, shards))
    found = scores(packs, replies, depth, shards, tokens, kinds)
    return found.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes")).withColumnRenamed("id", id_col)


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_scores(table(spark, sf_dir, "documents"))
