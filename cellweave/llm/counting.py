"""How often keys are met in a whole corpus, asked in packs.

A pack is what one pass of a task holds. It sends each bucket the keys that it has there as packed bytes and gets the
answers to them as packed bytes, so a key costs 4 bytes (16 where equality is to be sure) and no row. Keys that a
pack has more than once are summed before they move: it tells them once, however hot. Buckets are ranges of the
hash; their number follows the number of keys, so what a task holds at a time does not grow with the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a bucket, about: a task holds one bucket at a time.
BUCKET_KEYS = 2 << 20
ASKED = "pack long, size int, bucket int, asked int, keys binary, counts binary, times binary"
FIELDS = ("pack", "size", "bucket", "asked", "keys", "counts", "times")
SCHEMA = pa.schema([("pack", pa.int64()), ("size", pa.int32()), ("bucket", pa.int32()), ("asked", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("times", pa.binary())])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, keys: int) -> int:
    """Buckets for so many keys."""
    return max(partitions(spark), -(-keys // BUCKET_KEYS))


def pack_id(*parts: np.ndarray) -> int:
    """A pack's name, of what it holds alone: a task that runs again gives it the same. Equal packs get equal answers."""
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(np.ascontiguousarray(p).tobytes())
    return int.from_bytes(h.digest(), "little", signed=True)


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, np.uint32).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * 4, "zstd", asbytes=True), np.uint32) if n else np.zeros(0, np.uint32)


class Keys:
    """The keys of a pack in order of bucket and key: order (of its elements), run (of equal ones) and bucket of each run.

    wide: a second hash of each element; then keys are both hashes in full, else 32 bits beside the bucket.
    """

    def __init__(self, hashes: np.ndarray, buckets: int, wide: np.ndarray | None = None):
        self.wide = wide is not None
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        if wide is None:
            key = (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
            self.order = np.argsort(key, kind="stable")
            key = key[self.order]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            self.key = key[new].astype(np.uint32)
        else:
            self.order = np.lexsort((wide, hashes))
            a, b = hashes[self.order], wide[self.order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
            self.key = np.stack([a[new], b[new]], axis=1)
        self.run = np.cumsum(new) - 1
        self.times = np.bincount(self.run, minlength=len(self.key)) if len(self.key) else np.zeros(0, np.int64)
        self.bucket = bucket[self.order][new].astype(np.int64)

    def singles(self) -> np.ndarray:
        """Elements whose key the pack has once, in the order of what is asked; the others are known to repeat."""
        return self.order[self.times[self.run] == 1]

    def others(self) -> np.ndarray:
        return self.order[self.times[self.run] > 1]


def requests(pack: int, size: int, keys: Keys, totals: bool = False, owner: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket in which the pack has keys: first the keys that it asks for, then those it tells.

    totals: asks for all keys, and tells how often it has each. owner: of each element, the one of size sets that it
    is of; then the answer is by set.
    """
    asks = np.ones(len(keys.key), bool) if totals else keys.times == 1
    of_set = np.zeros(len(asks), np.int64)
    by_element = None
    if owner is not None:
        own = owner[keys.singles()]
        by_element = keys.bucket[asks]
        of_set[asks] = own
    order = np.lexsort((of_set, ~asks, keys.bucket))  # by set: its share of the answer is counted off
    asks, bucket = asks[order], keys.bucket[order]
    raw = np.ascontiguousarray(keys.key[order])
    met, starts = np.unique(bucket, return_index=True)
    stops = np.r_[starts, len(bucket)][1:]
    columns: list[list] = [[] for _ in FIELDS]
    for b, i, j in zip(met.tolist(), starts.tolist(), stops.tolist(), strict=True):
        row = [pack, size, b, int(asks[i:j].sum()), raw[i:j].tobytes(), None, None]
        if by_element is not None:
            lo, hi = np.searchsorted(by_element, [b, b + 1])
            row[5] = packed(np.bincount(own[lo:hi], minlength=size))
        if totals:
            row[6] = packed(keys.times[order[i:j]])
        for c, x in zip(columns, row, strict=True):
            c.append(x)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def whole_buckets(batches):
    """bucket and its rows, for rows in order of bucket."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in FIELDS), strict=True):
            if row[2] != at:
                if held:
                    yield at, held
                at, held = row[2], []
            held.append(row)
    if held:
        yield at, held


def answers(asked: DataFrame, mode: str, wide: bool = False) -> DataFrame:
    """pack, buckets, answers (in order of bucket) to requests. Mode bits: for each key asked for whether it is met at
    least twice; sets: for each set of the pack how many of its keys are; totals: the sum of all packs' times."""
    parts = partitions(asked.sparkSession)

    def run(batches):
        for bucket, rows in whole_buckets(batches):
            keys = [np.frombuffer(r[4], np.uint64 if wide else np.uint32) for r in rows]
            flat = np.concatenate(keys)
            if wide:
                flat = flat.reshape(-1, 2)
                order = np.lexsort((flat[:, 1], flat[:, 0]))
                sorted_ = flat[order]
                new = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(1)]
            else:
                order = np.argsort(flat, kind="stable")
                sorted_ = flat[order]
                new = np.r_[True, sorted_[1:] != sorted_[:-1]]
            of = np.cumsum(new) - 1
            times = np.concatenate([unpacked(r[6], len(k)) for r, k in zip(rows, keys, strict=True)])[order] if mode == "totals" else None
            met = np.empty(len(flat), np.int64)
            met[order] = np.bincount(of, weights=times).astype(np.int64)[of]
            stop, out = 0, []
            for (_, size, _, n, _, counts, _), own in zip(rows, keys, strict=True):
                part, stop = met[stop : stop + n], stop + len(own) // (2 if wide else 1)
                if mode == "bits":
                    out.append(np.packbits(part > 1).tobytes())
                elif mode == "sets":
                    out.append(packed(np.bincount(np.repeat(np.arange(size), unpacked(counts, size)), weights=part > 1, minlength=size)))
                else:
                    out.append(packed(part))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(out, pa.binary())], ["pack", "bucket", "answer"])

    dealt = asked.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    found = dealt.mapInArrow(run, "pack long, bucket int, answer binary")
    by_pack = found.groupBy("pack").agg(F.array_sort(F.collect_set(F.struct("bucket", "answer"))).alias("a"))
    return by_pack.select("pack", F.col("a.bucket").alias("buckets"), F.col("a.answer").alias("answers"))


def bits_of(keys: Keys, buckets: list[int], replies: list[bytes]) -> np.ndarray:
    """Of each of keys.singles() whether its key is met again."""
    return bits_in_order(np.bincount(keys.bucket[keys.times == 1], minlength=1), buckets, replies)


def bits_in_order(sizes: np.ndarray, buckets: list[int], replies: list[bytes]) -> np.ndarray:
    """Bits of the keys asked for, in order of bucket; sizes: how many were asked for in each bucket."""
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(sizes[b])).astype(bool) for b, x in zip(buckets, replies, strict=True) if b < len(sizes) and sizes[b]]
    found = np.concatenate(parts) if parts else np.zeros(0, bool)
    if len(found) != int(sizes.sum()):
        raise RuntimeError("a pack lacks answers: the input was not read alike twice")
    return found
