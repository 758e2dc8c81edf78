"""Large files by byte ranges: parts read in parallel, split and put together with checks, CRC-32 as an aggregate, stored archives.

A file is never whole in a task: parts are read by offset and length, and what makes one file of them streams them in order.
Files are opened by pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.sources.raster import opened
from cellweave.sources.shared import stored

#: Fixed value of the check sum: its polynomial, lowest power at the highest of 32 bits.
POLYNOMIAL = 0xEDB88320
#: Fixed values of the archive format: marks of its parts, and the time stamp of all members (1 January 2020, midnight).
LOCAL_MARK, CENTRAL_MARK, END_MARK, STAMP_TIME, STAMP_DATE = 0x04034B50, 0x02014B50, 0x06054B50, 0, (40 << 9) | (1 << 5) | 1
BUFFER = 4 << 20


def times_x8(n: int) -> list[int]:
    """The 32 by 32 matrix over two elements (a column for each bit) that multiplies by x to the 8 n: what n bytes behind do."""
    step = [POLYNOMIAL] + [1 << k for k in range(31)]  # by x: bits move down one place
    for _ in range(3):
        step = multiplied(step, step)
    out = [1 << k for k in range(32)]
    while n:
        if n & 1:
            out = multiplied(step, out)
        step, n = multiplied(step, step), n >> 1
    return out


def applied(matrix: list[int], vector: int) -> int:
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


def multiplied(a: list[int], b: list[int]) -> list[int]:
    return [applied(a, column) for column in b]


def crc_combined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one behind the other, from those of both and the length of the second."""
    return applied(times_x8(length), first) ^ second


def shifted_crc(crc: Column, after: Column) -> Column:
    """What a part's CRC-32 is of the whole's if after bytes follow it: the whole's is the xor over its parts."""

    @F.pandas_udf("long")
    def shift(crcs: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series(shifted(crcs.to_numpy(np.int64), lengths.to_numpy(np.int64)))

    return shift(crc, after)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each check sum moved by its own number of bytes, all together: one matrix for each binary place of the numbers."""
    out, step = crcs.copy(), times_x8(1)
    for place in range(int(lengths.max(initial=0)).bit_length()):
        met = np.flatnonzero(lengths >> place & 1)
        own, moved = out[met], np.zeros(len(met), np.int64)
        for bit, column in enumerate(step):
            moved ^= np.where(own >> bit & 1, column, 0)
        out[met] = moved
        step = multiplied(step, step)
    return out


def whole_crc(parts: DataFrame, *keys: str) -> DataFrame:
    """keys, length and crc of what parts (keys, offset, length, crc) make: an aggregate, each part's share by itself."""
    total = parts.groupBy(*keys).agg(F.sum("length").alias("total"))
    both = parts.join(F.broadcast(total), list(keys)) if keys else parts.crossJoin(F.broadcast(total))
    share = both.withColumn("share", shifted_crc(F.col("crc"), F.col("total") - F.col("offset") - F.col("length")))
    return share.groupBy(*keys).agg(F.sum("length").alias("length"), F.bit_xor("share").alias("crc"))


def pieces(path: str, offset: int, length: int) -> Iterator[bytes]:
    system, name = opened(path)
    with system.open_input_file(name) as f:
        f.seek(offset)
        while length > 0:
            raw = f.read(min(BUFFER, length))
            if not raw:
                return
            length -= len(raw)
            yield raw


def ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """part, offset, length of a file's parts of size bytes, the last one shorter; an empty file has one empty part."""
    if size <= 0:
        raise ValueError("parts need a size")
    system, name = opened(path)
    info = system.get_file_info(name)
    if not info.is_file:
        raise FileNotFoundError(path)
    n = max(1, -(-info.size // size))
    rows = spark.range(n, numPartitions=min(n, 4096)).select(F.col("id").cast("int").alias("part"), (F.col("id") * size).alias("offset"))
    return rows.withColumn("length", F.least(F.lit(size), F.lit(info.size) - F.col("offset")).cast("long"))


FACTS = "part int, offset long, length long, crc long, sha256 string, name string"


def over_parts(rows: DataFrame, path: str, out: str | None) -> DataFrame:
    """FACTS of a file's ranges, each read by its task a little at a time; with out also written there under its name."""

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                crc, sha, name, got = 0, hashlib.sha256(), f"part-{r['part']:06d}", 0
                target = None
                if out is not None:
                    system, folder = opened(out)
                    system.create_dir(folder, recursive=True)
                    draft = f"{folder}/_{name}-{np.random.default_rng().integers(1 << 62)}"
                    target = system.open_output_stream(draft)
                for raw in pieces(path, r["offset"], r["length"]):
                    crc, got = zlib.crc32(raw, crc), got + len(raw)
                    sha.update(raw)
                    if target is not None:
                        target.write(raw)
                if got != r["length"]:
                    raise ValueError(f"{path} became shorter while it was read")
                if target is not None:
                    target.close()
                    system.move(draft, f"{folder}/{name}")
                found.append(r | {"crc": crc, "sha256": sha.hexdigest(), "name": name})
            if found:
                yield pa.RecordBatch.from_pylist(found, pa.schema([("part", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("sha256", pa.string()), ("name", pa.string())]))

    return rows.mapInArrow(run, FACTS)


def part_facts(spark: SparkSession, path: str, size: int) -> DataFrame:
    """part, offset, length, crc, sha256 and name of each range of a file."""
    return over_parts(ranges(spark, path, size), path, None)


def split_file(spark: SparkSession, path: str, out: str, size: int) -> DataFrame:
    """Write a file's ranges as files of a folder, in parallel, and return their facts: the manifest."""
    done = over_parts(ranges(spark, path, size), path, out)
    return spark.createDataFrame(done.collect(), FACTS)  # a row for each part


def bad_parts(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """name, problem (missing, other length, other content) of parts in a folder that are not as the manifest says."""

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                system, base = opened(folder)
                info = system.get_file_info(f"{base}/{r['name']}")
                problem = "missing" if info.type != fs.FileType.File else "other length" if info.size != r["length"] else None
                if problem is None:
                    sha = hashlib.sha256()
                    for raw in pieces(f"{folder.rstrip('/')}/{r['name']}", 0, r["length"]):
                        sha.update(raw)
                    problem = "other content" if sha.hexdigest() != r["sha256"] else None
                if problem:
                    found.append({"name": r["name"], "problem": problem})
            if found:
                yield pa.RecordBatch.from_pylist(found, pa.schema([("name", pa.string()), ("problem", pa.string())]))

    return manifest.select("name", "length", "sha256").mapInArrow(run, "name string, problem string")


def in_one_file(spark: SparkSession, sources: list[tuple[str, int]], before: list[bytes], after: bytes, out: str) -> dict:
    """One task writes out: for each source the bytes before it, then the file, a little at a time; at the end what comes after."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            system, name = opened(out)
            draft, sha, crc, length = f"{name}-{np.random.default_rng().integers(1 << 62)}", hashlib.sha256(), 0, 0
            with system.open_output_stream(draft) as f:
                for (path, size), head in zip(sources, before, strict=True):
                    for raw in (head, *([] if not size else pieces(path, 0, size))):
                        f.write(raw)
                        sha.update(raw)
                        crc, length = zlib.crc32(raw, crc), length + len(raw)
                f.write(after)
                sha.update(after)
                crc, length = zlib.crc32(after, crc), length + len(after)
            system.move(draft, name)
            yield pa.RecordBatch.from_pylist([{"length": length, "crc": crc, "sha256": sha.hexdigest()}])

    return spark.range(1, numPartitions=1).mapInArrow(run, "length long, crc long, sha256 string").first().asDict()


def joined_file(spark: SparkSession, folder: str, manifest: DataFrame, out: str) -> dict:
    """Put a folder's parts together in order: length, crc, sha256 of the file. A part that is not as the manifest says, a gap
    between parts, or a file whose CRC-32 is not what the manifest's parts make, is an error; no file is left then."""
    if (bad := bad_parts(spark, folder, manifest).first()) is not None:
        raise ValueError(f"{bad.name}: {bad.problem}")
    rows = manifest.select("name", "offset", "length").orderBy("offset", "part").collect()
    at = 0
    for r in rows:
        if r["offset"] != at:
            raise ValueError(f"{r.name}: begins at {r['offset']}, not at {at}")
        at += r["length"]
    got = in_one_file(spark, [(f"{folder.rstrip('/')}/{r['name']}", r["length"]) for r in rows], [b""] * len(rows), b"", out)
    want = whole_crc(manifest).first()
    if rows and (got["length"], got["crc"]) != (want.length, want.crc):
        system, name = opened(out)
        system.delete_file(name)
        raise ValueError(f"the file has CRC {got['crc']}, its parts make {want.crc}")
    return got


def stored_archive(spark: SparkSession, members: list[tuple[str, str]], out: str, size: int = 64 << 20) -> dict:
    """A zip archive of files (name, path), stored as they are, with one fixed time stamp: the same members give the same bytes.

    CRC-32 sums are aggregates over parts that are read in parallel; then one task streams the members. Archives of 4 GB
    and more, or of more than 65 535 members, are refused: the plain format cannot say their sizes.
    """
    if len(members) > 0xFFFF or len({n for n, _ in members}) < len(members):
        raise ValueError("too many members, or a name twice")
    heads, central, at, sources = [], b"", 0, []
    for name, path in members:
        facts = whole_crc(part_facts(spark, path, size)).first()
        raw = name.encode()
        utf8 = 0 if name.isascii() else 0x800
        if at + 30 + len(raw) + facts.length >= 1 << 32:
            raise ValueError("an archive of 4 GB or more")
        common = struct.pack("<HHHHHIIIHH", 20, utf8, 0, STAMP_TIME, STAMP_DATE, facts.crc, facts.length, facts.length, len(raw), 0)
        heads.append(struct.pack("<I", LOCAL_MARK) + common + raw)
        central += struct.pack("<IH", CENTRAL_MARK, 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw
        at += 30 + len(raw) + facts.length
        sources.append((path, facts.length))
    end = struct.pack("<IHHHHIIH", END_MARK, 0, 0, len(members), len(members), len(central), at, 0)
    return in_one_file(spark, sources, heads, central + end, out)


def crc_in_order(rows: DataFrame, text: str, order: list[str], *keys: str) -> DataFrame:
    """keys, length and crc of all texts of each key one behind the other in order, as UTF-8 (null: nothing): each text's own
    CRC-32, and how many bytes follow it, are enough; texts do not move.

    Rows are dealt by ranges of keys and order; what follows is counted within a range, then, over a row for each, among them.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    own = stored(rows.select(*keys, *order, F.octet_length(raw).cast("long").alias("length"), F.crc32(raw).alias("crc")), "own")
    dealt = stored(own.repartitionByRange(*keys, *order).withColumn("slab", F.spark_partition_id()), "slabs")
    after = lambda by, last: F.coalesce(F.sum("length").over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in last]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = dealt.withColumn("after", after([*keys, "slab"], order)).withColumn("share", shifted_crc(F.col("crc"), F.col("after")))
    slabs = shares.groupBy(*keys, "slab").agg(F.sum("length").alias("length"), F.bit_xor("share").alias("crc"))
    whole = slabs.withColumn("after", after(keys, ["slab"])).withColumn("share", shifted_crc(F.col("crc"), F.col("after")))
    return whole.groupBy(*keys).agg(F.sum("length").alias("length"), F.bit_xor("share").alias("crc"))
