"""Session, storage and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cellweave.sources.shared import shared_dir, stored

__all__ = ["PASS_BYTES", "Kept", "map_arrow", "passes", "release", "shared_dir", "stored", "table"]

#: Text bytes that one numpy pass of a kernel works on; longer texts are passes of their own.
PASS_BYTES = 1 << 20
#: What a task keeps of words met before, in bytes (with about ENTRY for each word's objects), and letters of the longest.
KEPT_BYTES = 24 << 20
ENTRY = 180
KEPT_LETTERS = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Kept:
    """Results by word that a task keeps from part to part, about KEPT_BYTES of them at most; long words are not kept.

    Two generations: when the young one has half of that, it takes the place of the old one.
    """

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def of(self, words: set[str], compute: Callable[[list[str]], list]) -> dict:
        """The result of each of words, by compute where it is not known."""
        out = {w: self.young[w] for w in words if w in self.young}
        again = {w: self.old[w] for w in words if w not in out and w in self.old}
        new = [w for w in words if w not in out and w not in again]
        found = dict(zip(new, compute(new), strict=True)) if new else {}
        keep = again | {w: x for w, x in found.items() if len(w) <= KEPT_LETTERS}
        more = sum(ENTRY + len(w) + (len(x) if isinstance(x, bytes) else 0) for w, x in keep.items())
        if self.held + more > KEPT_BYTES // 2:
            self.old, self.young, self.held = self.young, {}, 0
        if more <= KEPT_BYTES // 2:
            self.young.update(keep)
            self.held += more
        return out | again | found


def map_arrow(df: DataFrame, schema: str | StructType, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], **options) -> DataFrame:
    """mapInArrow with a function of one batch; state between batches is the function's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        release()

    return df.mapInArrow(run, schema, **options)


def release() -> None:
    """Give freed memory back to the system: workers stay for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def passes(batch: pa.RecordBatch, column: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about limit bytes; a longer text comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop

