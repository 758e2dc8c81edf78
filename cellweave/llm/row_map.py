"""A bitmap of row keys, of fixed size, that spares the move of rows in which nothing was found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Bits of the map; they do not grow with the data. Beyond as many keys nearly every row passes, and moves.
MAP_BITS = 26


def bit_of() -> Column:
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << MAP_BITS))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (hashes of id and text) and row, all of docs' columns: their names cannot clash with the keys'.

    Rows that share both have equal ids and texts, and so equal results.
    """
    keys = (F.xxhash64(docs[id_col].cast("string")), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    return docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


class RowMap:
    """Whether a row (k1, k2) may be among found; no row of found is missed, joins decide."""

    def __init__(self, found: DataFrame):
        bits = found.select((bit_of() + 1).alias("b"))  # Spark numbers bits from 1
        parts = bits.groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
        whole = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        for r in parts:
            start = (r.bucket - 1) * len(r.bits)
            whole[start : start + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
        self.sent = found.sparkSession.sparkContext.broadcast(whole)

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows that are not in the map, and those that may be."""
        return self.part(rows, False), self.part(rows, True)

    def part(self, rows: DataFrame, inside: bool) -> DataFrame:
        sent, columns = self.sent, rows.columns

        def one(batch: pa.RecordBatch):
            yield batch.filter(pa.array(hits(sent.value, batch) == inside)).select(columns)

        return map_arrow(rows.withColumn("__bit", bit_of()), rows.schema, one)


def hits(whole: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    at = batch.column("__bit").to_numpy(zero_copy_only=False)
    return ((whole[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
