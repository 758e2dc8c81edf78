"""Run-length bytes of fields of three values: 0, 1 and null. Each run is its length (uleb128) and a code (0, 1, 2 for null)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose runs a task has as Python objects at once.
ROWS = 64


def write_length(n: int) -> bytes:
    out = []
    while n >= 128:
        out.append(n % 128 + 128)
        n //= 128
    return bytes([*out, n])


def read_runs(blob: bytes, cells: int) -> list[dict]:
    """The runs of a blob. What is not exactly a field of so many cells is refused: a length cut short or beyond 2^56, none, a
    missing or unknown code, runs beyond the field or short of it, and bytes after its end."""
    runs, at, left = [], 0, cells
    while at < len(blob):
        if not left:
            raise ValueError(f"{len(blob) - at} bytes after the end of the field")
        end = at
        while end < len(blob) and blob[end] >= 128:
            end += 1
        if end >= len(blob) or end - at > 7:
            raise ValueError(f"run {len(runs)}: a length cut short or too long")
        n = sum((x & 127) << 7 * i for i, x in enumerate(blob[at : end + 1]))
        if end + 1 >= len(blob):
            raise ValueError(f"run {len(runs)} has no code")
        code = blob[end + 1]
        if not 0 < n <= left or code > 2:
            raise ValueError(f"run {len(runs)}: length {n}, code {code}, {left} cells left")
        runs.append({"length": n, "code": code})
        at, left = end + 2, left - n
    if left:
        raise ValueError(f"{left} cells without a run")
    return runs


def run_hex(run: Column) -> Column:
    """A run (length, code) as hex: the length by groups of seven bits, lowest first, all but the last marked; then the code."""
    n = run["length"].cast("long")
    groups = F.ceil(F.length(F.bin(n)) / 7).cast("int")
    byte = lambda i: F.pmod(F.floor(n / F.pow(F.lit(128.0), i)).cast("long"), F.lit(128)) + F.when(i < groups - 1, 128).otherwise(0)
    own = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0"))
    return F.concat(F.array_join(own, ""), F.lpad(F.hex(run["code"]), 2, "0"))


def encode_rows(cells: DataFrame) -> DataFrame:
    """r, cells, blob: the run bytes of each row of a field (r, c, p), dense in c. A value but 0, 1 and null is an error:
    rounding it would store another field."""
    p = F.col("p")
    null = p.isNull() | F.isnan(p)
    code = F.when(null, 2).when(p == 1, 1).when(p == 0, 0).otherwise(F.raise_error(F.concat(F.lit("not a field of 0, 1 and null: "), p.cast("string"))).cast("int"))
    w = Window.partitionBy("r").orderBy("c")
    marked = cells.select("r", "c", code.alias("code"))
    marked = marked.withColumn("run", F.sum(F.coalesce((F.col("code") != F.lag("code").over(w)).cast("int"), F.lit(0))).over(w))
    runs = marked.groupBy("r", "run").agg(F.count("*").alias("length"), F.max("code").alias("code"))
    by_row = runs.groupBy("r").agg(F.sum("length").alias("cells"), F.array_sort(F.collect_list(F.struct("run", "length", "code"))).alias("x"))
    return by_row.select("r", "cells", F.unhex(F.array_join(F.transform("x", run_hex), "")).alias("blob"))


def decode_rows(rows: DataFrame) -> DataFrame:
    """r, c (from 0), p of rows (r, cells, blob); a blob that read_runs refuses is an error."""

    def runs_of(parts):
        for pdf in parts:
            for at in range(0, len(pdf), ROWS):
                own = pdf[at : at + ROWS]
                found = [(r, k, x["length"], x["code"]) for r, n, b in zip(own.r, own.cells, own.blob, strict=True) for k, x in enumerate(read_runs(bytes(b), int(n)))]
                yield pd.DataFrame(found, columns=["r", "run", "length", "code"])

    kind = rows.schema["r"].dataType.simpleString()
    runs = rows.select("r", F.col("cells").cast("long").alias("cells"), "blob").mapInPandas(runs_of, f"r {kind}, run int, length long, code int")
    runs = runs.select("r", "run", F.struct("length", "code").alias("x"))
    before = F.sum("x.length").over(Window.partitionBy("r").orderBy("run")) - F.col("x.length")
    cells = runs.withColumn("start", before).select("r", F.explode(F.sequence("start", F.col("start") + F.col("x.length") - 1)).alias("c"), F.col("x.code").alias("code"))
    return cells.select("r", F.col("c").cast("int").alias("c"), F.when(F.col("code") < 2, F.col("code").cast("double")).alias("p"))


def value_histogram(cells: DataFrame) -> DataFrame:
    """zeros, ones, nulls, others of p."""
    p = F.col("p")
    null = p.isNull() | F.isnan(p)
    return cells.agg(F.count_if(~null & (p == 0)).alias("zeros"), F.count_if(~null & (p == 1)).alias("ones"), F.count_if(null).alias("nulls"), F.count_if(~null & (p != 0) & (p != 1)).alias("others"))
