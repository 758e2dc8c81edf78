"""Grids with their metadata: tables of cells beside a description (rows, columns, origin, cell size, reference system, nodata)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.files import clean_cells

#: Rows of a chunk: cells are stored by chunks of rows, so that a scan of some rows reads theirs alone.
CHUNK = 256
#: What two grids must share to be joined cell by cell, and the description's schema.
ALIGNED = ("height", "width", "crs", "transform")
META = "height int, width int, crs string, transform array<double>, nodata double, tags map<string, string>"


def write_grid(cells: DataFrame, path: str, meta: dict) -> None:
    """Cells (r, c, bands) and their description below path, cells in a folder for each chunk of rows."""
    cells.withColumn("chunk", F.floor(F.col("r") / CHUNK).cast("int")).repartition("chunk").write.partitionBy("chunk").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def describe_grid(spark: SparkSession, path: str) -> dict:
    row = spark.read.schema(META).json(f"{path}/meta").first()
    return row.asDict(recursive=True)


def read_grid(spark: SparkSession, path: str, bands: list[str] | None = None, sample: DataFrame | None = None) -> DataFrame:
    """r, c, the bands (all by default) with sentinels, nodata and non-finite values as null, and valid: whether any has a
    value. Only the bands asked for are read, and with sample (r, c) only its cells, of chunks that hold any."""
    meta = describe_grid(spark, path)
    cells = spark.read.parquet(f"{path}/cells")
    bands = bands or [c for c in cells.columns if c not in ("r", "c", "chunk")]
    if sample is not None:
        wanted = sample.select("r", "c").distinct().withColumn("chunk", F.floor(F.col("r") / CHUNK).cast("int"))
        cells = cells.join(wanted.select("chunk").distinct(), "chunk", "left_semi").join(wanted, ["chunk", "r", "c"], "left_semi")
    clean = clean_cells(cells.select("r", "c", *bands), bands, nodata=meta["nodata"])
    return clean.withColumn("valid", F.coalesce(*[F.col(b).isNotNull() for b in bands]) if len(bands) == 1 else F.greatest(*[F.col(b).isNotNull().cast("int") for b in bands]).cast("boolean"))


def read_labels(spark: SparkSession, path: str, band: str = "label") -> DataFrame:
    """r, c, fault (above 0.5) and valid; a cell without a value is no fault."""
    cells = read_grid(spark, path, [band])
    return cells.select("r", "c", F.coalesce(F.col(band) > 0.5, F.lit(False)).alias("fault"), "valid")


def misaligned(a: dict, b: dict, tolerance: float = 1e-9) -> list[str]:
    """The names of what two grids' descriptions differ in, of ALIGNED."""
    near = lambda x, y: x == y if not isinstance(x, list) or y is None else len(x) == len(y) and all(abs(p - q) <= tolerance for p, q in zip(x, y, strict=True))
    return [k for k in ALIGNED if not near(a.get(k), b.get(k))]


def aligned(spark: SparkSession, *paths: str) -> dict:
    """The one description that grids share, in what ALIGNED names; an error says which grid differs from the first in what."""
    first, *others = [describe_grid(spark, p) for p in paths]
    for path, other in zip(paths[1:], others, strict=True):
        if odd := misaligned(first, other):
            raise ValueError(f"{path} differs from {paths[0]} in {', '.join(odd)}")
    return first


def read_folds(spark: SparkSession, paths: dict[int, str], band: str = "p") -> DataFrame:
    """fold, r, c, p of one grid for each fold; they must be aligned."""
    aligned(spark, *paths.values())
    out = None
    for fold, path in paths.items():
        own = read_grid(spark, path, [band]).where("valid").select(F.lit(fold).alias("fold"), "r", "c", F.col(band).alias("p"))
        out = own if out is None else out.unionByName(own)
    return out


def resolve_path(explicit: str | None, names: list[str], folders: list[str]) -> str:
    """An explicit path, which must be there, or else the first of names in any of folders that is, then of the names with
    recon_ before them; an error names what was looked for."""
    if explicit:
        if not Path(explicit).exists():
            raise FileNotFoundError(explicit)
        return explicit
    asked = [Path(d) / n for n in [*names, *(f"recon_{n}" for n in names)] for d in folders]
    found = next((p for p in asked if p.exists()), None)
    if found is None:
        raise FileNotFoundError(f"none of {[str(p) for p in asked]}")
    return str(found)


def with_overrides(settings: dict, overrides: list[str]) -> dict:
    """settings with "a.b=value" put in; values are JSON where they are, else text. A key without '=' is an error."""
    out = json.loads(json.dumps(settings))
    for text in overrides:
        key, equals, value = text.partition("=")
        if not equals or not key:
            raise ValueError(f"not key=value: {text!r}")
        at = out
        *way, last = key.split(".")
        for part in way:
            at = at.setdefault(part, {})
        try:
            at[last] = json.loads(value)
        except json.JSONDecodeError:
            at[last] = value
    return out


def write_report(rows: DataFrame, path: str) -> DataFrame:
    """Write rows as JSON lines and read them back by their schema; numbers that JSON lacks (NaN, infinite) are null."""
    kinds = dict(rows.dtypes)
    fine = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns]
    rows.select(*fine).write.option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def pinned(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """name, problem of pins (name, sha256, length) that an inventory does not bear out, and of files that no pin names."""
    both = manifest.select("name", "sha256", "length").join(inventory.select("name", F.col("sha256").alias("got"), F.col("length").alias("size")), "name", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "not pinned").when(F.col("sha256") != F.col("got"), "other content").when(F.col("length") != F.col("size"), "other length")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")
