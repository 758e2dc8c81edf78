"""Sources and sinks of small documents and of grids: sweeps by file name, catalogues, hashed parts, checked writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_cells(df: DataFrame, bands: list[str], sentinel: float = -1e30, nodata: float | None = None) -> DataFrame:
    """Sentinels, nodata and non-finite values of bands become null."""
    def one(b: str) -> Column:
        v = F.col(b)
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < sentinel)
        return F.when(~(bad | (v == nodata) if nodata is not None else bad), v).alias(b)

    return df.select(*[one(x) if x in bands else F.col(x) for x in df.columns])


def coded(df: DataFrame, code: int, column: str = "code") -> DataFrame:
    """Cells of a code; none at all is an error."""
    out = df.where(F.col(column) == code)
    if out.isEmpty():
        raise ValueError(f"no cell has code {code}")
    return out


def band_name(tags: Column, i: int) -> Column:
    return F.coalesce(tags["description"], tags["name"], tags["LONG_NAME"], F.lit(f"band_{i}"))


def read_sweeps(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON rows with their file's stem; what cannot be read is left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob)
    return rows.withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(?:\\.json)?$", 1))


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and sha256 of each file of a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_parts(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Parts that are missing or differ from the manifest (name, length, sha256); none if all is well."""
    own = found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("got"), F.col("sha256").alias("got_sha"))
    both = manifest.join(own, "name", "left")
    return both.where(F.col("got").isNull() | (F.col("got") != F.col("length")) | (F.col("got_sha") != F.col("sha256"))).select("name", "length", "got")


def write_field(field: DataFrame, path: str) -> DataFrame:
    """Write r, c, p and read it back; an empty or all-zero field, a value out of 0..1 or a lost row is an error."""
    spark = field.sparkSession
    field.select("r", "c", "p").write.parquet(path)
    back = spark.read.parquet(path)
    s = back.agg(F.count("*").alias("n"), F.max("p").alias("hi"), F.min("p").alias("lo"), F.count_if(F.isnan("p") | F.col("p").isNull()).alias("bad")).first()
    if not s.n or not s.hi or s.hi > 1 or s.lo < 0 or s.bad:
        raise ValueError(f"not a field: {s.asDict()}")
    return back
