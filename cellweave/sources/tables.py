"""Grids made from the star-schema tables: cells are (r, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64
COLUMNS = 720
KINDS = ("purchase", "click", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r the user, c the hour since 2024, kind, value."""
    e = read(spark, sf_dir, "events")
    hour = F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 24 + F.hour("ts")
    return e.select(F.col("user_id").cast("int").alias("r"), hour.cast("int").alias("c"), F.col("event_type").alias("kind"), "value")


def truth_of(cells: DataFrame, kind: str = "error") -> DataFrame:
    return cells.where(F.col("kind") == kind).select("r", "c").distinct()


def field_of(cells: DataFrame, kind: str = "purchase", scale: float = 500.0) -> DataFrame:
    """p, the largest value by cell over scale, within 0..1; cells of p 0 are left out."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / scale))
    return cells.where(F.col("kind") == kind).groupBy("r", "c").agg(F.max(p).alias("p")).where("p > 0")


def fields(cells: DataFrame, kinds=KINDS) -> DataFrame:
    """field_of for several kinds at once: candidate, r, c, p."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 500.0))
    return cells.where(F.col("kind").isin(*kinds)).groupBy(F.col("kind").alias("candidate"), "r", "c").agg(F.max(p).alias("p")).where("p > 0")


def footprint_of(cells: DataFrame) -> DataFrame:
    return cells.select("r", "c").distinct()


def ship_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r the supplier, c the week of shipping since 1992, v the largest price: a grid with holes."""
    li = read(spark, sf_dir, "lineitem")
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01")) / 7)
    return li.groupBy(F.col("l_suppkey").cast("int").alias("r"), week.cast("int").alias("c")).agg(F.max("l_extendedprice").alias("v"), F.max("l_quantity").alias("q"), F.min("l_discount").alias("x"))
