"""Gates before a result goes out: each is a measurement with a status, and a record is not replaced by one that measured less."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.audits import degraded
from cellweave.sources.grids import pinned

PASS, FAIL, MISSING, SKIPPED, HUMAN = "PASS", "FAIL", "MISSING", "SKIPPED", "HUMAN"
GATE = "name string, status string, note string"


def gate(spark: SparkSession, name: str, status: str, note: str = "") -> DataFrame:
    """A gate that is known without a table: skipped, left to a person, or measured by the caller."""
    return spark.createDataFrame([(name, status, note)], GATE)


def files_gate(name: str, manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Are the files that a manifest (name, sha256, length) pins there as pinned? FAIL if any has other content or length, else
    MISSING if any is not there or nothing is pinned; files that no pin names do not count. note: the first problems."""
    odd = pinned(manifest, inventory).where("problem <> 'not pinned'").select(F.concat_ws(": ", "name", "problem").alias("text"), (F.col("problem") == "missing").alias("gone"))
    told = odd.orderBy("text").limit(5).agg(F.array_join(F.array_sort(F.collect_list("text")), "; ").alias("note"))
    sums = odd.agg(F.count_if("gone").alias("gone"), F.count_if(~F.col("gone")).alias("bad")).crossJoin(manifest.agg(F.count("*").alias("n")))
    status = F.when(F.col("bad") > 0, FAIL).when((F.col("gone") > 0) | (F.col("n") == 0), MISSING).otherwise(PASS)
    return sums.crossJoin(told).select(F.lit(name).alias("name"), status.alias("status"), "note")


def hash_gate(spark: SparkSession, name: str, recorded: str | None, got: str | None) -> DataFrame:
    """Is an artifact there (got: its hash) and what its record says? One without a record fails."""
    status = MISSING if got is None else PASS if recorded == got else FAIL
    return gate(spark, name, status, "" if status != FAIL else f"recorded {recorded}, is {got}")


def rules_gate(name: str, failed: DataFrame) -> DataFrame:
    """Does a check (failed: an array of names of broken rules, in one row; no row if it did not run) report none?"""
    f = failed.agg(F.count("*").alias("n"), F.max("failed").alias("failed"))
    status = F.when(F.col("n") == 0, MISSING).when(F.size("failed") == 0, PASS).otherwise(FAIL)
    return f.select(F.lit(name).alias("name"), status.alias("status"), F.coalesce(F.array_join("failed", ", "), F.lit("")).alias("note"))


def readiness(gates: list[DataFrame]) -> DataFrame:
    """All gates in one table, each name once: another one of a name is an error."""
    out = reduce(DataFrame.unionByName, gates)
    if (twice := out.groupBy("name").count().where("count > 1").first()) is not None:
        raise ValueError(f"two gates named {twice.name}")
    return out


def summary(gates: DataFrame) -> DataFrame:
    """total, passed, failed, human, missing (or skipped), failing (names), ready (nothing failed or missing)."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    s = gates.agg(F.count("*").alias("total"), of(PASS).alias("passed"), of(FAIL).alias("failed"), of(HUMAN).alias("human"), of(MISSING, SKIPPED).alias("missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == FAIL, F.col("name")))), ",").alias("failing"))
    return s.withColumn("ready", (F.col("failed") == 0) & (F.col("missing") == 0))


def recorded(gates: DataFrame, previous: DataFrame | None, path: str, allow: bool = False) -> DataFrame:
    """Write gates to path and return them, unless previous (name, status) had gates passed that are not measured now: that
    is an error, with allow none. A gate that fails now is always told, whatever it was before."""
    if previous is not None and not allow:
        weaker = degraded(previous, gates).orderBy("name").collect()
        if weaker:
            raise ValueError("measured less than the record: " + "; ".join(f"{r.name} {r.old} -> {r.new}" for r in weaker))
    gates.coalesce(1).write.mode("errorifexists").json(path)
    return gates.sparkSession.read.schema(GATE).json(path)
