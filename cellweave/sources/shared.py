"""Tables in the folder that driver and executors share (spark.checkpoint.dir): where lineage is cut."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
#: By application, the temporary folder of a session that names none.
LOCAL: dict[str, str] = {}
OPEN_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("cellweave_run", default=None)


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder. Where it names none, a temporary one, but on one machine (a local master) alone."""
    root = spark.conf.get(FOLDER, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {FOLDER} to a folder that driver and executors share: master is {master!r}")
        root = LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.gettempdir()}/cellweave-{uuid.uuid4().hex}")
    return root.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared one, or below that of the open run_folder."""
    return f"{OPEN_RUN.get() or shared_root(spark)}/cellweave-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and no executor's loss matters."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """All tables that operators write inside the block lie below one folder, which goes at its end.

    Results are lazy and read those tables: write or collect them inside the block.
    """
    path = f"{shared_root(spark)}/cellweave-run-{uuid.uuid4().hex}"
    token = OPEN_RUN.set(path)
    try:
        yield path
    finally:
        OPEN_RUN.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
