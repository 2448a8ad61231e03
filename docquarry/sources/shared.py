"""The folder that driver and executors share, and tables that are written there step by step."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; under a local one only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        found = tempfile.mkdtemp(prefix="docquarry-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the Parquet table under a path, in folders `by` column. The step's shuffle files go with it, and so does what the driver's
    heap still holds of its plan and its tasks: else steps add up until the heap is as large as it may be."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads this step's shuffle files again
    try:
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
