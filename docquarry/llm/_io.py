"""Sessions, shared folders and tables that cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that a batch from the JVM to Python may hold; texts are long, so Spark's 10,000 rows would be tens of MB.
ARROW_ROWS, ARROW_BYTES = 1000, 1 << 20
#: Folders of local sessions without a shared folder, by application.
_LOCAL: dict[str, str] = {}


def configure(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, where it has no bounds of its own; they are read when a frame runs, so they stay."""
    for name, default, own in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", str((1 << 31) - 1), ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) in (default, f"{default}b"):
            spark.conf.set(key, str(own))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        app = spark.sparkContext.applicationId
        found = _LOCAL.setdefault(app, _LOCAL.get(app) or tempfile.mkdtemp(prefix="docquarry-"))
    return found.rstrip("/")


#: Whether Spark removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the tables of written() are.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, drop: Iterable[DataFrame] = ()) -> DataFrame:
    """The frame as a Parquet table in the shared folder: it cuts lineage and outlives lost executors.

    The tables of the frames in `drop`, from calls before, are deleted once this one stands: nothing may read them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads this step's shuffle files again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    for old in drop:
        dropped(old)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # keeps the driver's heap small
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(old: DataFrame) -> None:
    """Deletes a table of written()."""
    sc, path = old.sparkSession.sparkContext, _PATHS.pop(old)
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
