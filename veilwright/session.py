"""Sending this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_veilwright_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="veilwright-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(path)
    sc._veilwright_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset on a single machine, a folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='veilwright-shared-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out over as many tasks as shuffles have where its files would give few: a file is read in as
    many tasks as it has row groups, often one, and work that is heavy for each row would be done there."""
    spark = table.sparkSession
    tasks = table._jdf.queryExecution().toRdd().getNumPartitions()
    least = 4 * spark.sparkContext.defaultParallelism
    return table if tasks >= least else table.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), least))


def exchange_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that are written and read again. They go when the driver's Python ends."""
    path = f"{shared_folder(spark)}/veilwright/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder (see exchange_path), computed once however often it is read."""
    spark, path = df.sparkSession, exchange_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is then left to its owner
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint()
