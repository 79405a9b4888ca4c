"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine, where it is missing, a temporary folder. A cluster needs the setting: its executors would write where nobody else can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerwatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """One folder for all tables of this application, deleted when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/ledgerwatch-{app}-{uuid.uuid4().hex[:8]}"
        where = spark._jvm.org.apache.hadoop.fs.Path(_runs[app])
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())

        def delete() -> None:
            with contextlib.suppress(Exception):  # the JVM may have ended before
                system.delete(where, True)

        atexit.register(delete)
    return _runs[app]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table of this run and read it back: what reads it twice makes it once, and a lost executor never repeats what came before."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
