"""The stored alert table that the serving queries read, so that no request makes the alerts anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import ALERT
from ..sources import sinks
from ..sources.adapter import transactions
from ..tables import run_dir
from . import detect

KEYS = ["alert_id"]
_tables: dict[tuple, str] = {}


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """What tells one state of an input folder from another: bytes, files and the time of its last change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = system.getContentSummary(where)
    return summary.getLength(), summary.getFileCount(), system.getFileStatus(where).getModificationTime()


def refresh(spark: SparkSession, path: str, alerts: DataFrame, batch_id: int) -> None:
    """Add a batch of alerts to the table; a batch that comes again replaces itself, an alert that comes again its older row. Usable as it is from ``foreachBatch``."""
    sinks.upsert_batch(path, KEYS, ["event_ms"])(alerts, batch_id)


def table(spark: SparkSession, path: str) -> DataFrame:
    return sinks.read_upserted(spark, path, KEYS).select(*[f.name for f in ALERT])


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule alerts of the input as they are stored. The table is filled when the input is first asked for, and again when the input has changed; nothing else makes alerts."""
    source = f"{sf_dir}/events.parquet"
    key = (spark.sparkContext.applicationId, source, *fingerprint(spark, source))
    if key not in _tables:
        path = f"{run_dir(spark)}/alerts-{len(_tables)}"
        refresh(spark, path, detect.rule_alerts(transactions(spark, sf_dir)), 0)
        _tables[key] = path
    return table(spark, _tables[key])
