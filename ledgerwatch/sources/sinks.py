"""Sinks: tables with keys, topics, parameter files."""

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys of the result tables.
KEYS = {
    "fraud_alert_result": ["alert_id"],
    "fraud_evaluation_metrics": ["metric_time"],
    "fraud_evaluation_detail": ["metric_time", "fraud_type"],
    "fraud_validation_result": ["sample_id"],
    "fraud_normal_transaction": ["tx_id"],
    "fraud_feedback_confirmed": ["feedback_id"],
    "fraud_feedback_false_positive": ["feedback_id"],
    "fraud_drift_event": ["event_id"],
    "fraud_feedback_stats": ["stat_id"],
}


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key. Aggregated on the map side, so many versions of one key don't meet in a task."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def upsert_batch(path: str, keys: list[str], order: list[str] | None = None):
    """A ``foreachBatch`` function of a keyed table. Each batch writes its own directory, named by its id, so a repeated batch replaces itself; readers keep a key's newest row.

    Of rows of one key in one batch the last by ``order`` stays (ties: by the row's hash), so which one wins is never left to chance.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c not in keys]
        rank = F.struct(*[F.col(c) for c in order or []], F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in others or keys]))
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others]) if others else batch.distinct()
        newest.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _parts(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Finished directories ``<kind>=<number>`` under ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/_SUCCESS")) or []
    names = [f.getPath().getParent().getName() for f in found]
    return {int(n.split("=")[1]): f"{path}/{n}" for n in names}


def _current(spark: SparkSession, path: str) -> list[str]:
    """The newest compacted base and the batches after it."""
    bases, batches = _parts(spark, path, "base"), _parts(spark, path, "batch")
    upto = max(bases, default=-1)
    return ([bases[upto]] if bases else []) + [p for n, p in sorted(batches.items()) if n > upto]


def read_upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key. A table that is one compacted base is read as it lies."""
    now = _current(spark, path)
    if not now:
        raise FileNotFoundError(f"no finished batch under {path}")
    rows = spark.read.option("mergeSchema", "true").parquet(*now)
    return (rows if len(now) == 1 else latest(rows, keys, "_batch")).drop("_batch")


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Write all batches so far as one base. A reader takes a base when it is finished; what it replaces goes at the next compaction, so that readers that began before can end."""
    batches, bases = _parts(spark, path, "batch"), _parts(spark, path, "base")
    upto, old = max(batches, default=-1), max(bases, default=-1)
    if upto <= old:
        return
    spark.read.option("mergeSchema", "true").parquet(*_current(spark, path)).transform(lambda d: latest(d, keys, "_batch")).write.mode("overwrite").parquet(f"{path}/base={upto}")
    root = spark._jvm.org.apache.hadoop.fs.Path
    system = root(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n, p in [*batches.items(), *bases.items()]:
        if n <= old and p != bases.get(old):
            system.delete(root(p), True)


def write_kafka(alerts: DataFrame, servers: str, topic: str, checkpoint: str):
    """Alerts as JSON to a topic. Needs Spark's Kafka package on the class path."""
    rows = alerts.select(F.col("alert_id").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "checkpointLocation": checkpoint}).start()


def preview(rows: DataFrame, n: int) -> DataFrame:
    return rows.limit(n)


def save_parameters(spark: SparkSession, path: str, version: int, parameters: dict) -> None:
    """A version of model parameters as one JSON row; a version is written once and never changed."""
    spark.createDataFrame([(version, json.dumps(parameters, sort_keys=True))], "version int, parameters string").coalesce(1).write.mode("error").json(f"{path}/version={version}")


def load_parameters(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version's parameters, the newest unless named."""
    rows = spark.read.schema("version int, parameters string").json(f"{path}/version={'*' if version is None else version}")
    return json.loads(rows.orderBy(F.col("version").desc()).first()["parameters"])


def create_tables(spark: SparkSession, schemas: dict) -> None:
    for name, schema in schemas.items():
        if not spark.catalog.tableExists(name):
            spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)


def last_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(key).desc()).limit(n)


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
