"""Messages to transactions: change envelopes, wrapped or flat JSON, CSV; and the readers and writers around them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalar import event_time, infer_hour, normalize_text
from ..schemas import MESSAGE, TX_FIELDS


def cdc_flatten(messages: DataFrame, data_type: str, at_ms: int) -> DataFrame:
    """``value`` envelopes ``{op, before, after}``: creates, reads and updates give the row after, with its kind; deletes and broken text give nothing."""
    shape = StructType([StructField("op", StringType()), StructField("after", MESSAGE)])
    m = parsed(messages, shape).filter("m.op in ('c', 'r', 'u') and m.after is not null")
    return m.select("m.after.*", F.lit(data_type).alias("_data_type"), F.when(F.col("m.op") == "u", "update").otherwise("insert").alias("_op_type"), F.lit(at_ms).cast("bigint").alias("_timestamp"))


def parse_messages(messages: DataFrame) -> DataFrame:
    """``value``: flat, or under ``data``, ``data.before`` or ``data.after``, the innermost winning. Broken text and invalid rows are dropped; missing fields take their defaults."""
    inner = StructType([*MESSAGE.fields, StructField("before", MESSAGE), StructField("after", MESSAGE)])
    shape = StructType([*MESSAGE.fields, StructField("data", inner)])
    flat = lambda path: F.when(F.col(path).isNotNull(), F.struct(*[F.col(f"{path}.{f.name}").alias(f.name) for f in MESSAGE]))
    m = parsed(messages, shape).select(F.explode(F.array(F.coalesce("m.data.after", "m.data.before", flat("m.data"), flat("m")))).alias("t")).select("t.*")
    return valid(with_defaults(m))


def parsed(messages: DataFrame, shape: StructType) -> DataFrame:
    """Column ``m``: each text parsed once. A generator keeps the optimizer from repeating the parser for every field."""
    return messages.select(F.explode(F.array(F.from_json("value", shape, {"mode": "PERMISSIVE"}))).alias("m")).filter("m is not null")


def with_defaults(m: DataFrame) -> DataFrame:
    """Snake-case columns with defaults; the hour follows from the step where it is missing."""
    out = []
    for name, column, kind, default in TX_FIELDS:
        if column == "transaction_hour":
            out.append(F.coalesce(F.col(name), F.when(F.coalesce("step", F.lit(0)) > 0, infer_hour(F.col("step"))).otherwise(0)).cast("int").alias(column))
        elif isinstance(default, str):
            out.append(normalize_text(F.col(name), default).alias(column))
        else:
            out.append(F.coalesce(F.col(name), F.lit(default).cast(kind)).alias(column))
    return m.select(*out, event_time(F.col("eventTime")).alias("event_ms"))


def valid(tx: DataFrame) -> DataFrame:
    """A known sender, a type, an amount of zero or more."""
    return tx.filter("trim(name_orig) <> '' and name_orig <> 'UNKNOWN' and trim(type) <> '' and amount >= 0")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """22 positional columns, or 23 with the event time; what can't be read takes the default."""
    return with_defaults(spark.read.schema(MESSAGE).csv(path, mode="PERMISSIVE"))


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """A topic's values as text. Needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"}).load().select(F.col("value").cast("string").alias("value"))


def read_files(spark: SparkSession, path: str, per_trigger: int = 10) -> DataFrame:
    """Text files of messages as a stream; stands in for a topic where no broker is at hand."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)


def read_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in ``parts`` ranges of a key, read in parallel. Needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()
