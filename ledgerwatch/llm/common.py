"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage defines it (Java and Python agree on it).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves on one machine, as in tests; a cluster needs the setting, since its executors would write where nobody else can read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerwatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor never repeats what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerwatch-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _places[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote. For those alone from which nothing will be read again, since all that was made of them is stored itself."""
    for table in tables:
        if path := _places.pop(table, None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_frugal: list[bool] = []


def frugal() -> None:
    """In a Python worker: arrays from 1 MB on go back to the system when they are freed. Workers live on between tasks, and what they keep counts against the executor."""
    if not _frugal:
        _frugal.append(True)
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
            pa.set_memory_pool(pa.system_memory_pool())
        except (OSError, AttributeError):
            pass  # another C library: only the memory kept between tasks is larger


#: Rows of an Arrow batch between Spark and Python while intermediate tables are written; Spark itself bounds a batch's bytes (64 MB).
BATCH_ROWS = 2_000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Spark's default number of rows in an Arrow batch is lowered to BATCH_ROWS and put back; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if before != "10000":
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_batches(df: DataFrame, setup: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, max_bytes: int = 8 << 20, max_rows: int = 1 << 30) -> DataFrame:
    """``mapInArrow`` with slices of about ``max_bytes``, so that memory stays bounded when texts are long. ``setup`` makes the function once for each task: what it remembers goes with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        fn = setup()
        for batch in batches:
            for part in slices(batch, max_bytes, max_rows):
                yield fn(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int, max_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    step = max(1, min(max_rows, int(batch.num_rows * max_bytes / max(1, batch.nbytes))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def fits_broadcast(df: DataFrame, rows: int, at_most: int = 200_000) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted ``rows`` are few; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if rows <= at_most else df


#: Rows of one key beyond which a join deals them over several tasks, and keys that are dealt so at most: those with the most rows. A key beyond these holds less than 1 / HOT_KEYS of all rows.
SPLIT = 200
HOT_KEYS = 100_000


def salted_join(big: DataFrame, small: DataFrame, key: str, also: tuple[str, ...] = (), how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` by ``key`` (and ``also``), where rows of ``big`` with a frequent key go to as many tasks as they need, and ``small``'s rows of that key to all of these.

    ``counts(key, n)``: rows of ``big`` by key, if they are known. ``big`` reads stored tables, so that a repeated task deals its rows as before. ``how``: inner or left.
    """
    counts = counts if counts is not None else big.groupBy(key).agg(F.count("*").alias("n"))
    hot = counts.filter(F.col(key).isNotNull() & (F.col("n") > SPLIT)).orderBy(F.col("n").desc(), key).limit(HOT_KEYS)
    found = hot.select(key, F.ceil(F.col("n") / SPLIT).cast("int").alias("salts")).collect()
    if not found:
        return big.join(small, [key, *also], how)
    many = F.broadcast(big.sparkSession.createDataFrame(found, f"`{key}` {big.schema[key].dataType.simpleString()}, salts int"))
    # other keys are joined as ever, on partitions that are there already; only the frequent keys' rows are dealt
    plain = big.join(many, key, "left_anti").join(small, [key, *also], how)
    dealt = big.join(many, key).withColumn("salt", F.floor(F.rand(17) * F.col("salts")).cast("int")).drop("salts")
    copied = small.join(many, key).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
    return plain.unionByName(dealt.join(copied, [key, *also, "salt"], how).drop("salt"))


def each_of(rows: DataFrame, count: str, number: str) -> DataFrame:
    """Each row as often as its ``count`` says, numbered from 0; in two steps, so that no row makes an array of a million places."""
    step = 1 << 12
    out = rows.filter(F.col(count) > 0).withColumn("_low", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {step})")))
    return out.withColumn(number, F.explode(F.expr(f"sequence(_low * {step}L, least(cast({count} as long) - 1, _low * {step}L + {step - 1}))"))).drop("_low")
