"""Tumbling-window detectors, behaviour sequences, throughput and latency."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTE, HOUR = 60_000, 3_600_000


def window_start(ms: int, column: str = "event_ms"):
    return F.expr(f"{column} div {ms} * {ms}")


#: Transactions to a task: a task sorts its rows, so its memory follows from this and not from the size of the input.
TASK_ROWS = 50_000

#: Senders are put into so many buckets: a busy segment or receiver meets in one task as a row a bucket, not as all of its senders.
BUCKETS = 64


def in_buckets(rows: DataFrame, cut: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with the ``bucket`` of their sender, dealt by ``cut`` and bucket to tasks by their number, and the number of tasks."""
    tasks = rows.count() // TASK_ROWS + 2
    return rows.withColumn("bucket", F.expr(f"pmod(hash(name_orig), {BUCKETS})")).repartition(tasks, *cut, "bucket"), tasks


def ip_gang(tx: DataFrame) -> DataFrame:
    """Half-hour windows of an ip segment with several senders of large, risky transfers."""
    cut = ["ip_segment", "window_ms"]
    rows = tx.filter("type = 'TRANSFER' and amount > 8000 and (device_risk_level = 'HIGH' or transaction_hour >= 20)").withColumn("window_ms", window_start(30 * MINUTE))
    rows, tasks = in_buckets(rows, cut)
    # first by sender, then by bucket of senders
    per = rows.groupBy(*cut, "bucket", "name_orig").agg(F.sum("amount").alias("amount"), F.min("event_ms").alias("lo"), F.max("event_ms").alias("hi"), F.min(F.struct("event_ms", "tx_id")).alias("first"))
    some = per.groupBy(*cut, "bucket").agg(F.count("*").alias("accounts"), F.sum("amount").alias("amount"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("name_orig", "first").alias("account_id"), F.min("first").alias("first"))
    both = some.repartition(tasks, *cut).groupBy(*cut).agg(
        F.sum("accounts").alias("accounts"), F.sum("amount").alias("total_amount"), F.min("lo").alias("min_ms"), F.max("hi").alias("max_ms"), F.min_by("account_id", "first").alias("account_id"), F.min("first")["tx_id"].alias("first_tx")
    )
    confidence = F.expr("least(1.0D, 0.45D + (accounts - 2) * 0.08D + total_amount / 400000.0D)")
    return both.filter("accounts >= 2 and total_amount > 30000").withColumn("confidence", confidence).filter("confidence > 0.6")


def scatter_in(tx: DataFrame) -> DataFrame:
    """Two-hour windows in which several senders pay into one account."""
    cut = ["name_dest", "window_ms"]
    rows = tx.filter("type = 'TRANSFER' and amount > 3000 and amount < 30000").withColumn("window_ms", window_start(2 * HOUR))
    rows, tasks = in_buckets(rows, cut)
    per = rows.groupBy(*cut, "bucket", "name_orig").agg(F.sum("amount").alias("amount"), F.min("event_ms").alias("lo"), F.max("event_ms").alias("hi"), F.max(F.struct("event_ms", "tx_id")).alias("last"))
    some = per.groupBy(*cut, "bucket").agg(F.count("*").alias("senders"), F.sum("amount").alias("amount"), F.max("amount").alias("max_sender"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("last").alias("last"))
    both = some.repartition(tasks, *cut).groupBy(F.col("name_dest").alias("account_id"), "window_ms").agg(
        F.sum("senders").alias("senders"), F.sum("amount").alias("total_amount"), F.max("max_sender").alias("max_sender"), F.min("lo").alias("min_ms"), F.max("hi").alias("max_ms"), F.max("last")["tx_id"].alias("last_tx")
    )
    confidence = F.expr("least(1.0D, 0.4D + (senders - 2) * 0.1D + total_amount / 100000.0D + if(max_sender / (total_amount / senders) > 3.0, 0.1D, 0.0D))")
    return both.filter("senders >= 2 and total_amount > 15000").withColumn("confidence", confidence).filter("confidence > 0.5")


def duplicated(tx: DataFrame) -> DataFrame:
    """Each transaction once for its sender and once for its receiver, in ``tracking_account``."""
    return tx.withColumn("tracking_account", F.explode(F.array("name_orig", "name_dest")))


SEQ_FIELDS = ["event_ms", "tx_id", "amount", "type", "name_orig", "name_dest", "city", "device_id", "pay_channel", "transaction_hour", "device_risk_level", "is_abroad", "oldbalance_org", "ip_segment", "is_fraud", "fraud_type"]


def sessions(rows: DataFrame, key: str, order: str, gap_ms: int, slice_ms: int = HOUR, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``slice`` and ``session``: sessions of a key, from 1, end where the next row comes more than ``gap_ms`` later. Rows at one time are in order of ``order``.

    A key's rows are cut into slices of time, each a window of its own, so that a busy key is spread over as many tasks as it has slices. What is open at a slice's ends is stitched from one summary row a
    slice: its first and last time and the sessions that begin inside. Slices are dealt to ``tasks``, if given.
    """
    cut = [key, "slice"]
    rows = rows.withColumn("slice", F.expr(f"event_ms div {slice_ms}"))
    rows = rows.repartition(tasks, *cut) if tasks else rows
    ordered = Window.partitionBy(*cut).orderBy("event_ms", order)
    rows = rows.withColumn("_new", F.coalesce((F.col("event_ms") - F.lag("event_ms").over(ordered) > gap_ms).cast("long"), F.lit(0)))
    rows = rows.withColumn("_inner", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*cut).agg(F.min("event_ms").alias("_lo"), F.max("event_ms").alias("_hi"), F.max("_inner").alias("_begun"))
    ends = ends.repartition(tasks, key) if tasks else ends
    over = Window.partitionBy(key).orderBy("slice")
    opens = F.coalesce((F.col("_lo") - F.lag("_hi").over(over) > gap_ms).cast("long"), F.lit(1))
    ends = ends.withColumn("_opens", opens).withColumn("_before", F.sum(F.col("_opens") + F.col("_begun")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_begun"))
    return rows.join(ends.select(*cut, "_before"), cut).withColumn("session", F.col("_before") + F.col("_inner")).drop("_new", "_inner", "_before")


def sequences(tx: DataFrame, gap_ms: int = 60_000, longest: int = 10, slice_ms: int = HOUR) -> DataFrame:
    """Behaviour sequences: every session of a tracked account without a gap above ``gap_ms``, at least two transactions, the last ``longest`` of them in order.

    Of a session only its last rows in each slice go on to be collected, so an account that never pauses stays bounded. Slices and sessions are dealt to tasks by the number of transactions.
    """
    account, cut = F.col("tracking_account"), ["tracking_account", "slice"]
    tasks = tx.count() // TASK_ROWS + 2
    rows = sessions(duplicated(tx).select("tracking_account", *SEQ_FIELDS), "tracking_account", "tx_id", gap_ms, slice_ms, tasks)
    newest = [F.col("event_ms").desc(), F.col("tx_id").desc()]
    last = F.row_number().over(Window.partitionBy(*cut, "session").orderBy(*newest))
    rows = rows.withColumn("back", last).filter(F.col("back") <= max(2, longest))
    rows = rows.repartition(tasks, "tracking_account", "session")
    whole = Window.partitionBy("tracking_account", "session")
    # counted before rows are collected, so that nothing is ever computed of a single transaction
    rows = rows.withColumn("size", F.count("*").over(whole)).filter("size >= 2").withColumn("back", F.row_number().over(whole.orderBy(*newest))).filter(F.col("back") <= longest)
    return rows.groupBy(account.alias("account_id"), "session").agg(F.array_sort(F.collect_list(F.struct(*SEQ_FIELDS))).alias("txs"))


def throughput(tx: DataFrame) -> DataFrame:
    """Transactions a minute, and over the last 5 and 15 minutes."""
    minutes = tx.groupBy(window_start(MINUTE).alias("minute_ms")).agg(F.count("*").alias("n"))
    day = F.expr(f"minute_ms div {24 * HOUR}")
    # one task never holds all minutes: each day also gets the quarter of an hour before it
    spread = minutes.withColumn("day", F.explode(F.array_distinct(F.array(day, F.expr(f"(minute_ms + {15 * MINUTE}) div {24 * HOUR}")))))
    over = lambda m: F.sum("n").over(Window.partitionBy("day").orderBy("minute_ms").rangeBetween(-(m - 1) * MINUTE, 0))
    return spread.select("minute_ms", "day", F.col("n").alias("per_1m"), over(5).alias("per_5m"), over(15).alias("per_15m")).filter(f"day = minute_ms div {24 * HOUR}").drop("day")


def latency_percentiles(values: DataFrame, group: str, value: str, ranks=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact ranks ``min(int(n * p), n - 1)`` of each group, with least, greatest and mean. Values are counted first, so a large group of equal values is small."""
    counted = values.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1), F.col(value)))
    return ranked.groupBy(group).agg(
        F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"), *[at(p).alias(f"p{int(p * 100)}") for p in ranks]
    )

