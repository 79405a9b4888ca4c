"""Cross-account joins: chains of transfers, scatter to cash-out, tags as of a time.

Range joins carry an equi-key on the account and a time bin as wide as the range, so that one busy account is spread over its bins and each row meets three bins, not all of the account's rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CONTEXT

HOUR = 3_600_000


def range_join(left: DataFrame, right: DataFrame, key_l: str, key_r: str, low_ms: int, high_ms: int, tasks: int | None = None) -> DataFrame:
    """Pairs with equal keys and ``right.event_ms - left.event_ms`` in [low, high]; columns get the prefixes ``l_`` and ``r_``. Bins are dealt to ``tasks``, if given."""
    width = max(1, high_ms - low_ms)
    lo = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    ro = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    first, last = F.expr(f"floor((l_event_ms + {low_ms}L) / {width})"), F.expr(f"floor((l_event_ms + {high_ms}L) / {width})")
    lo = lo.withColumn("bin", F.explode(F.sequence(first, last)))
    ro = ro.withColumn("bin", F.expr(f"floor(r_event_ms / {width})"))
    if tasks:
        lo, ro = lo.repartition(tasks, f"l_{key_l}", "bin"), ro.repartition(tasks, f"r_{key_r}", "bin")
    same = (F.col(f"l_{key_l}") == F.col(f"r_{key_r}")) & (lo["bin"] == ro["bin"])
    return lo.join(ro, same & F.expr(f"r_event_ms - l_event_ms between {low_ms} and {high_ms}")).drop("bin")


def chain_scores(diff: str = "time_diff", decay: str = "decay"):
    """Confidence of a chain A to B to C."""
    return F.expr(
        f"""least(1.0D, case when {diff} < 300 then 0.35D when {diff} < 1800 then 0.25D when {diff} < 3600 then 0.15D else 0.05D end
        + case when l_amount > 100000 then 0.35D when l_amount > 50000 then 0.25D when l_amount > 10000 then 0.15D else 0.05D end
        + case when {decay} < 0.15 then 0.35D when {decay} < 0.3 then 0.25D else 0.15D end + 0.25D)"""
    )


#: Pairs that meet at an account are put in order in slices of time, each a window of its own, so a task never holds an account.
SLICE_MS = 600_000

#: Transactions to a task of a join: a task sorts its pairs, so its memory follows from this and not from the size of the input.
TASK_ROWS = 25_000

SLICE = ["l_name_dest", "slice"]
PAIR_ORDER = ["at_ms", "l_event_ms", "r_event_ms", "l_tx_id", "r_tx_id"]


def in_slices(pairs: DataFrame) -> DataFrame:
    """Pairs with ``at_ms``, when their later transaction came, and the ``slice`` of it."""
    return pairs.withColumn("at_ms", F.greatest("l_event_ms", "r_event_ms")).withColumn("slice", F.expr(f"at_ms div {SLICE_MS}"))


def dealt(pairs: DataFrame, carried: DataFrame, tasks: int) -> DataFrame:
    """``pairs`` and a row for each slice with what comes from the slices before it; that row has no ``at_ms`` and so is the first of its slice."""
    return pairs.unionByName(carried, allowMissingColumns=True).repartition(tasks, *SLICE)


def in_order():
    return Window.partitionBy(*SLICE).orderBy(*PAIR_ORDER)


DISTINCT_PARTIES = "l_name_orig <> r_name_dest and l_name_orig <> l_name_dest and r_name_orig <> r_name_dest"


def chains(tx: DataFrame) -> DataFrame:
    """Interval self-join A->B, B->C within two hours either way. A pair (A, C) equal to the one before it at B is skipped."""
    moves = tx.filter("type = 'TRANSFER' and amount > 5000")
    tasks = moves.count() // TASK_ROWS + 2
    pairs = in_slices(range_join(moves, moves, "name_dest", "name_orig", -2 * HOUR, 2 * HOUR, tasks).filter(DISTINCT_PARTIES))
    pairs = pairs.withColumn("pair", F.concat_ws("->", "l_name_orig", "r_name_dest"))
    ends = pairs.groupBy(*SLICE).agg(F.max_by("pair", F.struct(*PAIR_ORDER)).alias("pair"))
    ends = ends.withColumn("pair", F.lag("pair").over(Window.partitionBy("l_name_dest").orderBy("slice"))).filter("pair is not null")
    pairs = dealt(pairs, ends, tasks).withColumn("before", F.lag("pair").over(in_order())).filter("at_ms is not null and (before is null or before <> pair)")
    pairs = pairs.withColumn("time_diff", F.expr("abs(r_event_ms - l_event_ms) / 1000.0D")).withColumn("decay", F.expr("if(l_amount > 0, abs(l_amount - r_amount) / l_amount, 0.0D)"))
    return pairs.withColumn("confidence", chain_scores()).filter("confidence > 0.6")


def chains_in_windows(tx: DataFrame) -> DataFrame:
    """The same within tumbling hours, larger transfers, each (A, C) once in a window."""
    moves = tx.filter("type = 'TRANSFER' and amount > 10000").withColumn("window_ms", F.expr(f"event_ms div {HOUR} * {HOUR}"))
    lo, ro = moves.select([F.col(c).alias(f"l_{c}") for c in moves.columns]), moves.select([F.col(c).alias(f"r_{c}") for c in moves.columns])
    pairs = lo.join(ro, (F.col("l_name_dest") == F.col("r_name_orig")) & (F.col("l_window_ms") == F.col("r_window_ms"))).filter(DISTINCT_PARTIES)
    order = Window.partitionBy("l_name_dest", "l_window_ms", "l_name_orig", "r_name_dest").orderBy("l_event_ms", "l_tx_id", "r_event_ms", "r_tx_id")
    pairs = pairs.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    pairs = pairs.withColumn("time_diff", F.expr("(r_event_ms - l_event_ms) / 1000.0D")).withColumn("decay", F.expr("if(l_amount > 0, abs(l_amount - r_amount) / l_amount, 0.0D)"))
    return pairs.withColumn("confidence", chain_scores()).filter("confidence > 0.7")


def scatter_cashout(tx: DataFrame) -> DataFrame:
    """Transfers into an account and its cash-out: the first joined pair whose cash-out reaches 70 % of what has been counted in fires, once an account."""
    ins = tx.filter("type = 'TRANSFER' and amount > 3000 and amount < 30000")
    outs = tx.filter("type = 'CASH_OUT' and amount > 15000")
    tasks = ins.count() // TASK_ROWS + 2
    pairs = in_slices(range_join(ins, outs, "name_dest", "name_orig", -HOUR, 3 * HOUR, tasks))
    # added as decimals, so that what is carried doesn't hang on the order in which tasks end
    sums = pairs.groupBy(*SLICE).agg(F.sum(F.col("l_amount").cast("decimal(28,9)")).alias("l_amount"), F.min("l_event_ms").alias("l_event_ms"))
    earlier = Window.partitionBy("l_name_dest").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*SLICE, F.sum("l_amount").over(earlier).cast("double").alias("l_amount"), F.min("l_event_ms").over(earlier).alias("l_event_ms")).filter("l_event_ms is not null")
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    pairs = dealt(pairs, sums, tasks).withColumns({"total_in": F.sum("l_amount").over(upto), "min_ms": F.min("l_event_ms").over(upto)}).filter("at_ms is not null")
    hits = pairs.withColumn("ratio", F.expr("if(total_in > 0, r_amount / total_in, 0.0D)")).filter("ratio >= 0.7")
    picked = ["l_tx_id", "r_tx_id", "total_in", "min_ms", "ratio", "r_amount", *[f"r_{c}" for c in CONTEXT if c != "amount"]]
    first = hits.groupBy(F.col("l_name_dest").alias("account_id")).agg(F.min_by(F.struct(*picked), F.struct(*PAIR_ORDER)).alias("f")).select("account_id", "f.*")
    first = first.withColumn("time_diff", F.expr("abs(r_event_ms - min_ms) / 1000.0D"))
    confidence = F.expr("least(1.0D, 0.45D + (ratio - 0.7D) * 0.5D + if(total_in > 50000, 0.25D, 0.15D) + case when time_diff < 1800 then 0.25D when time_diff < 3600 then 0.15D else 0.1D end)")
    return first.withColumn("confidence", confidence).filter("confidence > 0.5")


TAG_MS = 300_000


def tag_as_of(tx: DataFrame, tags: DataFrame, slice_ms: int = HOUR) -> DataFrame:
    """Each transaction with the newest tag (``account_id``, ``rule``, ``tag_ms``) of its sender at or before it, matched if at most five minutes old; of tags at one time the greatest rule's.

    A tag reaches five minutes ahead, so an account's rows are cut into slices of time, and a tag goes to the slice it lies in and, near its end, to the next one too.
    """
    cut = lambda ms: F.expr(f"{ms} div {slice_ms}")
    rows = tx.select(F.col("name_orig").alias("k"), cut("event_ms").alias("slice"), F.col("event_ms").alias("t"), F.lit(1).alias("side"), F.col("tx_id").alias("id"), F.struct(*tx.columns).alias("row"), F.lit(None).cast("struct<tag_ms:bigint,rule:string>").alias("tag"))
    both = F.explode(F.array_distinct(F.array(cut("tag_ms"), cut(f"(tag_ms + {TAG_MS})")))).alias("slice")
    marks = tags.select(F.col("account_id").alias("k"), both, F.col("tag_ms").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct("tag_ms", "rule").alias("tag"))
    before = Window.partitionBy("k", "slice").orderBy("t", "side", F.col("tag.rule"), "id").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.unionByName(marks).withColumn("tag", F.last("tag", ignorenulls=True).over(before)).filter("side = 1")
    matched = F.expr(f"coalesce(t - tag.tag_ms <= {TAG_MS}, false)")
    return joined.select("row.*", matched.alias("is_cep_matched"), F.when(matched, F.col("tag.rule")).otherwise("NONE").alias("cep_rule_name"))
