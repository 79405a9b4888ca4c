"""Evaluation against labels: running totals, per-type ratios, confusion counts, layer subsets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARED_ACCOUNTS = ["C8888888", "C9999999", "UNKNOWN", "NONE"]


def totals(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """Two one-row aggregates side by side."""
    has = lambda s: F.coalesce(F.sum(F.col("source").contains(s).cast("long")), F.lit(0))
    t = tx.agg(F.count("*").alias("total_transactions"))
    a = alerts.agg(F.count("*").alias("total_alerts"), has("CEP").alias("cep_alerts"), has("ML").alias("ml_alerts"), (has("FUSION") + has("MERGED")).alias("fusion_alerts"))
    rate = F.expr("round(if(total_transactions > 0, total_alerts / total_transactions, 0.0D), 4)")
    return t.join(F.broadcast(a)).withColumn("alert_rate", rate)


def by_type(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts of alerts and of labelled transactions by type, and the ratios taken from the counts."""
    a = alerts.groupBy("fraud_type").agg(F.count("*").alias("alert_count"), F.avg("confidence").alias("avg_confidence"))
    r = tx.filter("is_fraud = 1 or is_flagged_fraud = 1").groupBy("fraud_type").agg(F.count("*").alias("real_count"))
    both = a.join(r, "fraud_type", "left").fillna({"real_count": 0})
    both = both.withColumns({"type_precision": F.expr("least(1.0D, real_count / alert_count)"), "type_recall": F.expr("if(real_count > 0, least(1.0D, alert_count / real_count), 0.0D)")})
    return both.withColumn("type_f1", F.expr("if(type_precision + type_recall > 0, 2 * type_precision * type_recall / (type_precision + type_recall), 0.0D)"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``scored(account_id, n, probability, label)`` as confusion counts and their ratios."""
    rows = scored.filter(~F.col("account_id").isin(SHARED_ACCOUNTS) & (F.col("n") >= 2)).withColumn("hit", F.col("probability") >= threshold)
    c = lambda hit, label: F.count(F.when((F.col("hit") == hit) & (F.col("label") == label), 1))
    m = rows.agg(c(True, 1).alias("tp"), c(True, 0).alias("fp"), c(False, 0).alias("tn"), c(False, 1).alias("fn"))
    m = m.withColumns({"precision": F.expr("if(tp + fp > 0, tp / (tp + fp), 0.0D)"), "recall": F.expr("if(tp + fn > 0, tp / (tp + fn), 0.0D)"), "accuracy": F.expr("if(tp + fp + tn + fn > 0, (tp + tn) / (tp + fp + tn + fn), 0.0D)")})
    return m.withColumn("f1", F.expr("if(precision + recall > 0, 2 * precision * recall / (precision + recall), 0.0D)"))


def history(scored: DataFrame, every_ms: int = 3_600_000, threshold: float = 0.5) -> DataFrame:
    """``scored(account_id, n, probability, label, end_ms)``: confusion counts of all sequences up to the end of each interval, and their ratios. Sequences are counted by interval first, so only a row an interval is summed up in order."""
    rows = scored.filter(~F.col("account_id").isin(SHARED_ACCOUNTS) & (F.col("n") >= 2)).withColumn("hit", F.col("probability") >= threshold)
    c = lambda hit, label: F.count(F.when((F.col("hit") == hit) & (F.col("label") == label), 1))
    each = rows.groupBy(F.expr(f"end_ms div {every_ms}").alias("sample_id")).agg(c(True, 1).alias("tp"), c(True, 0).alias("fp"), c(False, 0).alias("tn"), c(False, 1).alias("fn"))
    upto = Window.orderBy("sample_id").rowsBetween(Window.unboundedPreceding, 0)
    m = each.select("sample_id", *[F.sum(k).over(upto).alias(k) for k in ("tp", "fp", "tn", "fn")])
    m = m.withColumns({"total_samples": F.expr("tp + fp + tn + fn"), "fraud_samples": F.expr("tp + fn"), "normal_samples": F.expr("fp + tn"), "precision": F.expr("if(tp + fp > 0, tp / (tp + fp), 0.0D)"), "recall": F.expr("if(tp + fn > 0, tp / (tp + fn), 0.0D)"), "accuracy": F.expr("(tp + tn) / (tp + fp + tn + fn)")})
    return m.withColumn("f1", F.expr("if(precision + recall > 0, 2 * precision * recall / (precision + recall), 0.0D)"))


def mark_repeats(alerts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Whether an alert is its account's first of a type, in order of time; nothing is dropped. Accounts and types are dealt to ``tasks``, if given."""
    alerts = alerts.repartition(tasks, "account_id", "fraud_type") if tasks else alerts
    order = Window.partitionBy("account_id", "fraud_type").orderBy("event_ms", "alert_id")
    return alerts.withColumn("dedup", F.when(F.row_number().over(order) == 1, "pass_first").otherwise("pass_duplicate"))


def layer_subsets(labels: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each non-empty subset of the four layers: an account counts as found if a layer of the subset alerts it. Layers become bits, subsets a 15-row table."""
    bit = F.expr("case when source like 'CEP%' then 1 when source like 'SQL%' then 2 when source like 'GRAPH%' then 4 else 8 end")
    flags = alerts.groupBy("account_id").agg(F.bit_or(bit).alias("bits"))
    rows = labels.join(flags, "account_id", "left").fillna({"bits": 0}).groupBy("label", "bits").agg(F.count("*").alias("n"))  # at most 32 rows
    sets = rows.sparkSession.range(1, 16).select(F.col("id").cast("int").alias("layers"))
    both = sets.join(F.broadcast(rows)).withColumn("hit", F.expr("bits & layers <> 0"))
    c = lambda hit, label: F.coalesce(F.sum(F.when((F.col("hit") == hit) & (F.col("label") == label), F.col("n"))), F.lit(0))
    return both.groupBy("layers").agg(c(True, 1).alias("tp"), c(True, 0).alias("fp"), c(False, 0).alias("tn"), c(False, 1).alias("fn"))
