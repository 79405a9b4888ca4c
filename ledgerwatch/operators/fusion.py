"""Alert fusion: enrichment by what an account's alerts in one session add up to, filters, and the projections of the sinks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import sessions

GAP_MS = 60_000


#: Alerts to a task of the enrichment.
TASK_ROWS = 50_000


def enrich(alerts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Running hits, edges and volume of an account's session (alerts at most a minute apart) raise an alert's confidence.

    Sums run inside slices of time; what a session has gathered before a slice is carried over from one row a slice, so an account that never stops alerting is many windows. They are dealt to ``tasks``, if given. ``alerts`` are read four times: store what isn't cheap to make.
    """
    a = sessions(alerts, "account_id", "alert_id", GAP_MS, tasks=tasks)
    path = F.coalesce("behavior_path", F.lit(""))
    volume = F.coalesce(F.regexp_extract("details", r"(?:amountA|totalIn):\s*([0-9.eE+-]+)", 1).try_cast("double"), F.lit(0.0))
    hit = lambda s: F.col("source").contains(s).cast("long")
    each = {"cep_hits": hit("CEP"), "sql_hits": hit("SQL"), "ml_hits": hit("ML"), "edges": (path.contains("->") | path.contains("→")).cast("long"), "volume": F.greatest(volume, F.lit(0.0))}
    part = ["account_id", "session", "slice"]
    own = Window.partitionBy(*part).orderBy("event_ms", "alert_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("account_id", "session").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumns(each)
    a = a.repartition(tasks, *part) if tasks else a
    carried = a.groupBy(*part).agg(*[F.sum(c).alias(c) for c in each]).select(*part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in each])
    a = a.withColumns({c: F.sum(c).over(own) for c in each}).join(carried, part)
    a = a.withColumns({c: F.col(c) + F.col(f"_{c}") for c in each}).drop(*[f"_{c}" for c in each])
    bonus = F.expr(
        """least(0.15D, (cep_hits + sql_hits + ml_hits) * 0.05D) + case when edges >= 3 then 0.10D when edges >= 1 then 0.05D else 0.0D end
        + case when volume >= 50000 then 0.10D when volume >= 20000 then 0.05D else 0.0D end
        + if(cep_hits >= 1 and ml_hits >= 1, 0.08D, 0.0D) + if(sql_hits >= 1 and edges >= 2, 0.08D, 0.0D)"""
    )
    a = a.withColumn("confidence", F.least(F.lit(1.0), F.round(F.col("confidence") + bonus, 9))).withColumn("source", F.concat("source", F.lit("_ENRICHED")))
    return a.withColumn("risk_level", enriched_risk()).drop("slice")


def enriched_risk():
    return F.expr("case when confidence >= 0.90 or edges >= 4 then 'CRITICAL' when confidence >= 0.75 or edges >= 2 then 'HIGH' when confidence >= 0.55 then 'MEDIUM' else 'LOW' end")


def sink_risk():
    return F.expr("case when confidence >= 0.9 then 'HIGH' when confidence >= 0.75 then 'MEDIUM' else 'LOW' end")


def distinct_alerts(alerts: DataFrame) -> DataFrame:
    """One alert for each id; the ids say what an alert stands for."""
    return alerts.dropDuplicates(["alert_id"])


def confident(alerts: DataFrame, least: float = 0.45) -> DataFrame:
    """Known types from a confidence on."""
    return alerts.filter(~(F.col("fraud_type").startswith("UNKNOWN_PATTERN:") & F.col("source").startswith("ML_ONLY")) & (F.col("confidence") >= least))


def sink_rows(alerts: DataFrame) -> DataFrame:
    """The alert table's columns: blanks become UNKNOWN, times of day are Shanghai's."""
    text = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("UNKNOWN")).alias(c)
    return alerts.select(
        "alert_id", text("account_id"), text("fraud_type"), "confidence", text("source"), text("behavior_path"), time_of_day("event_ms").alias("alert_time"), text("details"), sink_risk().alias("risk_level"), "amount",
        text("city"), text("name_orig"), text("name_dest"), text("type"), text("device_id"), text("ip_segment"), "transaction_hour", text("is_abroad"), text("device_risk_level"),
        F.expr("event_ms div 86400000").alias("day"),
    )


def sink_json(alerts: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """``alert_id`` and the row's 23 keys as JSON. ``explanations(alert_id, explanation_summary, top_features, graph_path)`` may lack alerts; these have blanks."""
    rows = sink_rows(alerts)
    if explanations is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("explanation_summary", "top_features", "graph_path")})
    else:
        rows = rows.join(explanations, "alert_id", "left")
    keys = ["alert_id", "account_id", "fraud_type", "confidence", "source", "behavior_path", "alert_time", "details", "risk_level", "explanation_summary", "amount", "city", "name_orig", "name_dest", "type", "device_id", "ip_segment", "transaction_hour", "is_abroad", "device_risk_level", "top_features", "graph_path"]
    blank = {"explanation_summary": "UNKNOWN", "top_features": "", "graph_path": ""}
    columns = [F.coalesce(c, F.lit(blank[c])).alias(c) if c in blank else F.col(c) for c in keys]
    return rows.select("alert_id", F.to_json(F.struct(*columns, F.col("alert_time").alias("dt"))).alias("json"))


def time_of_day(ms: str):
    """``HH:mm:ss.SSS`` in Asia/Shanghai, eight hours ahead of UTC the whole year; zeros if the time isn't positive."""
    shifted = f"({ms} + 28800000) % 86400000"
    part = lambda unit, size, wide: F.lpad(F.expr(f"cast(({shifted}) div {unit} % {size} as string)"), wide, "0")
    return F.when(F.col(ms) <= 0, "00:00:00.000").otherwise(F.concat(part(3600000, 24, 2), F.lit(":"), part(60000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3)))


def normal_rows(tx: DataFrame) -> DataFrame:
    """The table of unsuspicious transactions; ids are digests of the row."""
    keep = ["type", "amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest", "city", "device_id", "device_type", "pay_channel", "ip_segment", "transaction_hour", "daily_tx_count", "device_risk_level", "is_abroad"]
    return tx.filter("is_fraud = 0").select(F.concat(F.lit("TX_"), "tx_id").alias("tx_id"), F.col("name_orig").alias("account_id"), "name_orig", "name_dest", *keep, time_of_day("event_ms").alias("tx_time"))
