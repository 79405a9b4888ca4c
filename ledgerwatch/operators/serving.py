"""The queries behind dashboards, over the alert, transaction and evaluation tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the dashboard's groups and their bounds.
FAMILIES = [("在线模型识别", "在线模型识别"), ("集成模型", "集成模型未知异常"), ("路径频率", "路径频率模型识别"), ("高置信", "高置信集成模型欺诈"), ("图模型", "图模型多目标分散"), ("时序模型", "时序模型夜间不规律"), ("统计画像", "统计画像偏离欺诈")]
CONFIDENCE = "case when confidence >= 0.9 then '高危(>90%)' when confidence >= 0.7 then '中危(70-90%)' else '低危(<70%)' end"
AMOUNT = "case when amount >= 100000 then '10万以上' when amount >= 50000 then '5-10万' when amount >= 10000 then '1-5万' when amount >= 1000 then '1千-1万' else '1千以下' end"
SOURCE = "case when source like 'C%' then 'CEP规则' when source like 'S%' then 'SQL引擎' when source like 'GRAPH%' or source like 'GNA%' then '图分析' when source like 'GN%' then 'GNN检测' when source like 'M%' then 'ML集成' else '其他' end"


def before(rows: DataFrame, hour: int | None) -> DataFrame:
    return rows if hour is None else rows.filter(F.col("transaction_hour") <= hour)


def distribution(rows: DataFrame, name) -> DataFrame:
    return rows.groupBy((F.expr(name) if isinstance(name, str) else name).alias("name")).agg(F.count("*").alias("value"))


def by_type(alerts: DataFrame) -> DataFrame:
    family = F.col("fraud_type")
    for prefix, name in FAMILIES:
        family = F.when(F.col("fraud_type").startswith(prefix), name).otherwise(family)
    return distribution(alerts, family)


def by_source(alerts: DataFrame) -> DataFrame:
    return distribution(alerts.filter("source is not null and source <> ''"), SOURCE)


def by_confidence(alerts: DataFrame) -> DataFrame:
    return distribution(alerts, CONFIDENCE)


def by_city(alerts: DataFrame) -> DataFrame:
    return distribution(alerts, "coalesce(city, '未知')")


def by_amount(alerts: DataFrame) -> DataFrame:
    return distribution(alerts, AMOUNT)


def alert_count(alerts: DataFrame, hour: int | None = None) -> DataFrame:
    return before(alerts, hour).filter("source is not null and source <> ''").agg(F.count("*").alias("cnt"))


def distinct_of(alerts: DataFrame, column: str) -> DataFrame:
    return alerts.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct()


def rule_hits(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.col("fraud_type").alias("name")).agg(F.count("*").alias("hits"))


def total_amounts(alerts: DataFrame, normal: DataFrame) -> DataFrame:
    a = alerts.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("fraud_total"))
    n = normal.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("normal_total"))
    return a.join(F.broadcast(n)).select(F.round("fraud_total", 2).alias("fraud_total"), F.round("normal_total", 2).alias("normal_total"), F.round(F.col("fraud_total") + F.col("normal_total"), 2).alias("grand_total"))


def recent(alerts: DataFrame, limit: int = 200) -> DataFrame:
    """The newest alerts; Spark keeps only the best of each partition."""
    return alerts.orderBy(F.col("event_ms").desc(), "alert_id").limit(limit)


def search(alerts: DataFrame, account: str = "", fraud_type: str = "", source: str = "", least: float = 0.0, most: float = 1.0, offset: int = 0, limit: int = 50) -> DataFrame:
    a = alerts.filter(F.col("confidence").between(least, most))
    for c, v in (("account_id", account), ("fraud_type", fraud_type), ("source", source)):
        a = a.filter(F.col(c).contains(v)) if v else a
    return a.orderBy(F.col("event_ms").desc(), "alert_id").offset(offset).limit(limit)


def by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    """One alert; where an id repeats, the newest."""
    return recent(alerts.filter(F.col("alert_id") == alert_id), 1)


def between(alerts: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Alerts of a range of dates, both ends included."""
    return alerts.filter(F.col("event_ms").between(start_ms, end_ms))


def until_now(alert_rows: DataFrame, normal_rows: DataFrame, now: str) -> DataFrame:
    """Rows of both tables up to a time of the day, ``HH:mm:ss``."""
    a = alert_rows.filter(F.col("alert_time") <= now).agg(F.count("*").alias("fraud_count"))
    n = normal_rows.filter(F.col("tx_time") <= now).agg(F.count("*").alias("normal_count"))
    return n.join(F.broadcast(a)).withColumn("total_count", F.expr("normal_count + fraud_count"))


def count_like(alerts: DataFrame, prefix: str = "ML") -> DataFrame:
    return alerts.filter(F.col("source").startswith(prefix)).agg(F.count("*").alias("cnt"))


def newest(rows: DataFrame, by: str, limit: int = 30) -> DataFrame:
    """The last rows of a history by a numeric key: metrics, validations, drift events."""
    return rows.orderBy(F.col(by).desc()).limit(limit)


def training_history(validations: DataFrame, limit: int = 100) -> DataFrame:
    """How the scores changed as samples came in."""
    return validations.orderBy("total_samples").limit(limit)


#: Categories that may be on at once; they are a condition of the plan, so more is an error.
MOST_CATEGORIES = 1_000


def enabled(alerts: DataFrame, categories: DataFrame) -> DataFrame:
    """Alerts whose source starts with the prefix of an enabled category of ``categories(prefix, enabled)``; if none is enabled nothing is filtered."""
    on = [r["prefix"] for r in categories.filter("enabled").select("prefix").distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(on) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories are enabled")
    found = F.lit(not on)
    for prefix in on:
        found = found | F.startswith("source", F.lit(prefix))
    return alerts.filter(found)


def second_of_day(column: str):
    return F.expr(f"cast(substring({column}, 1, 2) as int) * 3600 + cast(substring({column}, 4, 2) as int) * 60 + cast(substring({column}, 7, 2) as int)")


def traffic(alert_rows: DataFrame, normal_rows: DataFrame, now: int, seconds: int = 120) -> DataFrame:
    """Both tables a second over the last ``seconds`` before ``now`` (second of the day), empty seconds included, past midnight too."""
    slots = alert_rows.sparkSession.range(seconds).select(F.col("id").alias("slot"), F.expr(f"cast(pmod({now} - ({seconds} - 1 - id), 86400) as int)").alias("second"))
    inside = F.expr(f"pmod({now} - second, 86400) < {seconds}")
    count = lambda t, c, name: t.select(second_of_day(c).alias("second")).filter(inside).groupBy("second").agg(F.count("*").alias(name))
    out = slots.join(count(alert_rows, "alert_time", "fraud"), "second", "left").join(count(normal_rows, "tx_time", "normal"), "second", "left")
    return out.select("slot", "second", F.coalesce("normal", F.lit(0)).alias("normal"), F.coalesce("fraud", F.lit(0)).alias("fraud"))


def feedback_totals(confirmed: DataFrame, wrong: DataFrame) -> DataFrame:
    c, w = confirmed.agg(F.count("*").alias("confirmed_fraud")), wrong.agg(F.count("*").alias("false_positive"))
    return c.join(F.broadcast(w)).select(F.expr("confirmed_fraud + false_positive").alias("total_feedback"), "confirmed_fraud", "false_positive", F.expr("if(confirmed_fraud + false_positive > 0, false_positive / (confirmed_fraud + false_positive), 0.0D)").alias("false_positive_rate"))


def kpis(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of headline figures. Latency is not among them: it is what a listener measures, not a table."""
    t = tx.agg(F.count("*").alias("transactions"), F.sum(F.col("is_fraud").cast("long")).alias("labelled"))
    a = alerts.agg(F.count("*").alias("alerts"), F.count_distinct("account_id").alias("accounts"), F.count(F.when(F.col("confidence") >= 0.9, 1)).alias("high_risk"))
    return t.join(F.broadcast(a)).withColumn("alert_rate", F.expr("if(transactions > 0, alerts / transactions, 0.0D)"))
