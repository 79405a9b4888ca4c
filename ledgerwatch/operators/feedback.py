"""Reviewers' feedback: statistics, analysis, review queue, triggers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(feedback: DataFrame, by: str | None = None) -> DataFrame:
    """``feedback(feedback_type, ...)``: counts and the share of false positives, overall or by a column."""
    c = lambda kind: F.count(F.when(F.col("feedback_type") == kind, 1))
    grouped = feedback.groupBy(by) if by else feedback.groupBy()
    out = grouped.agg(F.count("*").alias("total"), c("CONFIRMED_FRAUD").alias("confirmed"), c("FALSE_POSITIVE").alias("false_positive"), c("INCORRECT_TYPE").alias("incorrect_type"))
    return out.withColumn("fpr", F.expr("if(total > 0, false_positive / total, 0.0D)"))


def keywords(feedback: DataFrame, k: int = 5) -> DataFrame:
    words = feedback.select(F.explode(F.split(F.lower(F.coalesce("comment", F.lit(""))), r"[\s,.;:!?，。；：！？]+")).alias("word")).filter("length(word) >= 2")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(k)


def suggestions(by_type: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Raise a type's threshold where at least ten reviews show more than a fifth false positives."""
    return by_type.withColumn("suggested", F.when((F.col("total") >= 10) & (F.col("fpr") > 0.2), F.least(F.lit(0.95), F.lit(threshold + 0.05))).otherwise(F.lit(threshold)))


def false_positive_profile(feedback: DataFrame) -> DataFrame:
    """``feedback(fraud_type, feedback_type, transaction_hour, reviewer_id)``: of each type's false positives the share at night (hours 0 to 5) and the number of reviewers."""
    wrong = feedback.filter("feedback_type = 'FALSE_POSITIVE'")
    return wrong.groupBy("fraud_type").agg(F.count("*").alias("false_positive"), F.avg(F.expr("if(transaction_hour >= 0 and transaction_hour < 6, 1.0D, 0.0D)")).alias("night_share"), F.count_distinct("reviewer_id").alias("reviewers"))


def written(feedback: DataFrame, path: str) -> None:
    """Append reviews to the tables of confirmed frauds and of false positives, one folder for each kind."""
    feedback.filter("feedback_type in ('CONFIRMED_FRAUD', 'FALSE_POSITIVE')").write.partitionBy("feedback_type").mode("append").parquet(path)


def newest(feedback: DataFrame, kind: str, limit: int = 30) -> DataFrame:
    """The last reviews of a kind."""
    return feedback.filter(F.col("feedback_type") == kind).orderBy(F.col("event_ms").desc(), "alert_id").limit(limit)


def review_queue(alerts: DataFrame, k: int = 100) -> DataFrame:
    """The most urgent alerts: weight of the risk times confidence."""
    weight = F.expr("case when confidence >= 0.90 then 4 when confidence >= 0.75 then 3 when confidence >= 0.50 then 2 else 1 end")
    return alerts.withColumn("priority", weight * F.col("confidence")).orderBy(F.col("priority").desc(), "alert_id").limit(k)


def review_states(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Where each alert stands in review: ``alerts(alert_id, event_ms)``, ``actions(alert_id, action, at_ms)`` with actions TAKEN, RELEASED and RESOLVED.

    The last action decides (at one time: RESOLVED, then RELEASED, then TAKEN): PENDING, IN_REVIEW or RESOLVED. ``waited_ms`` runs from the alert to the first TAKEN, ``handled_ms`` to the last RESOLVED; both are null until then. Only aggregates of an alert's
    actions are joined, so an alert with any number of actions is one row.
    """
    rank = F.expr("case action when 'RESOLVED' then 3 when 'RELEASED' then 2 else 1 end")
    time = lambda kind: F.when(F.col("action") == kind, F.col("at_ms"))
    last = actions.groupBy("alert_id").agg(F.max_by("action", F.struct("at_ms", rank.alias("rank"))).alias("last"), F.min(time("TAKEN")).alias("taken"), F.max(time("RESOLVED")).alias("resolved"), F.count("*").alias("actions"))
    state = F.expr("case last when 'RESOLVED' then 'RESOLVED' when 'TAKEN' then 'IN_REVIEW' else 'PENDING' end")
    joined = alerts.select("alert_id", "event_ms").join(last, "alert_id", "left")
    return joined.select("alert_id", state.alias("state"), (F.col("taken") - F.col("event_ms")).alias("waited_ms"), F.when(state == "RESOLVED", F.col("resolved") - F.col("event_ms")).alias("handled_ms"), F.coalesce("actions", F.lit(0)).alias("actions"))


def review_load(states: DataFrame) -> DataFrame:
    """Alerts, and mean waiting and handling time, by state."""
    return states.groupBy("state").agg(F.count("*").alias("n"), F.avg("waited_ms").alias("waited_ms"), F.avg("handled_ms").alias("handled_ms"))


def retrain_due(overall: DataFrame, by_type: DataFrame) -> DataFrame:
    """Whether feedback asks for a new model, and why."""
    worst = by_type.filter("total >= 10").agg(F.coalesce(F.max("fpr"), F.lit(0.0)).alias("worst_type"))
    return overall.join(F.broadcast(worst)).select(
        "total", "fpr", "worst_type", F.expr("case when fpr > 0.10 then 'HIGH_FPR' when worst_type > 0.30 then 'TYPE_FPR' when total >= 50 then 'NEW_SAMPLES' else 'NONE' end").alias("reason"), F.expr("total >= 50 or fpr > 0.10 or worst_type > 0.30").alias("due")
    )


def backfilled(feedback: DataFrame, alerts: DataFrame) -> DataFrame:
    """City and device from the alert where the feedback lacks them."""
    a = alerts.select("alert_id", F.col("city").alias("a_city"), F.col("device_id").alias("a_device"))
    return feedback.join(a, "alert_id", "left").withColumns({"city": F.coalesce("city", "a_city"), "device_id": F.coalesce("device_id", "a_device")}).drop("a_city", "a_device")
