"""Scoring of single transactions without history, as the detection endpoint does; the same expressions serve a batch, a stream and a request."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scores import first_of, points

#: Points of the behaviour score.
BEHAVIOR = [
    ("amount >= 25000", 0.12), ("amount >= 50000", 0.08), ("device_risk_level = 'HIGH'", 0.12), ("device_risk_level = 'MEDIUM'", 0.06), ("is_abroad = 'ABROAD'", 0.14), ("transaction_hour between 0 and 5", 0.10),
    ("transaction_hour between 22 and 23", 0.06), ("balance_ratio >= 0.40", 0.12), ("balance_ratio >= 0.80", 0.06), ("daily_tx_count >= 10", 0.08), ("daily_tx_count >= 20", 0.05),
    ("is_abroad = 'ABROAD' and device_risk_level = 'HIGH' and amount >= 20000", 0.08), ("transaction_hour between 0 and 5 and balance_ratio >= 0.5", 0.06), ("oldbalance_org >= 80000 and (is_abroad = 'ABROAD' or device_risk_level = 'HIGH')", 0.08),
]
#: Stateless stand-ins for four patterns, their names and confidences.
RULES = [
    ("amount >= 30000 and type in ('TRANSFER', 'CASH_OUT') and (is_abroad = 'ABROAD' or device_risk_level = 'HIGH')", "小额试探大额转出", 0.85),
    ("amount >= 30000 and type in ('TRANSFER', 'CASH_OUT') and (device_risk_level in ('MEDIUM', 'HIGH') or is_abroad = 'ABROAD')", "异地跨设备突发大额", 0.85),
    ("transaction_hour between 0 and 5 and type in ('TRANSFER', 'CASH_OUT') and amount >= 5000", "凌晨分批掏空", 0.80),
    ("amount >= 40000 and type in ('TRANSFER', 'CASH_OUT') and (device_risk_level = 'HIGH' or is_abroad = 'ABROAD')", "小额掩护大额跑路", 0.85),
]
TYPES = [
    ("transaction_hour between 0 and 5 and is_abroad = 'ABROAD' and device_risk_level = 'HIGH' and amount >= 10000", "账户被盗急速转账"),
    ("type = 'PAYMENT' and daily_tx_count >= 2 and amount >= 10000", "虚假交易退款套利"),
    ("type = 'PAYMENT' and daily_tx_count >= 3 and amount >= 15000", "养卡提额异常消费"),
    ("is_abroad = 'ABROAD' and amount >= 12000", "在线模型识别跨境异常大额"),
    ("transaction_hour between 0 and 5 and device_risk_level = 'HIGH'", "在线模型识别凌晨高风险交易"),
    ("device_risk_level = 'HIGH' and amount >= 25000", "在线模型识别高风险设备大额"),
    ("transaction_hour between 0 and 5 and balance_ratio >= 0.4", "在线模型识别夜间账户掏空"),
    ("daily_tx_count >= 10 and amount >= 10000", "在线模型识别高频资金转移"),
    ("type = 'CASH_OUT' and amount >= 8000", "在线模型识别集中提现模式"),
    ("fraud_probability >= 0.60", "高置信集成模型欺诈"),
    ("true", "集成模型未知异常模式"),
]


def detect(tx: DataFrame, model_score=None, threshold: float = 0.35, behavior_threshold: float = 0.30) -> DataFrame:
    """Probability, decision, type and risk of each transaction. ``model_score``: column of a trained model's probability, mixed 70 to 30 with the behaviour score."""
    t = tx.withColumn("balance_ratio", F.expr("if(oldbalance_org > 0, (oldbalance_org - newbalance_orig) / oldbalance_org, 0.0D)"))
    t = t.withColumn("behavior_score", F.expr(points(BEHAVIOR)))
    base = F.expr("least(1.0D, behavior_score * 0.6D + if(balance_ratio > 0.5, 0.1D, 0.0D) + if(is_abroad = 'ABROAD' and amount > 15000, 0.15D, 0.0D))")
    mixed = base if model_score is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), model_score * 0.7 + F.col("behavior_score") * 0.3))
    t = t.withColumns({"model_score": mixed, "rule": F.expr(first_of([(c, n) for c, n, _ in RULES])), "rule_confidence": F.expr("case " + " ".join(f"when {c} then {p}D" for c, _, p in RULES) + " else 0.0D end")})
    t = t.withColumn("fraud_probability", F.greatest("model_score", "rule_confidence")).withColumn("limit", F.expr(f"if(device_risk_level = 'HIGH' and is_abroad = 'ABROAD', {threshold}D * 0.80D, {threshold}D)"))
    t = t.withColumn("is_suspect", (F.col("fraud_probability") >= F.col("limit")) | (F.col("behavior_score") >= behavior_threshold))
    t = t.withColumn("fraud_probability", F.when(F.col("is_suspect"), F.greatest("fraud_probability", "behavior_score")).otherwise(F.col("fraud_probability")))
    risk = F.expr("case when fraud_probability >= 0.85 then 'CRITICAL' when fraud_probability >= 0.65 then 'HIGH' when fraud_probability >= 0.35 then 'MEDIUM' else 'LOW' end")
    return t.withColumns({"detected_type": F.expr(first_of(TYPES)), "risk_level": risk, "source": F.when(F.col("rule").isNotNull(), "CEP_RULE").otherwise("ML_ENSEMBLE")})
