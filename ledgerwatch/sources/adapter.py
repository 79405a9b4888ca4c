"""The ``events`` table seen as transactions: integer and CASE expressions only, so that any engine agrees bit by bit."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRANSACTION

EPOCH_MS = 1704067200000
#: The eleven kinds of fraud.
FRAUD_TYPES = ["小额试探大额转出", "多层链式洗钱", "异地跨设备突发大额", "分散转入集中提现", "多渠道轮番转账", "凌晨分批掏空", "小额掩护大额跑路", "团伙同IP批量作案", "账户被盗急速转账", "虚假交易退款套利", "养卡提额异常消费"]


def pick(index: str, *values: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({index} as int) + 1"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time is compressed 24 times, so that windows of minutes and hours hold several events of an account."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = e.select(F.col("event_id").alias("tx_id"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"), ms.alias("ms"))
    e = e.withColumn("event_ms", F.expr(f"(ms - {EPOCH_MS}L) div 24 + {EPOCH_MS}L")).withColumn("amount", F.expr("value * 1000"))
    out = e.select(
        "tx_id",
        "event_ms",
        F.expr(f"cast((event_ms - {EPOCH_MS}L) div 3600000 as int)").alias("step"),
        F.expr("case when event_type in ('view', 'purchase') then 'TRANSFER' when event_type = 'signup' then 'CASH_OUT' else 'PAYMENT' end").alias("type"),
        "amount",
        F.concat(F.lit("U"), "user_id").alias("name_orig"),
        F.expr("amount * (1 + tx_id % 4)").alias("oldbalance_org"),
        F.expr("amount * (tx_id % 4)").alias("newbalance_orig"),
        F.concat(F.lit("U"), "k").alias("name_dest"),
        F.lit(0.0).alias("oldbalance_dest"),
        F.col("amount").alias("newbalance_dest"),
        F.lit(0).alias("is_flagged_fraud"),
        F.concat(F.lit("D"), "user_id", F.lit("_"), F.expr("tx_id % 3")).alias("device_id"),
        pick("tx_id % 3", "ANDROID", "IOS", "PC").alias("device_type"),
        pick("tx_id % 3", "BANK_APP", "MINI_PROGRAM", "THIRD_PARTY").alias("pay_channel"),
        pick("tx_id % 5", "北京", "上海", "广州", "深圳", "杭州").alias("city"),
        F.concat(F.lit("10.0."), F.expr("user_id % 20")).alias("ip_segment"),
        F.expr("cast((event_ms div 3600000) % 24 as int)").alias("transaction_hour"),
        F.expr("cast(tx_id % 12 as int)").alias("daily_tx_count"),
        pick("tx_id % 3", "LOW", "MEDIUM", "HIGH").alias("device_risk_level"),
        F.expr("if(tx_id % 5 = 0, 'ABROAD', 'LOCAL')").alias("is_abroad"),
        F.lit("NONE").alias("group_id"),
        F.when(F.expr("tx_id % 20 = 0"), pick("(tx_id div 20) % 11", *FRAUD_TYPES)).otherwise("NORMAL").alias("fraud_type"),
        F.expr("cast(tx_id % 20 = 0 as int)").alias("is_fraud"),
    )
    return out.select([f.name for f in TRANSACTION])
