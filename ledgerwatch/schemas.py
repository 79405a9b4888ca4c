"""The row types: transactions, alerts."""

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_S, _D, _I, _L = StringType(), DoubleType(), IntegerType(), LongType()

#: Camel-case field names of the input messages, their column, type and default.
TX_FIELDS = [
    ("step", "step", _I, 0),
    ("type", "type", _S, "UNKNOWN"),
    ("amount", "amount", _D, 0.0),
    ("nameOrig", "name_orig", _S, "UNKNOWN"),
    ("oldbalanceOrg", "oldbalance_org", _D, 0.0),
    ("newbalanceOrig", "newbalance_orig", _D, 0.0),
    ("nameDest", "name_dest", _S, "UNKNOWN"),
    ("oldbalanceDest", "oldbalance_dest", _D, 0.0),
    ("newbalanceDest", "newbalance_dest", _D, 0.0),
    ("isFlaggedFraud", "is_flagged_fraud", _I, 0),
    ("deviceId", "device_id", _S, "UNKNOWN"),
    ("deviceType", "device_type", _S, "UNKNOWN"),
    ("payChannel", "pay_channel", _S, "UNKNOWN"),
    ("city", "city", _S, "UNKNOWN"),
    ("ipSegment", "ip_segment", _S, "UNKNOWN"),
    ("transactionHour", "transaction_hour", _I, None),
    ("dailyTxCount", "daily_tx_count", _I, 0),
    ("deviceRiskLevel", "device_risk_level", _S, "LOW"),
    ("isAbroad", "is_abroad", _S, "LOCAL"),
    ("groupId", "group_id", _S, "NONE"),
    ("fraudType", "fraud_type", _S, "NORMAL"),
    ("isFraud", "is_fraud", _I, 0),
]

TRANSACTION = StructType([StructField("tx_id", _L), StructField("event_ms", _L), *[StructField(c, t) for _, c, t, _ in TX_FIELDS]])

#: As the messages carry them; the event time may be a number or a text.
MESSAGE = StructType([*[StructField(j, t) for j, _, t, _ in TX_FIELDS], StructField("eventTime", _S)])

#: What an alert copies from the transaction it stands for.
CONTEXT = ["amount", "event_ms", "city", "name_orig", "name_dest", "type", "device_id", "ip_segment", "transaction_hour", "is_abroad", "device_risk_level"]

ALERT = StructType(
    [
        StructField("alert_id", _S), StructField("account_id", _S), StructField("fraud_type", _S), StructField("confidence", _D), StructField("source", _S),
        StructField("behavior_path", _S), StructField("details", _S), StructField("event_ms", _L), StructField("amount", _D), StructField("city", _S), StructField("name_orig", _S),
        StructField("name_dest", _S), StructField("type", _S), StructField("device_id", _S), StructField("ip_segment", _S), StructField("transaction_hour", _I),
        StructField("is_abroad", _S), StructField("device_risk_level", _S),
    ]
)

FEEDBACK = StructType([StructField("alert_id", _S), StructField("feedback_type", _S), StructField("reviewer_id", _S), StructField("comment", _S), StructField("event_ms", _L)])
REPAIR = StructType([StructField("severity", _S), StructField("action", _S), StructField("threshold", _D), StructField("retrain", BooleanType())])
