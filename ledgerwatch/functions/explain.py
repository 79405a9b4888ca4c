"""Why a sequence was alerted: contributions of features, triggered rules, composite risk."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES
from .scores import LR_STDS, LR_WEIGHTS, numbers

#: How many features are explained, and where their deviations differ from the linear model's.
EXPLAINED = 30
STDS = [*LR_STDS[:25], 3.0, 50000.0, 50000.0, 1.0, 5.0]

#: Conditions of the sequence rules and their names.
RULES = [
    ("abroad_count > 0 and max_amount >= 15000", "ML:境外大额交易"),
    ("night_count >= 1 and high_risk_count >= 1 and max_amount >= 8000", "ML:凌晨高风险交易"),
    ("city_changes >= 1 and device_changes >= 1 and max_amount >= 20000", "ML:异地跨设备异常"),
    ("total_amount >= 40000 and high_risk_count >= 1", "ML:大额高风险累计"),
    ("cash_out_ratio >= 0.5 and max_amount >= 15000", "ML:集中提现模式"),
    ("amount_slope > 8000", "ML:金额递增趋势"),
    ("freq_acceleration >= 2.0", "ML:交易频率加速"),
    ("interval_variance > 1000 and cash_out_ratio >= 0.4", "ML:间隔不规律+高提现比"),
    ("out_degree >= 3 and max_single_ratio >= 0.4", "ML:多目标分散转出"),
]


def contributions(seq: DataFrame, weights=LR_WEIGHTS) -> DataFrame:
    """``contributions``: features with value and share of the score, the strongest first."""
    names = ", ".join(f"'{c}'" for c in FEATURES[:EXPLAINED])
    value = "coalesce(nanvl(v, 0.0D), 0.0D)"
    share = f"(greatest(-3.0D, least(3.0D, {value} / {numbers(STDS)}[i])) / 3.0D * {numbers(weights[:EXPLAINED])}[i])"
    parts = f"transform(slice(features, 1, {EXPLAINED}), (v, i) -> struct(-abs{share} as order, i as i, array({names})[i] as feature, {value} as value, {share} as contribution))"
    return seq.withColumn("contributions", F.array_sort(F.expr(parts)))


def triggered(seq: DataFrame) -> DataFrame:
    return seq.withColumn("rules", F.array_compact(F.array(*[F.when(F.expr(c), n) for c, n in RULES])))


def brief(seq: DataFrame) -> DataFrame:
    """The three strongest positive features and the first rule, as text."""
    top = F.expr("slice(filter(contributions, x -> x.contribution > 0), 1, 3)")
    words = F.array_join(F.transform(top, lambda x: F.concat(x["feature"], F.lit("="), F.round(x["value"], 0).cast("bigint").cast("string"))), "|")
    rule = F.expr("if(size(rules) = 0, '', concat(';规则:', rules[0], if(size(rules) > 1, concat('等', size(rules), '条'), '')))")
    return triggered(contributions(seq)).withColumn("brief", F.concat(words, rule))


def composite_risk(rows: DataFrame) -> DataFrame:
    """``rows(confidence, n_rules, graph_risk, amount, transaction_hour)``: weighted risk and its level."""
    clamp = lambda c: f"greatest(0.0D, least(1.0D, {c}))"
    amount = "case when amount < 0 then 0.0D when amount < 5000 then 0.1D when amount < 20000 then 0.4D when amount < 100000 then 0.7D else 1.0D end"
    hour = "case when transaction_hour between 0 and 3 then 1.0D when transaction_hour between 4 and 5 then 0.8D when transaction_hour between 6 and 7 then 0.3D when transaction_hour between 22 and 23 then 0.5D else 0.1D end"
    score = f"{clamp('confidence')} * 0.40D + least(n_rules / 5.0D, 1.0D) * 0.20D + {clamp('graph_risk')} * 0.15D + {amount} * 0.15D + {hour} * 0.10D"
    out = rows.withColumn("composite", F.expr(f"round({clamp(score)}, 9)"))  # sums of tenths must not fall just below a level
    return out.withColumn("level", F.expr("case when composite >= 0.90 then 'CRITICAL' when composite >= 0.75 then 'HIGH' when composite >= 0.50 then 'MEDIUM' else 'LOW' end"))


#: Registry of patterns by the family that their name contains.
PATTERN_FAMILIES = [("链式", "洗钱"), ("环路", "洗钱"), ("洗钱", "洗钱"), ("掏空", "盗用"), ("被盗", "盗用"), ("跨设备", "盗用"), ("试探", "试探"), ("掩护", "试探"), ("分散", "聚散"), ("汇聚", "聚散"), ("集中", "聚散"), ("团伙", "团伙"), ("同IP", "团伙"), ("退款", "套利"), ("养卡", "套利"), ("多渠道", "聚散")]


def pattern_family(fraud_type):
    """Family of a fraud type by what its name contains, in the registry's order."""
    out = F.lit("其他")
    for part, family in reversed(PATTERN_FAMILIES):
        out = F.when(fraud_type.contains(part), family).otherwise(out)
    return out


#: The registry of known patterns, in order, and how grave each is.
PATTERNS = [
    ("小额试探大额转出", "极高"), ("多层链式洗钱", "极高"), ("异地跨设备突发大额", "高"), ("分散转入集中提现", "高"), ("多渠道轮番转账", "高"), ("凌晨分批掏空", "极高"), ("小额掩护大额跑路", "极高"), ("团伙同IP批量作案", "极高"),
    ("多层链式洗钱(SQL)", "极高"), ("团伙同IP批量作案(SQL)", "极高"), ("分散转入集中提现(SQL)", "极高"),
]
UNKNOWN_SEVERITY = "中"


def described(types: DataFrame) -> DataFrame:
    """``types(fraud_type, ...)`` with ``pattern`` and ``severity`` of the registry: the entry of that name, else the first whose name contains the type's without its parentheses, or is contained in it."""
    registry = types.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(PATTERNS)], "place int, pattern string, severity string")
    plain = F.trim(F.regexp_replace("fraud_type", r"\(.*\)", ""))
    fits = (F.col("fraud_type") == F.col("pattern")) | F.col("pattern").contains(plain) | plain.contains(F.col("pattern"))
    names = types.select("fraud_type").distinct()
    best = names.join(F.broadcast(registry), fits).groupBy("fraud_type").agg(F.min(F.struct((F.col("fraud_type") != F.col("pattern")).alias("fuzzy"), "place", "pattern", "severity")).alias("best"))
    return types.join(best.select("fraud_type", "best.pattern", "best.severity"), "fraud_type", "left").fillna({"severity": UNKNOWN_SEVERITY})


def report(alerts: DataFrame) -> DataFrame:
    """A sentence for each alert, and its fields as JSON."""
    from .scalar import amount_words, confidence_words

    text = F.concat(F.lit("账户"), "account_id", F.lit("触发"), "fraud_type", F.lit("，置信度"), confidence_words(F.col("confidence")), F.lit("，涉及金额"), amount_words(F.col("amount")))
    return alerts.select("alert_id", text.alias("report"), F.to_json(F.struct("account_id", "fraud_type", "confidence", "source", "amount")).alias("report_json"))
