"""Event patterns compiled to window plans.

A pattern is a list of stages; each stage takes the first later event of the key that fits (relaxed contiguity), or exactly the next one (``follow="next"``). As the choice is
deterministic, the match that starts at an event is a function of the ordered partition: going from the last stage to the first, a running window that reads the partition backwards carries
the nearest event that completes the rest of the pattern. Every start event yields its own match; the last event must come less than ``within_ms`` after the first.

All patterns of a key share one window order, so Spark sorts each key's rows once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CONTEXT

MINUTE, HOUR = 60_000, 3_600_000


@dataclass(frozen=True)
class Stage:
    when: str
    follow: str = "any"  # "any": the first later event that fits; "next": the very next event


@dataclass(frozen=True)
class Pattern:
    name: str
    fraud_type: str
    key: str
    stages: tuple[Stage, ...]
    within_ms: int
    confidence: float


def repeat(when: str, times: int, consecutive: bool = True) -> tuple[Stage, ...]:
    return (Stage(when), *[Stage(when, "next" if consecutive else "any")] * (times - 1))


RISKY = "(is_abroad = 'ABROAD' or device_risk_level = 'HIGH')"
MOVES = "type in ('TRANSFER', 'CASH_OUT')"

#: The stages, limits and confidences of the eleven patterns.
PATTERNS = [
    Pattern("p01", "小额试探大额转出", "name_orig", (Stage("amount between 1000 and 6000 and type = 'TRANSFER'"), Stage(f"amount >= 30000 and {MOVES} and {RISKY}")), 2 * HOUR, 0.85),
    Pattern("p02", "多层链式洗钱", "name_orig", (Stage("amount >= 50000 and type = 'TRANSFER' and (device_risk_level = 'HIGH' or pay_channel = 'BANK_APP')"), Stage("type = 'TRANSFER' and amount >= 30000"), Stage(f"type = 'CASH_OUT' and {RISKY}")), 2 * HOUR, 0.90),
    Pattern("p03", "异地跨设备突发大额", "name_orig", (Stage("amount <= 5000 and type in ('PAYMENT', 'TRANSFER') and device_risk_level = 'LOW'"), Stage(f"amount >= 30000 and {MOVES} and {RISKY}")), 3 * HOUR, 0.85),
    Pattern("p04", "分散转入集中提现", "name_dest", (*repeat("type = 'TRANSFER' and amount between 4000 and 30000", 2), Stage("type = 'CASH_OUT' and amount >= 20000")), 2 * HOUR, 0.80),
    Pattern("p05", "多渠道轮番转账", "name_orig", repeat("type = 'TRANSFER' and amount >= 5000", 3, consecutive=False), HOUR, 0.80),
    Pattern("p06", "凌晨分批掏空", "name_orig", (Stage(f"transaction_hour between 0 and 5 and {MOVES} and amount >= 5000"), Stage(f"transaction_hour between 0 and 5 and {MOVES} and amount >= 5000"), Stage(f"transaction_hour between 0 and 5 and {MOVES}")), 4 * HOUR, 0.80),
    Pattern("p07", "小额掩护大额跑路", "name_orig", (*repeat("amount between 100 and 1000 and type in ('PAYMENT', 'TRANSFER')", 2), Stage(f"amount >= 40000 and {MOVES} and {RISKY}")), 8 * HOUR, 0.85),
    Pattern("p08", "团伙同IP批量作案", "ip_segment", repeat("amount >= 15000 and type = 'TRANSFER'", 2), 30 * MINUTE, 0.85),
    Pattern("p09", "账户被盗急速转账", "name_orig", (Stage(f"{RISKY} and (transaction_hour <= 5 or transaction_hour >= 22) and amount >= 20000"), Stage(f"amount >= 30000 and {MOVES}")), HOUR, 0.90),
    Pattern("p10", "虚假交易退款套利", "name_orig", (*repeat("type = 'PAYMENT' and amount >= 10000", 2), Stage("type = 'CASH_OUT' and amount >= 30000")), 6 * HOUR, 0.80),
    Pattern("p11", "养卡提额异常消费", "name_orig", (Stage("type = 'PAYMENT' and amount >= 5000 and (transaction_hour <= 5 or transaction_hour >= 22)"), Stage("type = 'PAYMENT' and amount >= 20000"), Stage("type = 'PAYMENT' and amount >= 50000")), 12 * HOUR, 0.80),
]


#: Longest times of a pattern in a slice of a key's rows: one row in so many is copied.
SLICES = 4

#: Transactions to a task: a task sorts its rows, so its memory follows from this and not from the size of the input.
TASK_ROWS = 50_000


def with_matches(tx: DataFrame, patterns: list[Pattern], tasks: int = 1) -> DataFrame:
    """``tx`` with, for each pattern, the column ``m_<name>``: array of the matched (tx_id, event_ms) of the later stages, null without a match.

    A match ends within a pattern's time, so a key's rows are cut into slices of SLICES times the longest such time, and rows that a start in the slice before can reach are copied there: a busy key is as many windows as slices.
    Which stages a row fits is one number, made before the rows are dealt to ``tasks``; every window reads backwards, so rows are sorted once, before matches widen them.
    """
    wide, key = max(p.within_ms for p in patterns), patterns[0].key
    slice_ms = SLICES * wide
    places = {(p.name, k): i for i, (p, k) in enumerate((p, k) for p in patterns for k in range(len(p.stages)))}
    bits = [F.when(F.expr(p.stages[k].when), F.lit(1 << i)).otherwise(0).cast("long") for p in patterns for k in range(len(p.stages)) for i in [places[p.name, k]]]
    fits = lambda p, k: F.col("_fits").bitwiseAND(F.lit(1 << places[p.name, k]).cast("long")) != 0
    tx = tx.withColumn("_fits", reduce(lambda x, y: x.bitwiseOR(y), bits))
    tx = tx.withColumn("_slice", F.explode(F.expr(f"array_distinct(array(floor(event_ms / {slice_ms}), floor((event_ms - {wide}) / {slice_ms})))"))).repartition(tasks, key, "_slice")
    order = Window.partitionBy(key, "_slice").orderBy(F.col("event_ms").desc(), F.col("tx_id").desc())
    later = order.rowsBetween(Window.unboundedPreceding, -1)
    depth = max(len(p.stages) for p in patterns)
    at: dict[str, object] = {}
    for level in range(depth - 1, 0, -1):
        new = {}
        for p in patterns:
            if level >= len(p.stages):
                continue
            own = F.array(F.struct("tx_id", "event_ms"))
            rest = F.col(f"n_{p.name}_{level}") if level < len(p.stages) - 1 else None
            # the nearest fitting event counts even if nothing completes it: its open end then has no time
            step = F.when(fits(p, level), own if rest is None else F.concat(own, F.coalesce(rest, F.array(F.struct(F.lit(None).cast("long").alias("tx_id"), F.lit(None).cast("long").alias("event_ms"))))))
            new[f"n_{p.name}_{level - 1}"] = F.lag(step).over(order) if p.stages[level].follow == "next" else F.last(step, ignorenulls=True).over(later)
        tx = tx.withColumns(new)
        at |= new
    matched = {}
    for p in patterns:
        n = F.col(f"n_{p.name}_0")
        inside = F.element_at(n, -1)["event_ms"] - F.col("event_ms") < p.within_ms
        matched[f"m_{p.name}"] = F.when(fits(p, 0) & inside, n)
    return tx.withColumns(matched).filter(f"_slice = floor(event_ms / {slice_ms})").drop("_slice", "_fits", *at)


def alerts(tx: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """One row for each match: the alert of its first event, and the ids of all its events."""
    parts = []
    patterns = patterns or PATTERNS
    tasks = tx.count() // TASK_ROWS + 2
    for key in dict.fromkeys(p.key for p in patterns):
        own = [p for p in patterns if p.key == key]
        rows = with_matches(tx.filter(F.col(key).isNotNull()), own, tasks)
        found = F.filter(F.array(*[F.struct(F.lit(p.name).alias("pattern"), F.lit(p.fraud_type).alias("fraud_type"), F.lit(p.confidence).alias("confidence"), F.col(f"m_{p.name}").alias("m")) for p in own]), lambda x: x["m"].isNotNull())
        parts.append(rows.withColumn("hit", F.explode(found)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(
        F.col("hit.pattern").alias("pattern"),
        "tx_id",
        F.array_join(F.transform("hit.m", lambda x: x["tx_id"].cast("string")), ",").alias("next_ids"),
        F.element_at("hit.m", -1)["event_ms"].alias("last_ms"),
        F.col("name_orig").alias("account_id"),
        F.col("hit.fraud_type").alias("fraud_type"),
        F.col("hit.confidence").alias("confidence"),
        F.lit("CEP_RULE").alias("source"),
        *[c for c in CONTEXT],
    )
