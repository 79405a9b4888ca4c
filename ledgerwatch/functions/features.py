"""The 36 features of a behaviour sequence, as expressions over its array of transactions ``txs``."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The features in the order of the vector.
FEATURES = [
    "avg_amount", "std_amount", "max_amount", "total_amount", "city_changes", "device_changes", "channel_changes", "night_count", "high_risk_count", "abroad_count", "distinct_cities", "distinct_devices",
    "distinct_channels", "balance_ratio", "cash_out_ratio", "velocity", "interval_mean", "interval_variance", "amount_slope", "freq_acceleration", "out_degree", "max_single_ratio", "distinct_dests",
    "graph_cycle", "graph_chain_depth", "graph_community", "graph_in_amount", "graph_out_amount", "graph_flow_balance", "graph_degree", "direction_asymmetry", "in_out_freq_ratio", "net_flow_asymmetry",
    "time_concentration", "time_density", "hour_risk",
]
SEQUENCE = FEATURES[:23]
GRAPH = FEATURES[23:34]


def total(body: str, start: str = "0.0D") -> str:
    return f"aggregate(txs, {start}, (s, x) -> s + {body})"


def count_of(condition: str) -> str:
    return f"size(filter(txs, x -> {condition}))"


#: Places 1 to n - 1; none where n is 1.
STEPS = "slice(sequence(0, n - 1), 2, n)"


def changes(field: str) -> str:
    return f"size(filter({STEPS}, i -> not (txs[i].{field} <=> txs[i - 1].{field})))"


def distinct(field: str) -> str:
    return f"size(array_distinct(transform(txs, x -> x.{field})))"


NIGHT, HIGH, ABROAD, MOVE = "x.transaction_hour >= 22 or x.transaction_hour <= 6", "x.device_risk_level = 'HIGH'", "x.is_abroad in ('ABROAD', 'YES', '1')", "x.type in ('TRANSFER', 'CASH_OUT')"


def with_features(seq: DataFrame) -> DataFrame:
    """``seq(account_id, session, txs)`` with the features that the sequence alone gives, and its path."""
    e = F.expr
    seq = seq.withColumn("n", F.size("txs")).withColumns({"start_ms": e("txs[0].event_ms"), "end_ms": e("txs[n - 1].event_ms"), "total_amount": e(total("x.amount"))})
    seq = seq.withColumns(
        {
            "avg_amount": e("total_amount / n"),
            "max_amount": e("greatest(0.0D, array_max(transform(txs, x -> x.amount)))"),
            "sq": e(total("x.amount * x.amount")),
            "city_changes": e(changes("city")),
            "device_changes": e(changes("device_id")),
            "channel_changes": e(changes("pay_channel")),
            "night_count": e(count_of(NIGHT)),
            "high_risk_count": e(count_of(HIGH)),
            "abroad_count": e(count_of(ABROAD)),
            "distinct_cities": e(distinct("city")),
            "distinct_devices": e(distinct("device_id")),
            "distinct_channels": e(distinct("pay_channel")),
            "balance_ratio": e("greatest(0.0D, array_max(transform(txs, x -> if(x.oldbalance_org > 0, x.amount / x.oldbalance_org, 0.0D))))"),
            "cash_out_ratio": e(f"{count_of(MOVE)} / n"),
            "velocity": e("n / greatest(greatest(end_ms - start_ms, 1) / 60000.0D, 0.1D)"),
            "gaps": e(f"transform({STEPS}, i -> greatest((txs[i].event_ms - txs[i - 1].event_ms) / 1000.0D, 0.1D))"),
            "xy": e("aggregate(transform(txs, (x, i) -> i * x.amount), 0.0D, (s, v) -> s + v)"),
            "mid": e("n div 2"),
            "out_degree": e(distinct("name_dest")),
            "max_single": e(f"coalesce(array_max(transform(filter(txs, x -> {MOVE}), x -> x.amount)), 0.0D)"),
        }
    )
    seq = seq.withColumns(
        {
            "std_amount": e("sqrt(greatest(sq / n - avg_amount * avg_amount, 0.0D))"),
            "interval_mean": e("aggregate(gaps, 0.0D, (s, v) -> s + v) / greatest(n - 1, 1)"),
            "amount_slope": e("(n * xy - (n * (n - 1) / 2.0D) * total_amount) / nullif(n * ((n - 1) * n * (2 * n - 1) / 6.0D) - pow(n * (n - 1) / 2.0D, 2), 0.0D)"),
            "freq_acceleration": e("((n - mid) * 1000.0D / greatest(end_ms - txs[mid].event_ms, 1)) / nullif(mid * 1000.0D / greatest(get(txs, mid - 1).event_ms - start_ms, 1), 0.0D)"),
            "max_single_ratio": e("if(total_amount > 0, max_single / total_amount, 0.0D)"),
            "distinct_dests": F.col("out_degree"),
            "behavior_path": behavior_path(),
        }
    )
    return seq.withColumn("interval_variance", e("aggregate(gaps, 0.0D, (s, v) -> s + (v - interval_mean) * (v - interval_mean)) / greatest(n - 1, 1)")).drop("sq", "gaps", "xy", "mid", "max_single")


def behavior_path():
    """One letter a transaction (T, C, P, D or ?), marks where city, device or channel change, arrows between."""
    letter = "case x.type when 'TRANSFER' then 'T' when 'CASH_OUT' then 'C' when 'PAYMENT' then 'P' when 'DEBIT' then 'D' else '?' end"
    mark = lambda f, m: f"if(i < n - 1 and not (x.{f} <=> get(txs, i + 1).{f}), '[{m}]', '')"
    return F.expr(f"array_join(transform(txs, (x, i) -> concat({letter}, {mark('city', 'CITY')}, {mark('device_id', 'DEV')}, {mark('pay_channel', 'CH')})), '->')")


#: Any clause makes a short sequence worth scoring at once. Fixed values.
SUSPICIOUS = [
    "max_amount >= 15000 and high_risk_count >= 1 and abroad_count >= 1",
    "night_count >= 1 and high_risk_count >= 1 and moves >= 1 and max_amount >= 10000",
    "night_count >= 1 and high_risk_count >= 1 and max_amount >= 15000",
    "city_changes >= 1 and device_changes >= 1 and max_amount >= 15000",
    "channel_changes >= 2 and moves >= 1 and total_amount >= 20000",
    "balance_ratio >= 0.45 and moves >= 1 and max_amount >= 15000",
    "total_amount >= 40000 and high_risk_count >= 1",
    "payments >= 1 and moves >= 2 and total_amount >= 25000",
    "n >= 3 and night_count >= 1 and high_risk_count >= 1 and max_amount >= 10000",
    "n >= 3 and total_amount >= 50000",
    "avg_amount >= 15000 and high_risk_count >= 1 and max_amount >= 20000",
    "abroad_count >= 1 and moves >= 1 and max_amount >= 20000",
    "night_count >= 2 and max_amount >= 10000",
    "high_risk_count >= 2 and total_amount >= 30000",
    "abroad_count >= 1 and night_count >= 1 and max_amount >= 15000",
    "total_amount >= 80000",
    "max_amount >= 40000 and moves >= 1",
    "channel_changes >= 3 and total_amount >= 30000",
    "device_changes >= 2 and high_risk_count >= 1 and max_amount >= 15000",
    "abroad_count >= 1 and max_amount >= 25000",
    "night_count >= 1 and total_amount >= 30000 and max_amount >= 15000",
    "high_risk_count >= 1 and balance_ratio >= 0.7 and max_amount >= 20000",
    "moves >= 3 and total_amount >= 40000",
]


def suspicious(seq: DataFrame) -> DataFrame:
    rows = seq.withColumns({"moves": F.expr(count_of(MOVE)), "payments": F.expr(count_of("x.type = 'PAYMENT'"))})
    return rows.withColumn("suspicious", F.expr(" or ".join(f"({c})" for c in SUSPICIOUS)))


def with_graph(seq: DataFrame, account_stats: DataFrame) -> DataFrame:
    """Join the graph's numbers of each account, and add the two features of time."""
    filled = seq.join(account_stats, "account_id", "left").fillna(0.0, subset=GRAPH)
    near = lambda m: f"size(filter(txs, x -> end_ms - x.event_ms <= {m * 60_000}))"
    hour = "x.transaction_hour"
    each = f"case when {hour} between 0 and 4 then 1.0D when {hour} in (22, 23, 5, 6) then 0.6D when {hour} in (20, 21, 7, 8) then 0.3D else 0.0D end"
    risk = f"least({total(each)} / n, 1.0D)"
    return filled.withColumns({"time_density": F.expr(f"{near(5)} / {near(30)}"), "hour_risk": F.expr(risk)})


#: The neighbourhood features that follow the vector.
NEIGHBOURHOOD = ["neighbor_degree", "neighbor_amount_mean", "neighbor_amount_std", "neighbor_tier_risk", "community_attributes", "clustering", "betweenness", "embedding_norm"]


def with_neighbourhood(seq: DataFrame, clustering: DataFrame) -> DataFrame:
    """Features 36 to 43: what an account's receivers, addresses and devices look like up to each of its sequences; ``clustering(account, clustering)`` is the graph's.

    Receivers accumulate from sequence to sequence. Each (account, sequence, receiver) adds what it changes to the sums over receivers, so no receiver is met again in a later sequence, and sums run over an account's sequences.
    """
    id_ = ["account_id", "session"]
    each = seq.select(*id_, F.explode("txs").alias("x")).select(*id_, "x.*")
    paid = each.filter("name_dest is not null and name_dest <> 'UNKNOWN'").groupBy(*id_, F.col("name_dest").alias("party")).agg(F.sum("amount").alias("a"))
    before = Window.partitionBy("account_id", "party").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    paid = paid.withColumns({"p": F.sum("a").over(before), "first": F.min("session").over(before)}).withColumn("b", F.coalesce("p", F.lit(0.0)) + F.col("a"))
    tier = lambda c: f"case when {c} > 50000 then 0.3D when {c} > 20000 then 0.2D when {c} > 10000 then 0.1D else 0.0D end"
    grown = paid.groupBy(*id_).agg(
        F.count(F.when(F.col("p").isNull(), 1)).alias("d_n"), F.sum("a").alias("d_sum"), F.sum(F.expr("b * b - coalesce(p, 0.0D) * coalesce(p, 0.0D)")).alias("d_sq"),
        F.sum(F.expr(f"{tier('b')} - {tier('coalesce(p, 0.0D)')}")).alias("d_tier"),
    )
    # how often a sequence meets those who are receivers by then, whichever side they are on
    met = each.select(*id_, F.explode(F.array_distinct(F.array("name_orig", "name_dest"))).alias("party")).groupBy(*id_, "party").agg(F.count("*").alias("met")).filter("met >= 3")
    since = paid.groupBy("account_id", "party").agg(F.min("session").alias("since"))
    often = met.join(since, ["account_id", "party"]).filter("since <= session").groupBy(*id_).agg(F.sum(F.expr("if(met >= 5, 0.2D, 0.1D)")).alias("often"))
    used = each.select(*id_, F.explode(F.array(F.concat(F.lit("IP:"), F.nullif("ip_segment", F.lit("UNKNOWN"))), F.concat(F.lit("DEV:"), F.nullif("device_id", F.lit("UNKNOWN"))))).alias("by")).filter("by is not null")
    fresh = used.groupBy("account_id", "by").agg(F.min("session").alias("session")).groupBy(*id_).agg(F.count("*").alias("d_by"))
    upto = Window.partitionBy("account_id").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    s = seq.join(grown, id_, "left").join(fresh, id_, "left").join(often, id_, "left").join(clustering.select(F.col("account").alias("account_id"), "clustering"), "account_id", "left")
    s = s.withColumns({c: F.coalesce(F.sum(f"d_{c}").over(upto), F.lit(0.0)) for c in ("n", "sum", "sq", "tier", "by")} | {"seq_n": F.col("n")})
    moved = "aggregate(filter(txs, x -> x.type {} 'TRANSFER'), 0.0D, (s, x) -> s + x.amount)"
    s = s.withColumns({"went": F.expr(moved.format("=")), "came": F.expr(moved.format("<=> null or x.type <>")), "parties": F.expr(f"{distinct('name_orig')} + {distinct('name_dest')}")})
    s = s.withColumns(
        {
            "neighbor_degree": F.expr("least(1.0D, n / 20.0D)"),
            "neighbor_amount_mean": F.expr("if(n > 0, sum / n / 10000.0D, 0.0D)"),
            "neighbor_amount_std": F.expr("if(n > 0, sqrt(greatest(sq / n - (sum / n) * (sum / n), 0.0D)) / 10000.0D, 0.0D)"),
            "neighbor_tier_risk": F.expr("if(n > 0, (tier + coalesce(often, 0.0D)) / n, 0.0D)"),
            "community_attributes": F.expr("least(1.0D, by / 10.0D)"),
            "clustering": F.coalesce("clustering", F.lit(0.0)),
            "betweenness": F.expr("if(went + came > 0, 2.0D * least(went, came) / (went + came), 0.0D) * least(1.0D, parties / 10.0D)"),
            # an embedding has unit length unless all it is made of is zero
            "embedding_norm": F.expr("if(exists(txs, x -> x.amount <> 0) or seq_n > 0, 1.0D, 0.0D)"),
        }
    )
    return s.withColumn("n", F.col("seq_n")).drop("seq_n", "sum", "sq", "tier", "by", "often", "went", "came", "parties", "d_n", "d_sum", "d_sq", "d_tier", "d_by")


def vector():
    return F.array(*[F.col(c).cast("double") for c in FEATURES])
