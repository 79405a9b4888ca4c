"""Scores of behaviour sequences: behaviour clauses, linear model, path and profile anomalies, ensemble, neighbourhood score, and their alert rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES, STEPS

#: Fixed values: (condition, points) of the behaviour score.
BEHAVIOR = [
    ("max_amount >= 30000", 0.08), ("max_amount >= 50000", 0.06), ("total_amount >= 50000", 0.06), ("total_amount >= 100000", 0.06), ("high_risk_count >= 1", 0.08), ("high_risk_count >= 2", 0.06),
    ("abroad_count >= 1", 0.10), ("night_count >= 1", 0.06), ("night_count >= 2", 0.04), ("city_changes >= 1 and device_changes >= 1", 0.08), ("cash_out_ratio >= 0.5 and max_amount >= 15000", 0.08),
    ("cash_out_ratio >= 0.7 and max_amount >= 30000", 0.06), ("balance_ratio >= 0.5", 0.08), ("balance_ratio >= 0.8", 0.06), ("velocity >= 2.0 and cash_out_ratio >= 0.4", 0.06),
    ("channel_changes >= 2 and total_amount >= 20000", 0.06), ("out_degree >= 3 and max_single_ratio >= 0.3", 0.06), ("amount_slope > 8000", 0.06), ("freq_acceleration >= 2.0", 0.04),
    ("night_count >= 1 and abroad_count > 0 and high_risk_count >= 1 and max_amount >= 20000", 0.10), ("cash_out_ratio = 0 and n >= 2 and total_amount >= 15000 and total_amount <= 200000", 0.10),
    ("cash_out_ratio = 0 and n >= 3 and night_count >= 2 and max_amount >= 20000", 0.10),
]

#: The first condition that holds names the fraud.
ML_TYPES = [
    ("night_count >= 2 and abroad_count > 0 and high_risk_count >= 1 and max_amount >= 50000", "账户被盗急速转账"),
    ("cash_out_ratio = 0 and n >= 3 and total_amount >= 50000 and total_amount <= 500000", "虚假交易退款套利"),
    ("cash_out_ratio = 0 and n >= 4 and night_count >= 2 and max_amount >= 50000", "养卡提额异常消费"),
    ("city_changes >= 1 and device_changes >= 1 and max_amount >= 30000", "在线模型识别异地跨设备异常"),
    ("cash_out_ratio >= 0.6 and max_amount >= 30000", "在线模型识别集中提现模式"),
    ("velocity >= 2.0 and cash_out_ratio >= 0.5", "在线模型识别高频资金转移"),
    ("high_risk_count >= 1 and total_amount >= 50000", "在线模型识别高风险设备大额"),
    ("abroad_count > 0 and night_count >= 1 and max_amount >= 30000", "在线模型识别境外夜间异常"),
    ("stat_score >= 0.50 and balance_ratio >= 0.5", "统计画像偏离欺诈"),
    ("out_degree >= 3 and max_single_ratio >= 0.3", "在线模型识别多目标分散转出"),
    ("n >= 2 and amount_slope > 10000 and max_amount >= 30000", "在线模型识别小额试探大额转出"),
    ("night_count >= 2 and balance_ratio >= 0.7 and total_amount >= 30000", "在线模型识别凌晨分批掏空"),
    ("probability >= 0.75", "高置信集成模型欺诈"),
]

#: Any of these alerts while no global model exists.
ML_RULES = [
    "behavior_score >= 0.55", "abroad_count > 0 and high_risk_count >= 1 and max_amount >= 50000", "night_count >= 2 and high_risk_count >= 1 and max_amount >= 50000",
    "city_changes >= 1 and device_changes >= 1 and max_amount >= 50000", "total_amount >= 100000 and high_risk_count >= 1", "cash_out_ratio >= 0.7 and max_amount >= 50000", "night_count >= 2 and max_amount >= 50000",
    "abroad_count > 0 and night_count >= 1 and max_amount >= 30000", "channel_changes >= 2 and total_amount >= 50000", "amount_slope > 15000 and max_amount >= 50000",
    "out_degree >= 3 and max_single_ratio >= 0.4 and total_amount >= 50000",
]

#: Fixed values of the linear model: weights, bias, and the means and deviations it assumes before it has seen samples.
LR_WEIGHTS = [0.15, 0.10, 0.20, 0.18, 0.14, 0.18, 0.10, 0.14, 0.22, 0.22, 0.12, 0.12, 0.08, 0.25, 0.16, 0.13, 0.18, 0.20, 0.23, 0.16, 0.13, 0.20, 0.10, 0.18, 0.15, 0.20, 0.12, 0.12, 0.15, 0.10, 0.25, 0.18, 0.22, 0.20, 0.18, 0.22]
LR_BIAS = -0.8
LR_MEANS = [80000, 30000, 180000, 260000, 0.5, 0.5, 0.4, 0.3, 0.2, 0.1, 1.4, 1.4, 1.3, 0.35, 0.55, 1.2, 30.0, 500.0, 1000.0, 1.0, 2.0, 0.4, 2.0, 0.5, 1.5, 3.0, 50000.0, 50000.0, 1.0, 4.0, 0.5, 1.5, 0.3, 0.5, 0.3, 0.4]
LR_STDS = [90000, 50000, 180000, 300000, 1.2, 1.2, 1.0, 1.0, 0.8, 0.6, 1.0, 1.0, 0.8, 0.35, 0.35, 1.5, 60.0, 800.0, 5000.0, 1.5, 3.0, 0.3, 3.0, 2.0, 2.0, 5.0, 80000.0, 80000.0, 1.5, 6.0, 0.5, 1.0, 0.5, 0.4, 0.3, 0.3]
#: Weights of linear model, boosted trees, behaviour, profile and path.
ENSEMBLE = {"lr": 0.28, "gbdt": 0.22, "behavior": 0.28, "stat": 0.12, "path": 0.10}


def points(table) -> str:
    """Sum of the points whose condition holds, 1 at most; added as decimals, so a sum of tenths never falls beside its level or a half of the last digit shown."""
    return "cast(least(1BD, " + " + ".join(f"if({c}, {p}BD, 0BD)" for c, p in table) + ") as double)"


def first_of(table) -> str:
    return "case " + " ".join(f"when {c} then '{t}'" for c, t in table) + " end"


def behavior_score(seq: DataFrame) -> DataFrame:
    return seq.withColumn("behavior_score", F.expr(points(BEHAVIOR)))


def numbers(values) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def lr_score(seq: DataFrame, weights=LR_WEIGHTS, bias=LR_BIAS, means=LR_MEANS, stds=LR_STDS) -> DataFrame:
    """Logistic probability and mean distance from what is usual, mixed 72 to 28. One loop over the vector: 36 inlined terms would outgrow a compiled method."""
    seq = seq.withColumn("z", F.expr(f"transform(features, (v, i) -> greatest(-3.0D, least(3.0D, (coalesce(nanvl(v, 0.0D), 0.0D) - {numbers(means)}[i]) / (3.0D * {numbers(stds)}[i]))) / 3.0D)"))
    seq = seq.withColumns({"logit": F.expr(f"aggregate(zip_with(z, {numbers(weights)}, (a, b) -> a * b), {float(bias)!r}D, (s, x) -> s + x)"), "far": F.expr(f"least(1.0D, aggregate(z, 0.0D, (s, x) -> s + abs(x)) / {len(weights)}.0D)")})
    p = "case when logit > 35 then 1.0D when logit < -35 then 0.0D else 1.0D / (1.0D + exp(-logit)) end"
    return seq.withColumn("lr_score", F.expr(f"greatest(0.0D, least(1.0D, ({p}) * 0.72D + far * 0.28D))")).drop("z", "logit", "far")


#: Sequences to a task of the join with paths, and of a path from which it is broadcast: such paths are no more than all sequences by this number.
TASK_ROWS = 25_000


def path_scores(seq: DataFrame) -> DataFrame:
    """Rare paths are odd: by the path's count among all sequences. Frequent paths are broadcast, the rest is dealt to tasks by the number of sequences, so no task holds a path."""
    counts = seq.groupBy("behavior_path").agg(F.count("*").alias("path_count"))
    totals = counts.agg(F.sum("path_count").alias("path_total"))
    freq = "(path_count / path_total)"
    score = F.expr(f"case when path_total < 2 then 0.0D when {freq} < 1.0D / (path_total * 0.5D) then 0.9D when path_count < 5 then 0.5D + 0.4D * (1.0D - path_count / 5.0D) else greatest(0.0D, 0.3D * (1.0D - {freq} * 10)) end")
    often, seldom = F.broadcast(counts.filter(F.col("path_count") > TASK_ROWS)), counts.filter(F.col("path_count") <= TASK_ROWS)
    tasks = seq.count() // TASK_ROWS + 2
    rest = seq.join(often, "behavior_path", "left_anti").repartition(tasks, "behavior_path").join(seldom.repartition(tasks, "behavior_path"), "behavior_path")
    both = seq.join(often, "behavior_path").unionByName(rest)
    return both.join(F.broadcast(totals)).withColumn("path_score", score)  # one row of totals


def profile(seq: DataFrame) -> DataFrame:
    """Mean and sample deviation of each feature over all sequences: one row."""
    each = seq.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.count("*").alias("samples"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))
    rows = F.array_sort(F.collect_list(F.struct("i", "mean", "std")))  # as many as features
    return each.agg(F.max("samples").alias("samples"), rows.alias("r")).select("samples", F.col("r.mean").alias("means"), F.col("r.std").alias("stds"))


def stat_scores(seq: DataFrame) -> DataFrame:
    """Mean over features of the distance from the profile in deviations, 3 and more counting 1."""
    total = F.expr("if(samples < 2, 0.0D, aggregate(transform(features, (v, i) -> least(1.0D, abs(v - means[i]) / greatest(stds[i], 0.001D) / 3.0D)), 0.0D, (s, x) -> s + x) / size(features))")
    return seq.join(F.broadcast(profile(seq))).withColumn("stat_score", total).drop("means", "stds", "samples")  # one row of figures


def ensemble(seq: DataFrame, global_model: bool = False, drift: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """Alerts from component scores ``lr_score, gbdt_score, behavior_score, stat_score, path_score, isolation_score``. Rows without a nameable type go. ``weights``: learned ones in place of the fixed."""
    weights = weights or ENSEMBLE
    whole = sum(weights.values())
    base = " + ".join(f"{k}_score * {weights[k] / whole * 0.7!r}D" for k in ENSEMBLE)
    limit = 0.55 * (0.8 if drift else 1.0) * (0.85 if global_model else 1.0)
    seq = seq.withColumn("probability", F.expr(f"least(1.0D, {base} + isolation_score * 0.15D + gbdt_score * 0.15D)"))
    rule = f"probability >= {limit!r}D" + ("" if global_model else " or " + " or ".join(f"({r})" for r in ML_RULES))
    named = seq.filter(rule).withColumn("fraud_type", F.expr(first_of(ML_TYPES))).filter("fraud_type is not null")
    return named.withColumn("confidence", F.greatest("probability", "behavior_score"))


# -- neighbourhood (star graph) score -----------------------------------------------------------------

#: Initial risk of a node.
NODE_RISK = [("max_amount > 25000", 0.15), ("total_amount > 80000", 0.10), ("velocity > 3.0", 0.10), ("night_count > 0", 0.10), ("high_risk_count > 0", 0.12), ("abroad_count > 0", 0.15), ("balance_ratio > 0.5", 0.12), ("cash_out_ratio > 0.6", 0.08)]
#: What is usual of a feature, and its deviation.
USUAL = {0: (5000.0, 3000.0), 2: (10000.0, 5000.0), 3: (20000.0, 15000.0), 4: (0.0, 1.0), 5: (0.0, 0.5), 7: (0.0, 0.5), 8: (0.0, 0.3), 9: (0.0, 0.2)}
#: The first condition that holds names the fraud.
GNN_TYPES = [
    ("out_degree >= 4 and structure > 0.5", "GNN识别星型分散转出洗钱"),
    ("out_degree >= 2 and cash_out_ratio > 0.7", "GNN识别链式转账洗钱"),
    ("risk > 0.6 and out_degree >= 3", "GNN识别高危邻域关联欺诈"),
    ("cash_out_ratio > 0.8 and total_amount > 30000", "GNN识别集中提现异常"),
    ("structure > 0.6", "GNN识别图拓扑结构异常"),
    ("risk > 0.5", "GNN识别嵌入空间异常模式"),
    ("true", "GNN综合识别图神经网络异常"),
]
TOP_K = 8


def edge_weight(amount: str) -> str:
    return f"(log1p({amount}) / log1p(100000.0D))"


def top_neighbors(seq: DataFrame, k: int = TOP_K) -> DataFrame:
    """``edges``: transactions to others, and ``top``: the ``k`` largest, equal amounts in order of time."""
    edges = F.expr("filter(txs, x -> x.name_dest is not null and x.name_dest <> 'UNKNOWN' and x.name_dest <> account_id)")
    top = F.expr(f"slice(array_sort(transform(edges, (x, i) -> struct(-x.amount as neg, i as i, x.name_dest as dest, x.amount as amount, x.type as type, {edge_weight('x.amount')} as w))), 1, {k})")
    return seq.withColumn("edges", edges).withColumn("top", top)


def gnn_scores(seq: DataFrame) -> DataFrame:
    """Message passing over the star of a sequence: 40 % itself, 35 % neighbours, 25 % neighbours' neighbours; then risk, structure and their mix."""
    e, fused = F.expr, {}
    seq = top_neighbors(seq)
    # only features that the risk looks at are passed on; 0, 2, 3 and 7 have a part from neighbours
    hop1 = lambda body: f"coalesce(aggregate(top, 0.0D, (s, x) -> s + x.w * {body}) / nullif(aggregate(top, 0.0D, (s, x) -> s + x.w), 0.0D), 0.0D)"
    norm = "(log1p(x.amount) / 15.0D)"
    seq = seq.withColumn("totals", e("transform(array_distinct(transform(edges, x -> x.name_dest)), d -> struct(d as dest, aggregate(filter(edges, x -> x.name_dest = d), 0.0D, (s, x) -> s + x.amount) as amount))"))
    # second hop: for the i-th of the largest, every other neighbour that isn't among the first i
    pairs = f"flatten(transform(top, (t, i) -> transform(filter(totals, d -> not array_contains(transform(slice(top, 1, i + 1), q -> q.dest), d.dest)), d -> struct(d.amount as amount, {edge_weight('d.amount')} * 0.25D as w))))"
    seq = seq.withColumn("second", e(pairs))
    hop2 = lambda part: f"coalesce(aggregate(second, 0.0D, (s, x) -> s + x.w * {norm} * {part}) / nullif(aggregate(second, 0.0D, (s, x) -> s + x.w), 0.0D), 0.0D)"
    for i, (usual, dev) in USUAL.items():
        near = {0: hop1(norm), 2: hop1(f"{norm} * 1.5D"), 3: hop1(f"{norm} * 5.0D"), 7: hop1("if(x.amount > 20000, 1.0D, 0.0D)")}.get(i, "0.0D")
        far = {0: hop2("0.5D"), 3: hop2("2.5D")}.get(i, "0.0D")
        # a share of a count is exact, as SQL's decimals are
        own = f"0.4D * {FEATURES[i]}" if i in (0, 2, 3) else f"{FEATURES[i]} * 4 / 10.0D"
        fused[i] = f"least(1.0D, abs(if(size(top) = 0, {FEATURES[i]}, {own} + 0.35D * {near} + 0.25D * {far}) - {usual}D) / {dev}D * 0.1D)"
    neighbor = "cast(case when x.amount > 50000 then 0.3BD when x.amount > 20000 then 0.2BD when x.amount > 10000 then 0.1BD else 0BD end + case x.type when 'CASH_OUT' then 0.15BD when 'TRANSFER' then 0.05BD else 0BD end as double)"
    seq = seq.withColumns(
        {
            "node_risk": e(points(NODE_RISK)),
            "neighbor_risk": e(f"coalesce(aggregate(edges, 0.0D, (s, x) -> s + {edge_weight('x.amount')} * {neighbor}) / nullif(aggregate(edges, 0.0D, (s, x) -> s + {edge_weight('x.amount')}), 0.0D), 0.0D)"),
            "deviation": e(f"least(1.0D, ({' + '.join(fused.values())}) / 36.0D)"),
            "n_edges": e("size(edges)"),
            "max_total": e("coalesce(array_max(transform(totals, d -> d.amount)), 0.0D)"),
            "variance": e("coalesce(greatest(aggregate(totals, 0.0D, (s, d) -> s + d.amount * d.amount) / nullif(size(totals), 0) - pow(aggregate(totals, 0.0D, (s, d) -> s + d.amount) / nullif(size(totals), 0), 2), 0.0D), 0.0D)"),
            "chain_share": e("size(filter(sequence(1, greatest(n - 2, 1)), i -> n >= 3 and get(txs, i - 1).type = 'TRANSFER' and get(txs, i).type = 'TRANSFER' and get(txs, i + 1).type = 'TRANSFER')) / greatest(n - 2, 1)"),
            "ups": e(f"size(filter({STEPS}, i -> txs[i].amount > txs[i - 1].amount))"),
            "downs": e(f"size(filter({STEPS}, i -> txs[i].amount < txs[i - 1].amount))"),
            "debit": e("aggregate(filter(txs, x -> x.type = 'DEBIT'), 0.0D, (s, x) -> s + x.amount)"),
            "cash": e("aggregate(filter(txs, x -> x.type = 'CASH_OUT'), 0.0D, (s, x) -> s + x.amount)"),
            "cashes": e("size(filter(txs, x -> x.type = 'CASH_OUT'))"),
            "most_met": e("coalesce(array_max(transform(totals, d -> size(filter(edges, x -> x.name_dest = d.dest)))), 0)"),
        }
    )
    # no node has an embedding, which counts 0.5; points are hundredths, so their share is a decimal too and a score that ends in a half doesn't fall below it
    seq = seq.withColumn("risk", e("least(1.0D, cast(cast(node_risk as decimal(4, 2)) * 0.30BD as double) + neighbor_risk * 0.25D + deviation * 0.25D + 0.5D * 0.20D)"))
    chain = "if(n < 3, 0.0D, least(1.0D, chain_share * 0.5D + if(ups + downs = 0, 0.0D, greatest(ups, downs) / nullif(ups + downs, 0)) * 0.5D))"
    seq = seq.withColumn(
        "structure",
        e(
            f"""least(1.0D, cast(case when n_edges >= 5 then 0.25BD when n_edges >= 3 then 0.15BD when n_edges >= 2 then 0.05BD else 0BD end
            + if(max_total > 0 and variance / max_total < 0.1 and n_edges >= 3, 0.15BD, 0BD) as double) + {chain} * 0.20D
            + if(debit > 0 and cash > debit * 0.7 and cashes >= 2, 0.12D, 0.0D) + case when most_met >= 5 then 0.09D when most_met >= 3 then 0.045D else 0.0D end)"""
        ),
    )
    factor = "least(1.0D, greatest(out_degree, 1) / 5.0D)"
    seq = seq.withColumn("gnn_score", e(f"(0.5D + 0.3D * {factor}) * risk + (0.5D - 0.3D * {factor}) * structure"))
    seq = seq.withColumn("gnn_score", e("if(risk > 0.7 and structure > 0.5, least(1.0D, gnn_score * 1.15D), gnn_score)"))
    return seq.withColumn("gnn_score", e("least(1.0D, gnn_score + if(max_amount > 50000, 0.05D, 0.0D))"))


def gnn_alerts(seq: DataFrame) -> DataFrame:
    return gnn_scores(seq).filter("gnn_score >= 0.40").withColumn("fraud_type", F.expr(first_of(GNN_TYPES)))


