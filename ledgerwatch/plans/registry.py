"""Every query by name: functions of (spark, sf_dir) over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import api, explain, features, scalar, scores
from ..operators import drift, evaluate, feedback, fusion, graph, joins, models, serving, training, windows
from ..sources import ingest, sinks
from ..sources.adapter import transactions
from ..tables import run_dir, stored
from . import detect, patterns, served

Query = Callable[[SparkSession, str], DataFrame]
NOW_MS = 1704153600000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, the last by the scaled number, as SQL engines round: 0.35958249999999997, a half but for the last bit, goes up."""
    scale = F.lit(10.0**digits)
    return df.select([(F.round(F.col(c) * scale) / scale).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


# -- ingest ---------------------------------------------------------------------------------------


def messages(tx: DataFrame) -> DataFrame:
    from ..schemas import TX_FIELDS

    fields = [F.col(c).alias(j) for j, c, _, _ in TX_FIELDS]
    return tx.select("tx_id", F.struct(*fields, F.col("event_ms").alias("eventTime")).alias("t"))


def cdc_flatten(spark, sf):
    m = messages(transactions(spark, sf)).select(F.to_json(F.struct(F.expr("case tx_id % 4 when 0 then 'c' when 1 then 'r' when 2 then 'u' else 'd' end").alias("op"), F.when(F.expr("tx_id % 8 <> 6"), F.col("t")).alias("after"))).alias("value"))
    return ingest.cdc_flatten(m, "train", NOW_MS).select("nameOrig", "nameDest", "type", "amount", "eventTime", "_data_type", "_op_type", "_timestamp")


def parse_tx_json(spark, sf):
    m = messages(transactions(spark, sf))
    other = F.struct(F.lit("X").alias("nameOrig"))
    value = (
        F.when(F.expr("tx_id % 5 = 0"), F.to_json("t"))
        .when(F.expr("tx_id % 5 = 1"), F.to_json(F.struct(F.col("t").alias("data"))))
        .when(F.expr("tx_id % 5 = 2"), F.to_json(F.struct(F.struct(F.col("t").alias("after"), other.alias("before")).alias("data"))))
        .when(F.expr("tx_id % 5 = 3"), F.to_json(F.struct(F.struct(F.col("t").alias("before")).alias("data"))))
        .otherwise("{broken")
    )
    return ingest.parse_messages(m.select(value.alias("value"))).select("event_ms", "step", "type", "amount", "name_orig", "name_dest", "transaction_hour", "device_risk_level", "is_fraud")


TIMES = ["1718000000000", "6000000", "90000000000", "00:00:06", "01:02:03.5", "PT1H2M3.5S", "PT0.123S", "", "junk", "12:34"]


def parse_event_time(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.element_at(F.array(*[F.lit(x) for x in TIMES]), F.expr(f"cast(event_id % {len(TIMES)} as int) + 1")).alias("raw"))
    return t.select("event_id", "raw", scalar.event_time(F.col("raw")).alias("ms"))


def parse_amount(spark, sf):
    raw = F.expr("case event_id % 6 when 0 then concat('¥', event_id, 'K+') when 1 then concat('￥', event_id, ',500') when 2 then concat(event_id, 'M') when 3 then 'abc' when 4 then concat(' ', event_id, '.5 ') else null end")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", raw.alias("raw")).select("event_id", scalar.parse_amount(F.col("raw")).alias("amount"))


def mask_account(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", scalar.mask_account(F.col("c_name")).alias("account"), scalar.mask_phone(F.col("c_custkey").cast("string")).alias("phone"), scalar.mask_device(F.col("c_mktsegment")).alias("device"))


def valid_tx(spark, sf):
    return ingest.valid(transactions(spark, sf)).select("tx_id", "type", "amount", "name_orig")


def tx_adapter(spark, sf):
    return rounded(transactions(spark, sf))


def prior_risks(spark, sf):
    t = transactions(spark, sf).withColumn("source", F.expr("case tx_id % 4 when 0 then 'ML_ENSEMBLE' when 1 then 'CEP_RULE' when 2 then 'GNN_GRAPH' else 'OTHER' end"))
    return t.select("tx_id", scalar.source_risk(F.col("source")).alias("source_risk"), scalar.city_risk(F.col("city")).alias("city_risk"))


# -- detectors --------------------------------------------------------------------------------------


def one_pattern(p: patterns.Pattern) -> Query:
    return lambda spark, sf: patterns.alerts(transactions(spark, sf), [p]).select("tx_id", "next_ids", "last_ms", "account_id", "fraud_type", "confidence", "amount")


def cep_all(spark, sf):
    return patterns.alerts(transactions(spark, sf)).select("pattern", "tx_id", "next_ids", "account_id", "confidence")


def sql_chain_abc(spark, sf):
    return rounded(joins.chains(transactions(spark, sf)).select("l_tx_id", "r_tx_id", "pair", "time_diff", "decay", "confidence"))


def sql_chain_cogroup(spark, sf):
    return rounded(joins.chains_in_windows(transactions(spark, sf)).select("l_tx_id", "r_tx_id", "l_window_ms", "confidence"))


def sql_scatter_cashout(spark, sf):
    return rounded(joins.scatter_cashout(transactions(spark, sf)).select("account_id", "l_tx_id", "r_tx_id", "total_in", "ratio", "time_diff", "confidence"))


def tags(tx):
    return patterns.alerts(tx).select("account_id", F.col("pattern").alias("rule"), F.col("event_ms").alias("tag_ms"))


def tag_asof(spark, sf):
    tx = transactions(spark, sf)
    return joins.tag_as_of(tx, tags(tx)).select("tx_id", "is_cep_matched", "cep_rule_name")


def ml_input_anti(spark, sf):
    tx = transactions(spark, sf)
    return joins.tag_as_of(tx, tags(tx)).filter("not is_cep_matched").select("tx_id", "name_orig", "amount")


def sql_ip_gang(spark, sf):
    return rounded(windows.ip_gang(transactions(spark, sf)))


def sql_scatter_in(spark, sf):
    return rounded(windows.scatter_in(transactions(spark, sf)))


def tx_duplicate(spark, sf):
    return windows.duplicated(transactions(spark, sf)).select("tx_id", "tracking_account", "amount")


def behavior_seq(spark, sf):
    seq = windows.sequences(transactions(spark, sf))
    return seq.select("account_id", F.size("txs").cast("bigint").alias("n"), F.expr("array_join(transform(txs, x -> cast(x.tx_id as string)), ',')").alias("ids"))


def behavior_path(spark, sf):
    return features.with_features(windows.sequences(transactions(spark, sf))).select("account_id", "behavior_path")


def seq_features(spark, sf):
    return rounded(features.with_features(windows.sequences(transactions(spark, sf))).select("account_id", *features.SEQUENCE), 4)


def suspicious_seq(spark, sf):
    return features.suspicious(features.with_features(windows.sequences(transactions(spark, sf)))).select("account_id", "suspicious")


def full(spark, sf):
    return detect.scored_sequences(transactions(spark, sf))


def graph_features(spark, sf):
    seq = features.with_graph(features.with_features(windows.sequences(transactions(spark, sf))), graph.sequence_stats(transactions(spark, sf)))
    return rounded(seq.select("account_id", *features.FEATURES[23:]), 4)


def behavior_score(spark, sf):
    return rounded(scores.behavior_score(features.with_features(windows.sequences(transactions(spark, sf)))).select("account_id", "behavior_score"))


def ml_scores(spark, sf):
    return rounded(full(spark, sf).select("account_id", "lr_score", "path_score", "stat_score", "behavior_score"), 4)


def ml_alerts(spark, sf):
    return rounded(scores.ensemble(full(spark, sf)).select("account_id", "fraud_type", "probability", "confidence"), 4)


def gnn_topk(spark, sf):
    t = scores.top_neighbors(features.with_features(windows.sequences(transactions(spark, sf))))
    return rounded(t.select("account_id", F.posexplode("top")).select("account_id", "pos", "col.dest", "col.amount"))


def gnn_scores(spark, sf):
    return rounded(scores.gnn_scores(features.with_features(windows.sequences(transactions(spark, sf)))).select("account_id", "node_risk", "neighbor_risk", "deviation", "structure", "gnn_score"))


def gnn_alerts(spark, sf):
    return rounded(scores.gnn_alerts(features.with_features(windows.sequences(transactions(spark, sf)))).select("account_id", "fraud_type", "gnn_score"), 4)


def api_detect(spark, sf):
    return rounded(api.detect(transactions(spark, sf)).select("tx_id", "behavior_score", "fraud_probability", "is_suspect", "detected_type", "risk_level", "source"))


# -- graph --------------------------------------------------------------------------------------------


def graph_edges(spark, sf):
    return graph.recent_edges(graph.edges(transactions(spark, sf))).select("tx_id", "src", "dst", "amount", F.col("rank").cast("bigint").alias("rank"))


def graph_in_edges(spark, sf):
    return graph.recent_edges(graph.edges(transactions(spark, sf)), own="dst").select("tx_id", "src", "dst", "amount", F.col("rank").cast("bigint").alias("rank"))


def graph_attributes(spark, sf):
    return graph.shared_attributes(transactions(spark, sf))


def graph_degree(spark, sf):
    return rounded(graph.degrees(graph.edges(transactions(spark, sf))).select("account", "out_degree", "in_degree", "out_amount", "in_amount"))


def graph_direction(spark, sf):
    return rounded(graph.degrees(graph.edges(transactions(spark, sf))).select("account", "asymmetry", "freq_ratio", "net_flow", "time_concentration"))


def graph_neighbors(spark, sf):
    return graph.neighbors(graph.edges(transactions(spark, sf)))


def graph_community(spark, sf):
    return graph.communities(transactions(spark, sf))


def graph_cycles_2_3(spark, sf):
    """Cycles of 2 to 6 edges, as graph_cycles: the name is from when they ended at 3."""
    return graph.cycle_counts(graph.edges(transactions(spark, sf)))


def graph_chain_depth(spark, sf):
    return graph.chain_depth(graph.edges(transactions(spark, sf)))


def graph_chain_paths(spark, sf):
    paths = graph.chain_paths(graph.edges(transactions(spark, sf)))
    return paths.select("account", "depth", F.array_join("path", "->").alias("path"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def graph_cycles(spark, sf):
    return graph.cycle_counts(graph.edges(transactions(spark, sf)))


def graph_clustering(spark, sf):
    return rounded(graph.clustering(graph.edges(transactions(spark, sf))))


def khop_counts(spark, sf):
    return graph.hop_counts(graph.edges(transactions(spark, sf)))


def graph_fund_chains(spark, sf):
    chains = graph.fund_chains(graph.edges(transactions(spark, sf)), 2)
    return chains.withColumn("path", F.array_join("path", "->"))


def graph_path(spark, sf):
    e = graph.edges(transactions(spark, sf))
    return graph.path_texts(e, graph.shortest_rings(e))


def graph_scatter(spark, sf):
    return rounded(graph.scatter(graph.edges(transactions(spark, sf))))


def graph_counts(spark, sf):
    e = graph.edges(transactions(spark, sf))
    return graph.sides(e).agg(F.count_distinct("account").alias("nodes"), F.expr("count(*) div 2").alias("edges"))


def graph_risk(spark, sf):
    return rounded(graph.risk(graph.accounts(transactions(spark, sf))).select("account", "risk"))


def graph_alerts(spark, sf):
    return rounded(graph.alerts(graph.accounts(transactions(spark, sf))).select("account", "fraud_type", "score", "confidence"), 4)


def khop_neighbors(spark, sf):
    e = graph.edges(transactions(spark, sf))
    return graph.hops(e, e.filter("src like 'U%0'").select(F.col("src").alias("seed")).distinct())


def khop_neighbors_all(spark, sf):
    """Neighbourhood of every account that sends or receives; khop_neighbors is the share of it that its SQL checks."""
    e = graph.edges(transactions(spark, sf))
    return graph.hops(e, graph.sides(e).select(F.col("account").alias("seed")).distinct())


# -- fusion, evaluation, serving ------------------------------------------------------------------------

A = ["account_id", "fraud_type", "confidence", "source", "event_ms", "amount", "city"]


def alerts_union(spark, sf):
    return rounded(detect.rule_alerts(transactions(spark, sf)).select(*A))


def all_alerts(spark, sf):
    return rounded(detect.all_alerts(transactions(spark, sf)).groupBy("source", "fraud_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")))


def enriched(spark, sf):
    a = stored(detect.rule_alerts(transactions(spark, sf)))
    return fusion.confident(fusion.enrich(a, a.count() // fusion.TASK_ROWS + 2))


def alert_enrich(spark, sf):
    return rounded(enriched(spark, sf).select("alert_id", "account_id", "source", "cep_hits", "sql_hits", "edges", "volume", "confidence", "risk_level"))


def alert_sink_projection(spark, sf):
    return rounded(fusion.sink_rows(detect.rule_alerts(transactions(spark, sf))).select("alert_id", "account_id", "fraud_type", "confidence", "source", "alert_time", "risk_level", "amount", "city", "day"))


def normal_tx(spark, sf):
    return rounded(fusion.normal_rows(transactions(spark, sf)).select("tx_id", "account_id", "amount", "city", "transaction_hour", "tx_time"))


def eval_metrics(spark, sf):
    tx = transactions(spark, sf)
    return evaluate.totals(tx, detect.rule_alerts(tx))


def eval_detail(spark, sf):
    tx = transactions(spark, sf)
    return rounded(evaluate.by_type(tx, detect.rule_alerts(tx)))


def validation_metrics(spark, sf):
    seq = scores.behavior_score(features.with_features(windows.sequences(transactions(spark, sf))))
    return rounded(evaluate.confusion(seq.select("account_id", "n", F.col("behavior_score").alias("probability"), F.expr("array_max(transform(txs, x -> x.is_fraud))").alias("label"))))


def validation_dedup(spark, sf):
    tx = transactions(spark, sf)
    tasks = tx.count() // windows.TASK_ROWS + 2
    return evaluate.mark_repeats(detect.rule_alerts(tx), tasks).groupBy("fraud_type", "dedup").agg(F.count("*").alias("n"))


def ablation_real(spark, sf):
    tx = transactions(spark, sf)
    labels = tx.groupBy(F.col("name_orig").alias("account_id")).agg(F.expr("cast(count_if(is_fraud = 1) >= 4 as int)").alias("label"))
    found = detect.rule_alerts(tx).unionByName(detect.graph_layer(tx)).unionByName(detect.ml(tx))
    return rounded(evaluate.layer_subsets(labels, found))


def latency_percentiles(spark, sf):
    """How long each pattern takes from its first event to its last."""
    a = patterns.alerts(transactions(spark, sf)).select("pattern", (F.col("last_ms") - F.col("event_ms")).alias("took_ms"))
    return rounded(windows.latency_percentiles(a, "pattern", "took_ms"))


def throughput(spark, sf):
    return windows.throughput(transactions(spark, sf))


def serving_of(fn, name=None) -> Query:
    return lambda spark, sf: fn(served.alerts(spark, sf))


def serve_totals(spark, sf):
    tx = transactions(spark, sf)
    return serving.total_amounts(served.alerts(spark, sf), fusion.normal_rows(tx))


def serve_traffic(spark, sf):
    tx = transactions(spark, sf)
    return rounded(serving.traffic(fusion.sink_rows(served.alerts(spark, sf)), fusion.normal_rows(tx), now=60))


def serve_recent(spark, sf):
    return rounded(serving.recent(served.alerts(spark, sf)).select("alert_id", "account_id", "confidence", "event_ms"))


def serve_search(spark, sf):
    return rounded(serving.search(served.alerts(spark, sf), fraud_type="链式", source="SQL", least=0.7, offset=20, limit=50).select("alert_id", "account_id", "confidence"))


def serve_kpis(spark, sf):
    tx = transactions(spark, sf)
    return rounded(serving.kpis(tx, served.alerts(spark, sf)))


def feedback_rows(spark, sf):
    return served.alerts(spark, sf).select("alert_id", "fraud_type", "source", "city", "device_id", F.expr("case conv(substring(alert_id, 1, 2), 16, 10) % 5 when 0 then 'FALSE_POSITIVE' when 1 then 'INCORRECT_TYPE' else 'CONFIRMED_FRAUD' end").alias("feedback_type"), F.concat("fraud_type", F.lit(" ok "), "source").alias("comment"))


def feedback_stats(spark, sf):
    return rounded(feedback.rates(feedback_rows(spark, sf)))


def feedback_by_type(spark, sf):
    return rounded(feedback.suggestions(feedback.rates(feedback_rows(spark, sf), "fraud_type")))


def feedback_keywords(spark, sf):
    return feedback.keywords(feedback_rows(spark, sf))


def retrain_trigger(spark, sf):
    f = feedback_rows(spark, sf)
    return rounded(feedback.retrain_due(feedback.rates(f), feedback.rates(f, "fraud_type")))


def review_queue_topk(spark, sf):
    return rounded(feedback.review_queue(served.alerts(spark, sf)).select("alert_id", "account_id", "priority"))


def review_actions(spark, sf):
    """Reviewers' actions on the stored alerts: half are taken, of these a quarter released again, half resolved, some minutes after the alert, by digits of the alert's id."""
    a = served.alerts(spark, sf).select("alert_id", "event_ms", F.expr("cast(conv(substring(alert_id, 1, 2), 16, 10) as int)").alias("h"))
    taken = a.filter("h % 2 = 0").select("alert_id", F.lit("TAKEN").alias("action"), F.expr("event_ms + 60000L * (1 + h % 7)").alias("at_ms"))
    gone = a.filter("h % 8 = 2").select("alert_id", F.lit("RELEASED").alias("action"), F.expr("event_ms + 60000L * (10 + h % 5)").alias("at_ms"))
    done = a.filter("h % 4 = 0").select("alert_id", F.lit("RESOLVED").alias("action"), F.expr("event_ms + 60000L * (10 + h % 11)").alias("at_ms"))
    return taken.unionByName(gone).unionByName(done)


def review_states(spark, sf):
    states = feedback.review_states(served.alerts(spark, sf), review_actions(spark, sf))
    return states.withColumns({c: F.col(c).cast("double") for c in ("waited_ms", "handled_ms")})


def review_load(spark, sf):
    return rounded(feedback.review_load(review_states(spark, sf)))


def feedback_backfill(spark, sf):
    tx = served.alerts(spark, sf)
    f = fusion.distinct_alerts(tx).select("alert_id", F.lit(None).cast("string").alias("city"), F.when(F.substring("alert_id", 1, 1) < "8", F.lit("KNOWN")).alias("device_id"))
    return feedback.backfilled(f, fusion.distinct_alerts(tx)).groupBy("city", F.expr("device_id = 'KNOWN'").alias("known")).agg(F.count("*").alias("n"))


# -- drift, explanation -----------------------------------------------------------------------------------


def samples(spark, sf):
    """Five features of transactions; the last tenth is recent, the first half the baseline."""
    tx = transactions(spark, sf)
    n = tx.agg(F.max("tx_id").alias("m"))
    t = tx.join(F.broadcast(n))
    fields = ["amount", "oldbalance_org", "newbalance_orig", "daily_tx_count", "transaction_hour"]
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in fields]))
    return t.select("tx_id", one.alias("s"), F.expr("tx_id >= m - m div 10").alias("recent"), F.expr("tx_id < m div 2").alias("baseline")).select("tx_id", "s.*", "recent", "baseline")


def ks_stat(spark, sf):
    return rounded(drift.ks(samples(spark, sf)))


def psi(spark, sf):
    return rounded(drift.psi(samples(spark, sf)), 4)


def page_hinkley(spark, sf):
    v = transactions(spark, sf).select(F.col("type").alias("series"), F.col("tx_id").alias("at"), F.expr("amount / 1000").alias("x"))
    return rounded(drift.page_hinkley(v).groupBy("series").agg(F.count("*").alias("n"), F.max("excess").alias("excess"), F.count(F.when(F.col("drift"), 1)).alias("drifts")), 3)


def adwin(spark, sf):
    v = transactions(spark, sf).select(F.col("type").alias("series"), F.col("tx_id").alias("at"), F.expr("amount / 500000").alias("x"))
    return rounded(drift.adwin(v), 6)


def drift_severity(spark, sf):
    k = drift.ks(samples(spark, sf)).agg(F.avg("ks").alias("ks"))
    p = drift.psi(samples(spark, sf)).agg(F.avg("psi").alias("psi"), F.avg((F.col("psi") > 0.2).cast("double")).alias("ratio"))
    return rounded(drift.repair(drift.severity(k.join(F.broadcast(p))), 0.55), 4)


def threshold_opt(spark, sf):
    t = api.detect(transactions(spark, sf)).select(F.round("fraud_probability", 6).alias("score"), F.col("is_fraud").alias("label"))
    return rounded(drift.thresholds(t))


def reservoir(spark, sf):
    return drift.bottom_k(transactions(spark, sf).filter("is_fraud = 1"), "tx_id", 100).select("tx_id", "amount")


def top_features(spark, sf):
    e = explain.contributions(full(spark, sf))
    return rounded(e.select("account_id", F.posexplode(F.slice("contributions", 1, 3))).select("account_id", "pos", "col.feature", "col.contribution"), 4)


def triggered_rules(spark, sf):
    return explain.triggered(features.with_features(windows.sequences(transactions(spark, sf)))).select("account_id", F.array_join("rules", ";").alias("rules"))


def explain_brief(spark, sf):
    return explain.brief(full(spark, sf)).select("account_id", "brief")


def risk_composite(spark, sf):
    t = api.detect(transactions(spark, sf)).select("tx_id", F.col("fraud_probability").alias("confidence"), F.expr("cast(tx_id % 7 as int)").alias("n_rules"), F.expr("(tx_id % 10) / 10.0D").alias("graph_risk"), "amount", "transaction_hour")
    return rounded(explain.composite_risk(t).select("tx_id", "composite", "level"), 4)


def pattern_registry(spark, sf):
    a = served.alerts(spark, sf)
    return a.groupBy(explain.pattern_family(F.col("fraud_type")).alias("family")).agg(F.count("*").alias("n"))


def alert_report(spark, sf):
    return explain.report(served.alerts(spark, sf)).select("alert_id", "report")


def pattern_described(spark, sf):
    a = served.alerts(spark, sf).groupBy("fraud_type").agg(F.count("*").alias("n"))
    return explain.described(a).select("fraud_type", "pattern", "severity", "n")


def serve_by_id(spark, sf):
    a = served.alerts(spark, sf)
    first = a.agg(F.min("alert_id").alias("wanted"))
    return rounded(serving.recent(a.join(F.broadcast(first), F.col("alert_id") == F.col("wanted")), 1).select("alert_id", "account_id", "fraud_type", "confidence", "amount"))


def serve_until_now(spark, sf):
    tx = transactions(spark, sf)
    return serving.until_now(fusion.sink_rows(served.alerts(spark, sf)), fusion.normal_rows(tx), "12:00:00")


def serve_ml_count(spark, sf):
    tx = transactions(spark, sf)
    return serving.count_like(served.alerts(spark, sf).unionByName(detect.ml(tx)))


def serve_enabled(spark, sf):
    toggles = spark.createDataFrame([("CEP", False), ("SQL", True), ("GRAPH", False)], "prefix string, enabled boolean")
    return rounded(serving.recent(serving.enabled(served.alerts(spark, sf), toggles)).select("alert_id", "account_id", "confidence", "event_ms"))


def serve_between(spark, sf):
    a = serving.between(served.alerts(spark, sf), 1704074400000, 1704081600000)
    return rounded(serving.search(a, limit=100).select("alert_id", "account_id", "confidence", "event_ms"))


def serve_feedback_totals(spark, sf):
    f = feedback_rows(spark, sf)
    return rounded(serving.feedback_totals(f.filter("feedback_type = 'CONFIRMED_FRAUD'"), f.filter("feedback_type = 'FALSE_POSITIVE'")))


def validations(spark, sf):
    seq = scores.behavior_score(features.with_features(windows.sequences(transactions(spark, sf))))
    return evaluate.history(seq.select("account_id", "n", "end_ms", F.col("behavior_score").alias("probability"), F.expr("array_max(transform(txs, x -> x.is_fraud))").alias("label")))


def serve_training_history(spark, sf):
    return rounded(serving.training_history(validations(spark, sf)).select("total_samples", "f1", "precision", "recall", "accuracy", "fraud_samples", "normal_samples"))


def serve_drift_history(spark, sf):
    return rounded(serving.newest(validations(spark, sf), "sample_id").select("sample_id", "f1", "precision", "recall", "accuracy", "total_samples", "fraud_samples"))


def serve_validation_latest(spark, sf):
    return rounded(serving.newest(validations(spark, sf), "sample_id", 1).select("sample_id", "tp", "fp", "tn", "fn", "f1"))


def reviews(spark, sf):
    """Feedback with the alert's hour and time, and a reviewer."""
    a = served.alerts(spark, sf)
    kind = F.expr("case conv(substring(alert_id, 1, 2), 16, 10) % 5 when 0 then 'FALSE_POSITIVE' when 1 then 'INCORRECT_TYPE' else 'CONFIRMED_FRAUD' end")
    return a.select("alert_id", "fraud_type", "transaction_hour", "event_ms", kind.alias("feedback_type"), F.concat(F.lit("R"), F.substring("alert_id", 3, 1)).alias("reviewer_id"))


def feedback_profile(spark, sf):
    return rounded(feedback.false_positive_profile(reviews(spark, sf)))


def feedback_recent(spark, sf):
    return feedback.newest(reviews(spark, sf), "FALSE_POSITIVE").select("alert_id", "fraud_type", "event_ms", "reviewer_id")


def threshold_best(spark, sf):
    t = drift.thresholds(api.detect(transactions(spark, sf)).select(F.round("fraud_probability", 6).alias("score"), F.col("is_fraud").alias("label")))
    both = drift.best_threshold(t).withColumn("mode", F.lit("normal")).unionByName(drift.best_threshold(t, conservative=True).withColumn("mode", F.lit("conservative")))
    return rounded(both)


def fraud_buffer(spark, sf):
    return rounded(drift.newest_frauds(transactions(spark, sf), 200).select("tx_id", "amount", "fraud_type"))


def drift_vote(spark, sf):
    return rounded(drift.vote(samples(spark, sf)), 6)


def drift_mean_shift(spark, sf):
    s = samples(spark, sf)
    first = s.agg(F.min("tx_id").alias("first"))
    return rounded(drift.mean_shift(s.join(F.broadcast(first)).select("feature", (F.col("tx_id") - F.col("first")).alias("at"), "x")))


def graph_shortest_ring(spark, sf):
    return graph.shortest_rings(graph.edges(transactions(spark, sf)))


def alert_json(spark, sf):
    return fusion.sink_json(served.alerts(spark, sf))


def latest_upsert(spark, sf):
    rows = transactions(spark, sf).select(F.col("name_orig").alias("k"), "tx_id", "amount", "city")
    return sinks.latest(rows, ["k"], "tx_id")


TRAIN = ["amount", "oldbalance_org", "newbalance_orig", "transaction_hour", "daily_tx_count"]


def retrain(spark, sf):
    """Fit on two thirds of the transactions, score the rest."""
    t = transactions(spark, sf).select("tx_id", F.col("is_fraud").alias("label"), *TRAIN)
    model = training.logistic(t.filter("tx_id % 3 <> 0"), TRAIN)
    return rounded(training.probability(model, t.filter("tx_id % 3 = 0")).select("tx_id", "label", "probability"))


def isolation(spark, sf):
    seq = features.with_features(windows.sequences(transactions(spark, sf))).withColumn("features", F.array(*[F.col(c).cast("double") for c in features.SEQUENCE]))
    return rounded(training.isolation_scores(seq, training.isolation_forest(seq)).select("account_id", "isolation_score"))


def sage_embedding(spark, sf):
    e = graph.edges(transactions(spark, sf))
    nodes = training.hash_embedding(graph.sides(e).select("account").distinct(), "account")
    return training.sage(e, nodes).select("account", F.transform("embedding", lambda x: F.round(x, 6)).cast("string").alias("embedding"))


def gnn_features(spark, sf):
    """The eight neighbourhood features of every sequence."""
    tx = transactions(spark, sf)
    seq = features.with_neighbourhood(features.with_features(windows.sequences(tx)), graph.clustering(graph.edges(tx)))
    return rounded(seq.select("account_id", "session", *features.NEIGHBOURHOOD))


def drift_service(spark, sf):
    return rounded(drift.service(samples(spark, sf)))


def drift_half_cuts(spark, sf):
    s = samples(spark, sf).select(F.col("feature").alias("series"), F.col("tx_id").alias("at"), "x")
    return rounded(drift.half_cuts(s))


def drift_fraud_rate(spark, sf):
    s = samples(spark, sf).filter("feature = 'amount'").join(transactions(spark, sf).select("tx_id", F.col("is_fraud").alias("label")), "tx_id")
    return rounded(drift.rate_shift(s.select("label", "recent")))


def serve_drift_events(spark, sf):
    s = samples(spark, sf)
    first = s.agg(F.min("tx_id").alias("first"))
    shifts = drift.mean_shift(s.join(F.broadcast(first)).select("feature", (F.col("tx_id") - F.col("first")).alias("at"), "x"))
    return rounded(serving.newest(drift.drift_events(shifts), "window"))


def samples_by_type(spark, sf):
    """Five transactions of each type and hour, by seeded digest."""
    t = transactions(spark, sf).select("tx_id", "type", F.expr("event_ms div 3600000").alias("hour"), "amount")
    return rounded(drift.sketches(t, ["type", "hour"], "tx_id", 5).select("type", "hour", "tx_id", "amount"))


def labelled(spark, sf):
    return detect.scored_sequences(transactions(spark, sf)).withColumn("label", F.expr("array_max(transform(txs, x -> x.is_fraud))"))


def trained(spark, sf):
    """Sequences scored by a version of the model that was trained on two thirds of the accounts, stored, and loaded again."""
    seq = stored(labelled(spark, sf).drop("lr_score", "gbdt_score", "isolation_score").withColumns({"lr_score": F.lit(0.0)}))
    path = f"{run_dir(spark)}/models-{uuid.uuid4().hex}"
    models.save(spark, path, 1, models.train(seq.filter("pmod(crc32(account_id), 3) <> 2")))
    return seq, models.load(spark, path)


def model_scores(spark, sf):
    seq, parameters = trained(spark, sf)
    return rounded(models.scored_with(seq, parameters).select("account_id", "session", "label", "lr_score", "gbdt_score", "behavior_score", "stat_score", "path_score", "isolation_score"))


def model_alerts(spark, sf):
    seq, parameters = trained(spark, sf)
    return rounded(models.alerts(seq, parameters).select("account_id", "session", "fraud_type", "probability", "confidence"))


def queries() -> dict[str, Query]:
    here = globals()
    plain = [
        "cdc_flatten", "parse_tx_json", "parse_event_time", "parse_amount", "mask_account", "valid_tx", "tx_adapter", "prior_risks", "cep_all", "sql_chain_abc", "sql_chain_cogroup", "sql_scatter_cashout", "tag_asof",
        "ml_input_anti", "sql_ip_gang", "sql_scatter_in", "tx_duplicate", "behavior_seq", "behavior_path", "seq_features", "suspicious_seq", "graph_features", "behavior_score", "ml_scores", "ml_alerts", "gnn_topk",
        "gnn_scores", "gnn_alerts", "api_detect", "graph_edges", "graph_degree", "graph_direction", "graph_neighbors", "graph_community", "graph_cycles_2_3", "graph_chain_depth", "graph_scatter", "graph_counts",
        "graph_risk", "graph_alerts", "khop_neighbors", "khop_neighbors_all", "alerts_union", "all_alerts", "alert_enrich", "alert_sink_projection", "normal_tx", "eval_metrics", "eval_detail", "validation_metrics", "validation_dedup",
        "ablation_real", "latency_percentiles", "throughput", "serve_totals", "serve_traffic", "serve_recent", "serve_search", "serve_kpis", "feedback_stats", "feedback_by_type", "feedback_keywords", "retrain_trigger",
        "review_queue_topk", "feedback_backfill", "ks_stat", "psi", "page_hinkley", "adwin", "drift_severity", "threshold_opt", "reservoir", "top_features", "triggered_rules", "explain_brief", "risk_composite",
        "pattern_registry", "alert_report", "latest_upsert", "retrain", "isolation", "sage_embedding",
        "pattern_described", "serve_by_id", "serve_until_now", "serve_ml_count", "serve_enabled", "serve_between", "serve_feedback_totals", "serve_training_history", "serve_drift_history", "serve_validation_latest",
        "feedback_profile", "feedback_recent", "threshold_best", "fraud_buffer", "drift_vote", "graph_shortest_ring", "alert_json", "drift_mean_shift", "graph_fund_chains", "graph_path",
        "review_states", "review_load", "gnn_features", "drift_service", "drift_half_cuts", "drift_fraud_rate", "serve_drift_events", "samples_by_type", "model_scores", "model_alerts",
        "graph_in_edges", "graph_attributes", "graph_cycles", "graph_clustering", "graph_chain_paths", "khop_counts",
    ]
    out: dict[str, Query] = {f"cep_{p.name}": one_pattern(p) for p in patterns.PATTERNS}
    out |= {name: here[name] for name in plain}
    for name in ("by_type", "by_source", "by_confidence", "by_city", "by_amount", "rule_hits", "alert_count"):
        out[f"serve_{name}"] = serving_of(getattr(serving, name))
    out["serve_types"] = serving_of(lambda a: serving.distinct_of(a, "fraud_type"))
    out["serve_before_hour"] = serving_of(lambda a: serving.alert_count(a, 8))
    return out
