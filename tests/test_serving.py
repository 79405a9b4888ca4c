"""Histories, toggles, feedback tables, alert JSON, drift votes and rings on small made-up rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions import explain
from ledgerwatch.operators import drift, evaluate, feedback, fusion, graph, serving
from ledgerwatch.plans import detect, registry
from ledgerwatch.sources.adapter import transactions


def test_rings_of_up_to_six_edges(spark):
    ring = lambda name, n: [(f"{name}{i}", f"{name}{(i + 1) % n}") for i in range(n)]
    edges = spark.createDataFrame([*ring("b", 2), *ring("d", 4), *ring("f", 6), *ring("g", 7), ("d0", "x"), ("x", "y"), ("d0", "d2")], "src string, dst string")
    got = {r.account: r.length for r in graph.shortest_rings(edges).collect()}
    assert got == {"b0": 2, "b1": 2, "d0": 3, "d2": 3, "d3": 3, "d1": 4, **{f"f{i}": 6 for i in range(6)}}


def test_alert_json_has_every_key(spark, sf_dir):
    alerts = detect.rule_alerts(transactions(spark, sf_dir)).limit(20)
    first = alerts.agg(F.min("alert_id")).first()[0]
    more = spark.createDataFrame([(first, "because", "[]", None)], "alert_id string, explanation_summary string, top_features string, graph_path string")
    rows = {r.alert_id: json.loads(r.json) for r in fusion.sink_json(alerts, more).collect()}
    assert all(len(r) == 23 and r["dt"] == r["alert_time"] for r in rows.values())
    assert rows[first]["explanation_summary"] == "because" and {r["explanation_summary"] for k, r in rows.items() if k != first} <= {"UNKNOWN"} and rows[first]["graph_path"] == ""


def test_toggles(spark):
    alerts = spark.createDataFrame([("CEP_RULE",), ("SQL_X",), ("ML_Y",)], "source string")
    table = lambda *rows: spark.createDataFrame(rows, "prefix string, enabled boolean")
    assert {r.source for r in serving.enabled(alerts, table(("CEP", True), ("SQL", False))).collect()} == {"CEP_RULE"}
    assert serving.enabled(alerts, table(("CEP", False))).count() == 3


def test_feedback_tables(spark, tmp_path):
    rows = [(f"a{i}", ["CONFIRMED_FRAUD", "FALSE_POSITIVE", "INCORRECT_TYPE"][i % 3], i) for i in range(9)]
    path = str(tmp_path / "reviews")
    for part in (rows[:5], rows[5:]):
        feedback.written(spark.createDataFrame(part, "alert_id string, feedback_type string, event_ms long"), path)
    table = spark.read.parquet(path)
    assert table.count() == 6 and [r.alert_id for r in feedback.newest(table, "FALSE_POSITIVE", 2).collect()] == ["a7", "a4"]


def test_history_adds_up(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i}", 2, float(rng.random()), int(rng.random() < 0.4), int(t)) for i, t in enumerate(rng.integers(0, 9 * 3_600_000, 200))]
    got = evaluate.history(spark.createDataFrame(rows, "account_id string, n int, probability double, label int, end_ms long")).collect()
    for r in got:
        some = [x for x in rows if x[4] // 3_600_000 <= r.sample_id]
        assert (r.total_samples, r.tp) == (len(some), sum(x[2] >= 0.5 and x[3] == 1 for x in some))


def test_drift_vote(spark):
    rng = np.random.default_rng(1)
    rows = [(f, i, float(rng.normal(5 if f == "moved" and i >= 900 else 1, 0.1)), i >= 900, i < 500) for f in ("still", "moved") for i in range(1000)]
    got = drift.vote(spark.createDataFrame(rows, "feature string, tx_id long, x double, recent boolean, baseline boolean")).first()
    assert (got.features, got.adwin) == (2, 1) and got.ks > 0.15 and got.psi > 0.2 and got.severity in ("SEVERE", "CRITICAL")
    none = drift.vote(spark.createDataFrame([r for r in rows if r[0] == "still"], "feature string, tx_id long, x double, recent boolean, baseline boolean")).first()
    assert (none.adwin, none.ph) == (0, 0)


def test_thresholds_and_samples(spark):
    tries = spark.createDataFrame([(20, 0.9, 0.2, 0.45), (30, 0.6, 0.05, 0.6), (31, 0.6, 0.01, 0.6), (60, 0.7, 0.0, 0.7)], "t int, f1 double, fpr double, value double")
    assert drift.best_threshold(tries).first().threshold == 0.6 and drift.best_threshold(tries, conservative=True).first().threshold == 0.3
    assert drift.best_threshold(tries.filter("t > 99")).first().threshold == 0.55
    rows = spark.createDataFrame([(i, int(i < 2)) for i in range(12)], "tx_id long, is_fraud int")
    assert drift.oversampled(rows, 10, 2).filter("is_fraud = 1").count() == 10


def test_registry_of_patterns(spark):
    types = spark.createDataFrame([("多层链式洗钱",), ("多层链式洗钱(SQL)",), ("分散转入集中提现(X)",), ("凌晨",), ("其他",)], "fraud_type string")
    got = {r.fraud_type: (r.pattern, r.severity) for r in explain.described(types).collect()}
    assert got == {"多层链式洗钱": ("多层链式洗钱", "极高"), "多层链式洗钱(SQL)": ("多层链式洗钱(SQL)", "极高"), "分散转入集中提现(X)": ("分散转入集中提现", "高"), "凌晨": ("凌晨分批掏空", "极高"), "其他": (None, "中")}


def test_review_states_follow_the_last_action(spark):
    alerts = spark.createDataFrame([(x, 100) for x in "abcde"], "alert_id string, event_ms long")
    rows = [("a", "TAKEN", 110), ("a", "RESOLVED", 150), ("b", "TAKEN", 120), ("b", "RELEASED", 130), ("b", "TAKEN", 140), ("c", "TAKEN", 105), ("c", "RELEASED", 105), ("d", "RESOLVED", 160), ("d", "TAKEN", 170), ("d", "RESOLVED", 180)]
    actions = spark.createDataFrame(rows, "alert_id string, action string, at_ms long")
    got = {r.alert_id: (r.state, r.waited_ms, r.handled_ms, r.actions) for r in feedback.review_states(alerts, actions).collect()}
    assert got == {"a": ("RESOLVED", 10, 50, 2), "b": ("IN_REVIEW", 20, None, 3), "c": ("PENDING", 5, None, 2), "d": ("RESOLVED", 70, 80, 3), "e": ("PENDING", None, None, 0)}
    load = {r.state: (r.n, r.waited_ms, r.handled_ms) for r in feedback.review_load(feedback.review_states(alerts, actions)).collect()}
    assert load == {"RESOLVED": (2, 40.0, 65.0), "IN_REVIEW": (1, 20.0, None), "PENDING": (2, 5.0, None)}


def test_too_many_categories_are_an_error(spark):
    alerts = spark.createDataFrame([("SQL_X",), ("CEP_RULE",), ("GRAPH",)], "source string")
    names = lambda n: spark.createDataFrame([(f"SQL_{i}" if i else "SQL", True) for i in range(n)] + [("CEP", False)], "prefix string, enabled boolean")
    assert [r.source for r in serving.enabled(alerts, names(150)).collect()] == ["SQL_X"]
    assert serving.enabled(alerts, names(0)).count() == 3
    with pytest.raises(ValueError, match="categories"):
        serving.enabled(alerts, names(serving.MOST_CATEGORIES + 1))


def test_enrichment_reads_stored_alerts_and_deals_their_slices(spark, sf_dir):
    plan = registry.alert_enrich(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "account_id" in plan
    assert plan.count(", 2), REPARTITION_BY_NUM") >= 4
    alerts = detect.rule_alerts(transactions(spark, sf_dir))
    key = lambda d: sorted((r.alert_id, r.session, r.cep_hits, r.edges, r.volume, r.confidence) for r in d.collect())
    assert key(fusion.enrich(alerts, 7)) == key(fusion.enrich(alerts))
