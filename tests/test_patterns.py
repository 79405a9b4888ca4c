"""Patterns: bounds, contiguity, keys; compiled plans against a plain matcher on random sequences, in batch and as a stream."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import evaluate, fusion, windows
from ledgerwatch.plans import detect, patterns, registry
from ledgerwatch.plans.patterns import PATTERNS, Pattern, Stage, alerts, repeat
from ledgerwatch.schemas import TRANSACTION
from ledgerwatch.sources.adapter import transactions
from ledgerwatch.streaming.detectors import matches

BASE = {"step": 0, "type": "TRANSFER", "amount": 0.0, "name_orig": "A", "oldbalance_org": 0.0, "newbalance_orig": 0.0, "name_dest": "Z", "oldbalance_dest": 0.0, "newbalance_dest": 0.0, "is_flagged_fraud": 0, "device_id": "d", "device_type": "t", "pay_channel": "x", "city": "c", "ip_segment": "i", "transaction_hour": 12, "daily_tx_count": 0, "device_risk_level": "LOW", "is_abroad": "LOCAL", "group_id": "g", "fraud_type": "NORMAL", "is_fraud": 0}
HOUR = 3_600_000


def rows(spark, *events):
    data = [{**BASE, **e, "tx_id": i, "event_ms": e.get("event_ms", i * 1000)} for i, e in enumerate(events)]
    return spark.createDataFrame([tuple(d[f.name] for f in TRANSACTION) for d in data], TRANSACTION)


def found(spark, name, *events):
    p = next(p for p in PATTERNS if p.name == name)
    return sorted((r.tx_id, r.next_ids) for r in alerts(rows(spark, *events), [p]).collect())


@pytest.mark.parametrize("amount, hit", [(999.99, False), (1000.0, True), (6000.0, True), (6000.01, False)])
def test_p01_first_amount(spark, amount, hit):
    assert bool(found(spark, "p01", {"amount": amount}, {"amount": 30000.0, "device_risk_level": "HIGH"})) == hit


@pytest.mark.parametrize("gap, hit", [(2 * HOUR - 1, True), (2 * HOUR, False)])
def test_p01_within_is_exclusive(spark, gap, hit):
    assert bool(found(spark, "p01", {"amount": 2000.0, "event_ms": 5}, {"amount": 30000.0, "is_abroad": "ABROAD", "event_ms": 5 + gap})) == hit


def test_relaxed_contiguity(spark):
    a, b, x = {"amount": 2000.0}, {"amount": 30000.0, "is_abroad": "ABROAD"}, {"type": "PAYMENT", "amount": 1.0}
    assert found(spark, "p01", a, x, b) == [(0, "2")]
    assert found(spark, "p01", a, a, b) == [(0, "2"), (1, "2")]
    assert found(spark, "p01", a, b, b) == [(0, "1")]


def test_consecutive(spark):
    s, big, x = {"amount": 500.0}, {"amount": 40000.0, "is_abroad": "ABROAD"}, {"amount": 5000.0}
    assert found(spark, "p07", s, s, big) == [(0, "1,2")]
    assert found(spark, "p07", s, x, s, big) == []
    assert found(spark, "p07", s, s, s, big) == [(0, "1,3"), (1, "2,3")]


def test_keys_other_than_the_sender(spark):
    assert found(spark, "p08", {"amount": 15000.0, "name_orig": "A"}, {"amount": 15000.0, "name_orig": "B"}) == [(0, "1")]
    assert found(spark, "p04", {"amount": 5000.0, "name_orig": "A"}, {"amount": 5000.0, "name_orig": "B"}, {"amount": 20000.0, "type": "CASH_OUT", "name_orig": "C"}) == [(0, "1,2")]


def test_equal_times_fall_back_to_ids(spark):
    assert found(spark, "p01", {"amount": 2000.0, "event_ms": 7}, {"amount": 30000.0, "is_abroad": "ABROAD", "event_ms": 7}) == [(0, "1")]


@pytest.mark.parametrize("seed", range(3))
def test_random_sequences_match_a_plain_matcher(spark, seed):
    rng = random.Random(seed)
    events = [{"amount": float(rng.choice([10, 20, 30])), "name_orig": rng.choice("AB"), "event_ms": rng.randrange(60)} for _ in range(120)]
    table = rows(spark, *events)
    patterns = [
        Pattern("x", "x", "name_orig", (Stage("amount = 10"), Stage("amount = 20"), Stage("amount = 30")), 15, 0.5),
        Pattern("y", "y", "name_orig", (*repeat("amount = 10", 2), Stage("amount >= 20")), 25, 0.5),
        Pattern("z", "z", "name_orig", repeat("amount >= 20", 3, consecutive=False), 9, 0.5),
    ]
    tests = {"x": [{10.0}, {20.0}, {30.0}], "y": [{10.0}, {10.0}, {20.0, 30.0}], "z": [{20.0, 30.0}] * 3}
    want = set()
    for p in patterns:
        for key in "AB":
            flags = lambda e: sum((e["amount"] in s) << k for k, s in enumerate(tests[p.name]))  # noqa: B023, E731
            seq = sorted((e["event_ms"], i, flags(e)) for i, e in enumerate(events) if e["name_orig"] == key)
            want |= {(p.name, m[0], m[1]) for m in matches(seq, [s.follow for s in p.stages[1:]], p.within_ms)}
    assert {(r.pattern, r.tx_id, r.next_ids) for r in alerts(table, patterns).select("pattern", "tx_id", "next_ids").collect()} == want


def test_one_sort_serves_the_patterns_of_a_key(spark, sf_dir):
    from ledgerwatch.sources.adapter import transactions

    own = [p for p in PATTERNS if p.key == "name_orig"]
    plan = alerts(transactions(spark, sf_dir), own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(name_orig") == 1
    assert "Python" not in plan and F is not None


def test_slices_of_a_key_change_nothing(spark, sf_dir, monkeypatch):
    """Every pattern with slices as short as its time, and with one slice for all: the same matches."""
    tx = transactions(spark, sf_dir).withColumn("event_ms", F.expr("event_ms * 20"))
    found = {}
    for slices in (1, 4, 1_000_000):
        monkeypatch.setattr(patterns, "SLICES", slices)
        found[slices] = sorted((r.pattern, r.tx_id, r.next_ids) for r in patterns.alerts(tx).select("pattern", "tx_id", "next_ids").collect())
    assert found[1] == found[4] == found[1_000_000] and found[1]


def test_sessions_are_stitched_over_slices(spark, sf_dir):
    """Slices of a second and of a year give the same sessions."""
    tx = transactions(spark, sf_dir)
    key = lambda d: sorted((r.account_id, r.session, tuple(x.tx_id for x in r.txs)) for r in d.collect())
    one, other = (key(windows.sequences(tx, slice_ms=ms)) for ms in (1000, 31_536_000_000))
    assert one == other and one
    found = patterns.alerts(tx).selectExpr("cast(tx_id as string) || pattern as alert_id", "account_id", "event_ms", "source", "confidence", "cast(null as string) behavior_path", "cast(null as string) details")
    rows = fusion.enrich(found).select("alert_id", "session", "cep_hits").collect()
    assert max(r.cep_hits for r in rows) > 1


def test_a_task_of_the_patterns_stays_small(spark, sf_dir, monkeypatch):
    """Rows are dealt to tasks by their number, and one sort before the windows serves all stages of a key's patterns."""
    monkeypatch.setattr(patterns, "TASK_ROWS", 100)
    tx = transactions(spark, sf_dir)
    own = [p for p in PATTERNS if p.key == "name_orig"]
    plan = alerts(tx, own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and f", {tx.count() // 100 + 2})" in plan


def test_sequences_are_dealt_to_tasks_by_number(spark, sf_dir, monkeypatch):
    """A task's rows follow from TASK_ROWS, whatever the session's number of shuffle partitions."""
    tx = transactions(spark, sf_dir)
    key = lambda df: {(r.account_id, tuple(x.tx_id for x in r.txs)) for r in df.collect()}
    want = key(windows.sequences(tx))
    monkeypatch.setattr(windows, "TASK_ROWS", 100)
    got = windows.sequences(tx)
    assert got.rdd.getNumPartitions() == tx.count() // 100 + 2 > 4 and key(got) == want and want


def test_graph_figures_are_joined_in_tasks_dealt_by_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(windows, "TASK_ROWS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(detect.scored_sequences(transactions(spark, sf_dir)).inputFiles()) > 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["eval_metrics", "eval_detail", "validation_dedup"])
def test_windows_of_senders_are_dealt_to_tasks_by_number(spark, sf_dir, monkeypatch, name):
    """Senders of a window, and the transactions that windows point to, are dealt by TASK_ROWS, whatever the session's number of shuffle partitions."""
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(registry.queries()[name](spark, sf_dir))
    monkeypatch.setattr(windows, "TASK_ROWS", 20)
    tx = transactions(spark, sf_dir)
    got = registry.queries()[name](spark, sf_dir)
    plan = re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())
    tasks = {
        "ip_segment, window_ms": tx.filter("type = 'TRANSFER' and amount > 8000 and (device_risk_level = 'HIGH' or transaction_hour >= 20)").count() // 20 + 2,
        "name_dest, window_ms": tx.filter("type = 'TRANSFER' and amount > 3000 and amount < 30000").count() // 20 + 2,
    }
    for cut, n in tasks.items():
        assert f"hashpartitioning({cut}, bucket, {n})" in plan and f"hashpartitioning({cut}, {n})" in plan and n > 4
    for column in ("first_tx", "last_tx"):
        assert f"hashpartitioning({column}, {tx.count() // 20 + 2})" in plan
    assert key(got) == want and want


def test_buckets_of_senders_change_nothing(spark, sf_dir, monkeypatch):
    """Sender by sender and all senders at once: the same windows, but for the last bits of sums."""
    tx = transactions(spark, sf_dir).withColumn("name_dest", F.expr("concat('U', tx_id % 3)"))
    key = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    for windowed in (windows.ip_gang, windows.scatter_in):
        found = {}
        for buckets in (1, 64, 1_000_000):
            monkeypatch.setattr(windows, "BUCKETS", buckets)
            found[buckets] = key(windowed(tx))
        assert found[1] == found[64] == found[1_000_000]
        assert found[1] or windowed is windows.ip_gang


def test_repeats_are_marked_in_tasks_dealt_by_number(spark, sf_dir, monkeypatch):
    tx = transactions(spark, sf_dir)
    monkeypatch.setattr(windows, "TASK_ROWS", 20)
    got = registry.validation_dedup(spark, sf_dir)
    plan = re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())
    assert f"hashpartitioning(account_id, fraud_type, {tx.count() // 20 + 2})" in plan
    found = detect.rule_alerts(tx)
    key = lambda df: sorted((r.alert_id, r.dedup) for r in df.collect())
    marked = evaluate.mark_repeats(found, 7)
    assert marked.rdd.getNumPartitions() == 7 and key(marked) == key(evaluate.mark_repeats(found)) and marked.filter("dedup = 'pass_duplicate'").count() > 0
