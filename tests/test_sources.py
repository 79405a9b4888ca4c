"""The change feed across a restart, the keyed table and its compaction, progress of streams, and sketches."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import drift
from ledgerwatch.plans import served
from ledgerwatch.sources import changes, ingest, sinks
from ledgerwatch.streaming import progress


def change(op, name, amount):
    return json.dumps({"op": op, "before": None if op == "c" else {"nameOrig": name}, "after": None if op == "d" else {"nameOrig": name, "nameDest": "z", "type": "TRANSFER", "amount": amount}})


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(lines))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def test_changes_reach_the_flattener_once_across_a_restart(spark, tmp_path):
    folder, out, cp = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "cp")
    put(folder, "0001", [change("c", "a", 1.0), change("c", "b", 2.0), "", "{broken"])
    put(folder, "0002", [change("u", "a", 3.0)])

    def run():
        q = changes.read_changes(spark, folder, per_trigger=1).writeStream.format("parquet").option("checkpointLocation", cp).start(out)
        q.processAllAvailable()
        q.stop()

    run()
    put(folder, "0003", [change("d", "b", 0.0), change("c", "c", 4.0)])
    run()
    run()
    rows = spark.read.parquet(out)
    assert sorted((r.file, r.line) for r in rows.collect()) == [("0001", 0), ("0001", 1), ("0001", 3), ("0002", 0), ("0003", 0), ("0003", 1)]
    flat = ingest.cdc_flatten(rows, "train", 1)
    assert sorted((r.nameOrig, r.amount, r._op_type) for r in flat.collect()) == [("a", 1.0, "insert"), ("a", 3.0, "update"), ("b", 2.0, "insert"), ("c", 4.0, "insert")]
    batch = changes.read_changes(spark, folder, streaming=False)
    assert batch.count() == 6 and changes.files(str(tmp_path / "none")) == []


def test_keyed_table_decides_ties_and_compacts(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k"]
    write = sinks.upsert_batch(path, keys, ["at"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at long, v string")
    with pytest.raises(FileNotFoundError):
        sinks.read_upserted(spark, path, keys)
    write(rows(("a", 2, "new"), ("a", 1, "old"), ("b", 1, "x"), ("b", 1, "y")), 0)
    got = lambda: {(r.k, r.v) for r in sinks.read_upserted(spark, path, keys).collect()}
    first = got()
    assert ("a", "new") in first and len(first) == 2
    write(rows(("b", 1, "y"), ("b", 1, "x"), ("a", 1, "old"), ("a", 2, "new")), 0)  # the batch comes again, in another order
    assert got() == first
    write(rows(("a", 0, "later")), 1)
    sinks.compact(spark, path, keys)
    assert got() == {("a", "later"), *[r for r in first if r[0] == "b"]}
    write(rows(("c", 5, "c")), 2)
    assert ("c", "c") in got() and len(got()) == 3
    sinks.compact(spark, path, keys)
    sinks.compact(spark, path, keys)
    assert len(got()) == 3 and sorted(d for d in os.listdir(path) if "=" in d) == ["base=1", "base=2", "batch=2"]


def test_alert_table_is_filled_once_and_refreshed_when_its_input_changes(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.filter("event_id < 500").write.parquet(str(tmp_path / "events.parquet"))
    few = served.alerts(spark, str(tmp_path))
    tables = len(served._tables)
    assert served.alerts(spark, str(tmp_path)).count() == few.count() and len(served._tables) == tables
    assert "events.parquet" not in few._jdf.queryExecution().executedPlan().toString()
    events.filter("event_id >= 500").write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert served.alerts(spark, str(tmp_path)).count() > few.count() and len(served._tables) == tables + 1
    path = str(tmp_path / "table")
    served.refresh(spark, path, few, 0)
    served.refresh(spark, path, few.withColumn("confidence", F.lit(0.25)), 1)
    assert {r.confidence for r in served.table(spark, path).collect()} == {0.25} and served.table(spark, path).count() == few.count()


def test_progress_of_a_stream(spark, tmp_path):
    path, rows = str(tmp_path / "progress"), str(tmp_path / "in")
    spark.range(50).write.parquet(rows)
    listener = progress.ProgressListener(spark, path)
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.schema("id long").parquet(rows).writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        for _ in range(50):
            if listener.rows:
                break
            q.awaitTermination(0.2)
        listener.flush()
    finally:
        spark.streams.removeListener(listener)
    found = {r.stage: r for r in progress.summary(spark, path).collect()}
    assert {"addBatch", "triggerExecution"} <= set(found) and found["addBatch"].least <= found["addBatch"].p50 <= found["addBatch"].most and found["addBatch"]["query"] == "watched"
    total = progress.throughput(spark, path).collect()
    assert [(r["query"], r.rows) for r in total] == [("watched", 50)]


def test_sketches_merge(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.random()) for i, g in enumerate(rng.choices("aaaaab", k=400))]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    ids = lambda d: {(r.g, r.i) for r in d.collect()}
    whole = ids(drift.sketches(df, ["g"], "i", 7))
    one, two = (drift.sketches(df.filter(f"i % 2 = {k}"), ["g"], "i", 7) for k in (0, 1))
    assert ids(drift.merged(one, two, ["g"], "i", 7)) == whole == ids(drift.merged(drift.sketches(df, ["g"], "i", 7), one, ["g"], "i", 7))
    assert len(whole) == 14
