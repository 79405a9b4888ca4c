"""Streams give what the batch forms give."""

import shutil

from pyspark.sql import functions as F

from ledgerwatch.functions import features, scores
from ledgerwatch.operators import fusion, graph, joins, windows
from ledgerwatch.plans import detect
from ledgerwatch.plans.patterns import PATTERNS, alerts
from ledgerwatch.sources import sinks
from ledgerwatch.sources.adapter import transactions
from ledgerwatch.streaming import detectors


def stream_of(spark, tmp_path, rows, order="event_ms"):
    """The rows as a file stream of two ordered files, and a last row that pushes the watermark past everything."""
    path, cut = str(tmp_path / "in"), rows.agg(F.expr(f"percentile({order}, 0.5)")).first()[0]
    rows.filter(F.col(order) <= cut).coalesce(1).write.parquet(path + "/a")
    rows.filter(F.col(order) > cut).coalesce(1).write.parquet(path + "/b")
    return path


def replay(spark, path, schema, tail, fn, tmp_path, mode="append"):
    for k, part in enumerate(("a", "b")):
        shutil.copytree(f"{path}/{part}", f"{path}/all/{k}-{part}")
    tail.coalesce(1).write.parquet(f"{path}/all/9-tail")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/all")
    q = fn(stream).writeStream.outputMode(mode).format("memory").queryName("t" + str(abs(hash(path)))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table("t" + str(abs(hash(path))))


def late(tx):
    return tx.limit(1).withColumn("event_ms", F.lit(1800000000000)).withColumn("amount", F.lit(0.5)).withColumn("name_orig", F.lit("late")).withColumn("tx_id", F.lit(10**9))


def test_ip_gang_and_chains(spark, tmp_path):
    tx = transactions(spark, "/root/testdata/sf0.01").filter("tx_id < 3000")
    path = stream_of(spark, tmp_path, tx)
    got = replay(spark, path, tx.schema, late(tx), detectors.ip_gang, tmp_path)
    key = lambda d: {(r.ip_segment, r.window_ms, r.accounts, round(r.total_amount, 4)) for r in d.collect()}
    assert key(got) == key(windows.ip_gang(tx)) and key(got)


def test_scatter_in_windows(spark, tmp_path):
    tx = transactions(spark, "/root/testdata/sf0.001").withColumn("event_ms", F.expr("event_ms * 8 - 7 * 1704067200000"))
    path = stream_of(spark, tmp_path, tx)
    got = replay(spark, path, tx.schema, late(tx).unionByName(late(tx).withColumn("event_ms", F.lit(1900000000000))), detectors.scatter_in, tmp_path)
    key = lambda d: {(r.account_id, r.window_ms, r.senders, round(r.total_amount, 4), round(r.confidence, 9)) for r in d.collect()}
    assert key(got) == key(windows.scatter_in(tx)) and key(got)


def test_chains(spark, tmp_path):
    tx = transactions(spark, "/root/testdata/sf0.001")
    path = stream_of(spark, tmp_path, tx)
    got = replay(spark, path, tx.schema, late(tx), detectors.chains, tmp_path)
    moves = tx.filter("type = 'TRANSFER' and amount > 5000")
    pairs = joins.range_join(moves, moves, "name_dest", "name_orig", -2 * joins.HOUR, 2 * joins.HOUR).filter(joins.DISTINCT_PARTIES)
    pairs = pairs.withColumn("time_diff", F.expr("abs(r_event_ms - l_event_ms) / 1000.0D")).withColumn("decay", F.expr("abs(l_amount - r_amount) / l_amount"))
    want = pairs.withColumn("confidence", joins.chain_scores()).filter("confidence > 0.6")
    key = lambda d: sorted((r.l_tx_id, r.r_tx_id) for r in d.select("l_tx_id", "r_tx_id").collect())
    assert key(got) == key(want) and key(got)


def test_pattern_with_keyed_state(spark, tmp_path):
    p, tx = PATTERNS[4], transactions(spark, "/root/testdata/sf0.001")
    path = stream_of(spark, tmp_path, tx)
    late_key = tx.select("name_orig").distinct().crossJoin(late(tx).drop("name_orig")).select(tx.columns).withColumn("tx_id", F.expr("1000000000 + hash(name_orig) % 1000"))
    got = replay(spark, path, tx.schema, late_key, lambda s: detectors.pattern(s, p), tmp_path)
    key = lambda d: sorted((r.tx_id, r.next_ids) for r in d.select("tx_id", "next_ids").collect())
    assert key(got) == key(alerts(tx, [p])) and key(got)


def test_enrichment_with_keyed_state(spark, tmp_path):
    al = detect.rule_alerts(transactions(spark, "/root/testdata/sf0.001"))
    rows = al.select("account_id", "alert_id", "event_ms", "source", "confidence", F.coalesce(F.col("behavior_path").contains("->").cast("int"), F.lit(0)).alias("edge"), F.coalesce(F.regexp_extract("details", r"(?:amountA|totalIn):([0-9.E]+)", 1).try_cast("double"), F.lit(0.0)).alias("volume"))
    tail = rows.limit(1).withColumn("event_ms", F.lit(1800000000000)).withColumn("account_id", F.lit("late")).withColumn("alert_id", F.lit("late"))
    path = stream_of(spark, tmp_path, rows)
    got = replay(spark, path, rows.schema, tail, detectors.enrich, tmp_path, mode="append").filter("account_id <> 'late'")
    key = lambda d: sorted((r.alert_id, r.edges, round(r.confidence, 6)) for r in d.select("alert_id", "edges", "confidence").collect())
    assert key(got) == key(fusion.enrich(al)) and key(got)


def test_upsert_keeps_the_newest_row_and_survives_a_restart(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "k string, v long"
    run = lambda: detectors.run(spark.readStream.schema(schema).parquet(path), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"]).awaitTermination()
    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.parquet(path)
    run()
    spark.createDataFrame([("a", 2)], schema).write.mode("append").parquet(path)
    run()
    assert {tuple(r) for r in sinks.read_upserted(spark, str(tmp_path / "out"), ["k"]).select("k", "v").collect()} == {("a", 2), ("b", 1)}


def test_sequences_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    tx = transactions(spark, "/root/testdata/sf0.001").withColumn("event_ms", F.expr("event_ms div 40"))  # so that sessions are long, too
    tx = tx.withColumn("event_ms", F.expr("1700000000000 + (event_ms - 42000000000)"))
    path = stream_of(spark, tmp_path, tx)
    got = replay(spark, path, tx.schema, late(tx), detectors.sequences, tmp_path)
    key = lambda d: sorted((r.account_id, r.ids) for r in d.selectExpr("account_id", "array_join(transform(txs, x -> cast(x.tx_id as string)), ',') as ids").collect())
    want = key(windows.sequences(tx))
    assert key(got) == want and any(ids.count(",") == 9 for _, ids in want)


def test_neighbourhood_alerts_of_a_stream(spark, tmp_path):
    tx = transactions(spark, "/root/testdata/sf0.001").withColumns({"amount": F.expr("amount * 40"), "device_risk_level": F.lit("HIGH"), "is_abroad": F.lit("ABROAD"), "transaction_hour": F.lit(2), "event_ms": F.expr("1700000000000 + event_ms div 40 - 42000000000")})
    path = stream_of(spark, tmp_path, tx)
    got = replay(spark, path, tx.schema, late(tx), detectors.gnn_alerts, tmp_path)
    key = lambda d: sorted((r.account_id, r.end_ms, r.fraud_type, round(r.gnn_score, 9)) for r in d.select("account_id", "end_ms", "fraud_type", "gnn_score").collect())
    want = key(scores.gnn_alerts(features.with_features(windows.sequences(tx))))
    assert key(got) == want and want


def test_tags_of_a_stream(spark, tmp_path):
    tx = transactions(spark, "/root/testdata/sf0.001")
    tags = alerts(tx).select("account_id", F.col("pattern").alias("rule"), F.col("event_ms").alias("tag_ms"))
    narrow = tx.select("tx_id", "name_orig", "event_ms")
    both = narrow.select("*", F.lit(None).cast("string").alias("rule")).unionByName(tags.select(F.lit(None).cast("long").alias("tx_id"), F.col("account_id").alias("name_orig"), F.col("tag_ms").alias("event_ms"), "rule"))
    path = stream_of(spark, tmp_path, both)
    fn = lambda s: detectors.tag_as_of(s.filter("rule is null"), s.filter("rule is not null").select(F.col("name_orig").alias("account_id"), "rule", F.col("event_ms").alias("tag_ms")))
    tail = both.limit(1).withColumns({"event_ms": F.lit(1800000000000), "name_orig": F.lit("late"), "tx_id": F.lit(10**9), "rule": F.lit(None).cast("string")})
    got = replay(spark, path, both.schema, tail, fn, tmp_path)
    key = lambda d: sorted((r.tx_id, r.is_cep_matched, r.cep_rule_name) for r in d.select("tx_id", "is_cep_matched", "cep_rule_name").collect())
    assert key(got) == key(joins.tag_as_of(tx, tags)) and any(r[1] for r in key(got))


def test_degrees_of_a_stream(spark, tmp_path):
    tx = transactions(spark, "/root/testdata/sf0.001")
    path = stream_of(spark, tmp_path, tx)
    got = replay(spark, path, tx.schema, tx.limit(0), detectors.graph_degrees, tmp_path, mode="complete")
    key = lambda d: sorted((r.account, r.out_degree, r.in_degree, round(r.out_amount, 4), round(r.in_amount, 4)) for r in d.collect())
    assert key(got) == key(graph.degrees(graph.edges(tx)))
