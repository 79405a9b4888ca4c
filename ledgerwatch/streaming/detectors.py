"""Streaming forms of the detectors: the same rules, with watermarks, windows, stream-stream joins and keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import features, scores
from ..operators import graph, windows
from ..operators.joins import DISTINCT_PARTIES, TAG_MS, chain_scores
from ..plans.patterns import Pattern

LATENESS = "5 seconds"


def timed(tx: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """``event_ts`` from ``event_ms``, with the watermark that all event-time operators share."""
    return tx.withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", lateness)


def ip_gang(tx: DataFrame) -> DataFrame:
    """Half-hour windows in append mode; late rows beyond the watermark are dropped. Distinct senders are gathered as a set, since exact distinct counts don't stream."""
    rows = timed(tx).filter("type = 'TRANSFER' and amount > 8000 and (device_risk_level = 'HIGH' or transaction_hour >= 20)")
    w = rows.groupBy("ip_segment", F.window("event_ts", "30 minutes")).agg(F.size(F.collect_set("name_orig")).alias("accounts"), F.sum("amount").alias("total_amount"), F.min(F.struct("event_ms", "tx_id", "name_orig")).alias("first"))
    w = w.filter("accounts >= 2 and total_amount > 30000").withColumn("confidence", F.expr("least(1.0D, 0.45D + (accounts - 2) * 0.08D + total_amount / 400000.0D)"))
    return w.filter("confidence > 0.6").select("ip_segment", F.unix_millis("window.start").alias("window_ms"), "accounts", "total_amount", F.col("first.name_orig").alias("account_id"), "confidence")


def scatter_in(tx: DataFrame) -> DataFrame:
    """Two-hour windows in which several senders pay into one account, in append mode. Senders are summed up first, in a window aggregation of their own, so an account's state is a row a sender until its window closes."""
    rows = timed(tx).filter("type = 'TRANSFER' and amount > 3000 and amount < 30000")
    per = rows.groupBy("name_dest", F.window("event_ts", "2 hours"), "name_orig").agg(F.sum("amount").alias("amount"))
    both = per.groupBy(F.col("name_dest").alias("account_id"), F.window(F.window_time("window"), "2 hours").alias("window")).agg(F.count("*").alias("senders"), F.sum("amount").alias("total_amount"), F.max("amount").alias("max_sender"))
    confidence = F.expr("least(1.0D, 0.4D + (senders - 2) * 0.1D + total_amount / 100000.0D + if(max_sender / (total_amount / senders) > 3.0, 0.1D, 0.0D))")
    found = both.filter("senders >= 2 and total_amount > 15000").withColumn("confidence", confidence).filter("confidence > 0.5")
    return found.select("account_id", F.unix_millis("window.start").alias("window_ms"), "senders", "total_amount", "confidence")


def chains(tx: DataFrame) -> DataFrame:
    """Stream-stream self-join A->B, B->C within two hours; both watermarks and the range let Spark drop old state. (The skip of repeated pairs needs an order and stays with the batch form.)"""
    moves = tx.filter("type = 'TRANSFER' and amount > 5000").select("tx_id", "event_ms", "amount", "name_orig", "name_dest")
    side = lambda p: timed(moves).select([F.col(c).alias(f"{p}_{c}") for c in (*moves.columns, "event_ts")])
    joined = side("l").join(side("r"), F.expr("l_name_dest = r_name_orig and r_event_ts >= l_event_ts - interval 2 hours and r_event_ts <= l_event_ts + interval 2 hours")).filter(DISTINCT_PARTIES)
    joined = joined.withColumn("time_diff", F.expr("abs(r_event_ms - l_event_ms) / 1000.0D")).withColumn("decay", F.expr("abs(l_amount - r_amount) / l_amount"))
    return joined.withColumn("confidence", chain_scores()).filter("confidence > 0.6").select("l_tx_id", "r_tx_id", "confidence")


class PatternProcessor(StatefulProcessor):
    """Matches one pattern for a key. Stage flags arrive with the rows, so the predicates stay in Spark.

    Rows wait in state until the watermark passes a start event's ``within``; then its match, if any, is settled in event order, and what no start can reach any more is forgotten.
    """

    SCHEMA = "key string, tx_id long, next_ids string, last_ms long"

    def __init__(self, follows: list[str], within_ms: int):
        self.follows, self.within_ms = follows, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "event_ms long, tx_id long, flags int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        self.rows.appendList([(int(a), int(b), int(c)) for a, b, c in zip(new["event_ms"], new["tx_id"], new["flags"], strict=True)])
        for due in {int(m) + self.within_ms for m, f in zip(new["event_ms"], new["flags"], strict=True) if f & 1}:
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.rows.get())
        out = [(key[0], *m) for m in matches(rows, self.follows, self.within_ms) if m[3] + self.within_ms == due]
        alive = [r for r in rows if r[0] > due - self.within_ms]
        self.rows.put(alive) if alive else self.rows.clear()
        yield pd.DataFrame([m[:4] for m in out], columns=["key", "tx_id", "next_ids", "last_ms"])

    def close(self) -> None:
        pass


def matches(rows: list[tuple[int, int, int]], follows: list[str], within_ms: int) -> list[tuple[int, str, int, int]]:
    """All matches in a key's ordered rows (time, id, flags): id, ids of the later stages, last time, first time."""
    out = []
    for i, (start, first_id, flags) in enumerate(rows):
        if not flags & 1:
            continue
        at, ids = i, []
        for stage, follow in enumerate(follows, 1):
            ahead = range(at + 1, min(at + 2, len(rows)) if follow == "next" else len(rows))
            at = next((j for j in ahead if rows[j][2] >> stage & 1), None)
            if at is None:
                break
            ids.append(rows[at][1])
        if at is not None and rows[at][0] - start < within_ms:
            out.append((first_id, ",".join(map(str, ids)), rows[at][0], start))
    return out


def pattern(tx: DataFrame, p: Pattern) -> DataFrame:
    """A pattern over a stream. Needs the RocksDB state store."""
    flags = " + ".join(f"if({s.when}, {1 << k}, 0)" for k, s in enumerate(p.stages))
    rows = timed(tx).select(F.col(p.key).alias("key"), "event_ms", "tx_id", F.expr(flags).alias("flags"), "event_ts")
    processor = PatternProcessor([s.follow for s in p.stages[1:]], p.within_ms)
    return rows.groupBy("key").transformWithStateInPandas(processor, outputStructType=PatternProcessor.SCHEMA, outputMode="Append", timeMode="EventTime")


class SequenceProcessor(StatefulProcessor):
    """Sessions of an account. Its transactions wait in a list until the watermark has passed the session's last one by the gap: an event-time timer then settles every session that nothing can join any more.

    Of a session that goes on only the last ``longest`` transactions are kept, so an account that never pauses stays bounded. Timers take the place of a time to live: what is settled leaves the state.
    """

    SCHEMA = "account_id string, end_ms long, txs string"

    def __init__(self, fields: list[str], kinds: str, gap_ms: int, longest: int):
        self.fields, self.kinds, self.gap_ms, self.longest = fields, kinds, gap_ms, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(None if v is None or v != v else v for v in r) for r in pd.concat(list(rows))[self.fields].astype(object).itertuples(index=False, name=None)]
        held = sessions(sorted([*map(tuple, self.rows.get()), *new], key=in_order), self.gap_ms)
        self.rows.put([r for s in held for r in s[-max(2, self.longest) :]])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for s in held:
            self.handle.registerTimer(s[-1][0] + self.gap_ms + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = sessions(sorted(map(tuple, self.rows.get()), key=in_order), self.gap_ms)
        over = [s for s in held if s[-1][0] + self.gap_ms < due]
        left = [r for s in held if s[-1][0] + self.gap_ms >= due for r in s]
        self.rows.put(left) if left else self.rows.clear()
        out = [(key[0], int(s[-1][0]), json.dumps([dict(zip(self.fields, r, strict=True)) for r in s[-self.longest :]])) for s in over if len(s) >= 2]
        yield pd.DataFrame(out, columns=["account_id", "end_ms", "txs"])

    def close(self) -> None:
        pass


def in_order(row: tuple) -> tuple:
    """Sequences are ordered by time, then by transaction: the first two fields."""
    return row[:2]


def sessions(rows: list[tuple], gap_ms: int) -> list[list[tuple]]:
    """Ordered rows, time first, cut where the gap is too long."""
    out: list[list[tuple]] = []
    for r in rows:
        if out and r[0] - out[-1][-1][0] <= gap_ms:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def sequences(tx: DataFrame, gap_ms: int = 60_000, longest: int = 10) -> DataFrame:
    """Behaviour sequences of a stream, each once when it is over: ``account_id``, ``end_ms`` and ``txs`` as the batch form has them, so that features and scores apply to both. Needs the RocksDB state store."""
    rows = timed(windows.duplicated(tx)).select(F.col("tracking_account").alias("account_id"), *windows.SEQ_FIELDS, "event_ts")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in windows.SEQ_FIELDS)
    processor = SequenceProcessor(windows.SEQ_FIELDS, kinds, gap_ms, longest)
    found = rows.groupBy("account_id").transformWithStateInPandas(processor, outputStructType=SequenceProcessor.SCHEMA, outputMode="Append", timeMode="EventTime")
    return found.select("account_id", "end_ms", F.from_json("txs", f"array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>").alias("txs"))


def gnn_alerts(tx: DataFrame) -> DataFrame:
    """Neighbourhood alerts of a stream's sequences."""
    found = scores.gnn_alerts(features.with_features(sequences(tx)))
    return found.select("account_id", "end_ms", "fraud_type", "gnn_score")


class TagProcessor(StatefulProcessor):
    """Marks an account's transactions with its newest tag at or before them. Transactions wait until the watermark has passed them, then they meet the tags in order; a tag is forgotten when it is too old to match."""

    SCHEMA = "tx_id long, is_cep_matched boolean, cep_rule_name string"

    def __init__(self, valid_ms: int):
        self.valid_ms = valid_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "event_ms long, side int, rule string, tx_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        self.rows.appendList([(int(a), int(b), None if c is None else str(c), None if d != d else int(d)) for a, b, c, d in zip(new["event_ms"], new["side"], new["rule"], new["tx_id"], strict=True)])
        for due in {int(m) + 1 for m, side in zip(new["event_ms"], new["side"], strict=True) if side}:
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, tag, out, left = expiredTimerInfo.getExpiryTimeInMs(), None, [], []
        for row in sorted(map(tuple, self.rows.get()), key=lambda r: (r[0], r[1], r[2] or "", r[3] or 0)):
            at, side, rule, tx_id = row
            if at >= due or (not side and at + self.valid_ms >= due):
                left.append(row)
            if at < due and side:
                matched = tag is not None and at - tag[0] <= self.valid_ms
                out.append((tx_id, matched, tag[1] if matched else "NONE"))
            elif at < due:
                tag = (at, rule)
        self.rows.put(left) if left else self.rows.clear()
        yield pd.DataFrame(out, columns=["tx_id", "is_cep_matched", "cep_rule_name"])

    def close(self) -> None:
        pass


def tag_as_of(tx: DataFrame, tags: DataFrame) -> DataFrame:
    """Transactions with the newest tag of their sender, ``tags(account_id, rule, tag_ms)`` being a stream too: ``tx_id``, ``is_cep_matched``, ``cep_rule_name``. Needs the RocksDB state store."""
    rows = tx.select(F.col("name_orig").alias("k"), "event_ms", F.lit(1).alias("side"), F.lit(None).cast("string").alias("rule"), "tx_id")
    marks = tags.select(F.col("account_id").alias("k"), F.col("tag_ms").alias("event_ms"), F.lit(0).alias("side"), "rule", F.lit(None).cast("long").alias("tx_id"))
    return timed(rows.unionByName(marks)).groupBy("k").transformWithStateInPandas(TagProcessor(TAG_MS), outputStructType=TagProcessor.SCHEMA, outputMode="Append", timeMode="EventTime")


def graph_degrees(tx: DataFrame) -> DataFrame:
    """Degrees and amounts of accounts as transactions come, in complete or update mode; distinct neighbours need the batch form."""
    s = graph.sides(graph.edges(tx))
    out = F.col("is_out")
    n = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0.0))
    return s.groupBy("account").agg(n(out).alias("out_degree"), n(~out).alias("in_degree"), total(out).alias("out_amount"), total(~out).alias("in_amount"))


class EnrichProcessor(StatefulProcessor):
    """Running hits, edges and volume of an account, forgotten after a minute without alerts."""

    SCHEMA = "account_id string, alert_id string, hits int, edges int, volume double, confidence double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "cep int, sql int, ml int, edges int, volume double, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = list(self.sums.get()) if self.sums.exists() else [0, 0, 0, 0, 0.0, None]
        out = []
        for r in pd.concat(list(rows)).sort_values(["event_ms", "alert_id"]).itertuples():
            if state[5] is None or r.event_ms - state[5] > 60_000:
                state = [0, 0, 0, 0, 0.0, None]
            state = [state[0] + ("CEP" in r.source), state[1] + ("SQL" in r.source), state[2] + ("ML" in r.source), state[3] + int(r.edge), state[4] + float(r.volume), int(r.event_ms)]
            out.append((key[0], r.alert_id, sum(state[:3]), state[3], state[4], min(1.0, round(r.confidence + bonus(*state[:5]), 9))))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.sums.update(tuple(state))
        self.handle.registerTimer(state[5] + 60_001)
        yield pd.DataFrame(out, columns=["account_id", "alert_id", "hits", "edges", "volume", "confidence"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.sums.clear()
        return iter([])

    def close(self) -> None:
        pass


def bonus(cep: int, sql: int, ml: int, edges: int, volume: float) -> float:
    out = min(0.15, (cep + sql + ml) * 0.05) + (0.10 if edges >= 3 else 0.05 if edges >= 1 else 0) + (0.10 if volume >= 50_000 else 0.05 if volume >= 20_000 else 0)
    return out + (0.08 if cep and ml else 0) + (0.08 if sql and edges >= 2 else 0)


def enrich(alerts: DataFrame) -> DataFrame:
    """``alerts(account_id, alert_id, event_ms, source, confidence, edge, volume)`` as they come."""
    return timed(alerts).groupBy("account_id").transformWithStateInPandas(EnrichProcessor(), outputStructType=EnrichProcessor.SCHEMA, outputMode="Append", timeMode="EventTime")


def distinct_alerts(alerts: DataFrame, within: str = "10 minutes") -> DataFrame:
    return alerts.withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", within).dropDuplicatesWithinWatermark(["alert_id"])


def run(rows: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Write a stream to a keyed table; a repeated batch replaces itself."""
    from ..sources.sinks import upsert_batch

    return rows.writeStream.foreachBatch(upsert_batch(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
