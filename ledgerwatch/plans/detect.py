"""All layers brought to one alert schema."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features, scores
from ..operators import graph, joins, windows
from ..schemas import ALERT, CONTEXT
from ..tables import stored
from . import patterns


def as_alerts(rows: DataFrame, **columns) -> DataFrame:
    """Name the alert's columns; the id is a digest of what it stands for, so that it is the same in every run."""
    named = {k: (v if not isinstance(v, str) else F.expr(v)) for k, v in columns.items()}
    context = {c: named.pop(c, F.col(c)) for c in CONTEXT}
    ids = named.pop("ids")
    out = rows.select(*[v.alias(k) for k, v in named.items()], *[v.alias(k) for k, v in context.items()], F.array_join(ids.cast("array<string>"), ",").alias("ids"))
    for c in ("behavior_path", "details"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.withColumn("alert_id", F.sha2(F.concat_ws("|", "source", "fraud_type", "account_id", "ids"), 256))
    out = out.withColumn("confidence", F.round("confidence", 9))  # sums of tenths must not fall just below a level
    return out.select(*[F.col(f.name).cast(f.dataType) for f in ALERT])


def cep(tx: DataFrame) -> DataFrame:
    return as_alerts(patterns.alerts(tx), account_id="account_id", fraud_type="fraud_type", confidence="confidence", source="source", ids=F.array(F.col("tx_id").cast("string"), F.col("next_ids")))


def _side(prefix: str) -> dict:
    return {c: F.col(f"{prefix}_{c}") for c in CONTEXT}


def chain(tx: DataFrame) -> DataFrame:
    path = F.concat(F.lit("A:"), "l_name_orig", F.lit("->B:"), "l_name_dest", F.lit("->C:"), "r_name_dest")
    details = F.concat(F.lit("amountA:"), F.round("l_amount", 2).cast("string"), F.lit(",amountB:"), F.round("r_amount", 2).cast("string"))
    return as_alerts(joins.chains(tx), account_id="l_name_orig", fraud_type="'多层链式洗钱(SQL)'", confidence="confidence", source="'SQL_CHAIN_PATTERN'", behavior_path=path, details=details, ids=F.array("l_tx_id", "r_tx_id"), **_side("l"))


def scatter_cashout(tx: DataFrame) -> DataFrame:
    details = F.concat(F.lit("totalIn:"), F.round("total_in", 2).cast("string"), F.lit(",cashOut:"), F.round("r_amount", 2).cast("string"))
    return as_alerts(joins.scatter_cashout(tx), account_id="account_id", fraud_type="'分散转入集中提现(SQL)'", confidence="confidence", source="'SQL_SCATTER_CASHOUT'", details=details, ids=F.array("l_tx_id", "r_tx_id"), **_side("r"))


def _with_context(found: DataFrame, tx: DataFrame, column: str) -> DataFrame:
    """Bring the transaction that an aggregate points to. Transactions are dealt to tasks by their number; where windows are few, Spark broadcasts them."""
    tasks = tx.count() // windows.TASK_ROWS + 2
    return found.repartition(tasks, column).join(tx.select(F.col("tx_id").alias(column), *CONTEXT).repartition(tasks, column), column)


def ip_gang(tx: DataFrame) -> DataFrame:
    return as_alerts(_with_context(windows.ip_gang(tx).drop("ip_segment"), tx, "first_tx"), account_id="account_id", fraud_type="'团伙同IP批量作案(SQL)'", confidence="confidence", source="'SQL_IP_GANG'", ids=F.array("first_tx"))


def scatter_in(tx: DataFrame) -> DataFrame:
    return as_alerts(_with_context(windows.scatter_in(tx), tx, "last_tx"), account_id="account_id", fraud_type="'分散转入集中转出(SQL)'", confidence="confidence", source="'SQL_SCATTER_PATTERN'", ids=F.array("last_tx", "window_ms"))


def rule_alerts(tx: DataFrame) -> DataFrame:
    """Union (bag) of the pattern layer and the four cross-account detectors."""
    out = cep(tx)
    for layer in (chain, scatter_cashout, ip_gang, scatter_in):
        out = out.unionByName(layer(tx))
    return out


def scored_sequences(tx: DataFrame, gap_ms: int = 60_000) -> DataFrame:
    """Sequences with all 36 features and the component scores that need no training (boosted trees and isolation forest count 0 until a model exists)."""
    tasks = tx.count() // windows.TASK_ROWS + 2  # the session's number of partitions would let a task grow with the input
    seq = features.with_features(windows.sequences(tx, gap_ms)).repartition(tasks, "account_id")
    seq = features.with_graph(seq, graph.sequence_stats(tx).repartition(tasks, "account_id"))
    # three aggregates and the scores read these rows
    seq = stored(seq.withColumn("features", features.vector()))
    seq = scores.stat_scores(scores.lr_score(scores.behavior_score(scores.path_scores(seq))))
    return seq.withColumns({"gbdt_score": F.lit(0.0), "isolation_score": F.lit(0.0)})


def last_context() -> dict:
    at = "element_at(txs, -1)"
    return {c: F.expr(f"{at}.{c}") for c in CONTEXT if c != "event_ms"} | {"event_ms": F.col("end_ms")}


def ml(tx: DataFrame) -> DataFrame:
    return as_alerts(scores.ensemble(scored_sequences(tx)), account_id="account_id", fraud_type="fraud_type", confidence="confidence", source="'ML_ENSEMBLE'", behavior_path="behavior_path", ids=F.expr("transform(txs, x -> x.tx_id)"), **last_context())


def gnn(tx: DataFrame) -> DataFrame:
    seq = features.with_features(windows.sequences(tx))
    return as_alerts(scores.gnn_alerts(seq), account_id="account_id", fraud_type="fraud_type", confidence="gnn_score", source="'GNN_GRAPH'", behavior_path="behavior_path", ids=F.expr("transform(txs, x -> x.tx_id)"), **last_context())


def graph_layer(tx: DataFrame) -> DataFrame:
    none = {c: F.lit(None) for c in CONTEXT}
    found = graph.alerts(graph.accounts(tx))
    return as_alerts(found, account_id="account", fraud_type="fraud_type", confidence="confidence", source="'GRAPH_ANALYZER'", behavior_path="account", ids=F.array(F.lit("")), **(none | {"amount": F.expr("out_amount + in_amount"), "event_ms": F.col("hi")}))


def all_alerts(tx: DataFrame) -> DataFrame:
    out = rule_alerts(tx)
    for layer in (ml, gnn, graph_layer):
        out = out.unionByName(layer(tx))
    return out
