"""Trained models as versions of a table: the online linear model, boosted trees, isolation trees and the weights of the ensemble. Scorers load a version and broadcast it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.features import FEATURES
from ..sources import sinks
from ..tables import stored
from . import training

#: Fixed values of the linear model's learning.
RATE, DECAY, FRAUD_WEIGHT, LEAST_VARIANCE = 0.12, 0.0003, 5.0, 1e-6
#: Gradient steps on a batch; a step is one aggregation over it.
STEPS = 20


def new_linear() -> dict:
    """The state before any sample: fixed weights, no moments."""
    return {"n": 0, "frauds": 0, "means": [0.0] * len(FEATURES), "m2": [0.0] * len(FEATURES), "weights": list(scores.LR_WEIGHTS), "bias": scores.LR_BIAS}


def spread(linear: dict) -> tuple[list[float], list[float]]:
    """Means and deviations that scores are taken from; fixed ones before the second sample."""
    if linear["n"] < 2:
        return (linear["means"] if linear["n"] else list(scores.LR_MEANS)), list(scores.LR_STDS)
    return linear["means"], [math.sqrt(max(v / (linear["n"] - 1), LEAST_VARIANCE)) for v in linear["m2"]]


def clean():
    """Features without null, NaN and infinite values."""
    return F.transform("features", lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def learned(linear: dict, batch: DataFrame, steps: int = STEPS) -> dict:
    """The linear model after a batch ``(features, label)``: its moments join the running ones, then the weights follow the mean gradient, frauds counting FRAUD_WEIGHT times. Only sums over the batch reach the driver."""
    rows = stored(batch.select(clean().alias("features"), F.col("label").cast("double").alias("label")))
    each = rows.select("label", F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"), F.sum("label").alias("frauds")).collect()
    if not each:
        return linear
    n, k = linear["n"], each[0].n
    means, m2 = list(linear["means"]), list(linear["m2"])
    for r in each:
        far = r["mean"] - means[r.i]
        means[r.i] += far * k / (n + k)
        m2[r.i] += r.m2 + far * far * n * k / (n + k)
    out = {"n": n + k, "frauds": linear["frauds"] + int(each[0].frauds), "means": means, "m2": m2, "weights": list(linear["weights"]), "bias": linear["bias"]}
    mean, std = spread(out)
    z = F.expr(f"transform(features, (v, i) -> greatest(-3.0D, least(3.0D, (v - {scores.numbers(mean)}[i]) / (3.0D * {scores.numbers(std)}[i]))) / 3.0D)")
    rows = stored(rows.select(z.alias("z"), "label"))
    for _ in range(steps):
        logit = F.expr(f"aggregate(zip_with(z, {scores.numbers(out['weights'])}, (a, b) -> a * b), {out['bias']!r}D, (s, x) -> s + x)")
        c = F.when(F.col("label") == 1, FRAUD_WEIGHT).otherwise(1.0)
        pulled = rows.withColumn("e", c * (F.col("label") - 1 / (1 + F.exp(-logit)))).withColumn("c", c)
        sums = pulled.select("c", "e", F.posexplode(F.concat("z", F.array(F.lit(1.0)))).alias("i", "x")).groupBy("i").agg(F.avg(F.col("e") * F.col("x")).alias("g"), F.avg("c").alias("c")).collect()
        for r in sums:
            if r.i == len(FEATURES):
                out["bias"] += RATE * r.g
            else:
                out["weights"][r.i] += RATE * (r.g - DECAY * r.c * out["weights"][r.i])
    return out


def learn_batch(path: str):
    """A ``foreachBatch`` function over ``(features, label)``: each batch makes the next version of the linear model from the newest one before it, so a batch that comes again makes the same version again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = versions(spark, path)
        start = load(spark, path, max((v for v in before if v < batch_id + 1), default=None))["linear"] if any(v < batch_id + 1 for v in before) else new_linear()
        if batch_id + 1 not in before:
            save(spark, path, batch_id + 1, {"linear": learned(start, batch)})

    return step


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(sinks._parts(spark, path, "version"))


def save(spark: SparkSession, path: str, version: int, parameters: dict) -> None:
    """A version is written once and never changed; it counts when it is finished."""
    sinks.save_parameters(spark, path, version, parameters)


def load(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version's parameters, the newest unless named."""
    found = sinks._parts(spark, path, "version")
    if not found:
        raise FileNotFoundError(f"no model under {path}")
    return sinks.load_parameters(spark, path, max(found) if version is None else version)


def trees_of(model: GBTClassificationModel) -> dict:
    """Boosted trees as plain lists: what a scorer needs without the library."""

    def node(n) -> dict:
        if n.getClass().getSimpleName() == "LeafNode":
            return {"v": n.prediction()}
        return {"f": n.split().featureIndex(), "cut": n.split().threshold(), "l": node(n.leftChild()), "r": node(n.rightChild())}

    return {"weights": list(model.treeWeights), "trees": [node(t._call_java("rootNode")) for t in model.trees]}


def tree_values(tree: dict, x: np.ndarray) -> np.ndarray:
    if "v" in tree:
        return np.full(len(x), tree["v"])
    out, left = np.empty(len(x)), x[:, tree["f"]] <= tree["cut"]
    out[left], out[~left] = tree_values(tree["l"], x[left]), tree_values(tree["r"], x[~left])
    return out


def train(seq: DataFrame, trees: int = 10, depth: int = 4) -> dict:
    """All parts of the ensemble from ``seq(account_id, session, features, label)`` with the scores that need no training: linear model, boosted trees, isolation trees (on their bounded sample), and weights by accuracy."""
    rows = stored(seq.withColumn("features", clean()))
    linear = learned(new_linear(), rows)
    weighted = training.balanced(rows)
    boosted = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42).fit(weighted.withColumn("vector", array_to_vector("features")))
    parameters = {"linear": linear, "boosted": trees_of(boosted), "isolation": training.isolation_forest(rows)}
    scored = scored_with(rows, parameters)
    right = scored.agg(*[F.avg(((F.col(f"{k}_score") >= 0.5).cast("int") == F.col("label")).cast("double")).alias(k) for k in scores.ENSEMBLE]).first()
    return parameters | {"weights": training.ensemble_weights({k: right[k] or 0.0 for k in scores.ENSEMBLE})}


def scored_with(seq: DataFrame, parameters: dict) -> DataFrame:
    """``lr_score``, ``gbdt_score`` and ``isolation_score`` by a version's parameters, which are broadcast; batches of arrays are scored in numpy."""
    linear = parameters["linear"]
    means, stds = spread(linear)
    rows = scores.lr_score(seq, linear["weights"], linear["bias"], means, stds)
    if "boosted" not in parameters:
        return rows.withColumns({"gbdt_score": F.lit(0.0), "isolation_score": F.lit(0.0)})
    shared = seq.sparkSession.sparkContext.broadcast((parameters["boosted"], parameters["isolation"]))

    @F.pandas_udf("gbdt double, isolation double")
    def score(v: pd.Series) -> pd.DataFrame:
        boosted, forest = shared.value
        x = np.nan_to_num(np.array(v.tolist(), dtype=float), nan=0.0, posinf=0.0, neginf=0.0).reshape(len(v), -1)
        margin = sum((w * tree_values(t, x) for w, t in zip(boosted["weights"], boosted["trees"], strict=True)), np.zeros(len(x)))
        depth = np.mean([training.path_lengths(t, x) for t in forest], axis=0)
        return pd.DataFrame({"gbdt": 1 / (1 + np.exp(-2 * margin)), "isolation": 2.0 ** (-depth / training.expected_path(training.SUBSAMPLE))})

    return rows.withColumn("_s", score("features")).withColumns({"gbdt_score": F.col("_s.gbdt"), "isolation_score": F.col("_s.isolation")}).drop("_s")


def alerts(seq: DataFrame, parameters: dict) -> DataFrame:
    """The ensemble's alerts by a version of the model."""
    return scores.ensemble(scored_with(seq, parameters), global_model=True, weights=parameters.get("weights"))
