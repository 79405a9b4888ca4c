"""Training: logistic regression and boosted trees on Spark's pipelines, an isolation forest on a bounded sample, ensemble weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows an isolation tree is grown on, trees, and rows that they are drawn from.
SUBSAMPLE, TREES, RESERVOIR = 64, 50, 500


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """``weight``: classes count alike."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # two rows
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return rows.withColumn("weight", weight)


def logistic(rows: DataFrame, columns: list[str], label: str = "label") -> PipelineModel:
    """The scaler is part of the saved pipeline, so training and serving see the same inputs."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="weight", regParam=1e-3)]
    return Pipeline(stages=stages).fit(balanced(rows, label))


def boosted(rows: DataFrame, columns: list[str], label: str = "label", trees: int = 20, depth: int = 4) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42)]).fit(rows)


def probability(model: PipelineModel, rows: DataFrame, name: str = "probability") -> DataFrame:
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability")[1])
    return scored.drop("probability", "rawPrediction", "prediction", "raw", "features").withColumnRenamed("_p", name)


def grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    spread = np.flatnonzero(sample.max(0) > sample.min(0)) if len(sample) > 1 else []
    if limit == 0 or not len(spread):
        return {"n": len(sample)}
    f = int(rng.choice(spread))
    cut = float(rng.uniform(sample[:, f].min(), sample[:, f].max()))
    left = sample[:, f] < cut
    return {"f": f, "cut": cut, "l": grow(sample[left], rng, limit - 1), "r": grow(sample[~left], rng, limit - 1)}


def expected_path(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def path_lengths(tree: dict, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if "n" in tree:
        return np.full(len(x), depth + expected_path(tree["n"]))
    out, left = np.empty(len(x)), x[:, tree["f"]] < tree["cut"]
    out[left], out[~left] = path_lengths(tree["l"], x[left], depth + 1), path_lengths(tree["r"], x[~left], depth + 1)
    return out


def isolation_forest(rows: DataFrame, column: str = "features", keys: tuple[str, ...] = ("account_id", "session"), seed: int = 42) -> list[dict]:
    """Trees on a sample of RESERVOIR rows of lowest seeded hash; the bound is the sample's, whatever the table."""
    sample = rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(RESERVOIR).select(column).toPandas()[column]
    x, rng = np.array(sample.tolist(), dtype=float), np.random.default_rng(seed)
    size = min(SUBSAMPLE, len(x))
    return [grow(x[rng.choice(len(x), size, replace=False)], rng, int(np.ceil(np.log2(max(2, size))))) for _ in range(TREES)]


def isolation_scores(rows: DataFrame, trees: list[dict], column: str = "features") -> DataFrame:
    """``isolation_score`` near 1 for rows that few cuts set apart. Batches of arrays, scored in numpy."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # a few thousand nodes

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float)
        mean = np.mean([path_lengths(t, x) for t in shared.value], axis=0)
        return pd.Series(2.0 ** (-mean / expected_path(SUBSAMPLE)))

    return rows.withColumn("isolation_score", score(column))


def ensemble_weights(accuracies: dict[str, float], temperature: float = 2.0) -> dict[str, float]:
    """Softmax of recent accuracies."""
    e = {k: float(np.exp(v * temperature)) for k, v in accuracies.items()}
    return {k: v / sum(e.values()) for k, v in e.items()}


def hash_embedding(rows: DataFrame, key: str, dim: int = 16) -> DataFrame:
    """A deterministic start vector of each node: signs of hashes, unit length."""
    return rows.withColumn("embedding", F.array(*[F.when(F.xxhash64(F.lit(i), key) % 2 == 0, 1.0).otherwise(-1.0) / float(np.sqrt(dim)) for i in range(dim)]))


def sage(edges: DataFrame, nodes: DataFrame, rounds: int = 2, dim: int = 16) -> DataFrame:
    """Embeddings by ``rounds`` of neighbourhood means weighted by log amount: 70 % itself, 40 % neighbours, leaky rectifier, unit length. ``nodes(account, embedding)``."""
    links = edges.groupBy("src", "dst").agg(F.log1p(F.sum("amount")).alias("w"))
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    now = nodes
    for _ in range(rounds):
        parts = both.join(now.withColumnRenamed("account", "dst"), "dst").groupBy("src").agg(*[(F.sum(F.col("w") * F.col("embedding")[i]) / F.sum("w")).alias(f"m{i}") for i in range(dim)])
        joined = now.join(parts, now["account"] == parts["src"], "left")
        mixed = [0.7 * F.col("embedding")[i] + 0.4 * F.coalesce(F.col(f"m{i}"), F.lit(0.0)) for i in range(dim)]
        raw = F.array(*[F.when(x > 0, x).otherwise(0.2 * x) for x in mixed])
        now = joined.select("account", raw.alias("raw")).select("account", F.expr("transform(raw, x -> x / greatest(sqrt(aggregate(raw, 0.0D, (s, y) -> s + y * y)), 1e-9D))").alias("embedding"))
    return now
