"""The model table: learning, versions, and scorers that load one."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerwatch.functions import scores
from ledgerwatch.functions.features import FEATURES
from ledgerwatch.operators import models, training
from ledgerwatch.plans import registry

N = len(FEATURES)


def rows_of(rng, n):
    out = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        out.append((f"a{i}", 1, [rng.gauss(3.0 * label, 1) if k < 5 else rng.random() for k in range(N)], label))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "account_id string, session long, features array<double>, label int").repartition(3)


def loss(linear, rows):
    """Frauds weigh as they do in learning."""
    means, stds = models.spread(linear)
    total = 0.0
    for _, _, v, y in rows:
        z = [max(-3.0, min(3.0, (x - m) / (3 * s))) / 3 for x, m, s in zip(v, means, stds, strict=True)]
        p = 1 / (1 + math.exp(-(linear["bias"] + sum(a * b for a, b in zip(z, linear["weights"], strict=True)))))
        total -= math.log(p) * models.FRAUD_WEIGHT if y else math.log(1 - p)
    return total / len(rows)


def test_linear_model_learns_by_batches(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 300)
    rows[0] = ("odd", 1, [None, float("nan"), float("inf"), *rows[0][2][3:]], rows[0][3])
    one = models.learned(models.new_linear(), frame(spark, rows[:200]))
    two = models.learned(one, frame(spark, rows[200:]))
    x = np.array([[0.0 if v is None or math.isnan(v) or math.isinf(v) else v for v in r[2]] for r in rows])
    assert two["n"] == 300 and two["frauds"] == sum(r[3] for r in rows)
    assert np.allclose(two["means"], x.mean(0)) and np.allclose(two["m2"], ((x - x.mean(0)) ** 2).sum(0))
    before = two | {"weights": list(scores.LR_WEIGHTS), "bias": scores.LR_BIAS}
    assert loss(two, rows[1:]) < loss(before, rows[1:])
    assert models.learned(two, frame(spark, [])) == two


def test_versions_of_a_stream(spark, tmp_path):
    path, rng = str(tmp_path / "models"), random.Random(2)
    first, second = frame(spark, rows_of(rng, 60)), frame(spark, rows_of(rng, 60))
    step = models.learn_batch(path)
    step(first, 0)
    step(second, 1)
    assert models.versions(spark, path) == [1, 2]
    newest = models.load(spark, path)
    step(second, 1)  # the batch comes again
    assert models.load(spark, path) == newest == {"linear": models.learned(models.load(spark, path, 1)["linear"], second)}
    with pytest.raises(Exception, match="already exists"):
        models.save(spark, path, 2, {})
    with pytest.raises(FileNotFoundError):
        models.load(spark, str(tmp_path / "none"))


def test_exported_trees_score_as_the_library(spark):
    rows = frame(spark, rows_of(random.Random(3), 200)).withColumn("vector", array_to_vector("features"))
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=4, maxDepth=3, seed=1).fit(rows)
    parameters = {"linear": models.new_linear(), "boosted": models.trees_of(model), "isolation": [{"n": 1}]}
    got = {r.account_id: r.gbdt_score for r in models.scored_with(rows, parameters).collect()}
    for r in model.transform(rows).collect():
        assert abs(got[r.account_id] - r.probability[1]) < 1e-12


def test_a_stored_version_gives_its_alerts_again(spark, sf_dir):
    seq, parameters = registry.trained(spark, sf_dir)
    rows = models.scored_with(seq, parameters).collect()
    for c in ("lr", "gbdt", "behavior", "stat", "path", "isolation"):
        assert any(r[f"{c}_score"] > 0 for r in rows), c
    one, two = ({(r.account_id, r.session, r.fraud_type, round(r.probability, 12)) for r in models.alerts(seq, parameters).collect()} for _ in range(2))
    assert one == two and one
    assert abs(sum(parameters["weights"].values()) - 1) < 1e-12 and seq.filter(F.col("label") == 1).count() > 0


def test_isolation_scores_equal_walks_down_the_trees(spark):
    rows = rows_of(random.Random(5), 80)
    df = frame(spark, rows)
    trees = training.isolation_forest(df)
    assert len(trees) == training.TREES and trees == training.isolation_forest(df.repartition(5))

    def depth(tree, v, at=0):
        while "n" not in tree:
            tree, at = tree["l" if v[tree["f"]] < tree["cut"] else "r"], at + 1
        n = tree["n"]
        return at + (0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)

    usual = 2 * (math.log(63) + 0.5772156649) - 2 * 63 / 64
    got = {r.account_id: r.isolation_score for r in training.isolation_scores(df, trees).collect()}
    for name, _, v, _ in rows:
        assert abs(got[name] - 2 ** (-sum(depth(t, v) for t in trees) / len(trees) / usual)) < 1e-9


def test_embeddings_equal_neighbour_means_by_hand(spark):
    edges = [("a", "b", 10.0), ("a", "b", 5.0), ("b", "c", 100.0), ("c", "a", 1.0), ("d", "a", 7.0)]
    e = spark.createDataFrame(edges, "src string, dst string, amount double")
    nodes = training.hash_embedding(spark.createDataFrame([(x,) for x in "abcde"], "account string"), "account", 4)
    now = {r.account: list(r.embedding) for r in nodes.collect()}
    paid = {}
    for s, d, a in edges:
        paid[s, d] = paid.get((s, d), 0.0) + a
    links = [(s, d, math.log1p(a)) for (s, d), a in paid.items()] + [(d, s, math.log1p(a)) for (s, d), a in paid.items()]
    for _ in range(2):
        after = {}
        for n, own in now.items():
            near = [(now[d], w) for s, d, w in links if s == n]
            total = sum(w for _, w in near)
            mean = [sum(v[i] * w for v, w in near) / total if near else 0.0 for i in range(4)]
            raw = [0.7 * a + 0.4 * b for a, b in zip(own, mean, strict=True)]
            raw = [x if x > 0 else 0.2 * x for x in raw]
            size = max(math.sqrt(sum(x * x for x in raw)), 1e-9)
            after[n] = [x / size for x in raw]
        now = after
    for r in training.sage(e, nodes, dim=4).collect():
        assert np.allclose(r.embedding, now[r.account], atol=1e-12)


def test_paths_are_joined_in_bounded_tasks(spark, monkeypatch):
    """Frequent paths are broadcast, others dealt by number; the scores are those of one join."""
    paths = ["T->T"] * 60 + ["T->C"] * 7 + [f"P->{i}" for i in range(33)]
    seq = spark.createDataFrame(list(enumerate(paths)), "id long, behavior_path string")
    scored = lambda: sorted((r.id, r.path_count, r.path_total, round(r.path_score, 9)) for r in scores.path_scores(seq).collect())
    want = scored()
    monkeypatch.setattr(scores, "TASK_ROWS", 10)
    assert scored() == want and [(r[1], r[2]) for r in want] == [(paths.count(p), 100) for p in paths]
    plan = scores.path_scores(seq)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(behavior_path" in plan and f", {100 // 10 + 2}), REPARTITION_BY_NUM" in plan
