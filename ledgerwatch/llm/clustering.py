"""Centroid clustering of embeddings by Lloyd's rounds over distinct quantised vectors with multiplicities.

Vectors become integers, so every sum, mean and distance is exact and rounds give the same result in any order of rows and on any cluster. Equal vectors are grouped first (map-side, so one that a third of all rows hold
travels once a task) and stored with their number; each round reads the distinct vectors, sums them weighted in integers inside the tasks, and sends a few sums for each centroid to the driver, which alone divides. At the end
the distinct vectors' clusters are joined back to the rows by a digest of the vector; rows of a frequent vector are dealt over several tasks.

Defined cases: null vectors, vectors of another length and such with a null, NaN or infinite component have no row. Repeated rows are rows of their own; a null vec_id comes last among the first centroids' candidates, ties go by
the vector. With fewer kept rows than centroids each row starts one. A centroid that no vector is nearest to stays where it is. A component beyond +-LARGEST (after scaling) raises an error: its squared distances would not
fit a long. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, salted_join, slices, stored

#: Scale of the quantisation, components of a vector, centroids, rounds and the seed of their choice.
SCALE, DIMENSIONS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, "3"
#: Largest quantised component.
LARGEST = 1 << 27
#: Multiplicities are summed in two parts, so that no partial sum leaves 64 bits.
_LOW = 20


def quantised(df: DataFrame, vector: str = "embedding", scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows with a whole vector, and ``q``: its integers."""
    whole = f"size(`{vector}`) = {dimensions} and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    fits = F.expr(f"forall(`{vector}`, x -> abs({scale}.0D * x) < {LARGEST}.0D)")
    q = F.expr(f"transform(`{vector}`, x -> cast(floor({scale}.0D * cast(x as double)) as int))")
    # Spark may evaluate q beside the filter, so q looks at whole vectors only
    return df.filter(whole).withColumn("q", F.when(F.expr(whole), F.when(fits, q).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")))))


def vectors_of(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first of equals, and the squared distance."""
    d = np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def weighted_sums(distinct: DataFrame, centroids: np.ndarray, last: bool = False) -> dict[int, tuple[int, list[int]]]:
    """Each cluster's number of rows and componentwise sums; ``last``: the sum of distances instead. Exact: tasks send two parts of each sum, which Spark adds as decimals."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for part in slices(batch, 4 << 20, 4_096):
                x, n = vectors_of(part.column(0), dimensions), part.column(1).to_numpy()
                at, far = nearest(x, centroids)
                values = far[:, None] if last else np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
                out = defaultdict(list)
                for c in np.unique(at):
                    of = at == c
                    if last:  # distances take up to 62 bits, so these few sums are Python's
                        total = sum(a * b for a, b in zip(values[of, 0].tolist(), n[of].tolist(), strict=True))
                        high, low = [total >> _LOW], [total & ((1 << _LOW) - 1)]
                    else:
                        high, low = ((n[of] >> _LOW) @ values[of]).tolist(), ((n[of] & ((1 << _LOW) - 1)) @ values[of]).tolist()
                    out["cluster"] += [int(c)] * len(low)
                    out["i"] += range(len(low))
                    out["high"] += high
                    out["low"] += low
                yield pa.RecordBatch.from_arrays([pa.array(out["cluster"], pa.int32()), pa.array(out["i"], pa.int32()), pa.array(out["high"], pa.int64()), pa.array(out["low"], pa.int64())], ["cluster", "i", "high", "low"])

    whole = F.sum(F.col("high").cast("decimal(38,0)") * (1 << _LOW) + F.col("low"))
    # as many rows as centroids have components
    rows = distinct.select("q", "n").mapInArrow(run, "cluster int, i int, high long, low long").groupBy("cluster", "i").agg(whole.cast("string").alias("total")).collect()
    found: dict[int, dict[int, int]] = defaultdict(dict)
    for r in rows:
        found[r.cluster][r.i] = int(r.total)
    return {c: (v[0], [v[i] for i in range(1, len(v))]) for c, v in found.items()}


def first_centroids(rows: DataFrame, key: str, k: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` rows with the smallest hash of seed and key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    chosen = rows.select(h.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([r.q for r in chosen], np.int64)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``v`` (digest), ``q`` and ``n``: each vector once, with the number of its rows."""
    return rows.groupBy("v").agg(F.first("q").alias("q"), F.count("*").alias("n"))


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: str = SEED) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every row with a whole vector."""
    rows = quantised(df.select(key, vector), vector, scale, dimensions).select(key, "q").withColumn("v", F.unhex(F.sha2(F.array_join("q", ","), 256)))
    distinct = stored(distinct_vectors(rows))
    centroids = first_centroids(rows, key, k, seed)
    if not len(centroids):
        centroids = np.zeros((0, dimensions), np.int64)
        inertia = {}
    else:
        for _ in range(rounds):
            for c, (n, sums) in weighted_sums(distinct, centroids).items():
                centroids[c] = [s // n for s in sums]  # // is floor, also below zero
        inertia = {c: v[0] for c, v in weighted_sums(distinct, centroids, last=True).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for part in slices(batch, 4 << 20, 4_096):
                at, far = nearest(vectors_of(part.column(1), dimensions), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(at.astype(np.int32)), pa.array(far)], ["v", "n", "cluster", "distance"])

    assigned = stored(distinct.select("v", "q", "n").mapInArrow(run, "v binary, n long, cluster int, distance long"))
    spark = df.sparkSession
    total = sum(inertia.values())
    names = [(c, inertia.get(c, 0), total, sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    named = F.broadcast(spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # a row a centroid
    back = salted_join(rows.drop("q"), assigned.drop("n"), "v", counts=assigned.select("v", "n"))
    return back.join(named, "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the query: a chain of tables, a round each."""
    floor = "(s - ((s % n) + n) % n) // n"
    ctes = [
        f"w AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT) for v in embedding] AS q FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len([v for v in embedding if v IS NOT NULL AND isfinite(CAST(v AS DOUBLE))]) = {DIMENSIONS})",
        "x AS MATERIALIZED (SELECT vec_id, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM w)",
        f"s0 AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM w QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM s0 JOIN x USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT x.vec_id, k.c, CAST(sum((x.x - k.x) * (x.x - k.x)) AS BIGINT) AS d FROM x JOIN c{r} k USING (i) GROUP BY 1, 2)")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            ctes.append(f"t{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY 1, 2)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, k.i, CAST(CASE WHEN n IS NULL THEN k.x ELSE {floor} END AS BIGINT) AS x FROM c{r} k LEFT JOIN t{r} t ON t.c = k.c AND t.i = k.i)")
    ctes.append(f"n AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY 1)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN n USING (c)"
