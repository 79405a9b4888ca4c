"""Clustering, whitening and line deduplication against brute force, on small tables with nulls, ties, repeats, odd rows and clashing column names."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from ledgerwatch.llm import clustering, linededup, whitening

VECTORS = "vec_id long, embedding array<float>, label int, q string, v string, n long, cluster string, component int, y string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "q", "v", 7, "c", 3, "y", "k") for i, e in rows], VECTORS).repartition(3)


def odd_rows(dims, seed=1, n=60):
    """Vectors with many copies of one, ties in coordinates, and rows that have to go."""
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(n)]
    rows += [(2 * n, rows[1][1]), (2 * n, rows[1][1]), (2 * n + 1, [0.0] * dims), (2 * n + 2, [-0.0] * dims)]
    bad = [None, [], [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [math.nan] + [1.0] * (dims - 1), [math.inf] + [1.0] * (dims - 1)]
    return rows, [(10_000 + i, b) for i, b in enumerate(bad)]


def lloyd(rows, k, rounds):
    """The contract, in plain Python."""
    q = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows]
    start = sorted(q, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(x) for _, x in start]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c)) for _, x in q]
    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            own = [x for (_, x), a in zip(q, at, strict=True) if a == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    d = [far(x, centroids[a]) for (_, x), a in zip(q, at, strict=True)]
    inertia = Counter()
    for a, f in zip(at, d, strict=True):
        inertia[a] += f
    h = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, a, f, inertia[a], sum(d), h[a]) for (i, _), a, f in zip(q, at, d, strict=True))


@pytest.mark.parametrize(("k", "seed"), [(8, 1), (5, 2)])
def test_clusters_equal_plain_rounds(spark, k, seed):
    rows, bad = odd_rows(64, seed)
    got = clustering.cluster(table(spark, rows + bad), k=k, rounds=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == lloyd(rows, k, 4)


def test_clusters_of_few_or_no_rows(spark):
    rows, bad = odd_rows(64)
    few = rows[:3]
    assert sorted(map(tuple, clustering.cluster(table(spark, few)).collect())) == lloyd(few, 8, 10)
    assert clustering.cluster(table(spark, bad)).count() == 0
    assert [r.vec_id for r in clustering.cluster(table(spark, [(None, rows[0][1])])).collect()] == [None]


def test_weighted_sums_are_exact_beyond_64_bits(spark):
    q = [(1 << 26) - 1] * 64
    distinct = spark.createDataFrame([(q, 1 << 50), (q, 3)], "q array<int>, n long")
    n, sums = clustering.weighted_sums(distinct, np.zeros((1, 64), np.int64))[0]
    assert n == (1 << 50) + 3 and sums == [q[0] * n] * 64
    assert clustering.weighted_sums(distinct, np.full((1, 64), q[0] - 1), last=True)[0][0] == 64 * n


def test_a_component_without_room_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(table(spark, [(1, [1e30] * 64)])).collect()


# -- whitening ------------------------------------------------------------------------------------------


def whitened(rows):
    """The contract by a dense solver, centred in integers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in e] for _, e in rows]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda r: np.array([(n * a - b) / n for a, b in zip(r, s, strict=True)])
    c = np.array([centred(r) for r in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, e[::-1], u[:, ::-1], np.array([centred(r) for r in x]), np.trace(v)


@pytest.mark.parametrize("dims", [64, 5])
def test_whitening_equals_a_dense_solver(spark, dims):
    rows, bad = odd_rows(dims)
    rows = [(i, [x * (1 + j) for j, x in enumerate(e)]) for i, e in rows]
    got = whitening.whiten(table(spark, rows + bad)).collect()
    n, deviation, e, u, x, trace = whitened(rows)
    k = min(16, dims)
    assert len(got) == k * len(rows) and {r.n for r in got} == {n}
    want = {}
    for (i, _), d, row in zip(rows, deviation, x @ u[:, :k] / np.sqrt(e[:k]), strict=True):
        want.setdefault(i, []).append((d, row))
    signs = {}
    for r in got:
        d, row = want[r.vec_id][0]
        assert (r.deviation, int(r.deviation_exact)) == (d, d)
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-10) and r.identity_error < 1e-9
        w = row[r.component - 1]
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-8)
        if abs(w) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * w > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_spread_or_rows(spark):
    rows, bad = odd_rows(6)
    assert whitening.whiten(table(spark, bad[:1] + bad[4:])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0] * 6), (2, [1.0] * 6)])).count() == 0
    two = whitening.whiten(table(spark, [(1, [1.0] * 6), (2, [2.0] * 6), (None, [2.0] * 6), (4, [1.0] * 5)])).collect()  # one direction
    assert sorted((r.vec_id or 0, r.component, round(abs(r.whitened), 9)) for r in two) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)]


@pytest.mark.parametrize("rank", [300, 7])
def test_lanczos_restarts_and_breaks_down(rank):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    e = np.zeros(300)
    e[:rank] = 1.5 ** -np.arange(rank)
    a = (q * e) @ q.T
    values, vectors = whitening.lanczos(lambda b: a @ b, 300, 6, block=4, most=24)
    assert values == pytest.approx(e[:6], abs=1e-12)
    assert np.abs(np.abs(q[:, :6].T @ vectors) - np.eye(6)).max() < 1e-9


def test_sums_beyond_64_bits():
    x = np.array([[1 << 40, 3], [-(1 << 41), 0]])
    assert whitening.deviations(x) == [(1 << 80) + 9, 1 << 82]


# -- lines ----------------------------------------------------------------------------------------------

LONG = ["A long line that many documents hold, number %d, äöü" % i for i in range(12)]


def line_docs(spark, texts, ids=None):
    rows = [(i, t, "x", 1, 2, "r") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, shard int, n long, dropped string").repartition(3)


def deduped(rows):
    """The contract, in plain Python; rows are documents."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held, top = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            top[k] = max(top.get(k, -math.inf), -math.inf if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and held[key(x)] >= 5 and top[key(x)] != (-math.inf if i is None else i))]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": -1, "shard_keys": 2}, {"shard_keys": 1}])
def test_lines_equal_brute_force(spark, way):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["", " \t", "short", "own %d" % rng.random(), " " * rng.randrange(3) + rng.choice(LONG) + "\r", rng.choice(LONG).upper(), "É" * 39, "é" * 40, "é" * 41 + str(rng.randrange(2))]) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts += [None, "", "\n", "\n".join(LONG), "x" * 100_000 + "\n" + LONG[0]] + [LONG[1]] * 3
    ids = [*range(len(texts) - 4), None, 7, 7, 7]
    got = linededup.dedup_lines(line_docs(spark, texts, ids), **way)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == deduped(list(zip(ids, texts, strict=True)))


def test_lines_of_empty_tables(spark):
    for way in ({}, {"broadcast_bytes": -1}):
        assert linededup.dedup_lines(line_docs(spark, []), **way).count() == 0
        only = linededup.dedup_lines(line_docs(spark, [None]), **way).collect()
        assert [(r.n_lines, r.n_dropped, r.kept) for r in only] == [(1, 0, "")]
    assert linededup.digests(line_docs(spark, [""])).first().kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    hi, lo = (rng.integers(0, 1 << 64, 5000, dtype=np.uint64) for _ in range(2))
    hi[:100] = hi[0]  # equal first halves are told apart by the second
    made = linededup.Index.build(hi, lo, np.arange(5000), np.arange(5000) * 3)
    again = linededup.Index.unpack(*made.pack())
    assert sorted(again.places(hi, lo)) == list(range(5000))
    counts, keepers = again.find(hi, lo)
    assert (counts == np.minimum(np.arange(5000), 255)).all() and (keepers == np.arange(5000) * 3).all()
    other, _ = again.find(rng.integers(0, 1 << 64, 5000, dtype=np.uint64), rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert not other.any()
