"""Mean-shift drift against the rule applied row by row."""

import math
import random

from ledgerwatch.operators import drift


def by_row(series):
    """Scores at the end of each window of 500 rows (and of the last, if it has 50)."""
    base, n_base, scores = None, 0, {}
    rows = list(zip(*series, strict=True))
    mean, m2, at = [0.0] * len(series), [0.0] * len(series), 0
    for i, row in enumerate(rows):
        at += 1
        for k, x in enumerate(row):
            x = 0.0 if x is None or math.isnan(x) or math.isinf(x) else x
            d = x - mean[k]
            mean[k] += d / at
            m2[k] += d * (x - mean[k])
        if at % 200 == 0:
            mix = lambda new, old: [0.1 * a + 0.9 * b for a, b in zip(new, old, strict=True)]
            base, n_base = (mix(mean, base[0]), mix(m2, base[1])) if base else (mean[:], m2[:]), i + 1
        if at == 500 or i == len(rows) - 1:
            if base and at >= 50:
                far = [min(3.0, abs(a - b) / math.sqrt(max(v / max(1, n_base - 1), 1e-6))) for a, b, v in zip(mean, *base, strict=True)]
                scores[i // 500] = sum(far) / len(far)
            base, n_base = (mean, m2), i + 1
            mean, m2, at = [0.0] * len(series), [0.0] * len(series), 0
    return scores


def test_mean_shift(spark):
    rnd = random.Random(5)
    for n in (49, 120, 400, 1049, 1050, 1260, 2500):
        series = [[rnd.gauss(0, 1) + (i > 900) for i in range(n)], [rnd.random() * 100 for _ in range(n)], [None if i % 7 == 0 else float("nan") if i % 7 == 1 else float("inf") if i % 7 == 2 else 1.0 for i in range(n)]]
        rows = [(f"f{k}", i, x) for k, s in enumerate(series) for i, x in enumerate(s)]
        got = {r.w: (r.score, r.drift) for r in drift.mean_shift(spark.createDataFrame(rows, "feature string, at long, x double")).collect()}
        want = by_row(series)
        assert set(got) == set(want)
        assert all(abs(got[w][0] - s) < 1e-6 and got[w][1] == (s > 0.3) for w, s in want.items())


def series_rows(rng, n=700):
    flat = [("flat", i, rng.random()) for i in range(n)]
    step = [("step", i, 0.1 * rng.random() + (0.8 if i >= n // 2 else 0.1)) for i in range(n)]
    return [*flat, *step, ("one", 0, 0.5)]


def in_ranges_of(spark, rows, schema):
    """More ranges than series, so that prefix scans have something to carry."""
    return spark.createDataFrame(rows, schema).repartition(3)


def test_page_hinkley_equals_a_loop(spark):
    rows = series_rows(random.Random(1))
    got = {(r.series, r.at): r.excess for r in drift.page_hinkley(in_ranges_of(spark, rows, "series string, at long, x double")).collect()}
    state = {}
    for s, at, x in rows:
        n, total, m, least = state.get(s, (0, 0.0, 0.0, math.inf))
        n, total = n + 1, total + x
        m += x - total / n - 0.005
        least = min(least, m)
        state[s] = (n, total, m, least)
        assert abs(got[(s, at)] - (m - least)) < 1e-9
    assert len(got) == len(rows)


def adaptive_by_hand(xs, clock=drift.CLOCK, most=drift.BUCKETS, delta=drift.DELTA):
    """Buckets as a list of lists by size, cuts tried one by one."""
    window, cuts = [], 0
    for i in range(0, len(xs), clock):
        part = xs[i : i + clock]
        window.append((len(part), sum(part)))
        again = True
        while again:  # the newest size with too many buckets merges its two oldest
            again = False
            for size in sorted({b[0].bit_length() for b in window}):
                at = [k for k, b in enumerate(window) if b[0].bit_length() == size]
                if len(at) > most:
                    k = at[0]
                    window[k : k + 2] = [(window[k][0] + window[k + 1][0], window[k][1] + window[k + 1][1])]
                    again = True
                    break
        while True:
            best = None
            for k in range(1, len(window)):
                a, b = sum(w[0] for w in window[:k]), sum(w[0] for w in window[k:])
                gap = abs(sum(w[1] for w in window[:k]) / a - sum(w[1] for w in window[k:]) / b)
                if a >= 5 and b >= 5 and gap > math.sqrt((1 / (2 * a) + 1 / (2 * b)) * math.log(4 / delta)) and (best is None or gap > best[0] + 1e-12):
                    best = (gap, k)
            if best is None:
                break
            window, cuts = window[best[1] :], cuts + 1
    n = sum(w[0] for w in window)
    return len(xs), cuts, n, sum(w[1] for w in window) / n


def test_adwin_equals_a_plain_version(spark):
    rows = series_rows(random.Random(2), 1500)
    got = {r.series: (r.n, r.cuts, r.window, r.mean) for r in drift.adwin(in_ranges_of(spark, rows, "series string, at long, x double")).collect()}
    for s in ("flat", "step", "one"):
        want = adaptive_by_hand([x for n, _, x in rows if n == s])
        assert got[s][:3] == want[:3] and abs(got[s][3] - want[3]) < 1e-9
    assert got["step"][1] > 0 and got["step"][3] > 0.8 and got["flat"][1] == 0
    full = drift.Adaptive()
    for _ in range(1 << 14):
        full.add(1, 0.5)
    assert len(full.buckets) <= drift.BUCKETS * 15 and full.n == 1 << 14


def test_ranks_and_distances_equal_sorting(spark):
    rng = random.Random(3)
    rows = [(f, rng.randrange(50) / 7 + (i >= 450), i >= 400, i < 250) for f in ("a", "b") for i in range(600)] + [("few", 1.0, True, True)]
    samples = in_ranges_of(spark, rows, "feature string, x double, recent boolean, baseline boolean")
    got = {r.feature: r for r in drift.order_statistics(samples, "feature", "x", {"low": "0L", "mid": "n div 2", "top": "n - 1"}).collect()}
    for f in ("a", "b", "few"):
        xs = sorted(r[1] for r in rows if r[0] == f)
        assert (got[f].low, got[f].mid, got[f].top) == (xs[0], xs[len(xs) // 2], xs[-1])
    two = {r.feature: r for r in drift.two_sample_ks(samples).collect()}
    assert set(two) == {"a", "b"}
    for f in ("a", "b"):
        old, new = ([r[1] for r in rows if r[0] == f and r[2] == late] for late in (False, True))
        d = max(abs(sum(v <= x for v in old) / len(old) - sum(v <= x for v in new) / len(new)) for x in old + new)
        scale = math.sqrt(len(old) * len(new) / (len(old) + len(new)))
        lam = (scale + 0.12 + 0.11 / scale) * d
        p = max(0.0, min(1.0, 2 * sum((1 if k % 2 else -1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))
        assert abs(two[f].ks - d) < 1e-12 and abs(two[f].p_value - (1.0 if lam < 0.2 else p)) < 1e-12


def test_half_cuts_equal_slices(spark):
    rng = random.Random(9)
    xs = [rng.random() + (i > 250) for i in range(450)]
    got = {r.window: r for r in drift.half_cuts(in_ranges_of(spark, [("s", i, x) for i, x in enumerate(xs)], "series string, at long, x double")).collect()}
    assert set(got) == {0, 1, 2, 3}
    for w, r in got.items():
        part = xs[100 * w : 100 * w + 100]
        a, b = sum(part[:50]) / 50, sum(part[50:]) / 50
        assert abs(r.before - a) < 1e-12 and abs(r.after - b) < 1e-12 and r.drift == (abs(a - b) > 0.05 * max(part))
