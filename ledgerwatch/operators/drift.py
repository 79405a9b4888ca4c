"""Concept drift: Page-Hinkley, Kolmogorov-Smirnov, population stability, adaptive windows; thresholds and repair."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def in_ranges(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` as a table in ranges of (group, order), numbered by ``block``: a group lies in as many blocks as it needs, one after the other. Equal keys share a block."""
    return stored(rows.repartitionByRange(group, order).withColumn("block", F.spark_partition_id()))


def carried(blocks: DataFrame, group: str, sums: list[str]) -> DataFrame:
    """``blocks(group, block, ...)``, a row a block, with the sum of each of ``sums`` over the blocks before it."""
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})


def running(rows: DataFrame, group: str, order: str, sums: list[str]) -> DataFrame:
    """``rows`` with ``upto_<c>`` for each of ``sums``: its sum over all rows of the group up to this one. A prefix scan: ranges are summed, the sums of ranges are carried over, each range is finished for itself, so no task holds a group."""
    r = in_ranges(rows, group, order)
    own = Window.partitionBy(group, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = carried(r.groupBy(group, "block").agg(*[F.sum(c).alias(c) for c in sums]), group, sums).drop(*sums)
    joined = r.withColumns({f"own_{c}": F.sum(c).over(own) for c in sums}).join(totals, [group, "block"])
    return joined.withColumns({f"upto_{c}": F.col(f"before_{c}") + F.col(f"own_{c}") for c in sums}).drop("block", *[f"{p}_{c}" for c in sums for p in ("own", "before")])


def page_hinkley(values: DataFrame, alpha: float = 0.005, limit: float = 50.0) -> DataFrame:
    """``values(series, at, x)``, ``at`` once a series: running deviation from the running mean, above its least value so far. No resets.

    Two prefix scans over ranges of a series: the first carries counts and sums, which gives each range its running means; the second carries the deviations' sums and their least partial sum.
    """
    r = in_ranges(values, "series", "at")
    cut = ["series", "block"]
    own = Window.partitionBy(*cut).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    first = carried(r.groupBy(*cut).agg(F.count("x").alias("n"), F.sum("x").alias("s")), "series", ["n", "s"]).drop("n", "s")
    mean = (F.col("before_s") + F.coalesce(F.sum("x").over(own), F.lit(0.0))) / F.nullif(F.col("before_n") + F.count("x").over(own), F.lit(0))
    v = r.join(first, cut).withColumn("mean", mean).drop("before_n", "before_s")
    v = v.withColumn("part", F.sum(F.col("x") - F.col("mean") - alpha).over(own)).withColumn("lowest", F.min("part").over(own))
    ends = v.groupBy(*cut).agg(F.sum(F.col("x") - F.col("mean") - alpha).alias("d"), F.min("part").alias("least"))
    ends = carried(ends, "series", ["d"])
    least = F.min(F.col("before_d") + F.col("least")).over(Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("before_least", least).select(*cut, "before_d", "before_least")
    done = v.join(ends, cut).withColumn("sum", F.col("before_d") + F.col("part"))
    return done.withColumn("excess", F.col("sum") - F.least("before_least", F.col("before_d") + F.col("lowest"))).withColumn("drift", F.col("excess") > limit).drop("block", "part", "lowest", "before_d", "before_least")


def ks(samples: DataFrame) -> DataFrame:
    """``samples(feature, x, recent)``: the history includes the recent samples. Values are counted first, so equal ones are one row; their running counts are a prefix scan over ranges of values."""
    counted = samples.groupBy("feature", "x").agg(F.count("*").alias("h"), F.count(F.when(F.col("recent"), 1)).alias("r"))
    c = running(counted, "feature", "x", ["h", "r"])
    totals = samples.groupBy("feature").agg(F.count("*").alias("nh"), F.count(F.when(F.col("recent"), 1)).alias("nr")).filter("nr >= 30 and nh >= 100")
    return c.join(totals, "feature").groupBy("feature").agg(F.max(F.abs(F.col("upto_r") / F.col("nr") - F.col("upto_h") / F.col("nh"))).alias("ks"))


def order_statistics(values: DataFrame, group: str, value: str, ranks: dict[str, str]) -> DataFrame:
    """A row a group with, for each name in ``ranks``, the value of that rank (an expression over ``n``, the group's rows, from 0). Equal values are one row, and each rank is picked from the one range that holds it."""
    counted = values.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = running(counted, group, value, ["c"])
    totals = values.groupBy(group).agg(F.count("*").alias("n"))
    here = lambda e: (F.expr(e) < F.col("upto_c")) & (F.expr(e) >= F.col("upto_c") - F.col("c"))
    return upto.join(totals, group).groupBy(group).agg(*[F.max(F.when(here(e), F.col(value))).alias(name) for name, e in ranks.items()])


def psi(samples: DataFrame, buckets: int = 10) -> DataFrame:
    """``samples(feature, x, baseline, recent)``: bounds are order statistics of the baseline, each bucket is expected to hold a tenth."""
    bounds = order_statistics(samples.filter("baseline"), "feature", "x", {f"b{b}": f"floor({b} * (n - 1) / {float(buckets)}D + 0.5D)" for b in range(1, buckets)})
    bucket = F.lit(buckets - 1)
    for b in range(buckets - 1, 0, -1):
        bucket = F.when(F.col("x") <= F.col(f"b{b}"), b - 1).otherwise(bucket)
    counted = samples.filter("recent").join(bounds, "feature").withColumn("bucket", bucket).groupBy("feature", "bucket").agg(F.count("*").alias("c"))
    n = samples.filter("recent").groupBy("feature").agg(F.count("*").alias("n"))
    each = n.filter("n >= 100").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).join(counted, ["feature", "bucket"], "left")
    share = F.greatest(F.coalesce("c", F.lit(0)) / F.col("n"), F.lit(0.0001))
    expected = 1.0 / buckets
    return each.groupBy("feature").agg(F.abs(F.sum((share - expected) * F.log(share / expected))).alias("psi"))


def severity(checks: DataFrame) -> DataFrame:
    """``checks(ks, psi, ratio)``: a vote of the tests, and how grave the drift is."""
    s = checks.withColumn("score", F.expr("if(ks > 0.15, 0.25D, 0.0D) + if(psi > 0.2, 0.25D, 0.0D) + 0.5D * ratio"))
    return s.withColumn("severity", F.expr("case when score >= 0.7 or ratio >= 0.6 then 'CRITICAL' when score >= 0.5 or ratio >= 0.4 then 'SEVERE' when score >= 0.3 or ratio >= 0.2 then 'MODERATE' when score >= 0.15 or ratio > 0 then 'MINOR' else 'NONE' end"))


#: Rows after which an adaptive window is looked at, buckets of one size that a window keeps, and the confidence of a cut.
CLOCK, BUCKETS, DELTA = 32, 5, 0.002


class Adaptive:
    """An adaptive window as an exponential histogram: buckets of (rows, sum), newest last, ``most`` of each size at most before two become one of double size, so n rows need about ``most`` log2(n) buckets, and as many cuts are tried."""

    def __init__(self, most: int = BUCKETS, delta: float = DELTA, least: int = 5):
        self.most, self.delta, self.least, self.buckets, self.cuts, self.n, self.sum = most, delta, least, [], 0, 0, 0.0

    def add(self, n: int, total: float) -> bool:
        """Take in ``n`` rows with their sum; drop the older part while its mean differs from the rest's by more than chance allows. Whether anything was dropped."""
        self.buckets.append((n, total))
        self.n, self.sum = self.n + n, self.sum + total
        end = len(self.buckets)
        while end:  # buckets of one size lie side by side, the newer sizes to the right
            size = self.buckets[end - 1][0].bit_length()
            start = end
            while start and self.buckets[start - 1][0].bit_length() == size:
                start -= 1
            if end - start > self.most:
                (a, x), (b, y) = self.buckets[start : start + 2]
                self.buckets[start : start + 2] = [(a + b, x + y)]
            end = start
        dropped = False
        while (cut := self.cut()) is not None:
            for a, x in self.buckets[:cut]:
                self.n, self.sum = self.n - a, self.sum - x
            self.buckets = self.buckets[cut:]
            self.cuts, dropped = self.cuts + 1, True
        return dropped

    def cut(self) -> int | None:
        """The buckets to drop for the largest gap between the means of both parts that is beyond its bound; None without one."""
        if len(self.buckets) < 2:
            return None
        rows, sums = np.array([b[0] for b in self.buckets], float), np.array([b[1] for b in self.buckets])
        left, low = np.cumsum(rows)[:-1], np.cumsum(sums)[:-1]
        right = self.n - left
        gap = np.abs(low / left - (self.sum - low) / right)
        bound = np.sqrt((1 / (2 * left) + 1 / (2 * right)) * math.log(4 / self.delta))
        beyond = (gap > bound) & (left >= self.least) & (right >= self.least)
        return int(np.where(beyond, gap, -1.0).argmax()) + 1 if beyond.any() else None


def adwin(values: DataFrame, delta: float = DELTA, clock: int = CLOCK) -> DataFrame:
    """``values(series, at, x)``: adaptive windows over each series in order of ``at``, ``x`` within 0 to 1: ``n`` rows, ``cuts``, and size and mean of the last ``window``.

    Rows are numbered by a prefix scan and summed by ``clock`` rows of their series in parallel; the window itself, which is sequential, then reads one row in ``clock`` and holds an exponential histogram, so no task holds a series.
    A null ``x`` is left out.
    """

    def run(frames):
        series, now, seen = None, Adaptive(delta=delta), 0
        row = lambda: (series, seen, now.cuts, now.n, now.sum / now.n)
        for pdf in frames:
            out = []
            for s, n, total in zip(pdf["series"], pdf["n"], pdf["total"], strict=True):
                if s != series:
                    if seen:
                        out.append(row())
                    series, now, seen = s, Adaptive(delta=delta), 0
                seen += int(n)
                now.add(int(n), float(total))
            yield pd.DataFrame(out, columns=["series", "n", "cuts", "window", "mean"])
        if seen:
            yield pd.DataFrame([row()], columns=["series", "n", "cuts", "window", "mean"])

    rows = values.filter("x is not null").select("series", "at", F.col("x").cast("double").alias("x"), F.lit(1).alias("one"))
    steps = running(rows, "series", "at", ["one"]).groupBy("series", F.expr(f"(upto_one - 1) div {clock}").alias("step")).agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    return steps.repartition("series").sortWithinPartitions("series", "step").mapInPandas(run, "series string, n long, cuts long, window long, mean double")


def thresholds(scored: DataFrame) -> DataFrame:
    """``scored(score, label)``: F1 of each threshold .15 to .65 by .01, less for a false-positive rate above a tenth.

    Scores are first counted by the threshold steps that they pass, so all rows collapse to about 52 before thresholds are tried.
    """
    step = F.least(F.greatest(F.floor(F.round(F.col("score") * 100, 9)).cast("int"), F.lit(14)), F.lit(65))
    counted = scored.groupBy(step.alias("step"), "label").agg(F.count("*").alias("n"))
    tries = scored.sparkSession.range(15, 66).select(F.col("id").cast("int").alias("t"))
    both = tries.join(F.broadcast(counted))
    c = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("n"))), F.lit(0))
    m = both.groupBy("t").agg(c("step >= t and label = 1").alias("tp"), c("step >= t and label = 0").alias("fp"), c("step < t and label = 0").alias("tn"), c("step < t and label = 1").alias("fn"))
    m = m.withColumns({"f1": F.expr("if(2 * tp + fp + fn > 0, 2.0D * tp / (2 * tp + fp + fn), 0.0D)"), "fpr": F.expr("if(fp + tn > 0, fp / (fp + tn), 0.0D)")})
    return m.withColumn("value", F.expr("if(fpr > 0.10, f1 * greatest(0.0D, 1.0D - 5.0D * (fpr - 0.10D)), f1)"))


def best_threshold(tries: DataFrame, conservative: bool = False, default: float = 0.55) -> DataFrame:
    """The threshold of the largest value, the lower one of equals; ``conservative``: only .25 to .55, and none with a false-positive rate above .05 counts. If nothing is above 0, the default."""
    t = tries.select("t", F.expr("if(fpr <= 0.05, f1, 0.0D)").alias("value")).filter("t between 25 and 55") if conservative else tries.select("t", "value")
    best = t.agg(F.max(F.struct("value", (-F.col("t")).alias("minus"))).alias("best"))
    return best.select(F.expr(f"if(best.value > 0, -best.minus / 100.0D, {default}D)").alias("threshold"), F.expr("coalesce(best.value, 0.0D)").alias("value"))


def newest_frauds(rows: DataFrame, k: int = 2000) -> DataFrame:
    """The buffer of fraud samples: the last ``k``."""
    return rows.filter("is_fraud = 1").orderBy(F.col("event_ms").desc(), F.col("tx_id").desc()).limit(k)


def oversampled(rows: DataFrame, normal: int, frauds: int, most: int = 5) -> DataFrame:
    """Fraud rows repeated until they are as many as the normal ones, ``most`` times at most."""
    times = max(1, min(most, normal // max(1, frauds)))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("is_fraud") == 1, times).otherwise(1))))


def vote(samples: DataFrame) -> DataFrame:
    """``samples(feature, tx_id, x, recent, baseline)``: how many features drift by adaptive windows and by Page-Hinkley, the largest KS and PSI, and what follows from all four."""
    series = samples.select(F.col("feature").alias("series"), F.col("tx_id").alias("at"), "x")
    scaled = series.join(series.groupBy("series").agg(F.max(F.abs("x")).alias("top")), "series").withColumn("x", F.expr("if(top > 0, x / top, 0.0D)"))
    a = adwin(scaled.select("series", "at", "x")).agg(F.count(F.when(F.col("cuts") > 0, 1)).alias("adwin"), F.count("*").alias("features"))
    p = page_hinkley(scaled.select("series", "at", "x")).groupBy("series").agg(F.max(F.col("drift").cast("int")).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("ph"))
    checks = a.join(F.broadcast(p)).join(F.broadcast(ks(samples).agg(F.max("ks").alias("ks")))).join(F.broadcast(psi(samples).agg(F.max("psi").alias("psi"))))
    s = checks.withColumn("score", F.expr("if(ks > 0.15, 0.25D, 0.0D) + if(psi > 0.2, 0.25D, 0.0D) + 0.5D * if(features > 0, (adwin + ph) / (2.0D * features), 0.0D)"))
    return s.withColumn("severity", F.expr("case when score >= 0.7 or adwin >= features * 0.6D then 'CRITICAL' when score >= 0.5 or adwin >= features * 0.4D then 'SEVERE' when score >= 0.3 or adwin >= features * 0.2D then 'MODERATE' when score >= 0.15 or adwin > 0 or ph > 0 then 'MINOR' else 'NONE' end"))


def kolmogorov_p(d, n, m):
    """Chance of a distance ``d`` between two samples of ``n`` and ``m`` rows of one distribution, by the first hundred terms of Kolmogorov's series."""
    scale = F.sqrt(n * m / (n + m))
    lam = (scale + F.lit(0.12) + F.lit(0.11) / scale) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def half_cuts(values: DataFrame, size: int = 100, limit: float = 0.05) -> DataFrame:
    """``values(series, at, x)``: each series in windows of ``size`` rows, cut in half: means of both halves, and ``drift`` where they differ by more than ``limit`` of the window's greatest absolute value. Windows without a full second half have no row."""
    numbered = running(values.select("series", "at", "x", F.lit(1).alias("one")), "series", "at", ["one"])
    w = numbered.select("series", F.expr(f"(upto_one - 1) div {size}").alias("window"), F.expr(f"(upto_one - 1) % {size} < {size // 2}").alias("early"), "x")
    mean = lambda c: F.avg(F.when(c, F.col("x")))
    each = w.groupBy("series", "window").agg(F.count("*").alias("n"), mean(F.col("early")).alias("before"), mean(~F.col("early")).alias("after"), F.max(F.abs("x")).alias("top"))
    return each.filter(f"n = {size}").select("series", "window", "before", "after", F.expr(f"top > 0 and abs(after - before) > {limit}D * top").alias("drift"))


def two_sample_ks(samples: DataFrame) -> DataFrame:
    """``samples(feature, x, recent)``: distance of the recent rows from the others, and its p-value."""
    counted = samples.groupBy("feature", "x").agg(F.count(F.when(~F.col("recent"), 1)).alias("h"), F.count(F.when(F.col("recent"), 1)).alias("r"))
    totals = samples.groupBy("feature").agg(F.count(F.when(~F.col("recent"), 1)).alias("nh"), F.count(F.when(F.col("recent"), 1)).alias("nr")).filter("nh > 0 and nr > 0")
    d = running(counted, "feature", "x", ["h", "r"]).join(totals, "feature").groupBy("feature").agg(F.max(F.abs(F.col("upto_r") / F.col("nr") - F.col("upto_h") / F.col("nh"))).alias("ks"), F.max("nh").alias("nh"), F.max("nr").alias("nr"))
    return d.select("feature", "ks", kolmogorov_p(F.col("ks"), F.col("nh"), F.col("nr")).alias("p_value"))


def bottom_k(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``k`` rows that is the same in every run: those of lowest seeded digest."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)


#: Parts that a group's rows are dealt over before its sketch is merged.
PARTS = 64


def sketches(rows: DataFrame, groups: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """A bottom-k sketch of each group: its ``k`` rows of lowest seeded digest (column ``digest``), a uniform sample that is the same in every run. Groups are dealt over PARTS parts by the digest first, so a group of any size is never one task's."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = rows.withColumn("digest", digest).withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(PARTS)))
    return lowest(lowest(marked, [*groups, "part"], key, k).drop("part"), groups, key, k)


def lowest(rows: DataFrame, groups: list[str], key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy("digest", key)
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def merged(one: DataFrame, other: DataFrame, groups: list[str], key: str, k: int) -> DataFrame:
    """The sketch of both tables' rows together, from their sketches alone; rows that both hold count once."""
    return lowest(one.unionByName(other).dropDuplicates([*groups, key]), groups, key, k)


def service(samples: DataFrame, limit: float = 0.05) -> DataFrame:
    """``samples(feature, x, recent)``: distance and p-value of each feature's recent rows, and whether they drift."""
    return two_sample_ks(samples).withColumn("drift", F.col("p_value") < limit)


def rate_shift(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """``rows(label, recent)``: share of frauds before and lately, and ``drift`` where they differ by more than ``least``. One row."""
    share = lambda c: F.coalesce(F.avg(F.when(c, F.col("label").cast("double"))), F.lit(0.0))
    return rows.agg(share(~F.col("recent")).alias("before"), share(F.col("recent")).alias("after")).withColumn("drift", F.abs(F.col("after") - F.col("before")) > least)


def drift_events(shifts: DataFrame) -> DataFrame:
    """``shifts(w, score)`` of windows that drift as rows of the event table: id, window, score, severity and what it asks for."""
    graded = shifts.filter("drift").select(F.sha2(F.concat(F.lit("mean_shift|"), F.col("w").cast("string")), 256).alias("event_id"), F.col("w").alias("window"), "score", F.expr("case when score >= 1.0 then 'CRITICAL' when score >= 0.7 then 'SEVERE' when score >= 0.5 then 'MODERATE' else 'MINOR' end").alias("severity"))
    return repair(graded, 0.55)


def repair(events: DataFrame, threshold: float) -> DataFrame:
    """What each drift event asks for: raise the threshold, retrain, both, or rules only."""
    return events.select(
        "*",
        F.expr("case severity when 'MINOR' then 'RAISE_THRESHOLD' when 'MODERATE' then 'RETRAIN_RECENT' when 'SEVERE' then 'RETRAIN_AND_THRESHOLD' when 'CRITICAL' then 'RULES_ONLY' else 'NONE' end").alias("action"),
        F.when(F.col("severity") == "MINOR", F.least(F.lit(0.70), F.lit(threshold * 1.05))).otherwise(F.lit(threshold)).alias("threshold"),
    )


def mean_shift(values: DataFrame, window: int = 500, every: int = 200, alpha: float = 0.1, limit: float = 0.3) -> DataFrame:
    """``values(feature, at, x)`` with ``at`` gapless from 0: at the end of each window of rows, how far the features' means lie from the baseline, in its deviations (3 at most), averaged over the features.

    The baseline is the window before, moved by ``alpha`` towards the present window after every ``every`` rows of it; the first window makes its own. Windows of fewer than 50 rows have no score. A null or
    infinite value counts as 0. A window's score needs two windows only, so they are groups joined by number, and no feature is one task.
    """
    x = F.when(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf")), 0.0).otherwise(F.col("x"))
    v = values.select("feature", F.floor(F.col("at") / window).alias("w"), (F.col("at") % window).alias("i"), x.alias("x"))
    marks = list(range(every, window, every))
    first = lambda k: F.when(F.col("i") < k, F.col("x"))
    stats = v.groupBy("feature", "w").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"),
        *[F.avg(first(k)).alias(f"mean_{k}") for k in marks], *[(F.var_pop(first(k)) * F.count(first(k))).alias(f"m2_{k}") for k in marks],
    )
    before = stats.select("feature", (F.col("w") + 1).alias("w"), F.col("mean").alias("base_mean"), F.col("m2").alias("base_m2"))
    s = stats.join(before, ["feature", "w"], "left").withColumn("seen", F.col("w") * window)
    for k in marks:
        moved = lambda c: F.when(F.col("n") >= k, F.coalesce(alpha * F.col(f"{c}_{k}") + (1 - alpha) * F.col(f"base_{c}"), F.col(f"{c}_{k}"))).otherwise(F.col(f"base_{c}"))  # noqa: B023, E731
        s = s.withColumns({"base_mean": moved("mean"), "base_m2": moved("m2"), "seen": F.when(F.col("n") >= k, F.col("w") * window + k).otherwise(F.col("seen"))})
    shift = F.expr("least(3.0D, abs(mean - base_mean) / sqrt(greatest(base_m2 / greatest(1, seen - 1), 1e-6D)))")
    scored = s.filter("n >= 50 and base_mean is not null").groupBy("w").agg(F.avg(shift).alias("score"))
    return scored.withColumn("drift", F.col("score") > limit)
