"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's budget (a share of all words by weight, at most ``most`` times the source, the excess shared again) is met by whole
copies of every document and, for the remaining budget, a subset: the same share of each length's documents, then a bounded knapsack by
dynamic programming over the words still missing, so that the sum is met exactly wherever lengths allow. Which documents of a length are taken is decided by a seeded hash, so reruns agree.

Only counts by (source, length) meet in one place, and only those of one source in one task: their number is bounded by the longest document. Sources stay a table; their targets are found by
rounds of sums over it. Documents of one length, however many, are ranked by parts of their hash: counts by the next ten bits tell in which part the count runs out, until that part is small, and only it is put in order.

A null source is a source of its own (last in order), a null text has size 0 and takes nothing; so do empty texts. Rows that equal one another are counted first and take one place, however often they
repeat; rows that share a doc_id only are rows of their own. Ties of the hash fall to the smaller key, then to the smaller hash of the row. Texts of any length are measured where they lie. An empty table gives
an empty result. Other columns are kept by ``mixed``, whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, each_of, salted_join, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
#: Words that the knapsack's table spans; what is larger is taken longest documents first until the rest fits.
TABLE_WORDS = 1 << 16
#: Documents of one source and length, or of a part of their hashes, that are put in order together.
BAND_ROWS = 200
#: Bits of the hash that a round looks at, and bits of the hash.
ROUND_BITS = 10
HASH_BITS = 63


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words sum to ``budget``, or as near below it as lengths allow."""
    whole = int((lengths * counts).sum())
    budget = min(budget, whole)
    taken = np.zeros(len(lengths), dtype=np.int64)
    if not budget:
        return taken
    use = lengths > 0
    taken[use] = (counts[use].astype(object) * budget // whole).astype(np.int64)  # the same share of every length
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # what the table can't span: longest first
        if rest <= TABLE_WORDS:
            break
        if use[i]:
            k = min(int(counts[i] - taken[i]), (rest - TABLE_WORDS) // int(lengths[i]) + 1, rest // int(lengths[i]))
            taken[i] += k
            rest -= k * int(lengths[i])
    return taken + knapsack(lengths, np.where(use, counts - taken, 0), rest)


def knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: one bit for each sum that can be reached; counts are split into powers of two. Of each sum only the step that first reached it is kept, which is enough to walk back."""
    mask = (1 << (budget + 1)) - 1
    reached, first, steps = 1, np.full(budget + 1, -1, dtype=np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        length, count, part = int(lengths[i]), int(free[i]), 1
        count = min(count, budget // length if length else 0)
        while count > 0:
            part = min(part, count)
            new = (reached << (length * part)) & mask & ~reached
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
                some = np.flatnonzero(raw)
                at = np.flatnonzero(np.unpackbits(raw[some], bitorder="little"))
                first[some[at // 8] * 8 + at % 8] = len(steps)
                steps.append((int(i), part))
                reached |= new
            count -= part
            part *= 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    out = np.zeros(len(lengths), dtype=np.int64)
    while at > 0:
        i, part = steps[first[at]]
        out[i] += part
        at -= int(lengths[i]) * part
    return out


def with_sizes(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(counts: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source of ``counts(source, size, n)``: shares of the whole by weight, none above ``most`` times its size, the excess shared again.

    Sources are numbered in order by ranges, and only the numbers of sources in each range are summed up. Each round sets a level (words for a unit of weight) and finds the sources that it fills; those stay full.
    """
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranged = stored(sizes.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = ranged.groupBy("part").agg(F.count("*").alias("k")).withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("none", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = stored(ranged.join(starts, "part").select("source", "source_size", weight.alias("weight")))
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    total, level, known = min(share * whole, most * whole), 0.0, -1
    while True:
        full = F.lit(False) if known < 0 else most * F.col("source_size") <= F.lit(level) * F.col("weight")
        n, filled, weight_left = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == known or not weight_left:
            break
        level, known = (total - (filled or 0)) / weight_left, n
    full = most * F.col("source_size") <= F.lit(level) * F.col("weight")
    target = F.when(full, most * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", (target if weight_left else most * F.col("source_size")).cast("double").alias("target"))


def plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each (source, size): ``copies`` that every document gets, and ``extra`` documents that get one more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        size, target = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
        copies = target // size if size else 0
        extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), target - copies * size)
        return pdf.assign(copies=copies, extra=extra)[["source", "size", "n", "groups", "source_size", "target", "copies", "extra"]]

    same = counts["source"].eqNullSafe(targets["source"])
    joined = counts.join(targets, same).select(counts["source"], "size", "n", "groups", "source_size", "target")
    return joined.groupBy("source").applyInPandas(run, "source string, size long, n long, groups long, source_size long, target double, copies long, extra long")


def kind():
    """Names a source and size."""
    return F.xxhash64("source", "size").alias("kind")


def part_of(h, depth):
    """The first bits of a hash after ``depth`` rounds."""
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - F.lit(ROUND_BITS) * depth).cast("int"))


def narrowed(same: DataFrame, planned: DataFrame) -> DataFrame:
    """``planned`` with ``depth``, ``part`` and ``ahead``: rows whose hash lies in a smaller part are taken (``ahead`` of them), those in a larger one aren't, those in ``part`` are put in order."""
    now = stored(planned.withColumns({"kind": kind(), "depth": F.lit(0), "part": F.lit(0).cast("long"), "ahead": F.lit(0).cast("long"), "open": F.when(F.expr("extra > 0 and extra < n"), F.col("groups")).otherwise(F.lit(0)).cast("long")}))
    for depth in range(HASH_BITS // ROUND_BITS):
        wide = now.filter(F.col("open") > BAND_ROWS)
        if not wide.limit(1).count():
            break
        rows = salted_join(same.withColumn("kind", kind()), wide.select("kind", "depth", "part", "ahead", "extra"), "kind", counts=wide.select("kind", F.col("open").alias("n")))
        rows = rows.filter(part_of(F.col("h"), F.col("depth")) == F.col("part")).withColumn("next", part_of(F.col("h"), F.lit(depth + 1)))
        counted = rows.groupBy("kind", "extra", "ahead", "next").agg(F.sum("n").alias("n"), F.count("*").alias("groups"))  # at most 2^ROUND_BITS rows of a kind
        upto = F.sum("n").over(Window.partitionBy("kind").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)) + F.col("ahead")
        cut = counted.withColumn("upto", upto).filter("upto >= extra and upto - n < extra").select("kind", F.col("next").alias("new_part"), F.expr("upto - n").alias("new_ahead"), F.col("groups").alias("new_open"))
        new = now.join(cut, "kind", "left")
        there = F.col("new_part").isNotNull()
        now = stored(new.withColumns({"depth": F.when(there, F.lit(depth + 1)).otherwise(F.col("depth")), "part": F.coalesce("new_part", "part"), "ahead": F.coalesce("new_ahead", "ahead"), "open": F.coalesce("new_open", "open")}).drop("new_part", "new_ahead", "new_open"))
    return now


def assignments(df: DataFrame, key: str = "doc_id", seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``key``, ``source``, ``size``, ``tie``, ``n``, ``source_size``, ``target``, ``copies``, ``more`` of the ``n`` rows of ``df(key, source, size, tie)`` that equal one another: each is taken ``copies`` times, ``more`` of them once more."""
    same = stored(df.groupBy(key, "source", "size", "tie").agg(F.count("*").alias("n")).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, "tie"), 1)))
    counts = stored(same.groupBy("source", "size").agg(F.sum("n").alias("n"), F.count("*").alias("groups")))
    planned = narrowed(same, plan(counts, source_targets(counts, weights, share, most)))
    p = planned.select("kind", F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", "copies", "extra", F.col("n").alias("of"), "depth", "part", "ahead")
    rows = salted_join(same.withColumn("kind", kind()), p, "kind", counts=planned.select("kind", F.col("groups").alias("n"))).filter("source <=> p_source and size = p_size")
    at = part_of(F.col("h"), F.col("depth"))
    rows = rows.withColumn("state", F.expr("if(extra = 0, 'none', if(extra = of, 'all', ''))")).withColumn("state", F.when(F.col("state") != "", F.col("state")).when(at < F.col("part"), "all").when(at > F.col("part"), "none").otherwise("open"))
    upto = F.sum("n").over(Window.partitionBy("kind").orderBy("h", key, "tie").rowsBetween(Window.unboundedPreceding, 0)) + F.col("ahead")
    ordered = rows.filter("state = 'open'").withColumn("more", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - upto + F.col("n"))).cast("long"))
    clear = rows.filter("state <> 'open'").withColumn("more", F.expr("if(state = 'all', n, 0L)"))
    keep = [key, "source", "size", "tie", "n", "source_size", "target", "copies", "more"]
    return ordered.select(keep).unionByName(clear.select(keep))


def row_hash(df: DataFrame, columns: list[str]):
    """Tells rows apart that share a key; columns of maps have no hash."""
    return F.xxhash64(*[F.col(c) for c in columns if "map<" not in df.schema[c].dataType.simpleString()]).alias("tie")


def mix(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken."""
    columns = ["doc_id", "source", "text"]
    sized = stored(with_sizes(docs.select(*columns, row_hash(docs, columns))).select("doc_id", "source", "size", "tie"))
    rows = each_of(assignments(sized), "n", "i")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + (F.col("i") < F.col("more")).cast("long"))).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``. The texts are shuffled once."""
    sized = stored(with_sizes(docs.select(F.col(key).alias("key"), "source", "text", row_hash(docs, docs.columns))).select("key", "source", "size", "tie"))
    name = F.xxhash64("key", "source", "tie").alias("name")
    taken = stored(assignments(sized, "key").select(name, "n", F.expr("if(size > 0, copies * n + more, 0L)").alias("times")).filter("times > 0"))
    packed = docs.select(F.col(key).alias("key"), F.col("source").alias("source"), row_hash(docs, docs.columns), F.struct(*docs.columns).alias("row"))  # no column's name can clash
    # the same plan at every size: ``taken`` grows with the documents and is never broadcast
    rows = salted_join(packed.select(name, "row"), taken.hint("merge"), "name", counts=taken.select("name", "n"))
    one = rows.filter("n = 1").select("row", "times")
    many = rows.filter("n > 1").groupBy("name").agg(F.first("row").alias("row"), F.first("times").alias("times")).select("row", "times")  # equal rows
    return each_of(one.unionByName(many), "times", "i").select("row.*")
