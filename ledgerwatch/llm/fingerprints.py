"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every distinct shingle hash below ``1 / SCALE`` of the range. Whatever the length of a document, the kept hashes are a fixed share of its shingles, so fingerprints of very
unequal documents can be compared and two fingerprints merge by union into that of both texts. So that short texts have marks too, the ``LEAST`` smallest hashes are kept in any case. A fingerprint thus
knows *all* hashes of its text up to some limit (the threshold, the last of the smallest, or no limit if nothing was left out); two are compared below the smaller of their limits.

Likeness (Jaccard) and containment of two texts of up to ``LEAST`` shingles are exact, but for hashes that meet by chance (48 bits). Else they are estimated from at least ``LEAST`` hashes of the shorter text: the standard error
is at most ``sqrt(J (1 - J) / LEAST)``, 0.063 at J = 0.5, and falls with a text's length (``sqrt(J (1 - J) SCALE / shingles)``).

The string is ``s<SCALE>:`` (``s<SCALE>c:`` if nothing was left out) and the kept hashes in ascending order, 48 bits each, in base 64. A null text is an empty one; a text without words has
no hash. Two fingerprints without a hash are alike (1), one without and one with a hash are not (0). Equal texts have equal fingerprints. Very long texts are hashed by pieces. Repeated rows, and rows with one
key, are rows of their own: of rows with one key the order is that of their texts' hashes. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, map_batches, stored
from .text import shingle_sets

#: One of so many shingle hashes is kept, and so many of the smallest in any case.
SCALE = 8
LEAST = 64
HASH_BITS = 48
#: Rows in a range of keys, about, when documents are put in order.
RANGE_ROWS = 2_000
#: Ranges at most: their bounds go to every task. Beyond it ranges hold more rows.
MAX_RANGES = 100_000


def threshold(scale: int = SCALE) -> int:
    return (1 << HASH_BITS) // scale - 1


@dataclass
class Sketch:
    """The kept hashes in ascending order, and whether they are all."""

    kept: np.ndarray
    whole: bool
    scale: int = SCALE

    @property
    def limit(self) -> int:
        """Up to here all hashes of the text are known."""
        return 1 << HASH_BITS if self.whole else max(threshold(self.scale), int(self.kept[-1]))


def cut(hashes: np.ndarray, limit: int, scale: int) -> Sketch:
    """The sketch of a sorted set of hashes that is known up to ``limit``."""
    known = hashes[: np.searchsorted(hashes, limit, "right")]
    n = max(int(np.searchsorted(known, threshold(scale), "right")), min(LEAST, len(known)))
    return Sketch(known[:n], limit > threshold(1) and n == len(known), scale)


def sketch(hashes: np.ndarray, scale: int = SCALE) -> Sketch:
    """The sketch of a sorted set of 64-bit hashes."""
    return cut(np.unique(hashes >> np.uint64(64 - HASH_BITS)), 1 << HASH_BITS, scale)


def to_text(s: Sketch) -> str:
    raw = s.kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8 :].tobytes()
    return f"s{s.scale}{'c' if s.whole else ''}:{base64.b64encode(raw).decode()}"


def from_text(text: str) -> Sketch:
    head, _, tail = text.partition(":")
    raw = np.frombuffer(base64.b64decode(tail), dtype=np.uint8).reshape(-1, HASH_BITS // 8)
    kept = np.zeros((len(raw), 8), dtype=np.uint8)
    kept[:, 8 - HASH_BITS // 8 :] = raw
    return Sketch(kept.reshape(-1).view(">u8").astype(np.uint64), head.endswith("c"), int(head[1:].rstrip("c")))


def merge(a: str, b: str) -> str:
    """The fingerprint of two texts' shingles together."""
    x, y = from_text(a), from_text(b)
    return to_text(cut(np.union1d(x.kept, y.kept), min(x.limit, y.limit), max(x.scale, y.scale)))


def _comparable(x: Sketch, y: Sketch) -> tuple[np.ndarray, np.ndarray]:
    limit = min(x.limit, y.limit)
    return x.kept[: np.searchsorted(x.kept, limit, "right")], y.kept[: np.searchsorted(y.kept, limit, "right")]


def likeness(x: Sketch, y: Sketch) -> float:
    a, b = _comparable(x, y)
    if not len(a) and not len(b):
        return float(len(x.kept) == len(y.kept))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(x: Sketch, y: Sketch) -> float:
    """Share of the first text's shingles that the second has."""
    a, b = _comparable(x, y)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float(not len(x.kept))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """``key`` and ``fingerprint`` of every row: a map over partitions."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(sketch(x, scale)) for x in shingle_sets(batch.column(1))], pa.string())], [key, "fingerprint"])

    return map_batches(df.select(key, text), lambda: run, f"`{key}` {key_type}, fingerprint string", max_bytes=2 << 20)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with ``next_text``, the text of the row after it by (key, hash of the text, text), the first row following the last.

    Keys are cut into ranges of about RANGE_ROWS rows at quantiles; a key with many rows is a range of its own, which is cut again by the hash of the text. Rows follow one another within a range, and each
    range also gets a copy of the next range's first row. Null keys come first; a single row follows itself.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).withColumn("h", F.shiftrightunsigned(F.xxhash64("t"), 1))
    n = df.select(key).count()
    parts = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    cuts = sorted(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.4 / parts)) if parts > 1 else []
    often = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}
    bounds = np.array(sorted({*cuts, *[float(np.nextafter(c, np.inf)) for c in often]}))

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.where(k.isna(), -1, np.searchsorted(bounds, k.to_numpy(dtype=float, na_value=-np.inf), "right")).astype(np.int32))

    rows = rows.withColumn("part", place(F.col("k").cast("double")))
    first = F.min(F.struct(F.col("k").isNotNull().alias("has"), "k", "h")).alias("f")
    found = stored(rows.groupBy("part").agg(first, F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")))
    hot = found.filter(F.col("low").eqNullSafe(F.col("high")) & (F.col("n") > 4 * RANGE_ROWS)).select("part", F.ceil(F.col("n") / RANGE_ROWS).alias("subs"))
    if n_hot := hot.count():
        rows = rows.join(fits_broadcast(hot, n_hot), "part", "left").withColumn("sub", F.floor(F.col("h") / F.lit(float(1 << 63)) * F.coalesce("subs", F.lit(1))).cast("int")).drop("subs")
        found = stored(rows.groupBy("part", "sub").agg(first))
    else:
        rows, found = rows.withColumn("sub", F.lit(0)), found.withColumn("sub", F.lit(0))
    return _followed(rows, found.select("part", "sub", F.col("f.k").alias("first_k"), F.col("f.h").alias("first_h"))).select(F.col("k").alias(key), F.col("t").alias(text), "next_text")


def _followed(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    # parts are MAX_RANGES and two at most, so their order is one small window; a part's pieces follow one another inside it
    parts = firsts.groupBy("part").agg(F.max("sub").alias("last"))
    before = F.coalesce(F.lag(F.struct("part", "last")).over(Window.orderBy("part")), F.max(F.struct("part", "last")).over(Window.partitionBy()))
    parts = parts.select("part", before.alias("before"))
    inside = F.lag("sub").over(Window.partitionBy("part").orderBy("sub"))
    ring = firsts.withColumn("inside", inside).join(fits_broadcast(parts, MAX_RANGES + 2), "part")
    ring = stored(ring.select("part", "sub", "first_k", "first_h", F.when(F.col("inside").isNotNull(), F.struct("part", F.col("inside").alias("sub"))).otherwise(F.struct(F.col("before.part").alias("part"), F.col("before.last").alias("sub"))).alias("goes_to")))
    heads = rows.join(fits_broadcast(ring, ring.count()), ["part", "sub"]).filter(F.col("k").eqNullSafe(F.col("first_k")) & (F.col("h") == F.col("first_h")))
    heads = heads.groupBy("goes_to").agg(F.min("t").alias("t"))
    mine = rows.select("part", "sub", "k", "h", "t", F.lit(0).alias("tail"))
    tails = heads.select("goes_to.part", "goes_to.sub", F.lit(None).cast(rows.schema["k"].dataType).alias("k"), F.lit(None).cast("long").alias("h"), "t", F.lit(1).alias("tail"))
    w = Window.partitionBy("part", "sub").orderBy("tail", "k", "h", "t")
    return mine.unionByName(tails).withColumn("next_text", F.lead("t").over(w)).filter("tail = 0")


def compare_edited(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """The contract's columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, follows = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + f[:h] for t, f, h in zip(texts, follows, halves, strict=True)]
        kept = [[sketch(x, scale) for x in shingle_sets(pa.array(side, pa.large_string()))] for side in (texts, edited, follows)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(x) for x in kept[0]], pa.string()),
                pa.array([to_text(x) for x in kept[1]], pa.string()),
                pa.array([likeness(x, y) for x, y in zip(kept[0], kept[1], strict=True)], pa.float64()),
                pa.array([likeness(x, y) for x, y in zip(kept[0], kept[2], strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return map_batches(with_next(docs), lambda: run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", max_bytes=4 << 20)
