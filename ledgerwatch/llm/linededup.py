"""Lines that many documents share are dropped, by a sharded minimal perfect hash.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased, hashed to 128 bits. Keys are counted by Spark's two-step aggregation. Those that enough documents hold are indexed: the first
bits of a hash name its shard, and in each shard a minimal perfect hash (levels of bit arrays, a key lies at the first level where nothing else meets it) gives every key its place in three compact arrays: fingerprint, count
and the largest doc_id that holds it. Keys of few documents are in no shard; the fingerprint (64 bits of the hash) turns them away.

Documents probe the arrays where they are read: while the arrays take ``BROADCAST_BYTES`` at most they are broadcast, and no line and no text is shuffled but for the counts. Beyond, each document sends its hashes, packed
by shard, to the shard's arrays; shards that many documents ask are copied to as many groups as they need, and texts meet the verdict on them. Both ways give the same rows. Two keys share a hash with a chance of 2^-128.

Defined cases: a null or empty text is one empty line. Rows are documents: repeated rows count each, and a key's lines stay in every row of its largest doc_id. A null doc_id lies below all others. Lines end at \\n alone, and
texts of any length are split whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fits_broadcast, frugal, salted_join, slices, stored
from .text import mix, text_bytes

SPACE = b" \t\n\x0b\x0c\r"
#: Code points that a key has at least, and documents that hold it at least, for its lines to go.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bits of a level for each key that enters it.
GAMMA = 2.0
#: Keys of a shard, about.
SHARD_KEYS = 1 << 16
#: Bytes of all arrays up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Documents that ask one copy of a shard's arrays, about.
GROUP_ROWS = 20_000
#: Stands for a null doc_id.
NULL_ID = -(1 << 63)
ARRAYS = "shard int, levels binary, words binary, ranks binary, fingerprints binary, counts binary, keepers binary"


def long_keys(raw: bytes, least: int) -> tuple[list[bytes], list[int], np.ndarray]:
    """The lines of a text, the places of those with a key of at least ``least`` code points, and these keys' hashes (two columns of 64 bits)."""
    lines, at, digests = raw.split(b"\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip(SPACE).lower()  # of bytes, lower() changes A-Z alone
            if len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least):
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(key))
    return lines, at, np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def shard_of(hi: np.ndarray, bits: int) -> np.ndarray:
    return (hi >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hi), np.int64)


def place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hi ^ mix(lo + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


class Index:
    """A shard: levels of bit arrays, and what its keys' places hold."""

    def __init__(self, levels: np.ndarray, words: np.ndarray, ranks: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.levels, self.words, self.ranks, self.fingerprints, self.counts, self.keepers = levels, words, ranks, fingerprints, counts, keepers

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Index:
        """Of distinct pairs (hi, lo). Each level takes the keys that are alone at their bit; about 40 % go on to the next."""
        todo, levels, words = np.arange(len(hi)), [], []
        while len(todo):
            size = max(64, math.ceil(GAMMA * len(todo) / 64) * 64)
            at = place(hi[todo], lo[todo], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            levels.append(size)
            todo = todo[~alone[at]]
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.uint32)[:-1]]).astype(np.uint32) if len(bits) else np.zeros(0, np.uint32)
        out = cls(np.array(levels, np.int64), bits, ranks, lo, counts, keepers)
        order = np.empty(len(hi), np.int64)
        order[out.places(hi, lo)] = np.arange(len(hi))
        out.fingerprints, out.counts, out.keepers = lo[order], np.minimum(counts[order], 255).astype(np.uint8), keepers[order]
        return out

    def places(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Where the arrays hold each key; any place, or -1, for what was never indexed."""
        out, todo, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.levels.tolist()):
            if not len(todo):
                break
            at = place(hi[todo], lo[todo], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.ranks[at[hit] >> 6].astype(np.int64) + below
            todo, base = todo[~hit], base + size
        return out

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each key (255 at most; 0: not indexed), and the largest doc_id among them."""
        at = self.places(hi, lo)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == lo[known]
        counts, keepers = np.zeros(len(hi), np.int64), np.full(len(hi), NULL_ID, np.int64)
        counts[known], keepers[known] = self.counts[at[known]], self.keepers[at[known]]
        return counts, keepers

    def pack(self) -> tuple[bytes, ...]:
        return tuple(x.tobytes() for x in (self.levels, self.words, self.ranks, self.fingerprints, self.counts, self.keepers))

    @classmethod
    def unpack(cls, *packed: bytes) -> Index:
        kinds = (np.int64, np.uint64, np.uint32, np.uint64, np.uint8, np.int64)
        return cls(*[np.frombuffer(x, dtype=k) for x, k in zip(packed, kinds, strict=True)])


def raw_texts(texts: pa.Array) -> Iterator[bytes]:
    data, offsets = text_bytes(texts)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b].tobytes()


def held_keys(df: DataFrame, text: str, doc: str, least: int) -> DataFrame:
    """``hi``, ``lo`` and ``doc`` of each long key of each document, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for part in slices(batch, 4 << 20):
                found = [np.unique(long_keys(raw, least)[2], axis=0) for raw in raw_texts(part.column(0))]
                docs = part.column(1).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
                both = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), docs], ["hi", "lo", "doc"])

    return df.select(text, F.col(doc).cast("long").alias("doc")).mapInArrow(run, "hi long, lo long, doc long")


def frequent_keys(df: DataFrame, text: str = "text", doc: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Keys held by enough documents: ``hi``, ``lo``, ``n`` and the largest doc_id, ``keeper``."""
    counts = held_keys(df, text, doc, least_chars).groupBy("hi", "lo").agg(F.count("*").alias("n"), F.coalesce(F.max("doc"), F.lit(NULL_ID)).alias("keeper"))
    return counts.filter(F.col("n") >= least_docs)


def build_arrays(keys: DataFrame, bits: int) -> DataFrame:
    """A row of packed arrays for each shard; hashes are even, so shards are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("hi", "lo"))
        made = Index.build(hi, lo, pdf["n"].to_numpy(), pdf["keeper"].to_numpy().astype(np.int64))
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), *made.pack())], columns=[c.split()[0] for c in ARRAYS.split(", ")])

    shard = F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)
    return keys.withColumn("shard", shard).groupBy("shard").applyInPandas(run, ARRAYS)


def probe(shards: dict[int, Index], bits: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and keepers of hashes of any shard."""
    counts, keepers, of = np.zeros(len(keys), np.int64), np.full(len(keys), NULL_ID, np.int64), shard_of(keys[:, 0], bits)
    if not len(keys):
        return counts, keepers
    order = np.argsort(of, kind="stable")
    names, first = np.unique(of[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(order, first[1:]), strict=True):
        if name in shards:
            counts[rows], keepers[rows] = shards[name].find(keys[rows, 0], keys[rows, 1])
    return counts, keepers


def _without(part: pa.RecordBatch, dropped: Callable[[list[np.ndarray]], list[np.ndarray]], least: int) -> pa.RecordBatch:
    """``part(key, text, ...)`` without the lines that ``dropped`` names; it gets the hashes of each text and gives a mask for each."""
    split = [long_keys(raw, least) for raw in raw_texts(part.column(1))]
    n_lines, n_dropped, kept = [], [], []
    for (lines, at, _), mask in zip(split, dropped([s[2] for s in split]), strict=True):
        gone = {at[i] for i in np.flatnonzero(mask)}
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        kept.append(b"\n".join([line for i, line in enumerate(lines) if i not in gone] if gone else lines))
    columns = [part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["key", "n_lines", "n_dropped", "kept"])


def _mapped(df: DataFrame, key: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for part in slices(batch, 4 << 20):
                yield fn(part)

    kind = df.schema[key].dataType.simpleString()
    return df.mapInArrow(run, f"key {kind}, n_lines long, n_dropped long, kept string").withColumnRenamed("key", key)


def probed_here(df: DataFrame, key: str, text: str, arrays: DataFrame, bits: int, least_chars: int, least_docs: int) -> DataFrame:
    """Documents probe broadcast arrays as they are read."""
    rows = arrays.collect()
    sent = df.sparkSession.sparkContext.broadcast([tuple(map(bytes, r[1:])) for r in rows])
    names = [r[0] for r in rows]

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        shards = {name: Index.unpack(*packed) for name, packed in zip(names, sent.value, strict=True)}
        ids = part.column(2).fill_null(NULL_ID).to_numpy(zero_copy_only=False)

        def dropped(keys: list[np.ndarray]) -> list[np.ndarray]:
            counts, keepers = probe(shards, bits, np.concatenate(keys))
            sizes = [len(k) for k in keys]
            gone = (counts >= least_docs) & (keepers != np.repeat(ids, sizes))
            return np.split(gone, np.cumsum(sizes)[:-1])

        return _without(part, dropped, least_chars)

    return _mapped(df.select(key, text, F.col(key).cast("long").alias("_id")), key, fn)


def probed_by_shard(df: DataFrame, key: str, text: str, arrays: DataFrame, bits: int, n_shards: int, least_chars: int, least_docs: int) -> DataFrame:
    """Documents' hashes go to the shards, packed; the hashes that must go come back to the texts."""
    row = F.sha2(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), 256)
    named = df.select(key, text, F.col(key).cast("long").alias("_id"), row.alias("row"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for part in slices(batch, 4 << 20):
                out = []
                for name, i, raw in zip(part.column(0).to_pylist(), part.column(1).fill_null(NULL_ID).to_pylist(), raw_texts(part.column(2)), strict=True):
                    keys = np.unique(long_keys(raw, least_chars)[2], axis=0)
                    of = shard_of(keys[:, 0], bits)
                    out += [(name, i, int(s), keys[of == s].tobytes()) for s in np.unique(of)]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["row", "id", "shard", "keys"])

    asked = named.select("row", "_id", text).mapInArrow(ask, "row string, id long, shard int, keys binary")
    load = stored(asked.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("salts")))
    few = fits_broadcast(load, n_shards)
    probes = asked.join(few, "shard").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
    copies = arrays.join(few, "shard").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")

    def answer(asking: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple[str, bytes]] = []
        for shard in own.to_pylist():  # one, or none
            index = Index.unpack(*[shard[c.split()[0]] for c in ARRAYS.split(", ")[1:]])
            for name, i, packed in zip(*(asking.column(c).to_pylist() for c in ("row", "id", "keys")), strict=True):
                keys = np.frombuffer(packed, np.uint64).reshape(-1, 2)
                counts, keepers = index.find(keys[:, 0], keys[:, 1])
                if (gone := (counts >= least_docs) & (keepers != i)).any():
                    out.append((name, keys[gone].tobytes()))
        return pa.table([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], ["row", "dropped"])

    found = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(answer, "row string, dropped binary")
    verdicts = stored(found.distinct().groupBy("row").agg(F.collect_list("dropped").alias("dropped")))

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        gone = [np.frombuffer(b"".join(x or []), np.uint64).reshape(-1, 2) for x in part.column(2).to_pylist()]
        sets = [set(map(tuple, g.tolist())) for g in gone]
        return _without(part, lambda keys: [np.array([tuple(k) in s for k in ks.tolist()], bool) for ks, s in zip(keys, sets, strict=True)], least_chars)

    joined = salted_join(named.drop("_id"), verdicts, "row", how="left")
    return _mapped(joined.select(key, text, "dropped"), key, fn)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``key``, ``n_lines`` (before), ``n_dropped`` and the text that is ``kept``, for every row. ``least_docs`` is 255 at most, as counts are kept in a byte."""
    if not 1 <= least_docs <= 255:
        raise ValueError("least_docs must be 1 to 255")
    keys = stored(frequent_keys(df, text, key, least_chars, least_docs))
    n = keys.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / shard_keys)))
    arrays = stored(build_arrays(keys, bits))
    discard(keys)
    size = arrays.agg(F.sum(sum(F.octet_length(c.split()[0]) for c in ARRAYS.split(", ")[1:]))).first()[0] or 0
    if size <= broadcast_bytes:
        return probed_here(df, key, text, arrays, bits, least_chars, least_docs)
    return probed_by_shard(df, key, text, arrays, bits, 1 << bits, least_chars, least_docs)


def digests(df: DataFrame) -> DataFrame:
    """The result of the query: ``doc_id``, ``n_lines``, ``n_dropped``, ``kept_sha256``."""
    done = dedup_lines(df.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))

