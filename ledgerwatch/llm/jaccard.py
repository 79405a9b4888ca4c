"""Exact n-gram Jaccard join with set-relation skipping, and the groups that its links make.

Sets are the distinct word 5-shingles of whole texts (64-bit hashes). Two sets link when ``100 * |A & B| >= threshold * |A | B|``.

1. *Equal sets* collapse first: a 64-bit set id stands for all copies, so copies cost nothing later. One pass over the texts names the sets and counts all shingles.
2. *Index.* Under any one order of shingles, two sets that link share one within their first ``n - ceil(t n) + 1`` (the prefix). The order is: rare shingles
   first, frequent ones (in more than ``FREQUENT`` sets) last, each by hash. Every shingle of every document is counted. The frequent ones are named by a bit map of bounded size; a
   shingle put among them by accident only moves in the order, so results don't depend on the map. Where they are too many for the map, only those of more sets count as frequent. Entries (shingle, set, size,
   position) travel packed, a few rows for each task and bucket; frequent shingles are dealt by set, never to one task.
3. *Index-level skipping.* The entries of a list that have one size and one position are a block. Blocks are kept in order of size and position; a scan ends where sizes are too far apart, and
   compares blocks, not entries: if what is left behind both positions can't reach the overlap that a link needs, no pair of the two blocks is looked at. As rare shingles come first,
   a frequent one stands in reach only in sets that are made of frequent shingles nearly alone.
4. *Answer-level skipping.* In the list of a frequent shingle every set is compared with one pivot, the set with the smallest share of rare shingles. Sets that link to the pivot are in one group, and
   nothing more is asked about pairs among them. For the rest, the answers of the pivot bound theirs: ``|X & Z| <= |Z & P| + |X| - |X & P|``; only pairs across groups that pass are compared.
5. Candidates are verified on whole sets, and links become components by star rounds. A candidate is never dropped for want of room. Joins by shingle, pivot or set deal the rows of a frequent key
   over several tasks.

Null texts and texts without words have size 0 and link with nothing. Repeated rows, and rows that share a doc_id but not a text, are documents of their own: sets are told apart by their shingles alone, and a
group's name is the smallest doc_id among its rows. Ties between pivots fall to the smaller set id. A text of any length is hashed by pieces; its set (8 bytes a shingle) must fit a task. An empty
table gives an empty result. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, salted_join, slices, stored
from .components import components
from .text import mix, set_id, shingle_sets

THRESHOLD = 80
#: Sets that hold a shingle beyond which it counts as frequent, and frequent shingles that the map takes at most. A matter of cost only.
FREQUENT = 8
MOST_FREQUENT = 1 << 24
#: A list longer than this in a bucket takes the road of frequent shingles.
LONG_LIST = 64
#: Bits of the maps that are broadcast, at most (128 MB).
MAX_BITS = 1 << 30
ENTRIES_PER_BUCKET = 50_000
SHINGLES_PER_BUCKET = 100_000
#: Bytes of text for a word, about, to tell the number of shingles beforehand.
WORD_BYTES = 6
#: Shingles, or entries, that a task holds before it sends them on, and bytes of text that it hashes at a time.
FLUSH = 500_000
TEXT_BYTES = 2 << 20
ENTRY = np.dtype([("token", "<u8"), ("sid", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("rare", "<i4")])


def prefix_length(n, threshold: int = THRESHOLD):
    return n - (threshold * n + 99) // 100 + 1


def overlap_needed(both, threshold: int = THRESHOLD):
    """Least overlap of two sets whose sizes sum to ``both``."""
    return -(-threshold * both // (100 + threshold))


# -- small maps of bits ---------------------------------------------------------------------------


def bit_map(values: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """A map with the bit ``value mod bits`` set for each long in ``values(v)``; at most MAX_BITS bits, whatever the table's size."""
    bits = min(MAX_BITS, max(1 << 12, 1 << int(np.ceil(np.log2(64 * max(1, rows))))))
    at = F.expr(f"pmod(v, {bits}L)")
    words = values.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(v, {bits}L) % 64 as int))")).alias("x"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for table in words.toArrow().to_batches():
        out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out.view(np.uint64), bits


def hits(words: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(bits - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


# -- passes over texts ----------------------------------------------------------------------------


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches whose first column is the text, and the sets of their rows."""
    frugal()
    for batch in batches:
        for part in slices(batch, TEXT_BYTES):
            yield part, shingle_sets(part.column(0))


def text_key():
    """Tells texts apart that share a doc_id."""
    return F.xxhash64("text").alias("t")


class Once:
    """Which set ids a task has met, bounded; copies that it forgets only cost time."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, sid: int) -> bool:
        if sid in self.seen:
            return False
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen.add(sid)
        return True


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else [], len(bucket)).astype(int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield (int(bucket[a]), *[c[a:b].tobytes() for c in columns])


def short_key(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 further bits of a shingle: enough to count by, at half the bytes."""
    return ((tokens & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32), (tokens >> np.uint64(32)).astype(np.uint32)


def map_key(bucket: np.ndarray, short: np.ndarray) -> np.ndarray:
    return mix(bucket.astype(np.uint64) << np.uint64(32) | short.astype(np.uint64))


def sets_and_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Of every document a row with ``doc_id``, ``t``, ``n`` (set size) and ``sid`` (name of the set); and, in rows with a ``bucket``, packed short keys of all shingles with the number of sets in which a task met them (``keys``, ``counts``)."""

    def run(batches):
        held, size, once = [], 0, Once()
        nothing = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
        names = ["doc_id", "t", "n", "sid", "bucket", "keys", "counts"]

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket, short = short_key(tokens, buckets)
            rows = list(by_bucket(bucket, short, np.minimum(counts, 0xFFFF).astype(np.uint16)))
            own = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing(len(rows), key_type, pa.int64(), pa.int32(), pa.int64()), *own], names)

        key_type = pa.int64()
        for part, sets in sets_of(batches):
            key_type, sids = part.column(1).type, [set_id(x) for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([len(x) for x in sets], pa.int32()), pa.array(sids, pa.int64()), *nothing(len(sets), pa.int32(), pa.binary(), pa.binary())], names)
            for x, sid in zip(sets, sids, strict=True):
                if len(x) and once(sid):
                    held.append(x)
                    size += len(x)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("text", "doc_id", text_key()).mapInArrow(run, f"doc_id {kind}, t long, n int, sid long, bucket int, keys binary, counts binary"))


def frequent(counts: DataFrame) -> DataFrame:
    """``v``: map keys of the shingles that more than FREQUENT sets hold, or of more where these are over MOST_FREQUENT."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        frugal()
        short = np.frombuffer(b"".join(pdf["keys"]), dtype=np.uint32)
        n = np.frombuffer(b"".join(pdf["counts"]), dtype=np.uint16)
        kinds, at = np.unique(short, return_inverse=True)
        sums = np.bincount(at, weights=n).astype(np.int64)
        often = kinds[sums > FREQUENT]
        return pd.DataFrame({"v": map_key(np.full(len(often), key[0]), often).view(np.int64), "sets": sums[sums > FREQUENT]})

    found = stored(counts.groupBy("bucket").applyInPandas(run, "v long, sets long"))
    least = FREQUENT
    while found.filter(F.col("sets") > least).count() > MOST_FREQUENT:
        least *= 2
    return found.filter(F.col("sets") > least)


def index(docs: DataFrame, buckets: int, frequent_map, bits: int, key_buckets: int, threshold: int) -> DataFrame:
    """Packed index entries: buckets below ``buckets`` by shingle; above, those of frequent shingles by set."""

    def run(batches):
        held, size, once, words = [], 0, Once(), frequent_map.value

        def flush():
            entries = np.concatenate([e for e, _ in held])
            often = np.concatenate([o for _, o in held])
            light = (entries["token"] % np.uint64(buckets)).astype(np.int32)
            dealt = buckets + (mix(entries["sid"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            rows = list(by_bucket(np.where(often, dealt, light), entries))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])

        for _, sets in sets_of(batches):
            for x in sets:
                if not len(x) or not once(sid := set_id(x)):
                    continue
                often = hits(words, bits, map_key(*short_key(x, key_buckets)))
                rare = len(x) - int(often.sum())
                x, often = (np.concatenate([x[~often], x[often]]), np.sort(often)) if often.any() else (x, often)
                p = prefix_length(len(x), threshold)
                e = np.empty(p, dtype=ENTRY)
                e["token"], e["sid"], e["n"], e["pos"], e["rare"] = x[:p], sid, len(x), np.arange(p), rare
                held.append((e, often[:p]))
                size += p
            if size > FLUSH // 2:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, entries binary")


def entry_pairs(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of entries of blocks that start at ``a`` and ``b``; of a block with itself each pair once."""
    each = na * nb
    which, k = np.repeat(np.arange(len(a)), each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    i, j = a[which] + k // nb[which], b[which] + k % nb[which]
    return i[i < j], j[i < j]


#: ``b`` is null for an entry of a frequent shingle, else the row is a candidate pair.
FOUND = "token long, a long, na int, pos int, rare int, b long, nb int"


def scan_lists(entries: DataFrame, buckets: int, threshold: int) -> DataFrame:
    """Candidate pairs of the short lists, with sizes and positions in reach; entries of frequent shingles pass through."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        frugal()
        e = np.frombuffer(b"".join(pdf["entries"]), dtype=ENTRY)
        e = e[np.lexsort((e["sid"], e["pos"], e["n"], e["token"]))]
        e = e[np.append(True, e[1:] != e[:-1])]  # copies that several tasks met
        new = np.append(True, e["token"][1:] != e["token"][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(e)))
        passed = np.repeat(sizes > LONG_LIST, sizes) if key[0] < buckets else np.ones(len(e), dtype=bool)
        rest = e[passed]
        e = e[~passed & ~np.repeat(sizes == 1, sizes)]
        n, pos, token = e["n"].astype(np.int64), e["pos"].astype(np.int64), e["token"]
        # a block: the entries of one list that have one size and one position
        edge = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1]))) if len(e) else np.zeros(0, np.int64)
        n, pos, token, count = n[edge], pos[edge], token[edge], np.diff(np.append(edge, len(e)))
        at, step, pairs = np.arange(len(edge)), 0, []
        while len(at):  # one more block along every list still open
            at = at[at + step < len(edge)]
            at = at[token[at] == token[at + step]]
            at = at[100 * n[at] >= threshold * n[at + step]]  # sizes ascend: the rest of the list is skipped
            other = at + step
            reach = np.minimum(n[at] - pos[at], n[other] - pos[other])
            ok = reach >= overlap_needed(n[at] + n[other], threshold)  # else the block is skipped by its position
            i, j = entry_pairs(edge[at[ok]], count[at[ok]], edge[other[ok]], count[other[ok]])
            sid, size = e["sid"], e["n"].astype(np.int64)
            pairs.append(np.stack([sid[i], size[i], sid[j], size[j]], 1))
            step += 1
        found = np.concatenate([*pairs, np.zeros((0, 4), np.int64)])
        found = found[found[:, 0] != found[:, 2]]
        flip = found[:, 0] > found[:, 2]
        found[flip] = found[flip][:, [2, 3, 0, 1]]
        found = np.unique(found, axis=0)
        part = lambda x, kind: pd.array(x, dtype=kind)
        one = pd.DataFrame({"token": part([None] * len(found), "Int64"), "a": found[:, 0], "na": found[:, 1], "pos": part([None] * len(found), "Int32"), "rare": part([None] * len(found), "Int32"), "b": part(found[:, 2], "Int64"), "nb": part(found[:, 3], "Int32")})
        two = pd.DataFrame({"token": part(rest["token"].view(np.int64), "Int64"), "a": rest["sid"], "na": rest["n"], "pos": part(rest["pos"], "Int32"), "rare": part(rest["rare"], "Int32"), "b": part([None] * len(rest), "Int64"), "nb": part([None] * len(rest), "Int32")})
        return pd.concat([one, two]) if len(one) and len(two) else one if len(one) else two

    return entries.groupBy("bucket").applyInPandas(run, FOUND)


def sets_for(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``sid`` and packed ``hashes`` of the documents in ``ids(v)`` (hashes of doc_id and text), and of some others that share a bit with them."""
    words, bits = bit_map(ids, ids.count())
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        frugal()
        for batch in batches:
            keep = hits(shared.value, bits, batch.column(1).to_numpy().view(np.uint64))
            for part in slices(batch.filter(pa.array(keep)), TEXT_BYTES):
                sets = [x for x in shingle_sets(part.column(0)) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["sid", "hashes"])

    return docs.select("text", F.xxhash64("doc_id", text_key()).alias("h")).mapInArrow(run, "sid long, hashes binary")


def verified(docs: DataFrame, pairs: DataFrame, first: DataFrame) -> DataFrame:
    """``a``, ``b``, ``na``, ``nb`` and the exact ``overlap`` of every pair (stored). ``first``: ``sid`` and ``h``, the hash of one document that has the set."""
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = stored(wanted.join(first, "sid").select(F.col("h").alias("v")))
    some = stored(sets_for(docs, wanted))
    sets = some.groupBy("sid").agg(F.first("hashes").alias("hashes"))

    def run(batches):
        frugal()
        for batch in batches:
            for part in slices(batch, 4 << 20):
                rows = zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)
                both = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in rows]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(both, pa.int32())], ["a", "b", "na", "nb", "overlap"])

    # a pivot is in many pairs; the second side's frequent sets are counted on the pairs too
    joined = salted_join(pairs, sets.withColumnsRenamed({"sid": "a", "hashes": "x"}), "a")
    joined = salted_join(joined, sets.withColumnsRenamed({"sid": "b", "hashes": "y"}), "b", counts=pairs.groupBy("b").agg(F.count("*").alias("n")))
    out = stored(joined.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, na int, nb int, overlap int"))
    discard(wanted, some)
    return out


def linked(pairs: DataFrame, threshold: int) -> DataFrame:
    return pairs.filter(F.expr(f"{100 + threshold} * cast(overlap as long) >= {threshold} * (cast(na as long) + nb)")).select("a", "b")


def across_groups(entries: DataFrame, done: DataFrame, joined: DataFrame, threshold: int) -> DataFrame:
    """Pairs of frequent lists that lie in different groups and that the pivot's answers don't rule out: ``a``, ``na``, ``b``, ``nb``."""
    e = stored(entries.join(joined.select(F.col("node").alias("a"), F.col("component").alias("g")), "a", "left").withColumn("g", F.coalesce("g", "a")))
    pivots = e.groupBy("token").agg(F.min(F.struct("odd", "a", "na", "g")).alias("p"), F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("n")).filter("g0 <> g1")
    own = F.least("a", "p.a"), F.greatest("a", "p.a")
    e = salted_join(e, pivots.select("token", "p"), "token", counts=pivots.select("token", "n")).select("*", own[0].alias("lo"), own[1].alias("hi"))
    e = e.join(done.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "overlap"), ["lo", "hi"], "left")
    e = e.select("token", "a", "na", "pos", "g", F.when(F.col("a") == F.col("p.a"), F.col("na")).otherwise(F.col("overlap")).alias("shared"), (F.col("g") == F.col("p.g")).alias("central"))
    e = stored(e.withColumn("band", F.floor(F.log("na") / float(np.log(100 / threshold))).cast("int")))
    other = e.filter("not central").select("token", *[F.col(c).alias(f"z_{c}") for c in e.columns if c != "token"]).withColumn("band", F.explode(F.array(*[F.col("z_band") + k for k in (-1, 0, 1)])))
    pair = salted_join(e, other, "token", ("band",))
    need = f"{threshold}L * (na + z_na)"
    room = f"{100 + threshold}L"
    return pair.filter(
        f"""g <> z_g and (central or a < z_a)
        and 100L * least(na, z_na) >= {threshold}L * greatest(na, z_na)
        and {room} * least(na - pos, z_na - z_pos) >= {need}
        and (shared is null or z_shared is null or {room} * least(z_shared + na - shared, shared + z_na - z_shared) >= {need})"""
    ).select(
        F.least("a", "z_a").alias("a"), F.expr("if(a < z_a, na, z_na)").alias("na"), F.greatest("a", "z_a").alias("b"), F.expr("if(a < z_a, z_na, na)").alias("nb")
    ).distinct()


def grouped_sets(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (``doc_id``, ``t``, ``n``, ``sid``), the distinct sets that aren't empty (``sid``, ``rep``: smallest doc_id, ``copies``), and the sets that link (``node``, ``component``)."""
    bytes_ = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    key_buckets = max(64, bytes_ // WORD_BYTES // SHINGLES_PER_BUCKET)
    both = sets_and_counts(docs, key_buckets)
    table = stored(both.filter("bucket is null").select("doc_id", "t", "n", "sid"))
    first = stored(table.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min(F.xxhash64("doc_id", "t")).alias("h"), F.count("*").alias("copies")))
    total = table.agg(F.sum(F.expr(f"n - (n * {threshold}L + 99) div 100 + 1"))).first()[0] or 0
    buckets = max(64, total // ENTRIES_PER_BUCKET)
    often = frequent(both.filter("bucket is not null").select("bucket", "keys", "counts"))
    discard(both)
    words, bits = bit_map(often.select("v"), often.count())
    shared = docs.sparkSession.sparkContext.broadcast(words)
    found = stored(scan_lists(index(docs, buckets, shared, bits, key_buckets, threshold), buckets, threshold))
    entries = stored(found.filter("b is null").select("token", "a", "na", "pos", F.expr("rare * 1000L div na").alias("odd")))
    pivots = entries.groupBy("token").agg(F.min(F.struct("odd", "a", "na")).alias("p"), F.count("*").alias("n"))
    starred = (
        salted_join(entries, pivots.select("token", "p"), "token", counts=pivots.select("token", "n"))
        .filter(f"a <> p.a and 100L * least(na, p.na) >= {threshold}L * greatest(na, p.na)")
        .select(F.least("a", "p.a").alias("a"), F.expr("if(a < p.a, na, p.na)").alias("na"), F.greatest("a", "p.a").alias("b"), F.expr("if(a < p.a, p.na, na)").alias("nb"))
    )
    pairs = stored(found.filter("b is not null").select("a", "na", "b", "nb").unionByName(starred).distinct())
    discard(found)
    done = verified(docs, pairs, first)
    joined = stored(components(linked(done, threshold)))
    more = stored(across_groups(entries, done, joined, threshold).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if more.limit(1).count():
        fresh = linked(verified(docs, more, first), threshold)
        joined = stored(components(fresh.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    return table, first, joined


def groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document: the smallest doc_id that links reach, itself included."""
    table, first, joined = grouped_sets(docs, threshold)
    members = stored(joined.join(first, joined["node"] == first["sid"]).select("sid", "component", "rep"))
    least = members.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    named = salted_join(members.select("sid", "component"), least.drop("n"), "component", counts=least.drop("least")).select("sid", "least")
    label = first.join(named, "sid", "left").select("sid", F.coalesce("least", "rep").alias("component_id"))
    keyed = salted_join(table.withColumn("sid", F.when(F.col("n") > 0, F.col("sid"))), label, "sid", how="left", counts=first.select("sid", F.col("copies").alias("n")))
    return keyed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those of a group but one: that of the smallest doc_id (null last), and of rows with one doc_id that of the smallest text hash; rows with one doc_id and one text are
    one document, of which the row that is first as JSON stays. Rows without words stay, as do rows whose doc_id another text has.

    Texts stay where they are, but for few: a bounded bit map tells nearly all rows that surely stay, and a second one, of what the first takes for dropped by mistake, nearly all that surely go. Only rows
    that both maps name, and kept rows that repeat, are shuffled and decided exactly.
    """
    table, first, joined = grouped_sets(docs, threshold)
    component = salted_join(table.filter("n > 0"), joined.withColumnsRenamed({"node": "sid"}), "sid", how="left", counts=first.select("sid", F.col("copies").alias("n")))
    members = stored(component.select("doc_id", "t", F.coalesce("component", "sid").alias("g")))
    best = members.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    several = salted_join(members, best.drop("n"), "g", counts=best.drop("best")).groupBy("doc_id", "t").agg(F.count("*").alias("n"), F.max(F.expr("doc_id <=> best.doc_id and t = best.t")).alias("wins"))
    several = stored(several.filter("n > 1 or not wins").select(F.xxhash64("doc_id", "t").alias("h"), "wins"))
    context, gone = docs.sparkSession.sparkContext, several.filter("not wins").select("h")

    def named_by(values: DataFrame):
        words, bits = bit_map(values.select(F.col("h").alias("v")), values.count())
        shared = context.broadcast(words)

        @F.pandas_udf("boolean")
        def named(h: pd.Series) -> pd.Series:
            return pd.Series(hits(shared.value, bits, h.to_numpy().view(np.uint64)))

        return named

    suspect = named_by(several)
    rows = table.select(F.xxhash64("doc_id", "t").alias("h")).filter(suspect("h")).groupBy("h").agg(F.count("*").alias("n"))
    stay = stored(rows.join(gone, "h", "left_anti").join(several.filter("wins"), "h", "left").select("h", "n", F.coalesce("wins", F.lit(False)).alias("one")))
    doubtful = named_by(stay)

    # the row travels packed, so that no column's name can clash
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", text_key()).alias("h")).withColumns({"suspect": suspect("h"), "doubtful": doubtful("h")})
    decided = salted_join(marked.filter("suspect and doubtful").select("h", "row"), stay.select("h", "one"), "h", counts=stay.select("h", "n"))
    firsts = decided.filter("one").groupBy("h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return marked.filter("not suspect").select("row.*").unionByName(decided.filter("not one").select("row.*")).unionByName(firsts)
