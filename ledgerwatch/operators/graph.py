"""The transaction graph as tables: edges, degrees, communities, cycles, chains, risk."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def edges(tx: DataFrame) -> DataFrame:
    return tx.filter("name_orig <> name_dest").select("tx_id", F.col("name_orig").alias("src"), F.col("name_dest").alias("dst"), "amount", "event_ms", "type", "ip_segment", "device_id")


def recent_edges(e: DataFrame, most: int = 50, own: str = "src") -> DataFrame:
    """An account's newest out-edges only, or in-edges with ``own="dst"``. Spark cuts each partition to ``most`` an account before it shuffles."""
    order = Window.partitionBy(own).orderBy(F.col("event_ms").desc(), F.col("tx_id").desc())
    return e.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def shared_attributes(tx: DataFrame) -> DataFrame:
    """Addresses and devices with the number of accounts that use each: ``kind``, ``name``, ``accounts``, ``transactions``."""
    each = F.explode(F.array(F.struct(F.lit("ip").alias("kind"), F.col("ip_segment").alias("name")), F.struct(F.lit("device").alias("kind"), F.col("device_id").alias("name")))).alias("by")
    used = tx.select("name_orig", each).select("name_orig", "by.*").filter("name is not null").groupBy("kind", "name", "name_orig").agg(F.count("*").alias("n"))
    return used.groupBy("kind", "name").agg(F.count("*").alias("accounts"), F.sum("n").alias("transactions"))


def sides(e: DataFrame) -> DataFrame:
    """Each edge once for either end: ``account``, ``other``, ``is_out``."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("account"), F.col("dst").alias("other"), F.lit(True).alias("is_out")), F.struct(F.col("dst").alias("account"), F.col("src").alias("other"), F.lit(False).alias("is_out"))))
    return e.withColumn("end", ends).select("end.*", "amount", "event_ms")


def degrees(e: DataFrame) -> DataFrame:
    """Edge counts, amounts, distinct neighbours and directional measures of each account, in one aggregation."""
    count = lambda c: F.count(F.when(c, 1))
    out = F.col("is_out")
    d = sides(e).groupBy("account").agg(
        count(out).alias("out_degree"), count(~out).alias("in_degree"), F.coalesce(F.sum(F.when(out, F.col("amount"))), F.lit(0.0)).alias("out_amount"), F.coalesce(F.sum(F.when(~out, F.col("amount"))), F.lit(0.0)).alias("in_amount"),
        F.min("event_ms").alias("lo"), F.max("event_ms").alias("hi"),
    )
    return d.withColumns(
        {
            "asymmetry": F.expr("if(in_amount + out_amount <= 0, 0.0D, abs(in_amount - out_amount) / (in_amount + out_amount))"),
            "freq_ratio": F.expr("case when out_degree = 0 then 0.0D when in_degree = 0 then 1000000.0D else out_degree / in_degree end"),
            "net_flow": F.expr("if(in_amount <= 0 and out_amount <= 0, 0.0D, (out_amount - in_amount) / (in_amount + out_amount))"),
            "time_concentration": F.expr("case when out_degree + in_degree < 2 then 0.0D when hi <= lo then 1.0D else least(10.0D * (out_degree + in_degree) / ((hi - lo) / 1000.0D), 1.0D) end"),
        }
    )


def neighbors(e: DataFrame) -> DataFrame:
    return sides(e).groupBy("account").agg(F.count_distinct(F.when(F.col("is_out"), F.col("other"))).alias("out_neighbors"), F.count_distinct(F.when(~F.col("is_out"), F.col("other"))).alias("in_neighbors"))


def pairs(e: DataFrame) -> DataFrame:
    """Distinct links; everything that walks the graph starts from these."""
    return e.select("src", "dst").distinct()


def communities(tx: DataFrame) -> DataFrame:
    """Size of an account's community: itself, those that share an ip segment or a device, and the direct neighbours of all these.

    What a single account uses reaches nothing that its other segments and devices don't reach. The shared ones of an account form a set; the reach of each set is counted once, and accounts refer to their set, so the accounts
    behind one address are not multiplied by what the address reaches.
    """
    shared = F.explode(F.array(F.concat(F.lit("ip:"), "ip_segment"), F.concat(F.lit("device:"), "device_id")))
    belongs = tx.select(F.col("name_orig").alias("account"), shared.alias("by")).filter("by is not null").distinct()
    common = belongs.groupBy("by").agg(F.count("*").alias("n")).filter("n >= 2").select("by")
    belongs = stored(belongs.groupBy("account").agg(F.collect_set("by").alias("bys")).select("account", F.explode("bys").alias("by")).join(common.withColumn("common", F.lit(True)), "by", "left"))
    sets = stored(belongs.groupBy("account").agg(F.array_sort(F.collect_list(F.when(F.col("common"), F.col("by")))).alias("bys")))
    p = pairs(edges(tx))
    touching = p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = stored(belongs.filter("common").join(touching, F.col("account") == F.col("src")).select("by", F.col("dst").alias("member")).unionByName(belongs.filter("common").select("by", F.col("account").alias("member"))).distinct())
    each = sets.filter("size(bys) > 0").select("bys").distinct().withColumn("by", F.explode("bys"))
    counted = each.join(near, "by").groupBy("bys").agg(F.count_distinct("member").alias("community"))
    alone = sets.filter("size(bys) = 0").join(touching, F.col("account") == F.col("src"), "left").groupBy("account").agg((F.count_distinct("dst") + 1).alias("community"))
    return sets.join(counted, "bys").select("account", "community").unionByName(alone)


def cycles(e: DataFrame, longest: int = 3) -> DataFrame:
    """Simple cycles of 2 to ``longest`` edges through each account, counted by length. Walks never revisit a node, and each step joins distinct links, of these only such as can lie on a cycle."""
    p = stored(looping(pairs(e)))
    step = lambda k: p.select(F.col("src").alias("at"), F.col("dst").alias(f"n{k}"))
    walk, found = p.select(F.col("src").alias("account"), F.col("dst").alias("n1")), None
    for k in range(2, longest + 1):
        ahead = walk.join(step(k), F.col(f"n{k - 1}") == F.col("at")).drop("at")
        closed = ahead.filter(F.col(f"n{k}") == F.col("account")).groupBy("account").agg(F.count("*").alias("cycles")).withColumn("length", F.lit(k))
        found = closed if found is None else found.unionByName(closed)
        seen = [F.col("account"), *[F.col(f"n{i}") for i in range(1, k)]]
        new = F.lit(True)
        for s in seen:
            new = new & (F.col(f"n{k}") != s)
        walk = ahead.filter(new)
    return found.select("account", F.col("length").cast("long").alias("length"), "cycles")


def looping(p: DataFrame) -> DataFrame:
    """Links between accounts that both send and receive: no other link is on a cycle."""
    ends = p.select(F.col("src").alias("account")).intersect(p.select(F.col("dst").alias("account")))
    return p.join(ends.withColumnRenamed("account", "src"), "src", "left_semi").join(ends.withColumnRenamed("account", "dst"), "dst", "left_semi").select("src", "dst")


def shortest_rings(e: DataFrame, longest: int = 6) -> DataFrame:
    """Edges of the shortest ring through each account, 2 to ``longest``.

    Walks meet in the middle: where an account leads to in half the edges, and what leads to it in the other half. Only accounts without a ring so far are walked from, distinct ends only, and each step is a table, so every
    step is made once; when all have come round, or none can, the rest isn't made.
    """
    p = stored(looping(pairs(e)))
    ahead, behind, found = p.select(F.col("src").alias("account"), F.col("dst").alias("at")), p.select(F.col("dst").alias("account"), F.col("src").alias("at")), None
    for k in range(2, longest + 1):
        if k > 2:
            left = found.select("account")
            ahead, behind = ahead.join(left, "account", "left_anti"), behind.join(left, "account", "left_anti")
            if k % 2:
                ahead = stored(ahead.join(p, F.col("at") == F.col("src")).select("account", F.col("dst").alias("at")).distinct())
            else:
                behind = stored(behind.join(p, F.col("at") == F.col("dst")).select("account", F.col("src").alias("at")).distinct())
            if (ahead if k % 2 else behind).isEmpty():
                break
        closed = ahead.join(behind, ["account", "at"], "left_semi").select("account").distinct().withColumn("length", F.lit(k).cast("long"))
        found = stored(closed if found is None else found.unionByName(closed))
    return found


def cycle_counts(e: DataFrame) -> DataFrame:
    """Simple cycles of 2 to 6 edges through each account, counted by length: ``account``, ``length``, ``cycles``. No cycle is ever listed.

    A cycle of r falls into a walk from r to some m and one from m back to r, of 3 edges at most and with other accounts between them. Walks are counted, by their ends and by each account between; pairs of walks that meet
    between the ends are taken out by inclusion and exclusion: less the pairs that share an account, plus those that share two. The last is a count of triangles over one link, or of paths of mutual links.
    """
    p = pairs(e)
    links = looping(p)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("mutual"))
    links = stored(links.join(back, ["src", "dst"], "left").fillna(0, subset=["mutual"]))
    link = lambda a, b, *more: links.select(F.col("src").alias(a), F.col("dst").alias(b), *more)
    # walks of two edges, r to v to m
    two = stored(link("r", "v").join(link("v", "m"), "v").filter("r <> m").groupBy("r", "m").agg(F.count("*").alias("two")))
    # walks of three edges, by the account v on first and on second place; less those that come through an end
    first = link("r", "v", "mutual").join(two.withColumnRenamed("r", "v"), "v").filter("r <> m").select("r", "m", "v", "two", "mutual", F.lit(1).alias("first"))
    second = link("v", "m", "mutual").join(two.withColumnRenamed("m", "v"), "v").filter("r <> m").select("r", "m", "v", "two", "mutual", F.lit(0).alias("first"))
    walks = first.unionByName(second).join(link("r", "m", F.lit(1).alias("direct")), ["r", "m"], "left").withColumn("n", F.expr("two - mutual * coalesce(direct, 0)"))
    by = stored(walks.groupBy("r", "m", "v").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("first")).alias("starts")).filter("n > 0"))
    three = stored(by.groupBy("r", "m").agg(F.sum("starts").alias("three")))
    turned = lambda t, name: t.select(F.col("r").alias("m"), F.col("m").alias("r"), *[F.col(c).alias(name if c in ("two", "three", "n") else c) for c in t.columns if c not in ("r", "m", "starts")])
    row = lambda t, length, n: t.groupBy(F.col("r").alias("account")).agg(F.sum(n).alias("cycles")).withColumn("length", F.lit(length))
    mutual = link("r", "v", "mutual").filter("mutual = 1").drop("mutual")
    degree = mutual.groupBy("r").agg(F.count("*").alias("d"))
    out = row(mutual, 2, F.lit(1))
    out = out.unionByName(row(two.join(link("m", "r"), ["m", "r"]), 3, F.col("two")))
    out = out.unionByName(row(two.join(turned(two, "other"), ["r", "m"]), 4, F.expr("two * other")))
    out = out.unionByName(row(mutual.join(degree.withColumnRenamed("r", "v"), "v"), 4, F.expr("1 - d")))
    out = out.unionByName(row(three.join(turned(two, "other"), ["r", "m"]), 5, F.expr("three * other")))
    out = out.unionByName(row(by.join(link("m", "v"), ["m", "v"]).join(link("v", "r"), ["v", "r"]), 5, -F.col("n")))
    out = out.unionByName(row(three.join(turned(three, "other"), ["r", "m"]), 6, F.expr("three * other")))
    out = out.unionByName(row(by.join(turned(by, "other"), ["r", "m", "v"]), 6, F.expr("-n * other")))
    # pairs of walks over one link u to v both ways round: the other corners of the link's triangles
    corners = link("u", "v").join(link("v", "r"), "v").join(link("r", "u"), ["r", "u"])
    per = corners.groupBy("u", "v").agg(F.count("*").alias("t"))
    out = out.unionByName(row(corners.join(per, ["u", "v"]), 6, F.expr("t - 1")))
    # and over mutual links, r to u to v to m
    inner = mutual.withColumnRenamed("v", "u").join(mutual.withColumnRenamed("r", "u"), "u").filter("r <> v").join(degree.withColumnRenamed("r", "v"), "v")
    out = out.unionByName(row(inner.join(mutual.withColumn("closes", F.lit(1)), ["r", "v"], "left"), 6, F.expr("d - 1 - coalesce(closes, 0)")))
    return out.groupBy("account", "length").agg(F.sum("cycles").alias("cycles")).filter("cycles > 0").select("account", F.col("length").cast("long").alias("length"), "cycles")


def chain_steps(e: DataFrame, deepest: int = 10) -> DataFrame:
    """``account``, ``depth``, ``leave_ms``, ``tx_id``, ``next``: the latest transaction with which a chain of ``depth`` transactions, each later than the one before, can leave an account, and where it leads.

    Whether a transaction starts a chain of k follows from when one of k - 1 can leave its receiver at the latest, so each depth is one join of the edges with a row an account: edges times depth in all, whatever the degrees.
    """
    rows = stored(e.select("src", "dst", "event_ms", "tx_id"))
    latest = F.max(F.struct("event_ms", (-F.col("tx_id")).alias("minus"), "dst")).alias("s")
    step = lambda t, k: t.groupBy(F.col("src").alias("account")).agg(latest).select("account", F.lit(k).cast("long").alias("depth"), F.col("s.event_ms").alias("leave_ms"), (-F.col("s.minus")).alias("tx_id"), F.col("s.dst").alias("next"))
    now = stored(step(rows, 1))
    out = now
    for k in range(2, deepest + 1):
        then = now.select(F.col("account").alias("dst"), "leave_ms")
        now = stored(step(rows.join(then, "dst").filter("event_ms < leave_ms"), k))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def chain_depth(e: DataFrame, deepest: int = 10) -> DataFrame:
    """Transactions of the longest chain in order of time that starts at an account, up to ``deepest``. A chain may pass an account again."""
    return chain_steps(e, deepest).groupBy("account").agg(F.max("depth").alias("depth"))


def chain_paths(e: DataFrame, deepest: int = 10) -> DataFrame:
    """The longest chain of each account, read out by its steps: ``account``, ``depth``, ``path`` (accounts) and ``ids`` (transactions)."""
    steps = stored(chain_steps(e, deepest))
    most = F.max("depth").over(Window.partitionBy("account"))
    walk = steps.withColumn("most", most).filter("depth = most").select("account", "depth", F.array("account", "next").alias("path"), F.array("tx_id").alias("ids"), (F.col("depth") - 1).alias("left"))
    done = []
    for _ in range(1, deepest):
        done.append(walk.filter("left = 0"))
        on = steps.select(F.col("account").alias("at"), F.col("depth").alias("left"), F.col("next").alias("then"), F.col("tx_id").alias("id"))
        walk = walk.withColumn("at", F.element_at("path", -1)).join(on, ["at", "left"]).select("account", "depth", F.concat("path", F.array("then")).alias("path"), F.concat("ids", F.array("id")).alias("ids"), (F.col("left") - 1).alias("left"))
    for d in done:
        walk = walk.unionByName(d)
    return walk.drop("left")


def triangles(e: DataFrame) -> DataFrame:
    """``account``, ``degree`` and ``triangles`` of the undirected graph of distinct links.

    Links point from the end of lower degree to the other (ties by name), wedges are made at their lower end only, so each triangle is found once and a hub's list is never crossed with itself: no account has more than the
    square root of twice the links ahead of it.
    """
    p = pairs(e)
    u = p.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = u.select(F.explode(F.array("a", "b")).alias("account")).groupBy("account").agg(F.count("*").alias("degree"))
    d = lambda c: degree.select(F.col("account").alias(c), F.col("degree").alias(f"d{c}"))
    turn = F.expr("da > db or (da = db and a > b)")
    up = stored(u.join(d("a"), "a").join(d("b"), "b").select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("low"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("high"), F.greatest("da", "db").alias("dh")))
    one, other = up.select("low", F.col("high").alias("x"), F.col("dh").alias("dx")), up.select("low", F.col("high").alias("y"), F.col("dh").alias("dy"))
    wedges = one.join(other, "low").filter("dx < dy or (dx = dy and x < y)")
    closed = wedges.join(up.select(F.col("low").alias("x"), F.col("high").alias("y")), ["x", "y"])
    counts = closed.select(F.explode(F.array("low", "x", "y")).alias("account")).groupBy("account").agg(F.count("*").alias("triangles"))
    return degree.join(counts, "account", "left").fillna(0, subset=["triangles"])


def clustering(e: DataFrame) -> DataFrame:
    """Share of an account's pairs of neighbours that are linked themselves."""
    return triangles(e).withColumn("clustering", F.expr("if(degree < 2, 0.0D, 2.0D * triangles / (degree * (degree - 1)))"))


def fund_chains(e: DataFrame, deepest: int = 3) -> DataFrame:
    """Fund chains from every account over distinct links, no account twice: ``account``, ``path``, ``edges``, ``ending`` and ``back``.

    A chain is recorded where it has ``deepest`` edges (``depth``), where no link leads on (``leaf``), and once for each link that would lead back to an account on it (``revisit``, with that account in ``back``).
    The number of chains grows with the power ``deepest`` of the degrees.
    """
    p = pairs(e).select(F.col("src").alias("at"), F.col("dst").alias("next"))
    row = lambda w, ending, back: w.select("account", "path", (F.size("path") - 1).cast("long").alias("edges"), ending.alias("ending"), back.alias("back"))
    walk, found = p.select(F.col("at").alias("account"), F.array("at", "next").alias("path")), []
    for _ in range(1, deepest):
        ahead = walk.join(p, F.element_at("path", -1) == F.col("at"), "left")
        again = F.coalesce(F.array_contains("path", F.col("next")), F.lit(True))
        found.append(row(ahead.filter(again), F.when(F.col("next").isNull(), "leaf").otherwise("revisit"), F.coalesce("next", F.lit(""))))
        walk = ahead.filter(~again).select("account", F.concat("path", F.array("next")).alias("path"))
    out = row(walk, F.lit("depth"), F.lit(""))
    for f in found:
        out = out.unionByName(f)
    return out


def path_texts(e: DataFrame, rings: DataFrame, most: int = 50, shown: int = 3) -> DataFrame:
    """Each account's links as a text: its out-edges, then its in-edges (of the newest ``most`` the oldest first; of more than ``shown`` the first alone), then a mark if it is in ``rings(account)``. Ids are cut to eight letters."""
    text = F.concat(F.substring("src", 1, 8), F.lit("→"), F.substring("dst", 1, 8), F.lit("("), F.round("amount").cast("long").cast("string"), F.lit(")"))

    def side(own: str, name: str) -> DataFrame:
        order = Window.partitionBy(own).orderBy(F.col("event_ms").desc(), F.col("tx_id").desc())
        kept = e.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        lists = kept.groupBy(F.col(own).alias("account")).agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("k"), text.alias("text")))).alias("l"))
        return lists.select("account", F.when(F.size("l") > shown, F.concat(F.col("l")[0]["text"], F.lit("..."))).otherwise(F.array_join("l.text", "")).alias(name))

    both = side("src", "outs").join(side("dst", "ins"), "account", "full").join(rings.select("account", F.lit("CYCLE detected").alias("ring")), "account", "left")
    return both.select("account", F.concat_ws(" | ", F.concat_ws(" ", "outs", "ins"), "ring").alias("path"))


#: Accounts to a block of bits, seeds to a round, and neighbours from which an account's are held as bits: a task of ``second_hops`` holds a block, whatever the size of the graph.
BLOCK, SEEDS, DENSE = 16_384, 512, 64
#: Links to a row of packed links, seeds whose accounts a group of ``second_hops`` names, pairs that a task lists, more or less, and accounts whose names are broadcast at most.
PIECE, NAMED, TASK_PAIRS, BROADCAST = 65_536, 256, 2**25, 2**20


def numbered(touching: DataFrame) -> DataFrame:
    """Every account of ``touching(src, dst)`` as ``account``, ``block`` and ``place`` in its block. Blocks are by hash, so none is counted by a single task."""
    accounts = stored(touching.select(F.col("src").alias("account")).distinct())
    blocks = accounts.count() // BLOCK + 1
    return stored(accounts.withColumn("block", F.expr(f"cast(pmod(xxhash64(account), {blocks}) as int)")).withColumn("place", (F.row_number().over(Window.partitionBy("block").orderBy("account")) - 1).cast("int")))


def _reached(links: np.ndarray, heads: np.ndarray, own: int, there: int, together: int, many_from: int):
    """Seeds, and bits of the accounts of block ``there`` that lead from them in two hops and in no fewer, ``together`` seeds at a time.

    ``links(seed, middle)`` are those of the seeds of block ``own``, ``heads(middle, place)`` those of all accounts into block ``there``; a middle is its block and place in one number.
    Middles with ``many_from`` neighbours are rows of bits, the rest are short lists. A seed takes its rows one by one, until all bits that any row has are set.
    """
    links, heads = links[np.lexsort((links[:, 1], links[:, 0]))], heads[np.lexsort((heads[:, 1], heads[:, 0]))]
    wide = int(heads[:, 1].max()) + 1
    middle, first, degree = np.unique(heads[:, 0], return_index=True, return_counts=True)
    dense = np.flatnonzero(degree >= many_from)
    row = np.full(len(middle), -1)
    row[dense] = np.arange(len(dense))
    at = np.searchsorted(middle, links[:, 1]).clip(max=len(middle) - 1)
    led = middle[at] == links[:, 1]
    packed = np.zeros((len(dense), (wide + 7) // 8), dtype=np.uint8)
    for k, m in enumerate(dense):
        bits = np.zeros(wide, dtype=bool)
        bits[heads[first[m] : first[m] + degree[m], 1]] = True
        packed[k] = np.packbits(bits)
    full = np.bitwise_or.reduce(packed, axis=0) if len(dense) else None
    seeds, begin = np.unique(links[:, 0], return_index=True)
    end = np.append(begin[1:], len(links))
    for low in range(0, len(seeds), together):
        some = seeds[low : low + together]
        seen = np.zeros((len(some), wide), dtype=bool)
        for i in range(len(some)):
            part = slice(begin[low + i], end[low + i])
            met = at[part][led[part]]
            many = row[met]
            if full is not None:
                bits = np.zeros(packed.shape[1], dtype=np.uint8)
                for n, k in enumerate(many[many >= 0]):
                    bits |= packed[k]
                    if n % 8 == 7 and (bits == full).all():
                        break
                seen[i] = np.unpackbits(bits, count=wide).view(bool)
            few = met[many < 0]
            for k in range(0, len(few), 65_536):
                f = few[k : k + 65_536]
                count = degree[f]
                seen[i, heads[np.repeat(first[f] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum()), 1]] = True
            direct = links[part, 1]
            direct = direct[direct >> 32 == there] & 0xFFFFFFFF
            seen[i, direct[direct < wide]] = False
            if own == there and some[i] < wide:
                seen[i, some[i]] = False
        yield some, seen


def _packed(rows: DataFrame) -> DataFrame:
    """Links as ``own``, ``there`` (blocks) and ``links``: numbers of both places in order, as differences, at most ``PIECE`` to a row. What goes to many tasks goes as these."""
    piece = PIECE

    def pack(key: tuple, links: pa.Table) -> pa.Table:
        numbers = np.sort(links["src_place"].to_numpy().astype(np.int64) << 32 | links["dst_place"].to_numpy())
        parts = [np.diff(numbers[k : k + piece], prepend=0).tobytes() for k in range(0, len(numbers), piece)]
        return pa.table({"own": pa.array([key[0].as_py()] * len(parts), pa.int32()), "there": pa.array([key[1].as_py()] * len(parts), pa.int32()), "links": pa.array(parts, pa.binary())})

    return rows.select(F.col("src_block").alias("own"), F.col("dst_block").alias("there"), "src_place", "dst_place").groupBy("own", "there").applyInArrow(pack, "own int, there int, links binary")


def _unpacked(rows: pa.Table, column: str, middle_first: bool) -> np.ndarray:
    """Pairs of numbers from packed rows in ``column`` with the block of the middles in ``middle``; a middle is its block and place in one number."""
    parts = [np.empty((0, 2), np.int64)]
    for block, links in zip(rows["middle"].to_pylist(), rows[column], strict=True):
        numbers = np.cumsum(np.frombuffer(links.as_buffer(), np.int64))
        both = np.column_stack([numbers >> 32, numbers & 0xFFFFFFFF])
        both[:, 0 if middle_first else 1] += block << 32
        parts.append(both)
    return np.concatenate(parts)


def second_hops(touching: DataFrame, seeds: DataFrame, names: DataFrame, counted: bool) -> DataFrame:
    """Accounts two undirected hops from each of ``seeds(seed)`` and no nearer, as rows of ``seed`` and a list of some of its ``accounts``; with ``counted`` their number ``n`` by ``block``, ``place`` and ``to``.

    Walks over a hub are never listed: for each pair of blocks one task takes the seeds' links and all links into the other block, and joins them as bits. A packed link is sent once for each block at its other end. Bits are sent
    once more, to where the names of some seeds and of a block are; names are never joined to pairs.
    """
    place = lambda side: names.select(F.col("account").alias(side), F.col("block").alias(f"{side}_block"), F.col("place").alias(f"{side}_place"))
    known = stored(touching.join(place("src"), "src").join(place("dst"), "dst").select("src", "src_block", "src_place", "dst_block", "dst_place"))
    last = names.agg(F.max("block")).first()[0] or 0
    blocks = F.sequence(F.lit(0), F.lit(last))
    whole = stored(_packed(known))
    mine = stored(names.join(seeds.select(F.col("seed").alias("account")), "account", "left_semi"))
    pairs_in_all = mine.count() * names.count()
    of_seeds = whole if pairs_in_all == names.count() ** 2 else stored(_packed(known.join(mine.select(F.col("account").alias("src")), "src", "left_semi")))
    out = of_seeds.select(F.col("own").alias("block"), F.explode(blocks).alias("to"), F.col("there").alias("middle"), "links")
    into = whole.select(F.explode(blocks).alias("block"), F.col("there").alias("to"), F.col("own").alias("middle"), F.col("links").alias("heads"))  # a name of its own: both sides may read one table

    together, many_from, slice_ = SEEDS, DENSE, NAMED
    fields = [("block", pa.int32()), ("place", pa.int32()), ("to", pa.int32()), ("n", pa.int64())] if counted else [("block", pa.int32()), ("slice", pa.int32()), ("to", pa.int32()), ("rank", pa.int32()), ("bits", pa.binary())]

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own, there = (k.as_py() for k in key)
        schema, parts, rank = pa.schema(fields), [], 0
        if left.num_rows and right.num_rows:
            for some, seen in _reached(_unpacked(left, "links", False), _unpacked(right, "heads", True), own, there, together, many_from):
                n = len(some)
                if counted:
                    row = [np.full(n, own, np.int32), some.astype(np.int32), np.full(n, there, np.int32), seen.sum(axis=1)]
                else:
                    ranks = np.arange(rank, rank + n, dtype=np.int32)
                    row = [np.full(n, own, np.int32), ranks // slice_, np.full(n, there, np.int32), ranks % slice_, pa.array([r.tobytes() for r in np.packbits(seen, axis=1)], pa.binary())]
                parts.append(pa.table(row, schema=schema))
                rank += n
        return pa.concat_tables(parts) if parts else schema.empty_table()

    def listed(key: tuple, rows: pa.Table, called: pa.Table) -> pa.Table:
        schema, parts = pa.schema([("seed", pa.string()), ("accounts", pa.list_(pa.string()))]), []
        if rows.num_rows:
            own, there = (called[c].combine_chunks().flatten() for c in ("own_names", "names"))
            for low in range(0, rows.num_rows, 16):  # a batch for Spark
                some = rows.slice(low, 16)
                places = [np.flatnonzero(np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8))) for v in some["bits"]]
                ends = np.cumsum([0, *map(len, places)]).astype(np.int32)
                accounts = pa.ListArray.from_arrays(pa.array(ends), there.take(pa.array(np.concatenate(places))))
                parts.append(pa.table([own.take(some["rank"].combine_chunks()), accounts], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    dealt = lambda t, tasks, *by: t.repartition(tasks, *by).groupBy(*by)
    pairs_of = 4 * (last + 1) ** 2
    rows = dealt(out, pairs_of, "block", "to").cogroup(dealt(into, pairs_of, "block", "to")).applyInArrow(join, ", ".join(f"`{c}` {kinds[t]}" for c, t in fields))
    if counted:
        return rows
    # seeds of a block are ranked by their place, as the task that joins bits meets them
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1)
    in_order = lambda by, name: F.array_sort(F.collect_list(F.struct(by, "account")))["account"].alias(name)
    key, tasks = ["block", "slice", "to"], pairs_in_all // TASK_PAIRS + 2
    slices = ranked.groupBy("block", F.expr(f"cast(rank div {slice_} as int)").alias("slice")).agg(in_order("rank", "own_names")).withColumn("to", F.explode(blocks)).repartition(tasks, *key)
    per = stored(names.groupBy(F.col("block").alias("to")).agg(in_order("place", "names")))
    # names of a block are long rows: broadcast while accounts are few, so that they aren't dealt once for each slice
    called = slices.join(F.broadcast(per), "to") if names.count() <= BROADCAST else slices.join(per, "to").repartition(tasks, *key)
    return dealt(rows, tasks, *key).cogroup(called.groupBy(*key)).applyInArrow(listed, "seed string, accounts array<string>")


def both_ways(e: DataFrame) -> DataFrame:
    p = pairs(e)
    return stored(p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


def hops(e: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """Accounts within ``k`` undirected hops of each seed, with the least number of hops. Two hops are made in blocks (``second_hops``), further ones by joining the last with the links."""
    p, seeds = both_ways(e), stored(seeds.select("seed").distinct())
    row = lambda d, i: d.select("seed", "account", F.lit(i).cast("long").alias("hops"))
    reached = row(seeds.withColumn("account", F.col("seed")), 0)
    if k >= 1:
        reached = reached.unionByName(row(p.join(seeds, p["src"] == seeds["seed"]).withColumn("account", F.col("dst")), 1))
    if k < 2:
        return reached
    names = numbered(p)
    two = second_hops(p, seeds, names, False).select("seed", F.explode("accounts").alias("account"))
    reached, front = reached.unionByName(row(two, 2)), two
    if k == 2:
        return reached
    for i in range(3, k + 1):
        front = front.join(p, front["account"] == p["src"]).select("seed", F.col("dst").alias("account")).distinct()
        reached = reached.unionByName(row(front, i))
    return reached.groupBy("seed", "account").agg(F.min("hops").alias("hops"))


def hop_counts(e: DataFrame, k: int = 2) -> DataFrame:
    """How many accounts each account reaches in 1 to ``k`` undirected hops at least: ``seed``, ``hops``, ``accounts``. Up to two hops pairs are counted where they are found and never listed; ``hops`` gives those of chosen seeds."""
    if k != 2:
        return hops(e, sides(e).select(F.col("account").alias("seed")).distinct(), k).groupBy("seed", "hops").agg(F.count("*").alias("accounts"))
    p = both_ways(e)
    names = numbered(p)
    row = lambda d, i: d.select("seed", F.lit(i).cast("long").alias("hops"), "accounts")
    seeds = names.select(F.col("account").alias("seed"))
    one = p.groupBy(F.col("src").alias("seed")).agg(F.count("*").alias("accounts"))
    two = second_hops(p, seeds, names, True).groupBy("block", "place").agg(F.sum("n").alias("accounts")).filter("accounts > 0")
    return row(seeds.withColumn("accounts", F.lit(1).cast("long")), 0).unionByName(row(one, 1)).unionByName(row(two.join(names.withColumnRenamed("account", "seed"), ["block", "place"]), 2))


def scatter(e: DataFrame) -> DataFrame:
    """Accounts with at least two edges to, or from, at least two others."""
    s = sides(e).groupBy("account", "is_out").agg(F.count("*").alias("n"), F.count_distinct("other").alias("others"), F.sum("amount").alias("amount"))
    return s.filter("n >= 2 and others >= 2").select("account", F.when(F.col("is_out"), "out").otherwise("in").alias("direction"), "n", "others", "amount")


#: Points of the graph risk.
RISK = [
    ("out_degree >= 3", 0.15), ("out_degree >= 5", 0.10), ("in_degree >= 3", 0.15), ("in_degree >= 5", 0.10), ("out_amount > 100000", 0.15), ("in_amount > 100000", 0.10),
    ("in_amount > 0 and out_amount > 0 and out_amount > 0.9 * in_amount and out_amount < 1.1 * in_amount", 0.10), ("has_cycle", 0.20), ("community >= 3", 0.10), ("community >= 5", 0.10),
]

#: The first condition that holds names the fraud.
GRAPH_TYPES = [
    ("has_cycle and out_degree >= 1", "图分析-洗钱环路"),
    ("chain_node and depth >= 2 and cash_heavy", "图分析-链式洗钱网络"),
    ("chain_node and depth >= 2", "图分析-链式中转节点"),
    ("fan_in and cash_heavy", "图分析-分散转入集中提现"),
    ("fan_in", "图分析-资金汇聚节点"),
    ("community >= 3 and fan_out", "图分析-团伙协作网络"),
    ("fan_out", "图分析-多目标分散转出"),
    ("asymmetry > 0.5 and cash_heavy and out_degree >= 1", "图分析-账户被盗资金转移"),
    ("net_flow > 0.4 and cash_heavy", "图分析-异常资金流出"),
    ("chain_node", "图分析-链式中转节点"),
    ("true", "图分析-异常交易网络"),
]


def accounts(tx: DataFrame, longest: int = 6, deepest: int = 10) -> DataFrame:
    """Degrees, community, cycle flag and chain depth of every account."""
    e = edges(tx)
    looped = shortest_rings(e, longest).select("account", F.lit(True).alias("has_cycle"))
    joined = degrees(e).join(communities(tx), "account", "left").join(looped, "account", "left").join(chain_depth(e, deepest), "account", "left")
    return joined.fillna({"community": 1, "has_cycle": False, "depth": 0})


def risk(a: DataFrame) -> DataFrame:
    from ..functions.scores import points

    return a.withColumn("risk", F.expr(points(RISK)))


def alerts(a: DataFrame) -> DataFrame:
    from ..functions.scores import first_of

    a = a.withColumn("cash_ratio", F.expr("if(in_amount > 0, out_amount / in_amount, 0.0D)")).withColumns(
        {
            "cash_heavy": F.expr("out_amount > 5000 and cash_ratio > 0.7"),
            "chain_node": F.expr("out_degree >= 1 and in_degree >= 1"),
            "fan_out": F.expr("out_degree >= 3 and out_amount >= 15000"),
            "fan_in": F.expr("in_degree >= 2 and in_amount >= 10000"),
        }
    )
    score = F.expr(
        """if(chain_node, 25.0D + if(depth >= 2, 10.0D, 0.0D), 0.0D) + if(has_cycle and out_degree >= 1, 30.0D, 0.0D) + if(fan_out, 20.0D, 0.0D) + if(fan_in, 20.0D, 0.0D) + if(cash_heavy, 20.0D, 0.0D)
        + if(asymmetry > 0.5 and out_amount > in_amount and out_amount > 3000, 15.0D * asymmetry, 0.0D) + if(net_flow > 0.4 and out_amount > 5000, 10.0D * net_flow, 0.0D)
        + if(time_concentration > 0.5, 12.0D * time_concentration, 0.0D)"""
    )
    scored = a.withColumn("score", score).filter("score >= 35")
    return scored.withColumns({"confidence": F.expr("least(0.95D, score / 100.0D)"), "fraud_type": F.expr(first_of(GRAPH_TYPES))})


def sequence_stats(tx: DataFrame) -> DataFrame:
    """The graph features of each account, named as in the vector. Community counts distinct out-neighbours, as the vector defines it."""
    a = degrees(edges(tx)).join(neighbors(edges(tx)), "account").join(shortest_rings(edges(tx)).select("account", F.lit(1.0).alias("loop")), "account", "left").join(chain_depth(edges(tx)), "account", "left")
    return a.select(
        F.col("account").alias("account_id"), F.coalesce("loop", F.lit(0.0)).alias("graph_cycle"), F.coalesce("depth", F.lit(0)).cast("double").alias("graph_chain_depth"), F.col("out_neighbors").cast("double").alias("graph_community"),
        F.col("in_amount").alias("graph_in_amount"), F.col("out_amount").alias("graph_out_amount"), F.expr("if(in_amount > 0, out_amount / in_amount, 0.0D)").alias("graph_flow_balance"), F.expr("cast(out_degree + in_degree as double)").alias("graph_degree"),
        F.col("asymmetry").alias("direction_asymmetry"), F.col("freq_ratio").alias("in_out_freq_ratio"), F.col("net_flow").alias("net_flow_asymmetry"), "time_concentration",
    )
