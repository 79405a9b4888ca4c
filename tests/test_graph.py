"""Graph queries over every account."""

import random
from collections import Counter, defaultdict
from itertools import combinations

from ledgerwatch.operators import graph
from ledgerwatch.plans import registry
from ledgerwatch.sources.adapter import transactions


def test_khop_neighbors_of_every_account(spark, sf_dir):
    near = defaultdict(set)
    for r in graph.edges(transactions(spark, sf_dir)).select("src", "dst").distinct().collect():
        near[r.src].add(r.dst)
        near[r.dst].add(r.src)
    want = set()
    for seed in near:
        hops = {b: 2 for a in near[seed] for b in near[a]} | dict.fromkeys(near[seed], 1) | {seed: 0}
        want |= {(seed, account, k) for account, k in hops.items()}
    got = [tuple(r) for r in registry.queries()["khop_neighbors_all"](spark, sf_dir).select("seed", "account", "hops").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = {tuple(r) for r in registry.queries()["khop_neighbors"](spark, sf_dir).select("seed", "account", "hops").collect()}
    assert some < want


def test_khop_neighbors_of_accounts_that_only_receive(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, dst string")
    seeds = graph.sides(e.selectExpr("*", "1.0D amount", "0L event_ms")).selectExpr("account as seed").distinct()
    assert {(r.seed, r.account, r.hops) for r in graph.hops(e, seeds).collect() if r.seed in "ce"} == {("c", "c", 0), ("c", "b", 1), ("c", "a", 2), ("e", "e", 0), ("e", "d", 1)}


def chains_by_hand(links, deepest):
    nexts = {a: sorted(y for x, y in links if x == a) for a, _ in links}
    todo, out = [[a, b] for a, b in links], []
    while todo:
        path = todo.pop()
        ahead = nexts.get(path[-1], [])
        if len(path) > deepest:
            out.append((path[0], tuple(path), "depth", ""))
        elif not ahead:
            out.append((path[0], tuple(path), "leaf", ""))
        else:
            out += [(path[0], tuple(path), "revisit", n) for n in ahead if n in path]
            todo += [[*path, n] for n in ahead if n not in path]
    return sorted(out)


def test_fund_chains(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("b", "a"), ("d", "b")]
    e = spark.createDataFrame([*links, ("a", "b")], "src string, dst string")
    for deepest in (1, 2, 3, 4):
        got = sorted((r.account, tuple(r.path), r.ending, r.back) for r in graph.fund_chains(e, deepest).collect())
        assert got == chains_by_hand(links, deepest)
    assert graph.fund_chains(e.limit(0)).count() == 0


def test_path_texts(spark):
    rows = [("abcdefghij", f"t{i}", 10.5 * i, i, i) for i in range(5)] + [("t1", "x", 7.0, 9, 9), ("x", "t1", 8.0, 10, 10)]
    e = spark.createDataFrame(rows, "src string, dst string, amount double, event_ms long, tx_id long")
    got = {r.account: r.path for r in graph.path_texts(e, spark.createDataFrame([("x",), ("t1",)], "account string")).collect()}
    assert got["abcdefghij"] == "abcdefgh→t0(0)..." and got["t2"] == "abcdefgh→t2(21)"
    assert got["t1"] == "t1→x(7) abcdefgh→t1(11)x→t1(8) | CYCLE detected" and got["x"] == "x→t1(8) t1→x(7) | CYCLE detected"
    assert graph.path_texts(e, e.select("src").limit(0).withColumnRenamed("src", "account"), most=2).filter("account = 'abcdefghij'").first().path == "abcdefgh→t3(32)abcdefgh→t4(42)"


def random_links(rng, nodes, links):
    return sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)) if a != b})


def cycles_by_hand(links, longest=6):
    """Simple cycles through each account, walked one by one."""
    nexts = defaultdict(list)
    for a, b in links:
        nexts[a].append(b)
    out = Counter()

    def walk(path):
        for n in nexts[path[-1]]:
            if n == path[0] and len(path) >= 2:
                out[(path[0], len(path))] += 1
            elif n not in path and len(path) < longest:
                walk([*path, n])

    for a in list(nexts):
        walk([a])
    return out


def test_cycle_counts_equal_walks(spark):
    rng = random.Random(4)
    shapes = [random_links(rng, 7, 25), random_links(rng, 9, 70), random_links(rng, 14, 40), [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c"), ("d", "a"), ("a", "d")], [("a", "b"), ("b", "c")]]
    for links in shapes:
        e = spark.createDataFrame([*links, links[0]], "src string, dst string")
        got = {(r.account, r.length): r.cycles for r in graph.cycle_counts(e).collect()}
        want = cycles_by_hand(links)
        assert got == want
        least = {}
        for a, k in want:
            least[a] = min(k, least.get(a, k))
        assert {r.account: r.length for r in graph.shortest_rings(e).collect()} == least


def test_triangles_equal_walks(spark):
    rng = random.Random(6)
    links = [*random_links(rng, 12, 50), *[("hub", f"n{i}") for i in range(12)], ("x", "y")]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {a: (len(n), sum(y in near[x] for x, y in combinations(sorted(n), 2))) for a, n in near.items()}
    rows = graph.clustering(spark.createDataFrame(links, "src string, dst string")).collect()
    assert {r.account: (r.degree, r.triangles) for r in rows} == want
    assert {r.account: r.clustering for r in rows}["x"] == 0.0


def test_chains_in_order_of_time(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}", rng.randrange(40), i) for i in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    longest = {}
    for src, dst, at, i in sorted(edges, key=lambda e: -e[2]):
        longest[i] = 1 + max((longest[j] for s, _, t, j in edges if s == dst and t > at), default=0)
    want = {}
    for src, _, _, i in edges:
        want[src] = max(want.get(src, 0), longest[i])
    e = spark.createDataFrame(edges, "src string, dst string, event_ms long, tx_id long")
    for deepest in (1, 3, 50):
        capped = {a: min(d, deepest) for a, d in want.items()}
        assert {r.account: r.depth for r in graph.chain_depth(e, deepest).collect()} == capped
        by_id = {i: (s, d, t) for s, d, t, i in edges}
        paths = graph.chain_paths(e, deepest).collect()
        assert {r.account: r.depth for r in paths} == capped
        for r in paths:
            steps = [by_id[i] for i in r.ids]
            assert len(steps) == r.depth and r.path == [r.account, *[s[1] for s in steps]] and [s[0] for s in steps] == r.path[:-1]
            assert all(a[2] < b[2] for a, b in zip(steps, steps[1:], strict=False))
    assert graph.chain_depth(e.limit(0)).count() == 0 and graph.cycle_counts(e.limit(0)).count() == 0


def test_communities_by_hand(spark):
    tx = [("a", "x", "1", "d1"), ("b", "y", "1", "d2"), ("b", "z", "2", "d3"), ("c", "a", "2", "d3"), ("s", "t", "9", "d9"), ("n", "a", None, None), ("l", "l", "7", "d7")]
    rows = spark.createDataFrame([(*r, 1.0, 0, i, "T") for i, r in enumerate(tx)], "name_orig string, name_dest string, ip_segment string, device_id string, amount double, event_ms long, tx_id long, type string")
    got = {r.account: r.community for r in graph.communities(rows).collect()}
    # a and b share an address, b and c another and a device: a reaches a, b and their neighbours x, y, z, c, n
    assert got == {"a": 7, "b": 7, "c": 5, "s": 2, "l": 1}


def test_hops_in_blocks(spark, monkeypatch):
    """Hubs, far accounts and accounts without a second hop, over many blocks and in rows of bits and lists, against a walk by hand."""
    rng = random.Random(5)
    links = random_links(rng, 60, 70) + [("n1", f"m{i}") for i in range(40)] + [(f"m{i}", "hub") for i in range(0, 40, 3)] + [("alone", "other")]
    e = spark.createDataFrame([(a, b, 1.0, 0) for a, b in links], "src string, dst string, amount double, event_ms long")
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {(s, a): h for s in near for h, group in ((2, {b for x in near[s] for b in near[x]}), (1, near[s]), (0, {s})) for a in group}
    for block, seeds, dense in ((7, 3, 2), (16, 512, 5), (8_192, 512, 64)):
        monkeypatch.setattr(graph, "BLOCK", block)
        monkeypatch.setattr(graph, "SEEDS", seeds)
        monkeypatch.setattr(graph, "DENSE", dense)
        got = [tuple(r) for r in graph.hops(e, graph.sides(e).selectExpr("account as seed").distinct()).collect()]
        assert len(got) == len(set(got)) and {(s, a): h for s, a, h in got} == want
        counts = {(r.seed, r.hops): r.accounts for r in graph.hop_counts(e).collect()}
        assert counts == Counter((s, h) for (s, _), h in want.items())


def test_cycles_walk_only_what_can_close(spark):
    """Accounts that only send can't be on a cycle; a hub's walks from them aren't made."""
    links = [(f"s{i}", "hub") for i in range(50)] + [("hub", "b"), ("b", "hub"), ("b", "c"), ("c", "hub")]
    e = spark.createDataFrame(links, "src string, dst string")
    assert graph.looping(graph.pairs(e)).count() == 4
    assert {(r.account, r.length, r.cycles) for r in graph.cycles(e).collect()} == {("hub", 2, 1), ("b", 2, 1), ("hub", 3, 1), ("b", 3, 1), ("c", 3, 1)}


def test_cycles_of_the_query_go_on_beyond_three_edges(spark, tmp_path):
    links = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (1, 6), (6, 7), (7, 0), (2, 1), (7, 8)]
    rows = [(i, user, "view", 1.0, f'{{"k": {k}}}') for i, (user, k) in enumerate(links)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp '2024-01-02 00:00:00' ts").write.parquet(str(tmp_path / "events.parquet"))
    want = cycles_by_hand([(f"U{a}", f"U{b}") for a, b in links])
    assert {length for _, length in want} == {2, 4, 6}
    assert {(r.account, r.length): r.cycles for r in registry.queries()["graph_cycles_2_3"](spark, str(tmp_path)).collect()} == want


def test_pairs_of_hops_are_listed_last(spark, monkeypatch):
    """Pairs come out named: nothing joins or deals them. Small pieces and groups, some seeds and all, names broadcast and dealt."""
    rng = random.Random(9)
    links = random_links(rng, 50, 90) + [(f"n{i}", "hub") for i in range(0, 50, 2)]
    e = spark.createDataFrame([(a, b, 1.0, 0) for a, b in links], "src string, dst string, amount double, event_ms long")
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    everyone = graph.sides(e).selectExpr("account as seed").distinct()
    for few, broadcast, seeds in ((3, 0, everyone), (2, 1000, everyone.filter("seed like '%3' or seed = 'hub'").union(everyone.selectExpr("'nobody' as seed").limit(1)))):
        for name, value in (("BLOCK", 20), ("NAMED", few), ("PIECE", few), ("TASK_PAIRS", 500), ("BROADCAST", broadcast)):
            monkeypatch.setattr(graph, name, value)
        some = {r.seed for r in seeds.collect()} - {"nobody"}
        want = {(s, a) for s in some for x in near[s] for a in near[x]} - {(s, a) for s in some for a in near[s] | {s}}
        p = graph.both_ways(e)
        found = graph.second_hops(p, seeds, graph.numbered(p), False)
        got = [(r.seed, a) for r in found.collect() for a in r.accounts]
        assert len(got) == len(set(got)) and set(got) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("FlatMapCoGroupsInArrow")
        assert {(r.seed, r.account) for r in graph.hops(e, seeds).filter("hops = 2").collect()} == want
