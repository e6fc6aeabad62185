import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators import graph as G
from spanweave.operators import solvers as S


def frame(spark, rows, schema="src bigint, dst bigint, weight bigint"):
    return spark.createDataFrame(rows, schema)


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id bigint")


def grid(side, seed=0):
    rng = np.random.default_rng(seed)
    weights = iter(rng.permutation(10_000)[: 2 * side * side] + 100)
    at = lambda x, y: y * side + x
    out = []
    for x, y in itertools.product(range(side), range(side)):
        if x + 1 < side:
            out.append((at(x, y), at(x + 1, y), int(next(weights))))
        if y + 1 < side:
            out.append((at(x, y), at(x, y + 1), int(next(weights))))
    return out


def test_blocks_do_not_change_distances(spark):
    edges = frame(spark, grid(7))
    seeds = spark.createDataFrame([(0, 0, 0), (0, 48, 0), (1, 24, 5)], "origin bigint, node bigint, dist bigint")
    whole = sorted(map(tuple, G.relax(edges, seeds).collect()))
    assert whole == sorted(map(tuple, G.relax(edges, seeds, block=5).collect()))
    assert len(whole) == 98


def test_limit_cuts_far_nodes(spark):
    edges = frame(spark, [(0, 1, 10), (1, 2, 10), (2, 3, 10)])
    assert {r["node_id"] for r in G.sssp(edges, 0, limit=20).collect()} == {0, 1, 2}


def test_exact_solver_against_all_node_sets():
    import pandas as pd

    rows = grid(3)
    table = pd.DataFrame(rows, columns=["src", "dst", "weight"])
    terminals = [0, 4, 8]
    best = float("inf")
    for k in range(7):
        for extra in itertools.combinations([i for i in range(9) if i not in terminals], k):
            inside = {*terminals, *extra}
            root = {v: v for v in inside}

            def find(v, root=root):
                while root[v] != v:
                    v = root[v]
                return v

            total = joined = 0
            for a, b, w in sorted(rows, key=lambda r: r[2]):
                if a in inside and b in inside and find(a) != find(b):
                    root[find(a)] = find(b)
                    total, joined = total + w, joined + 1
            if joined == len(inside) - 1:
                best = min(best, total)
    total, found = S.exact_tree(table, terminals)
    weight = {(a, b): w for a, b, w in rows}
    assert total == best == sum(weight[e] for e in found)


def test_solvers_connect_without_dangling_ends(spark):
    edges, terminals = frame(spark, grid(5, seed=3)), nodes(spark, [0, 12, 24])
    exact = S.dijkstra_steiner(edges, terminals)
    for found in (S.mst_approximation(edges, terminals), S.pruned_dijkstra(edges, terminals), S.genetic(edges, terminals, population=8, generations=3, islands=2)):
        assert found.is_connected
        assert exact.total_weight <= found.total_weight <= 2 * exact.total_weight
        ends = [v for r in found.edges.collect() for v in (r["src"], r["dst"])]
        assert all(ends.count(v) > 1 or v in (0, 12, 24) for v in ends)


def test_two_components(spark):
    """Q22 and the two meanings of disconnected: largest group only, or a forest."""
    edges, terminals = frame(spark, [(0, 1, 5), (1, 2, 5), (7, 8, 5)]), nodes(spark, [0, 2, 8])
    approximation = S.mst_approximation(edges, terminals)
    assert approximation.total_weight == 10 and not approximation.is_connected
    assert S.pruned_dijkstra(edges, terminals).total_weight == 10
    alone = S.shortest_path_heuristic(frame(spark, [(4, 5, 1)]), nodes(spark, [1, 4]))
    assert alone.total_weight == 0 and not alone.is_connected
    assert S.mst_approximation(edges, nodes(spark, [0, 7])).total_weight == float("inf")


def test_thirteen_terminals_fall_back(spark):
    edges = frame(spark, [(i, i + 1, 1) for i in range(13)])
    assert S.dijkstra_steiner(edges, nodes(spark, range(13))).name == "dijkstra_steiner_fallback"


def test_tree_grown_in_memory_is_the_distributed_one(spark):
    rng = random.Random(8)
    for n in (12, 30):
        rows = [(a, b, rng.randrange(1, 4)) for a in range(n) for b in rng.sample(range(n), 2) if a != b] + [(n + 1, n + 2, 1)]
        ends = nodes(spark, sorted(rng.sample(range(n), 6)) + [n + 2])
        edges = frame(spark, rows)
        alone = {tuple(r) for r in S.shortest_path_heuristic(edges, ends).edges.collect()}
        assert alone == {tuple(r) for r in S._grown(edges, ends).collect()}
    assert S.shortest_path_heuristic(frame(spark, [(0, 1, 1)]), nodes(spark, [0]).limit(0)).edges.count() == 0


def test_forest_is_stitched(spark):
    edges = frame(spark, [(0, 1, 1), (1, 2, 9), (2, 3, 1), (0, 3, 50)])
    joined = G.connect_forest(edges.where("weight = 1"), edges)
    assert sorted(r["weight"] for r in joined.collect()) == [1, 1, 9]


def test_forest_is_stitched_as_cheaply_as_a_spanning_tree_of_all_distances(spark):
    rng = random.Random(4)
    rows = {(a, b): rng.randrange(1, 60) for a in range(40) for b in rng.sample(range(40), 2) if a < b}
    rows |= {(100, 101): 5, (101, 102): 3}  # a part of its own
    edges = [(a, b, w) for (a, b), w in rows.items()]
    parts = [e for e in edges if e[0] % 9 == 0] + [(100, 101, 5)]
    got = {tuple(r) for r in G.connect_forest(frame(spark, parts), frame(spark, edges)).select("src", "dst", "weight").collect()}
    assert set(parts) <= got <= set(edges)

    def roots(some, nodes):
        root = {n: n for n in nodes}
        find = lambda n: n if root[n] == n else find(root[n])
        for a, b, *_ in some:
            root[find(a)] = find(b)
        return {n: find(n) for n in nodes}

    ends = {n for e in parts for n in e[:2]}
    whole, before = roots(edges, {n for e in edges for n in e[:2]}), roots(parts, ends)
    after = roots(got, {n for e in got for n in e[:2]})
    assert all((after[a] == after[b]) == (whole[a] == whole[b]) for a in ends for b in ends)
    far = {(a, b): w for (a, b), w in rows.items()} | {(b, a): w for (a, b), w in rows.items()}
    names = sorted(whole)
    for k in names:
        for a in names:
            for b in names:
                if (a, k) in far and (k, b) in far:
                    far[a, b] = min(far.get((a, b), 10**9), far[a, k] + far[k, b])
    between = sorted((d, before[a], before[b]) for (a, b), d in far.items() if a in ends and b in ends and before[a] != before[b])
    joined, cost = {n: n for n in before.values()}, 0
    find = lambda n: n if joined[n] == n else find(joined[n])
    for d, a, b in between:
        if find(a) != find(b):
            joined[find(a)] = find(b)
            cost += d
    assert sum(w for *_, w in got - set(parts)) <= cost


def test_registry_and_terminal_checks(spark):
    with pytest.raises(ValueError, match="pruned_dijkstra"):
        S.get("nothing")
    with pytest.raises(ValueError, match="1 terminals"):
        S.check_terminals(nodes(spark, [1]), nodes(spark, [1, 2]))
    assert isinstance(S.run_all(frame(spark, [(0, 1, 1)]), nodes(spark, [0, 1]), ["nothing"])["nothing"], ValueError)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = frame(spark, [(i, i + 1, 1) for i in range(60)] + [(100, i, 1) for i in range(101, 140)])
    names = G.connected_components(nodes(spark, [*range(61), *range(100, 141)]), edges)
    got = {r["component"]: r["count"] for r in names.groupBy("component").count().collect()}
    assert got == {0: 61, 100: 40, 140: 1}
    assert names.agg(F.count("*")).first()[0] == 102


def _distances(rows, origin):
    import heapq

    near = {}
    for a, b, w in rows:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, heap = {origin: 0}, [(0, origin)]
    while heap:
        d, v = heapq.heappop(heap)
        for u, w in near.get(v, ()):
            if d + w < best.get(u, d + w + 1):
                best[u] = d + w
                heapq.heappush(heap, (d + w, u))
    return best, near


def _closure_tree_paths(rows, terminals):
    """All distances, Kruskal's tree with ties by (weight, src, dst), and its paths by the least node before."""
    far = {t: _distances(rows, t) for t in terminals}
    pairs = sorted((far[s][0][t], s, t) for s in terminals for t in terminals if s < t and t in far[s][0])
    root, out, tree = {t: t for t in terminals}, set(), []

    def find(v):
        return v if root[v] == v else find(root[v])

    for weight, s, t in pairs:
        if find(s) != find(t):
            root[find(s)] = find(t)
            tree.append((s, t, weight))
            dist, near = far[s]
            while t != s:
                before = min(u for u, w in near[t] if dist[u] + w == dist[t])
                out.add((min(before, t), max(before, t)))
                t = before
    return sorted(tree), out


def test_closure_tree_without_a_search_a_terminal(spark, monkeypatch):
    """Every terminal searched the whole graph; now the regions' borders do, with all ties (two weights only)."""
    rng = np.random.default_rng(0)
    rows = [(a, b, int(w)) for (a, b, _), w in zip(grid(9), rng.integers(1, 3, 200), strict=False)]
    terminals = sorted(int(t) for t in rng.choice(81, 14, replace=False))

    def no_search(*_, **__):
        raise AssertionError("a search from each terminal")

    monkeypatch.setattr(G, "distances_from", no_search)
    tree, paths = _closure_tree_paths(rows, terminals)
    cells = G.Cells.of(frame(spark, rows), nodes(spark, terminals))
    chosen = G.minimum_spanning_forest(cells.closure())
    assert sorted(map(tuple, chosen.select("src", "dst", "weight").collect())) == tree
    assert set(map(tuple, cells.paths(chosen).collect())) == paths


def test_searches_in_groups_add_up(spark, monkeypatch):
    """Distances of pairs are not written; those at exactly the limit count, in whichever block they lie."""
    monkeypatch.setattr(G, "distances_from", None)
    rows, terminals = grid(8), [0, 3, 9, 27, 36, 50, 63]
    far = {t: _distances(rows, t)[0] for t in terminals}
    limit = far[27][50]
    want = {}
    for t in terminals:
        for v, d in far[t].items():
            if d <= limit:
                n, total = want.get(v, (0, 0))
                want[v] = (n + 1, total + d)
    got = G.reach_totals(frame(spark, rows), nodes(spark, [*terminals, 700]), limit, size=3).collect()
    assert {r["node"]: (r["reachable"], r["total"]) for r in got} == want | {700: (1, 0)}
    pairs = {(s, t, far[s][t]) for s in terminals for t in terminals if s < t}
    assert set(map(tuple, G.metric_closure(frame(spark, rows), nodes(spark, [*terminals, 700])).collect())) == pairs


def test_tree_grows_by_local_work():
    """Each path's labels ran over all nodes that they improved, so time grew faster than the graph."""
    import time

    import pandas as pd

    side = 200
    k = np.arange(side * side)
    right, up = k[k % side < side - 1], k[k < side * (side - 1)]
    weights = 80000 + 2 * ((k * 7919) % 40009)
    table = pd.DataFrame({"src": np.concatenate([right, up]), "dst": np.concatenate([right + 1, up + side]), "weight": np.concatenate([weights[right], weights[up] + 1])})
    terminals = sorted({i * 7919 % len(k) for i in range(2000)})
    began = time.perf_counter()
    found = S.nearest_tree(table, terminals)
    assert time.perf_counter() - began < 10
    ends = {v for e in found for v in e}
    assert len(found) == len(ends) - 1 and ends >= set(terminals)
