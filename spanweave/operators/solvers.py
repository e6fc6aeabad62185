"""Solvers for low-cost networks that connect terminals, and their registry.

Each takes edges (src, dst, weight) and terminals (node_id) and returns a Solution. All but the exact
and the genetic one are compositions of distributed graph operators; those two evaluate many small
problems over a graph of a checked size.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import written
from . import graph as G

EXACT_TERMINALS = 12
#: Edges of a graph that fits one task; above it the exact and genetic solvers refuse.
SMALL_EDGES = 2_000_000
#: Edges that nearest_tree's flat arrays hold in the driver, at some 100 bytes each while they are made.
TREE_EDGES = 6_000_000
REACH_MM = 10_000_000


@dataclass
class Solution:
    """edges: src, dst, weight. total_weight is Infinity where the terminals cannot be connected."""

    edges: DataFrame
    terminals: DataFrame
    name: str
    total_weight: float
    is_connected: bool
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def steiner_points(self) -> DataFrame:
        return G.nodes_of(self.edges).join(self.terminals, "node_id", "left_anti")


Solver = Callable[..., Solution]
REGISTRY: dict[str, tuple[Solver, bool, str]] = {}


def register(name: str, fast: bool, about: str):
    def keep(solver: Solver) -> Solver:
        REGISTRY[name] = (solver, fast, about)
        return solver

    return keep


def get(name: str) -> Solver:
    if name not in REGISTRY:
        raise ValueError(f"unknown algorithm {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name][0]


def fast_names() -> list[str]:
    return [n for n, (_, fast, _) in REGISTRY.items() if fast]


def check_terminals(nodes: DataFrame, terminals: DataFrame) -> None:
    """An error for an empty graph, no terminals, or terminals that are not nodes."""
    if nodes.isEmpty():
        raise ValueError("the graph has no nodes")
    if terminals.isEmpty():
        raise ValueError("there are no terminals")
    if missing := terminals.join(nodes, "node_id", "left_anti").count():
        raise ValueError(f"{missing} terminals are not nodes of the graph")


def _finish(name: str, edges: DataFrame, terminals: DataFrame, failed: bool = False, **metadata: object) -> Solution:
    edges = written(edges.select("src", "dst", "weight"), name)
    total = edges.agg(G.total_weight(edges)).first()[0]
    connected = bool(G.is_connected(edges, terminals).first()[0])
    return Solution(edges, terminals, name, float("inf") if failed else float(total), connected, {k: str(v) for k, v in metadata.items()})


@register("mst_approximation", True, "spanning tree of the terminals' metric closure, expanded to paths")
def mst_approximation(edges: DataFrame, terminals: DataFrame, respan: bool = False, keep: DataFrame | None = None) -> Solution:
    """Unreachable terminals: the largest group is connected (Infinity if none has two). respan adds a spanning tree
    of the paths, which removes a cycle that tied paths can leave."""
    keep = terminals if keep is None else keep
    terminals = written(terminals.select("node_id").distinct(), "terminals")
    n = terminals.count()
    if n <= 1:
        return _finish("mst_approximation", edges.limit(0), terminals)
    cells = G.Cells.of(edges, terminals)
    closure = written(cells.closure(), "closure")
    names = G.connected_components(terminals, closure)
    main = names.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    if main["count"] <= 1:
        return _finish("mst_approximation", edges.limit(0), terminals, failed=True)
    inside = names.where(F.col("component") == main["component"]).select("node_id")
    tree = G.minimum_spanning_forest(G.induced_subgraph(closure, inside))
    paths = G.extract_subgraph(edges, cells.paths(tree))
    if respan:
        paths = G.minimum_spanning_forest(paths.select("src", "dst", "weight"))
    return _finish("mst_approximation", G.prune_leaves(paths, keep), terminals, terminals_connected=main["count"], terminals_total=n)


def steiner_candidates(edges: DataFrame, terminals: DataFrame, most: int = 100, reach: int = REACH_MM) -> DataFrame:
    """(node_id, degree, reachable, total): the non-terminals with the highest degree * reachable / (average
    distance in metres + 1), at least two terminals within reach. Distances run from the terminals, as
    they are symmetric."""
    near = G.reach_totals(edges, terminals, reach).withColumnRenamed("node", "node_id")
    per = near.join(terminals, "node_id", "left_anti").where("reachable >= 2")
    scored = per.join(G.degree(G.nodes_of(edges), edges), "node_id")
    score = F.col("degree") * F.col("reachable") / (F.col("total") / F.col("reachable") / 1000.0 + 1)
    return scored.withColumn("score", score).orderBy(F.desc("score"), "node_id").limit(most).select("node_id", "degree", "reachable", "total")


@register("mst_steiner_points", False, "mst_approximation with promising junctions as extra terminals")
def mst_steiner_points(edges: DataFrame, terminals: DataFrame, most: int = 100) -> Solution:
    extra = written(steiner_candidates(edges, terminals, most).select("node_id"), "candidates")
    wide = mst_approximation(edges, terminals.union(extra).distinct(), keep=terminals)
    return _finish("mst_steiner_points", wide.edges, terminals, failed=wide.total_weight == float("inf"), candidates=extra.count())


def nearest_tree(frame: pd.DataFrame, terminals: list[int]) -> set[tuple[int, int]]:
    """The ends of the edges of a tree that starts at the smallest terminal and always takes in the nearest one
    left. A new path's nodes spread their labels (distance, source) over those that they improve only, and as far as
    the next terminal, so the work is about each path. Nodes go by their rank, edges lie in flat arrays: some 32 bytes an edge and 32 a node."""
    flat = lambda v: array("q", v.astype(np.int64).tobytes())
    src, dst, w = (frame[c].to_numpy() for c in ("src", "dst", "weight"))
    names = np.unique(np.concatenate([src, dst, np.array(terminals, dtype=np.int64)]))
    a, b = np.searchsorted(names, src), np.searchsorted(names, dst)
    ends, size = np.concatenate([a[a != b], b[a != b]]), len(names)
    order = np.argsort(ends, kind="stable")
    to, weight = flat(np.concatenate([b[a != b], a[a != b]])[order]), flat(np.concatenate([w[a != b]] * 2)[order])
    start = flat(np.searchsorted(ends[order], np.arange(size + 1)))
    del src, dst, w, a, b, ends, order
    far = 1 << 62
    dists, sources, parents = flat(np.full(size, far)), flat(np.zeros(size)), flat(np.zeros(size))
    left = set(np.searchsorted(names, np.unique(np.array(terminals, dtype=np.int64))).tolist())
    first = min(left)
    left.remove(first)
    ahead: list[tuple[int, int]] = []
    pop, push = heapq.heappop, heapq.heappush
    heap = [(0, first, first, first)]
    found: set[tuple[int, int]] = set()
    while left:
        # Labels spread no further than the nearest terminal left, all of its distance included.
        while heap and (not ahead or heap[0][0] <= ahead[0][0]):
            dist, source, node, parent = pop(heap)
            was = dists[node]
            if was < dist or was == dist and sources[node] <= source:
                continue
            dists[node], sources[node], parents[node] = dist, source, parent
            if node in left:
                push(ahead, (dist, node))
            for i in range(start[node], start[node + 1]):
                other, new = to[i], dist + weight[i]
                was = dists[other]
                if new < was or new == was and source < sources[other]:
                    push(heap, (new, source, other, node))
        if not ahead:
            break
        dist, node = pop(ahead)
        if node not in left or dists[node] != dist:
            continue
        while parents[node] != node:
            push(heap, (0, node, node, node))
            left.discard(node)
            found.add((node, parents[node]))
            node = parents[node]
    return {(int(names[u]), int(names[v])) for u, v in found}


def _grown(edges: DataFrame, left: DataFrame) -> DataFrame:
    """The same tree by a distributed search for each terminal, on graphs of any size."""
    first = left.agg(F.min("node_id")).first()[0]
    tree = edges.limit(0).select("src", "dst", "weight")
    inside = left.where(F.col("node_id") == first)
    left = left.where(F.col("node_id") != first)
    while not left.isEmpty():
        labels = written(G.voronoi_labels(edges, inside), "labels")
        best = labels.join(left, "node_id").orderBy("dist", "node_id").first()
        if best is None:
            break
        steps = labels.select(F.lit(0).cast("bigint").alias("origin"), F.col("node_id").alias("node"), "parent")
        path = G.extract_subgraph(edges, G.walk_back(steps, steps.where(F.col("node") == best["node_id"]).select("origin", "node")))
        tree = written(tree.union(path.select("src", "dst", "weight")).distinct(), "tree")
        inside = written(G.nodes_of(tree).union(inside).distinct(), "inside")
        left = written(left.join(inside, "node_id", "left_anti"), "left")
    return tree


@register("shortest_path_heuristic", False, "a tree that grows by the nearest terminal")
def shortest_path_heuristic(edges: DataFrame, terminals: DataFrame, name: str = "shortest_path_heuristic") -> Solution:
    """Starts at the smallest terminal; stops, with what it has, where no further terminal is reachable. The
    terminals come one after another, so a graph of a checked size is searched in memory."""
    left = written(terminals.select("node_id").distinct(), "left")
    if left.isEmpty() or max(edges.count(), left.count()) > TREE_EDGES:
        tree = edges.limit(0).select("src", "dst", "weight") if left.isEmpty() else _grown(edges, left)
        return _finish(name, tree, terminals)
    found = nearest_tree(_small(edges, name, TREE_EDGES), [r[0] for r in left.collect()])
    pairs = edges.sparkSession.createDataFrame(sorted(found), "src bigint, dst bigint")
    return _finish(name, G.extract_subgraph(edges.select("src", "dst", "weight"), pairs).distinct(), terminals)


def _small(edges: DataFrame, what: str, most: int = SMALL_EDGES) -> pd.DataFrame:
    n = edges.count()
    if n > most:
        raise ValueError(f"{what} takes graphs of at most {most} edges; this one has {n}")
    return edges.select("src", "dst", "weight").toPandas()


def _neighbours(frame: pd.DataFrame) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in frame.itertuples(index=False, name=None):
        if a != b:
            out.setdefault(a, []).append((b, w))
            out.setdefault(b, []).append((a, w))
    return out


def exact_tree(frame: pd.DataFrame, terminals: list[int]) -> tuple[float, set[tuple[int, int]]]:
    """Least weight and edges of a tree over the terminals, by dynamic programming over their subsets."""
    near = _neighbours(frame)
    root, rest = terminals[0], terminals[1:]
    full = (1 << len(rest)) - 1
    if not full:
        return 0.0, set()
    cost: list[dict[int, int]] = [{} for _ in range(full + 1)]
    how: list[dict[int, tuple]] = [{} for _ in range(full + 1)]
    for i, t in enumerate(rest):
        cost[1 << i][t] = 0
    for mask in range(1, full + 1):
        best, by = cost[mask], how[mask]
        sub = (mask - 1) & mask
        while sub:
            other = mask ^ sub
            if sub <= other:
                for v, x in cost[sub].items():
                    y = cost[other].get(v)
                    if y is not None and x + y < best.get(v, x + y + 1):
                        best[v], by[v] = x + y, ("merge", sub)
            sub = (sub - 1) & mask
        heap = [(x, v) for v, x in best.items()]
        heapq.heapify(heap)
        while heap:
            x, v = heapq.heappop(heap)
            if x > best[v]:
                continue
            for u, w in near.get(v, ()):
                if x + w < best.get(u, x + w + 1):
                    best[u], by[u] = x + w, ("edge", v)
                    heapq.heappush(heap, (x + w, u))
    if root not in cost[full]:
        return float("inf"), set()
    found, todo = set(), [(full, root)]
    while todo:
        mask, v = todo.pop()
        step = how[mask].get(v)
        if step is None:
            continue
        kind, arg = step
        if kind == "edge":
            found.add((min(v, arg), max(v, arg)))
            todo.append((mask, arg))
        else:
            todo += [(arg, v), (mask ^ arg, v)]
    return float(cost[full][root]), found


@register("dijkstra_steiner", True, "exact for up to 12 terminals, else shortest_path_heuristic")
def dijkstra_steiner(edges: DataFrame, terminals: DataFrame, max_terminals: int = EXACT_TERMINALS) -> Solution:
    chosen = sorted(r[0] for r in terminals.select("node_id").distinct().limit(max_terminals + 1).collect())
    if len(chosen) > max_terminals:
        return shortest_path_heuristic(edges, terminals, "dijkstra_steiner_fallback")
    total, found = exact_tree(_small(edges, "the exact solver"), chosen)
    pairs = edges.sparkSession.createDataFrame(sorted(found), "src bigint, dst bigint")
    return _finish("dijkstra_steiner", G.extract_subgraph(edges, pairs), terminals, failed=total == float("inf"))


@register("pruned_dijkstra", True, "spanning forest of the terminals' nearest regions, expanded and pruned")
def pruned_dijkstra(edges: DataFrame, terminals: DataFrame, hub_threshold: int = 3, max_hubs: int = 50, **_ignored) -> Solution:
    """One multi-source search; borders are taken once labels are final, so no order matters. Components with one
    terminal keep it alone; hubs are only counted."""
    edges = written(edges.select("src", "dst", "weight"), "network")
    labels = written(G.voronoi_labels(edges, terminals), "regions")
    borders = written(G.voronoi_boundaries(edges, labels), "borders")
    pairs = borders.select(F.col("t1").alias("src"), F.col("t2").alias("dst"), F.col("cost").alias("weight"))
    chosen = G.minimum_spanning_forest(pairs).join(borders, (F.col("src") == F.col("t1")) & (F.col("dst") == F.col("t2")))
    chosen = written(chosen.select("u", "v"), "crossings")
    zero = F.lit(0).cast("bigint")
    starts = chosen.select(zero.alias("origin"), F.explode(F.array("u", "v")).alias("node"))
    steps = G.walk_back(labels.select(zero.alias("origin"), F.col("node_id").alias("node"), "parent"), starts)
    whole = G.extract_subgraph(edges, steps.select("src", "dst").union(chosen.select("u", "v")))
    kept = G.prune_leaves(whole, terminals)
    return _finish("pruned_dijkstra", kept, terminals, boundary_pairs=borders.count(), hubs=G.hubs(edges, labels, hub_threshold, max_hubs).count())


class _Tree:
    """Spanning trees of induced graphs on arrays, for the genetic solver."""

    def __init__(self, frame: pd.DataFrame, terminals: list[int]):
        frame = frame.sort_values(["weight", "src", "dst"])
        self.src, self.dst, self.weight = (frame[c].to_numpy() for c in ("src", "dst", "weight"))
        self.terminals, self.near = terminals, _neighbours(frame)

    def path(self, start: int, goals: set[int], cheap: set[int]) -> list[int]:
        """To the nearest goal; nodes already chosen are preferred among equals by their id order."""
        best, parent, heap = {start: 0}, {start: start}, [(0, start)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > best[v]:
                continue
            if v in goals:
                out = [v]
                while parent[v] != v:
                    v = parent[v]
                    out.append(v)
                return out
            for u, w in self.near.get(v, ()):
                new = d + (w // 2 if u in cheap else w)
                if new < best.get(u, new + 1):
                    best[u], parent[u] = new, v
                    heapq.heappush(heap, (new, u))
        return []

    def solve(self, genes: set[int]) -> tuple[float, list[int]]:
        """Weight and edge places of a pruned tree over the terminals that uses the genes where it helps."""
        nodes, joined = {self.terminals[0]}, {self.terminals[0]}
        for t in self.terminals[1:]:
            if t in joined:
                continue
            path = self.path(t, joined, genes | nodes)
            if not path:
                return float("inf"), []
            nodes.update(path)
            joined = set(nodes)
        at = np.flatnonzero(np.isin(self.src, list(nodes)) & np.isin(self.dst, list(nodes)))
        root = {v: v for v in nodes}

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        chosen = []
        for i in at.tolist():
            a, b = find(int(self.src[i])), find(int(self.dst[i]))
            if a != b:
                root[a] = b
                chosen.append(i)
        keep = set(self.terminals)
        while True:
            ends: dict[int, int] = {}
            for i in chosen:
                for v in (int(self.src[i]), int(self.dst[i])):
                    ends[v] = ends.get(v, 0) + 1
            lean = [i for i in chosen if all(ends[v] > 1 or v in keep for v in (int(self.src[i]), int(self.dst[i])))]
            if len(lean) == len(chosen):
                return float(self.weight[chosen].sum()) if chosen else 0.0, chosen
            chosen = lean


def genetic_tree(frame: pd.DataFrame, terminals: list[int], seed: int = 42, population: int = 50, generations: int = 100, mutation: float = 0.1, elite: float = 0.1, patience: int = 20) -> tuple[float, list[tuple[int, int, int]]]:
    """Sets of extra nodes evolve: tournaments of three, uniform crossover of unions, one node added or dropped."""
    rng, tree = np.random.default_rng(seed), _Tree(frame, terminals)
    pool = sorted(set(tree.near) - set(terminals))
    if len(terminals) < 2:
        return 0.0, []
    draw = lambda k: {int(x) for x in rng.choice(pool, min(k, len(pool)), replace=False)} if pool else set()
    people = [set(), *(draw(int(rng.integers(0, max(2, len(terminals))))) for _ in range(population - 1))]
    best: tuple[float, list[int]] = (float("inf"), [])
    stale = 0
    for _ in range(generations):
        judged = sorted(((*tree.solve(p), sorted(p)) for p in people), key=lambda r: (r[0], r[2]))
        if judged[0][0] < best[0]:
            best, stale = judged[0][:2], 0
        else:
            stale += 1
            if stale > patience:
                break
        scores = [r[0] for r in judged]
        ranked = [set(r[2]) for r in judged]
        people = ranked[: max(1, int(elite * population))]
        while len(people) < population:
            a, b = (ranked[min(rng.integers(0, len(ranked), 3), key=lambda i: scores[i])] for _ in range(2))
            child = {g for g in sorted(a | b) if rng.random() < 0.5}
            if rng.random() < mutation:
                child = child - {sorted(child)[int(rng.integers(len(child)))]} if child and rng.random() < 0.5 else child | draw(1)
            people.append(child)
    return best[0], [(int(tree.src[i]), int(tree.dst[i]), int(tree.weight[i])) for i in best[1]]


@register("genetic", False, "sets of extra nodes evolve; islands with different seeds run as tasks")
def genetic(edges: DataFrame, terminals: DataFrame, seed: int = 42, islands: int = 4, **options) -> Solution:
    spark = edges.sparkSession
    frame, chosen = _small(edges, "the genetic solver"), sorted(r[0] for r in terminals.select("node_id").distinct().collect())

    def island(batches):
        for batch in batches:
            for number in batch["id"]:
                total, found = genetic_tree(frame, chosen, seed + int(number), **options)
                yield pd.DataFrame([(total, int(number), a, b, w) for a, b, w in found] or [(total, int(number), -1, -1, 0)], columns=["total", "island", "src", "dst", "weight"])

    runs = written(spark.range(0, islands, 1, islands).mapInPandas(island, "total double, island bigint, src bigint, dst bigint, weight bigint"), "islands")
    best = runs.orderBy("total", "island").first()
    found = runs.where((F.col("island") == best["island"]) & (F.col("src") >= 0)).select("src", "dst", "weight")
    return _finish("genetic", found, terminals, failed=best["total"] == float("inf"), islands=islands)


def run_all(edges: DataFrame, terminals: DataFrame, names: list[str] | None = None) -> dict[str, Solution | Exception]:
    """Each named solver's result, or the error it ended with."""
    out: dict[str, Solution | Exception] = {}
    for name in names or fast_names():
        try:
            out[name] = get(name)(edges, terminals)
        except Exception as e:  # one solver's failure leaves the others their turn
            out[name] = e
    return out
