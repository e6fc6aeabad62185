"""Graph operators. A graph is two tables: nodes (node_id, ...) and edges (src, dst, weight, ...), each
undirected edge once. Ids and weights are bigints (weights in millimetres); ties go to the smaller id.

Shortest paths run block by block: nodes fall into blocks of bounded id ranges, each round settles whole
blocks in memory from the labels that changed, and only labels that cross block borders travel. A graph
of one block takes one round; a larger one about as many as a path crosses blocks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import written

BLOCK = 1 << 16
NO_LIMIT = (1 << 62) - 1
ORIGINS = 16  # searches that share one copy of a block's edges


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; loops are left out."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")).where("a <> b")
    return one.unionAll(one.select("b", "a", "w"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree) of all nodes; a loop counts twice."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst"))
    counted = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node reachable. Minima of neighbours, then pointer jumping, until
    nothing changes; only that fact reaches the driver."""
    both = written(adjacency(edges.withColumn("weight", F.lit(0))).select("a", "b").distinct(), "adjacency")
    labels = written(nodes.select("node_id", F.col("node_id").alias("component")).distinct(), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node_id", "b"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("heard"))
        met = labels.join(heard, "node_id", "left").select("node_id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        hook = met.where("component < was").groupBy(F.col("was").alias("node_id")).agg(F.min("component").alias("hook"))
        met = written(met.join(hook, "node_id", "left").select("node_id", "was", F.least("component", "hook").alias("component")), "labels")
        up = met.select(F.col("node_id").alias("component"), F.col("component").alias("up"))
        after = written(met.join(up, "component", "left").select("node_id", "was", F.least("component", "up").alias("component")), "labels")
        labels = after.select("node_id", "component")
        if after.where("component < was").isEmpty():
            return labels


def _settle(edges: pd.DataFrame, labels: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Dijkstra inside one block for each origin, from its fresh labels; labels for outside nodes are offers.
    Keys order by distance, source, parent."""
    out_edges: dict[int, list] = {}
    for a, b, w in zip(edges["a"].tolist(), edges["b"].tolist(), edges["w"].tolist(), strict=True):
        out_edges.setdefault(a, []).append((b, w))
    inside = out_edges.keys()
    best: dict[tuple, tuple] = {}
    heap: list[tuple] = []
    for origin, node, dist, source, parent, fresh in labels[["origin", "node", "dist", "source", "parent", "fresh"]].itertuples(index=False, name=None):
        best[origin, node] = (dist, source, parent)
        if fresh:
            heapq.heappush(heap, ((dist, source, parent), origin, node))
    changed: dict[tuple, tuple] = {}
    offers: dict[tuple, tuple] = {}
    while heap:
        key, origin, node = heapq.heappop(heap)
        if best[origin, node] != key:
            continue
        for other, w in out_edges.get(node, ()):
            new = (key[0] + w, key[1], node)
            if new[0] > limit:
                continue
            at = (origin, other)
            if other in inside:
                if at not in best or new < best[at]:
                    best[at] = changed[at] = new
                    heapq.heappush(heap, (new, origin, other))
            elif at not in offers or new < offers[at]:
                offers[at] = new
    rows = [(*at, *key) for found in (changed, offers) for at, key in found.items()]
    return pd.DataFrame(rows, columns=["origin", "node", "dist", "source", "parent"], dtype="int64")


def relax(edges: DataFrame, seeds: DataFrame, limit: int = NO_LIMIT, block: int = BLOCK, directed: bool = False, share: int = ORIGINS) -> DataFrame:
    """(origin, node, dist, source, parent) of every node within `limit` of a seed of its origin; seeds: origin,
    node, dist and, if they have them, source and parent. Each origin is a search of its own; source is the seed that
    a node is nearest to, parent the node before it (itself for seeds). directed takes edges from src to dst only.
    A block's edges travel once for each bucket of about `share` origins that are busy there, and buckets spread over
    tasks; searches of a few nodes each can all share them."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")) if directed else adjacency(edges)
    adj = written(both.withColumn("block", F.floor(F.col("a") / block)), "adjacency")
    schema = "origin bigint, node bigint, dist bigint, source bigint, parent bigint"
    own = lambda c: F.col(c if c in seeds.columns else "node").alias(c)
    start = seeds.select("origin", "node", F.col("dist").cast("bigint").alias("dist"), own("source"), own("parent"))
    start = start.groupBy("origin", "node").agg(F.min(F.struct("dist", "source", "parent")).alias("k")).select("origin", "node", "k.*")
    labels = written(start.withColumn("fresh", F.lit(True)), "labels")
    buckets = labels.select("origin").distinct().count() // share + 1
    while True:
        here = labels.withColumn("block", F.floor(F.col("node") / block)).withColumn("bucket", F.pmod(F.xxhash64("origin"), F.lit(buckets)))
        busy = here.where("fresh").select("block", "bucket", "origin").distinct()
        held = here.join(busy.select("block", "origin"), ["block", "origin"], "left_semi")
        # Named anew, or the two sides of the cogroup could not be told apart.
        blocks = adj.join(busy.select("block", F.col("bucket").alias("search")).distinct(), "block").withColumnRenamed("search", "bucket")
        blocks = blocks.select(F.col("block").alias("block"), F.col("bucket").alias("bucket"), "a", "b", "w")
        moved = blocks.groupBy("block", "bucket").cogroup(held.groupBy("block", "bucket")).applyInPandas(lambda e, k: _settle(e, k, limit), schema)
        inner = moved.withColumn("mine", F.lit(1)).unionByName(labels.select("origin", "node", "dist", "source", "parent").withColumn("mine", F.lit(0)))
        key = F.struct("dist", "source", "parent")
        merged = inner.groupBy("origin", "node").agg(F.min(key).alias("k"), F.min(F.when(F.col("mine") == 0, key)).alias("was"))
        # What a block settled itself is not fresh to it; a label is, if its parent lies in another block.
        crossed = F.floor(F.col("node") / block) != F.floor(F.col("k.parent") / block)
        fresh = crossed & (F.col("was").isNull() | (F.col("k") < F.col("was")))
        labels = written(merged.select("origin", "node", "k.*", fresh.alias("fresh")), "labels")
        if labels.where("fresh").isEmpty():
            return labels.drop("fresh")


def sssp(edges: DataFrame, source: int, limit: int = NO_LIMIT) -> DataFrame:
    """(node_id, dist, parent) from one source."""
    spark = edges.sparkSession
    seeds = spark.range(1).select(F.lit(0).cast("bigint").alias("origin"), F.lit(source).cast("bigint").alias("node"), F.lit(0).alias("dist"))
    return relax(edges, seeds, limit).select(F.col("node").alias("node_id"), "dist", "parent")


def voronoi_labels(edges: DataFrame, terminals: DataFrame, limit: int = NO_LIMIT) -> DataFrame:
    """(node_id, dist, source, parent): each node's nearest terminal."""
    seeds = terminals.select(F.lit(0).cast("bigint").alias("origin"), F.col("node_id").alias("node"), F.lit(0).alias("dist")).distinct()
    return relax(edges, seeds, limit).select(F.col("node").alias("node_id"), "dist", "source", "parent")


def distances_from(edges: DataFrame, sources: DataFrame, limit: int = NO_LIMIT) -> DataFrame:
    """(origin, node, dist, parent) from each of `sources`, one search each."""
    seeds = sources.select(F.col("node_id").alias("origin"), F.col("node_id").alias("node"), F.lit(0).alias("dist")).distinct()
    return relax(edges, seeds, limit).select("origin", "node", "dist", "parent")


GROUP, FEW = 1024, 128  # origins whose searches share one copy of the region around them
TASK_EDGES = 2_000_000  # of a region that one task holds
HELD = 4_000_000  # distances that one task holds at once


def _search(region: pd.DataFrame, origins: list[int], limit: int):
    """For each origin the places (in an array of all nodes, which comes first) and distances within limit. Many
    origins go side by side: what lies in the same band of distance is spread at once, until the band is stable."""
    names = np.unique(np.concatenate([region["a"].to_numpy(), region["b"].to_numpy(), np.array(origins, dtype=np.int64)]))
    yield names
    m, region = len(names), region.sort_values("a", kind="stable")
    start = np.searchsorted(region["a"].to_numpy(), names)
    degree = np.diff(np.append(start, len(region)))
    to, weight = np.searchsorted(names, region["b"].to_numpy()), region["w"].to_numpy().astype(np.int64)
    band = max(1, int(weight.mean())) if len(weight) else 1
    side = max(1, HELD // max(1, m))
    for first in range(0, len(origins), side):
        some = origins[first : first + side]
        best = np.full(len(some) * m, NO_LIMIT, np.int64)
        spread, place = best.copy(), np.zeros(len(best), np.int32)
        at = np.arange(len(some)) * m + np.searchsorted(names, some)
        best[at] = 0
        waiting: dict[int, list] = {0: [at]}
        bands = [0]
        while bands:
            k = heapq.heappop(bands)
            while k in waiting:
                at = np.concatenate(waiting.pop(k))
                place[at] = order = np.arange(len(at), dtype=np.int32)
                at = at[(place[at] == order) & (best[at] < spread[at])]
                spread[at] = best[at]
                node = at % m
                n = degree[node]
                edge = np.repeat(start[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                new, target = np.repeat(best[at], n) + weight[edge], np.repeat(at - node, n) + to[edge]
                less = (new <= limit) & (new < best[target])
                new, target = new[less], target[less]
                left = np.arange(len(new))
                while len(left):  # of several ways to one node the last one written stands until a shorter one is
                    best[target[left]] = new[left]
                    left = left[new[left] < best[target[left]]]
                kept = best[target] == new
                new, target = new[kept] // band, target[kept]
                for b in np.unique(new).tolist():
                    if b not in waiting:
                        waiting[b] = []
                        if b != k:
                            heapq.heappush(bands, b)
                    waiting[b].append(target[new == b])
        for origin, row in zip(some, best.reshape(len(some), m), strict=True):
            hit = np.flatnonzero(row < NO_LIMIT)
            yield origin, hit, row[hit]


def _grouped(sources: DataFrame, size: int) -> DataFrame:
    """(home, node): sources in groups of at most about `size` that lie close by their ids; smaller ones where there are
    few, so that all cores have some."""
    some = written(sources.select(F.col("node_id").alias("node")).distinct(), "sources")
    n, low, high = some.agg(F.count("*"), F.min("node"), F.max("node")).first()
    size = min(size, max(FEW, n // 48))
    width = max(1, (high - low + 1) * size // n) if n else 1
    return written(some.select(F.floor(F.col("node") / width).alias("home"), "node"), "homes")


def reach_totals(edges: DataFrame, sources: DataFrame, limit: int, size: int = GROUP) -> DataFrame:
    """(node, reachable, total): of each node the number of sources within limit and the sum of their distances. One
    search a group finds the region its sources reach; a task then searches from each of them there and adds up, so
    no distance of a pair is ever written."""
    homes = _grouped(sources, size)
    seeds = homes.select(F.col("home").alias("origin"), "node", F.lit(0).alias("dist"))
    region = relax(edges, seeds, limit).select(F.col("origin").alias("home"), F.col("node").alias("a"))
    held = region.join(written(adjacency(edges), "adjacency"), "a").select("home", "a", "b", "w")

    def totals(edges: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
        found = _search(edges, homes["node"].tolist(), limit)
        names = next(found)
        count, total = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for _, at, dist in found:
            count[at] += 1
            total[at] += dist
        hit = np.flatnonzero(count)
        return pd.DataFrame({"node": names[hit], "reachable": count[hit], "total": total[hit]})

    parts = held.groupBy("home").cogroup(homes.groupBy("home")).applyInPandas(totals, "node bigint, reachable bigint, total bigint")
    return parts.groupBy("node").agg(F.sum("reachable").alias("reachable"), F.sum("total").alias("total"))


def metric_closure(edges: DataFrame, terminals: DataFrame, most: int = TASK_EDGES) -> DataFrame:
    """(src, dst, weight): distances between all pairs of terminals that reach each other, src < dst. Where a task
    holds the graph, groups of terminals search it side by side and only their distances to terminals leave."""
    if edges.count() > most:
        near = distances_from(edges, terminals)
        ends = near.join(terminals.select(F.col("node_id").alias("node")), "node", "left_semi")
        return ends.where("origin < node").select(F.col("origin").alias("src"), F.col("node").alias("dst"), F.col("dist").alias("weight"))
    homes = _grouped(terminals, FEW)
    names = homes.select("home").distinct()
    held = written(adjacency(edges), "adjacency").crossJoin(F.broadcast(names)).select("home", "a", "b", "w")
    every = homes.select("node").crossJoin(F.broadcast(names)).select("home", "node", F.lit(False).alias("own"))
    ends = every.unionByName(homes.select("home", "node", F.lit(True).alias("own")))

    def closure(edges: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        own = ends["own"].to_numpy()
        found = _search(edges, ends["node"].to_numpy()[own].tolist(), NO_LIMIT)
        names = next(found)
        other = ends["node"].to_numpy()[~own]
        other = other[np.isin(other, names)]
        wanted = np.zeros(len(names), bool)
        wanted[np.searchsorted(names, other)] = True
        out = [(np.full(k.sum(), origin), names[at[k]], dist[k]) for origin, at, dist in found if (k := wanted[at] & (names[at] > origin)).any()]
        src, dst, weight = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))
        return pd.DataFrame({"src": src, "dst": dst, "weight": weight})

    return held.groupBy("home").cogroup(ends.groupBy("home")).applyInPandas(closure, "src bigint, dst bigint, weight bigint")


@dataclass
class Cells:
    """The nearest terminals of each node, all that tie. near: source, node, dist, parent (the least node before it on
    the source's own shortest paths); tight: a, b, w where a shortest path runs from a to b; edges: src, dst, weight."""

    edges: DataFrame
    near: DataFrame
    tight: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, terminals: DataFrame) -> Cells:
        edges = written(edges.select("src", "dst", "weight"), "cell_edges")
        labels = written(voronoi_labels(edges, terminals), "cells")
        end = lambda c: labels.select(F.col("node_id").alias(c), F.col("dist").alias(f"d_{c}"), F.col("source").alias(f"s_{c}"))
        tight = adjacency(edges).join(end("a"), "a").join(end("b"), "b").where("d_a + w = d_b")
        tight = written(tight.select("a", "b", "w", "d_b", "s_a", "s_b"), "tight")
        # A shortest path that enters a region labelled otherwise brings a tie along, and on to what lies behind.
        seeds = tight.where("s_a <> s_b").select(F.col("s_a").alias("origin"), F.col("b").alias("node"), F.col("d_b").alias("dist"), F.col("s_a").alias("source"), F.col("a").alias("parent"))
        tied = relax(tight.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")), seeds, directed=True, share=NO_LIMIT)
        near = labels.select("source", F.col("node_id").alias("node"), "dist", "parent").unionByName(tied.select(F.col("origin").alias("source"), "node", "dist", "parent"))
        near = near.groupBy("source", "node").agg(F.min("dist").alias("dist"), F.min("parent").alias("parent"))
        return cls(edges, written(near, "near"), tight.select("a", "b", "w"))

    def crossings(self) -> DataFrame:
        """(s, t, cost, x, y, d_x, w): edges x-y between a node nearest to s and one nearest to t, s < t."""
        end = lambda c, p: self.near.select(F.col("node").alias(c), F.col("source").alias(p), F.col("dist").alias(f"d_{c}"))
        both = adjacency(self.edges).select(F.col("a").alias("x"), F.col("b").alias("y"), "w")
        met = both.join(end("x", "s"), "x").join(end("y", "t"), "y").where("s < t")
        return met.select("s", "t", (F.col("d_x") + F.col("w") + F.col("d_y")).alias("cost"), "x", "y", "d_x", "w")

    def closure(self) -> DataFrame:
        """(src, dst, weight): as much of the terminals' metric closure as its minimum spanning forest can use, with
        ties by (weight, src, dst). A shortest path of a chosen pair has only nodes nearest to its two ends: any other
        would stand for a chain of pairs that are all closer."""
        return self.crossings().groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.min("cost").alias("weight"))

    def paths(self, chosen: DataFrame) -> DataFrame:
        """(src, dst) of the edges on the shortest path of each chosen pair (src, dst, weight) of such a forest: seen
        from dst, always on to the least node that is one step nearer to src."""
        pairs = written(chosen.select(F.monotonically_increasing_id().alias("pair"), F.col("src").alias("s"), F.col("dst").alias("t"), F.col("weight").alias("cost")), "pairs")
        over = self.crossings().join(pairs, ["s", "t", "cost"])
        seeds = over.select(F.col("pair").alias("origin"), F.col("y").alias("node"), (F.col("d_x") + F.col("w")).alias("dist"), F.col("s").alias("source"), F.col("x").alias("parent"))
        down = self.tight.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("w").alias("weight"))
        there = written(relax(down, seeds, directed=True, share=NO_LIMIT).select("origin", "node", "parent"), "there")
        steps = written(walk_back(there, pairs.select(F.col("pair").alias("origin"), F.col("t").alias("node"))), "steps")
        ends = steps.select("origin", F.explode(F.array("src", "dst")).alias("node")).distinct().join(there, ["origin", "node"], "left_anti")
        starts = ends.join(pairs.select(F.col("pair").alias("origin"), "s"), "origin").select(F.col("s").alias("origin"), "node").distinct()
        home = self.near.select(F.col("source").alias("origin"), "node", "parent")
        return written(steps.select("src", "dst").union(walk_back(home, starts).select("src", "dst")).distinct(), "paths")


def _borders(edges: DataFrame, labels: DataFrame) -> DataFrame:
    lab = lambda c: labels.select(F.col("node_id").alias(c), F.col("dist").alias(f"d_{c}"), F.col("source").alias(f"s_{c}"))
    both = edges.select("src", "dst", "weight").join(lab("src"), "src").join(lab("dst"), "dst").where("s_src <> s_dst")
    return both.select(F.least("s_src", "s_dst").alias("t1"), F.greatest("s_src", "s_dst").alias("t2"), (F.col("d_src") + F.col("weight") + F.col("d_dst")).alias("cost"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))


def voronoi_boundaries(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(t1, t2, cost, u, v): for neighbouring regions the cheapest way over one edge u-v."""
    best = _borders(edges, labels).groupBy("t1", "t2").agg(F.min(F.struct("cost", "u", "v")).alias("k"))
    return best.select("t1", "t2", "k.cost", "k.u", "k.v")


def hubs(edges: DataFrame, labels: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """(node_id, hits): nodes at `least` or more region borders, the `most` busiest; a report, not a solver input."""
    ends = _borders(edges, labels).select(F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= least).orderBy(F.desc("hits"), "node_id").limit(most)


def _roots(up: DataFrame) -> DataFrame:
    """(node_id, component) of a table (node_id, up) in which every component points at the one its cheapest
    edge leads to. Keys are distinct, so the only cycles are two that point at each other: the smaller
    becomes the root, and pointers jump there."""
    back = up.select(F.col("node_id").alias("up"), F.col("up").alias("upper"))
    root = (F.col("upper") == F.col("node_id")) & (F.col("node_id") < F.col("up"))
    names = written(up.join(back, "up").select("node_id", F.when(root, F.col("node_id")).otherwise(F.col("up")).alias("component")), "roots")
    while True:
        jump = names.select(F.col("node_id").alias("component"), F.col("component").alias("further"))
        once = names.join(jump, "component").select("node_id", F.col("component").alias("was"), F.col("further").alias("component"))
        twice = written(once.join(jump, "component").select("node_id", "was", F.col("further").alias("component")), "roots")
        names = twice.select("node_id", "component")
        if twice.where("component <> was").isEmpty():
            return names


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (src, dst, weight) of the forest: each round every component takes its cheapest edge out
    (ties by ends), and components that meet become one."""
    edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src <> dst")
    left = written(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).select("*", F.col("src").alias("c1"), F.col("dst").alias("c2")), "contracted")
    chosen: DataFrame | None = None
    while not left.isEmpty():
        key = F.struct("weight", "src", "dst")
        outs = left.select(F.col("c1").alias("c"), F.col("c2").alias("o"), key.alias("k")).unionAll(left.select("c2", "c1", key))
        best = written(outs.groupBy("c").agg(F.min(F.struct(F.col("k"), F.col("o"))).alias("m")).select("c", F.col("m.o").alias("o"), "m.k.*"), "cheapest")
        picked = best.select("src", "dst", "weight").distinct()
        chosen = picked if chosen is None else chosen.unionAll(picked)
        names = _roots(best.select(F.col("c").alias("node_id"), F.col("o").alias("up")))
        name = lambda c: names.select(F.col("node_id").alias(c), F.col("component").alias(f"new_{c}"))
        left = left.join(name("c1"), "c1").join(name("c2"), "c2").where("new_c1 <> new_c2")
        # Of parallel edges between two components only the cheapest can still be chosen.
        left = left.groupBy(F.least("new_c1", "new_c2").alias("c1"), F.greatest("new_c1", "new_c2").alias("c2")).agg(F.min(key).alias("k"))
        left = written(left.select("k.src", "k.dst", "k.weight", "c1", "c2"), "contracted")
    return edges.limit(0) if chosen is None else written(chosen.distinct(), "forest")


def walk_back(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(origin, src, dst): the edges from each start (origin, node) back along parents (origin, node, parent) to
    the node that is its own parent. Ancestors at distance 2, 4, 8 ... are joined, so rounds grow with the
    logarithm of the path length."""
    jump = written(parents.select("origin", "node", "parent"), "jump")
    on_path = written(starts.select("origin", "node").distinct(), "on_path")
    while True:
        more = on_path.join(jump, ["origin", "node"]).select("origin", F.col("parent").alias("node"))
        wider = written(on_path.unionAll(more).distinct(), "on_path")
        further = jump.alias("a").join(jump.alias("b"), (F.col("a.origin") == F.col("b.origin")) & (F.col("a.parent") == F.col("b.node"))).select("a.origin", "a.node", F.col("b.parent").alias("parent"))
        further = written(further, "jump")
        done = further.join(jump, ["origin", "node", "parent"], "left_anti").isEmpty()
        on_path, jump = wider, further
        if done:
            break
    steps = on_path.join(parents.select("origin", "node", "parent"), ["origin", "node"]).where("node <> parent")
    return steps.select("origin", F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst")).distinct()


def shortest_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    """(src, dst, weight) of one path's edges; empty if there is none."""
    tree = sssp(edges, source).select(F.lit(0).cast("bigint").alias("origin"), F.col("node_id").alias("node"), "parent")
    steps = walk_back(tree, tree.where(F.col("node") == target).select("origin", "node"))
    return extract_subgraph(edges, steps)


def extract_subgraph(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges, with all their columns, whose ends (in either order) are among pairs (src, dst)."""
    wanted = pairs.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    cond = (F.least("src", "dst") == F.col("lo")) & (F.greatest("src", "dst") == F.col("hi"))
    return edges.join(wanted, cond, "left_semi")


def prune_leaves(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Repeatedly drop edges that end in a degree-one node outside keep (node_id)."""
    now = written(edges, "pruned")
    while True:
        ends = now.select(F.col("src").alias("node_id")).unionAll(now.select("dst"))
        leaves = ends.groupBy("node_id").count().where("count = 1").join(keep, "node_id", "left_anti").select("node_id")
        leaves = written(leaves, "leaves")
        if leaves.isEmpty():
            return now
        now = now.join(leaves.withColumnRenamed("node_id", "src"), "src", "left_anti").join(leaves.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
        now = written(now.select(edges.columns), "pruned")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes."""
    kept = nodes.select("node_id").distinct()
    return edges.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(edges.columns)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst")).distinct()


def is_connected(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """One row: is_connected, true if there are terminals and all lie in one component of the edges (a lone
    terminal without edges counts as connected)."""
    names = connected_components(nodes_of(edges).union(terminals.select("node_id")).distinct(), edges)
    held = terminals.select("node_id").distinct().join(names, "node_id")
    return held.agg((F.countDistinct("component") == 1).alias("is_connected"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, issues and a verdict; nodes: node_id, lon_u, lat_u. Isolated nodes alone are
    tolerated below one per cent."""
    names = connected_components(nodes, edges)
    sizes = names.groupBy("component").agg(F.count("*").alias("n"))
    parts = sizes.agg(F.count("*").alias("n_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    alone = degree(nodes, edges).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("degree") == 0).alias("isolated"))
    bad = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("weight").isNull() | (F.col("weight") <= 0)).alias("invalid_weights"))
    blind = nodes.agg(F.count_if(F.col("lon_u").isNull() | F.col("lat_u").isNull()).alias("missing_coords"))
    one = alone.join(bad).join(parts).join(blind)  # four tables of one row
    sound = (F.col("n_nodes") > 0) & (F.col("n_components") <= 1) & (F.col("invalid_weights") == 0) & (F.col("missing_coords") == 0)
    return one.withColumn("is_valid", sound & (F.col("isolated") * 100 < F.col("n_nodes")))


def total_weight(edges: DataFrame) -> Column:
    return F.coalesce(F.sum("weight"), F.lit(0))


def connect_forest(solution: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Join the solution's components (and lone nodes) along cheapest paths; components that the network does
    not connect stay apart.

    One search from all components at once: each node learns its nearest one, the cheapest way over each border
    between two regions stands for their distance, and a spanning forest over the components picks the ways,
    which is as cheap as one over all distances between components."""
    now = written(solution.select("src", "dst", "weight"), "stitched")
    ends = nodes_of(now) if nodes is None else nodes_of(now).union(nodes.select("node_id")).distinct()
    names = written(connected_components(ends, now), "stitch_names")
    labels = voronoi_labels(edges, names.select("node_id"))
    of = names.select(F.col("node_id").alias("source"), "component")
    near = written(labels.join(of, "source").select("node_id", "dist", F.col("component").alias("source"), "parent"), "regions")
    ways = written(voronoi_boundaries(edges.select("src", "dst", "weight"), near), "ways")
    chosen = minimum_spanning_forest(ways.select(F.col("t1").alias("src"), F.col("t2").alias("dst"), F.col("cost").alias("weight")))
    taken = ways.join(chosen.select(F.col("src").alias("t1"), F.col("dst").alias("t2")), ["t1", "t2"], "left_semi")
    tree = near.select(F.lit(0).cast("bigint").alias("origin"), F.col("node_id").alias("node"), "parent")
    starts = taken.select(F.lit(0).cast("bigint").alias("origin"), F.explode(F.array("u", "v")).alias("node"))
    steps = walk_back(tree, starts).select("src", "dst").union(taken.select("u", "v"))
    path = extract_subgraph(edges.select("src", "dst", "weight"), steps)
    return now.union(path).distinct()
