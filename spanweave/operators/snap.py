"""Mapping locations onto the network by splitting edges.

Edges are straight here: segments (src, dst, weight, x1, y1, x2, y2) with ends in millionths of a degree;
a polyline edge is one row a piece (see functions.geo for places along whole lines). All steps are pure:
they return new tables and leave the given graph as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .build import dense_ids
from .spatial import near_segments, nearest

MAX_SNAP_M, ENDPOINT_M = 100.0, 15.0
METRES_PER_DEGREE = 111_000


def chords(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the coordinates of their ends as straight geometry."""
    end = lambda c, i: nodes.select(F.col("node_id").alias(c), F.col("lon_u").alias(f"x{i}"), F.col("lat_u").alias(f"y{i}"))
    return edges.join(end("src", 1), "src").join(end("dst", 2), "dst")


def nearest_edge(locations: DataFrame, segments: DataFrame, max_m: float = MAX_SNAP_M) -> DataFrame:
    """(loc_id, src, dst, dist_mm, along, px, py, du_mm, dv_mm): each location's nearest edge within max_m metres
    (0 or none: the default). Candidates come from twice that distance in degrees; the nearest by
    great-circle distance to the planar projection wins, ties go to the smaller ends."""
    max_m = max_m or MAX_SNAP_M
    reach = 2 * max_m / METRES_PER_DEGREE * 1e6
    points = locations.select(F.col("loc_id").alias("id"), F.col("lon_u").alias("x"), F.col("lat_u").alias("y"))
    met = near_segments(points, segments, reach)
    mm = lambda x, y: geo.haversine_mm(F.col("p_x"), F.col("p_y"), F.col(x), F.col(y))
    along = F.hypot(F.col("px") - F.col("x1"), F.col("py") - F.col("y1"))
    rated = met.select(F.col("p_id").alias("loc_id"), F.struct(mm("px", "py").alias("dist_mm"), "src", "dst", along.alias("along"), "px", "py", mm("x1", "y1").alias("du_mm"), mm("x2", "y2").alias("dv_mm")).alias("k"))
    # Structs are compared by a sort: it runs a shuffle partition at a time, not over all that a scan's task has joined.
    best = rated.repartition("loc_id").groupBy("loc_id").agg(F.min("k").alias("k"))
    return best.select("loc_id", "k.*").where(F.col("dist_mm") <= max_m * 1000)


def endpoint_snap(found: DataFrame) -> DataFrame:
    """found with mode and node_id: locations within ENDPOINT_M of an end (measured from the location, the first
    end first) take it; the others split the edge, or take its first end where they project onto it."""
    limit = ENDPOINT_M * 1000
    mode = F.when(F.col("du_mm") <= limit, "u").when(F.col("dv_mm") <= limit, "v").when(F.col("along") <= 0, "head").otherwise("split")
    node = F.when(F.col("du_mm") <= limit, F.col("src")).when(F.col("dv_mm") <= limit, F.col("dst")).when(F.col("along") <= 0, F.col("src"))
    return found.withColumn("mode", mode).withColumn("node_id", node)


def split_edges(edges: DataFrame, segments: DataFrame, found: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, new_nodes, loc_map). Each split place is one new node, shared by locations that project onto it;
    pieces share the weight in proportion to their length and add up to it."""
    snapped = endpoint_snap(found)
    places = snapped.where("mode = 'split'").groupBy("src", "dst", "along").agg(F.min(F.struct("px", "py")).alias("p")).select("src", "dst", "along", "p.*")
    new = dense_ids(places, ["src", "dst", "along"], "new_id", next_id)
    length = segments.select("src", "dst", "weight", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"))
    order = Window.partitionBy("src", "dst").orderBy("along")
    at = new.join(length, ["src", "dst"]).withColumn("cum", F.floor(F.col("weight") * F.least(F.lit(1.0), F.col("along") / F.col("length"))).cast("bigint"))
    at = at.withColumn("from", F.coalesce(F.lag("new_id").over(order), F.col("src"))).withColumn("was", F.coalesce(F.lag("cum").over(order), F.lit(0)))
    at = at.withColumn("next", F.lead("new_id").over(order))
    heads = at.select(F.col("from").alias("a"), F.col("new_id").alias("b"), (F.col("cum") - F.col("was")).alias("weight"))
    tails = at.where("next is null").select(F.col("new_id").alias("a"), F.col("dst").alias("b"), (F.col("weight") - F.col("cum")).alias("weight"))
    whole = edges.select("src", "dst", "weight").join(places.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    pieces = heads.unionByName(tails).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
    nodes = new.select(F.col("new_id").alias("node_id"), F.floor(F.col("px") + 0.5).alias("lon_u"), F.floor(F.col("py") + 0.5).alias("lat_u"))
    mapped = snapped.join(new.select("src", "dst", "along", "new_id"), ["src", "dst", "along"], "left")
    loc_map = mapped.select("loc_id", F.coalesce("node_id", "new_id").alias("node_id"), "dist_mm", "mode")
    return whole.unionByName(pieces), nodes, loc_map


def terminal_stats(locations: DataFrame, loc_map: DataFrame) -> DataFrame:
    """One row: locations, snapped, skipped, terminals."""
    counted = loc_map.agg(F.count("*").alias("snapped"), F.countDistinct("node_id").alias("terminals"))
    return locations.agg(F.count("*").alias("locations")).join(counted).select("locations", "snapped", (F.col("locations") - F.col("snapped")).alias("skipped"), "terminals")


def sample_terminals(terminals: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most `most` terminals in the order of a seeded hash."""
    return terminals.select("node_id").orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(most)


def snap_to_nodes(locations: DataFrame, nodes: DataFrame, radius: float, cutoff: float | None = None) -> DataFrame:
    """(loc_id, node_id, d2): the nearest node in the plane, at most cutoff away."""
    q = locations.select(F.col("loc_id").alias("id"), F.col("lon_u").alias("x"), F.col("lat_u").alias("y"))
    p = nodes.select(F.col("node_id").alias("id"), F.col("lon_u").alias("x"), F.col("lat_u").alias("y"))
    found = nearest(q, p, 1, radius).select(F.col("q_id").alias("loc_id"), F.col("id").alias("node_id"), "d2")
    return found if cutoff is None else found.where(F.col("d2") <= cutoff * cutoff)
