"""Export layers, reports and the lookups around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .graph import degree, nodes_of

PINNED = ("Starlink", "Viasat", "HughesNet")


def graph_nodes_layer(nodes: DataFrame, edges: DataFrame, terminals: DataFrame) -> DataFrame:
    marked = terminals.select("node_id", F.lit(True).alias("t")).distinct()
    kind = F.when(F.col("is_terminal"), "terminal").when(F.col("degree") > 2, "junction").otherwise("intermediate")
    joined = nodes.join(degree(nodes, edges), "node_id").join(marked, "node_id", "left").withColumn("is_terminal", F.coalesce("t", F.lit(False)))
    return joined.select("node_id", "lon_u", "lat_u", "degree", "is_terminal", kind.alias("node_type"))


def graph_edges_layer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """from_node, to_node, weight_m, weight_km, weight_mi and a straight geometry; edges of unplaced nodes are left out."""
    end = lambda c, p: nodes.where("lon_u is not null and lat_u is not null").select(F.col("node_id").alias(c), F.struct(F.col("lon_u").alias("x"), F.col("lat_u").alias("y")).alias(p))
    joined = edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    metres = F.col("weight") / 1000
    return joined.select(F.col("src").alias("from_node"), F.col("dst").alias("to_node"), metres.alias("weight_m"), (metres / 1000).alias("weight_km"), (metres / geo.MILE_EXPORT).alias("weight_mi"), F.array("a", "b").alias("geometry"))


def terminals_layer(nodes: DataFrame, edges: DataFrame, loc_map: DataFrame) -> DataFrame:
    per = loc_map.groupBy("node_id").agg(F.count("*").alias("loc_count"))
    return nodes.join(per, "node_id").join(degree(nodes, edges), "node_id").select("node_id", "lon_u", "lat_u", "degree", "loc_count")


def solution_edges_typed(solution: DataFrame, terminals: DataFrame, algorithm: str) -> DataFrame:
    mark = lambda c: terminals.select(F.col("node_id").alias(c), F.lit(1).alias(f"t_{c}")).distinct()
    ends = F.coalesce("t_src", F.lit(0)) + F.coalesce("t_dst", F.lit(0))
    kind = F.when(ends == 2, "terminal-terminal").when(ends == 1, "terminal-steiner").otherwise("steiner-steiner")
    joined = solution.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    return joined.select("src", "dst", "weight", kind.alias("edge_type"), F.lit(algorithm).alias("algorithm"))


def solution_nodes_typed(solution: DataFrame, nodes: DataFrame, terminals: DataFrame, algorithm: str) -> DataFrame:
    marked = terminals.select("node_id", F.lit(True).alias("t")).distinct()
    held = nodes_of(solution).union(terminals.select("node_id")).distinct()
    is_t = F.coalesce("t", F.lit(False))
    joined = held.join(nodes, "node_id").join(degree(held, solution), "node_id").join(marked, "node_id", "left")
    kind = F.when(is_t, "terminal").otherwise("steiner")
    return joined.select("node_id", "lon_u", "lat_u", "degree", is_t.alias("is_terminal"), (~is_t).alias("is_steiner"), kind.alias("node_type"), F.lit(algorithm).alias("algorithm"))


def solution_frame(solution: DataFrame, terminals: DataFrame) -> DataFrame:
    mark = lambda c: terminals.select(F.col("node_id").alias(c), F.lit(True).alias(f"t_{c}")).distinct()
    joined = solution.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    return joined.select("src", "dst", "weight", F.coalesce("t_src", "t_dst", F.lit(False)).alias("is_terminal_edge"))


def mileage_summary(solutions: DataFrame) -> DataFrame:
    """solutions (algorithm, src, dst, weight in mm) to one row an algorithm, shortest first."""
    total = solutions.groupBy("algorithm").agg(F.sum("weight").alias("mm"), F.count("*").alias("edge_count"))
    ends = solutions.select("algorithm", F.explode(F.array("src", "dst")).alias("n")).groupBy("algorithm").agg(F.countDistinct("n").alias("node_count"))
    m = F.col("mm") / 1000
    out = total.join(ends, "algorithm").select("algorithm", m.alias("total_meters"), (m / 1000).alias("total_kilometers"), (m / geo.MILE_EXPORT).alias("total_miles"), (m * geo.FEET).alias("total_feet"), "node_count", "edge_count")
    return out.orderBy("total_meters", "algorithm")


def benchmark_summary(results: DataFrame) -> DataFrame:
    """results (algorithm, meters, nodes, edges; Infinity: failed) with distance text and distance from the best."""
    # A row an algorithm: the window over all of them is small by nature.
    best = F.min("meters").over(Window.partitionBy())
    failed = F.col("meters") == F.lit(float("inf"))
    more = (F.col("meters") - best) / best * 100
    against = F.when(failed | (best <= 0), "-").when(more > 0, F.concat(F.lit("+"), F.format_string("%.1f", more), F.lit("%"))).otherwise("BEST")
    text = F.when(failed, "FAILED").otherwise(F.concat(F.format_string("%.2f", F.col("meters") / 1000), F.lit("km")))
    return results.select("algorithm", text.alias("distance"), "nodes", "edges", against.alias("vs_best"))


def cluster_summary(name: str, points: DataFrame, road_mm: DataFrame, drop_mm: DataFrame, crossings: DataFrame) -> DataFrame:
    """One row; miles and ratios in whole hundredths. points: unit_count; *_mm: one column mm; crossings: type."""
    mile = geo.MILE_REPORT * 1000
    hundredth = lambda v: F.floor(v * 100 + 0.5).cast("bigint")
    p = points.agg(F.count("*").alias("locations"), F.sum("unit_count").alias("units"))
    r = road_mm.agg(F.sum("mm").alias("road"))
    d = drop_mm.agg(F.sum("mm").alias("drops"))
    count = lambda t: F.count_if(F.col("type") == t)
    x = crossings.agg(count("Railroad").alias("railroads"), count("Tunnel").alias("tunnels"), count("Bridges").alias("bridges"))
    one = p.join(r).join(d).join(x)  # tables of one row
    miles = F.col("road") / mile
    return one.select(F.lit(name).alias("cluster_name"), "locations", hundredth(miles).alias("road_miles_x100"), hundredth(F.col("locations") / miles).alias("locations_per_mile_x100"), "units", hundredth(F.col("units") / miles).alias("units_per_mile_x100"), hundredth(F.col("drops") / mile / F.col("locations")).alias("average_drop_miles_x100"), "railroads", "tunnels", "bridges")


def provider_share(blocks: DataFrame, pinned: tuple[str, ...] = PINNED) -> DataFrame:
    """blocks (provider, area) to (position, provider, area): smallest share first, the pinned names last in
    their order; names that do not occur are left out."""
    total = blocks.groupBy("provider").agg(F.sum("area").alias("area"))
    place = F.coalesce(*[F.when(F.col("provider") == p, i + 1) for i, p in enumerate(pinned)], F.lit(0))
    order = Window.orderBy(place, F.when(place == 0, F.col("area")), "provider")  # a row a provider
    return total.select(F.row_number().over(order).alias("position"), "provider", "area")


def crossings_near(infra: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """infra points (id, x, y, type) at most radius from a segment, once each."""
    from .spatial import near_segments

    hit = near_segments(infra, segments, radius).select(F.col("p_id").alias("id")).distinct()
    return infra.join(hit, "id", "left_semi")


def connected_vote(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """One row: on_road counts every (point, segment) match; connected if that is more than half the points."""
    from .spatial import near_segments

    hits = near_segments(points, segments, radius).agg(F.count("*").alias("on_road"))
    return points.agg(F.count("*").alias("points")).join(hits).select("points", "on_road", (F.col("on_road") * 2 > F.col("points")).alias("connected"))


def entitlement(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """requests (client, region, wanted) against limits (client, most, and one boolean column a region): why not, or
    'ok'. The region's column is found by turning the columns into rows."""
    regions = [c for c in limits.columns if c not in ("client", "most")]
    rows = limits.unpivot(["client", "most"], regions, "region", "allowed")
    joined = requests.join(limits.select("client", F.lit(True).alias("known")), "client", "left").join(rows, ["client", "region"], "left")
    verdict: Column = F.when(F.col("known").isNull(), "unknown client").when(~F.coalesce("allowed", F.lit(False)), "region not allowed").when(F.col("wanted") > F.col("most"), "too many locations").otherwise("ok")
    return joined.select("client", "region", "wanted", verdict.alias("verdict"))


def road_class_filter(roads: DataFrame, classes: list[str], excluded: str = "I") -> DataFrame:
    """roads (road_type, mtfcc): not of the excluded type, of one of the classes, and with a type at all."""
    return roads.where(F.col("road_type").isNotNull() & (F.col("road_type") != excluded) & F.col("mtfcc").isin(classes))
