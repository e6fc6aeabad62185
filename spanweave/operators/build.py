"""From polylines to a graph. Lines come as vertices (road_id, pos, lon_u, lat_u) in millionths of a degree.

A vertex is a node if it ends a line or occurs more than once anywhere; nodes closer than the tolerance
become one; lines are cut at nodes. Closed pieces and further roads between the same two nodes are kept
by a virtual node at their middle; a road whose length is within one per cent of one already there is
taken for the same road.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.store import written
from .graph import connected_components
from .spatial import within

#: Two lengths count as one road if they differ by less than this share of the longer one.
SAME_PERCENT = 1
SNAP_M = 1.0

Length = Callable[[Column, Column, Column, Column], Column]


def extract_lines(vertices: DataFrame) -> DataFrame:
    """Vertices with both coordinates of lines that have at least two such."""
    sound = vertices.where("lon_u is not null and lat_u is not null")
    lines = sound.groupBy("road_id").agg(F.count("*").alias("n")).where("n >= 2").select("road_id")
    return sound.join(lines, "road_id", "left_semi")


def explode_lines(lines: DataFrame) -> DataFrame:
    """lines (road_id, geom array<struct<x,y>> in degrees) to vertices."""
    each = lines.select("road_id", F.posexplode("geom").alias("pos", "p"))
    return each.select("road_id", F.col("pos").cast("bigint").alias("pos"), geo.micro(F.col("p.x")).alias("lon_u"), geo.micro(F.col("p.y")).alias("lat_u"))


def vertex_counts(vertices: DataFrame) -> DataFrame:
    """(lon_u, lat_u, n, is_end): every occurrence counts, also within one line."""
    line = Window.partitionBy("road_id")
    marked = vertices.withColumn("end", (F.col("pos") == F.min("pos").over(line)) | (F.col("pos") == F.max("pos").over(line)))
    return marked.groupBy("lon_u", "lat_u").agg(F.count("*").alias("n"), F.max("end").alias("is_end"))


def identify_nodes(vertices: DataFrame) -> DataFrame:
    return vertex_counts(vertices).where("is_end or n > 1").select("lon_u", "lat_u")


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with consecutive ids in the order of unique columns. Ranges are numbered side by side; only one
    count a range reaches the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dict(ranged.groupBy("_part").count().collect())
    offset, table = start, {}
    for part in sorted(counts):
        table[part] = offset
        offset += counts[part]
    if not table:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    firsts = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, (F.element_at(firsts, F.col("_part")) + row - 1).cast("bigint")).drop("_part")


def snap_pairs(nodes: DataFrame, tolerance_m: float = SNAP_M) -> DataFrame:
    """(a_lon, a_lat, b_lon, b_lat): pairs within tolerance * 1e-5 degrees in the plane and within the tolerance
    on the ellipsoid; a stands before b by coordinates."""
    reach = max(1, round(tolerance_m * 10))
    points = nodes.select("lon_u", "lat_u", F.col("lon_u").alias("x"), F.col("lat_u").alias("y"))
    near = within(points, points, reach).where("l_lon_u < r_lon_u or (l_lon_u = r_lon_u and l_lat_u < r_lat_u)")
    metres = geo.short_geodesic(*(F.col(c) / 1e6 for c in ("l_lon_u", "l_lat_u", "r_lon_u", "r_lat_u")))
    return near.where(metres <= tolerance_m).select(F.col("l_lon_u").alias("a_lon"), F.col("l_lat_u").alias("a_lat"), F.col("r_lon_u").alias("b_lon"), F.col("r_lat_u").alias("b_lat"))


def number_nodes(nodes: DataFrame, tolerance_m: float = SNAP_M) -> tuple[DataFrame, DataFrame]:
    """(ids, map): ids (node_id, lon_u, lat_u), clusters numbered by their smallest (lon, lat), which is also
    their place; map (lon_u, lat_u, node_id) of every vertex that is a node."""
    plain = written(dense_ids(nodes.select("lon_u", "lat_u").distinct(), ["lon_u", "lat_u"], "k"), "plain")
    place = lambda p, k: plain.select(F.col("lon_u").alias(f"{p}_lon"), F.col("lat_u").alias(f"{p}_lat"), F.col("k").alias(k))
    pairs = snap_pairs(plain, tolerance_m).join(place("a", "src"), ["a_lon", "a_lat"]).join(place("b", "dst"), ["b_lon", "b_lat"]).select("src", "dst")
    names = connected_components(plain.select(F.col("k").alias("node_id")), written(pairs, "pairs"))
    member = plain.join(names, F.col("k") == F.col("node_id")).select("lon_u", "lat_u", "k", "component")
    heads = written(dense_ids(member.where("k = component").select("component", "lon_u", "lat_u"), ["lon_u", "lat_u"], "node_id"), "heads")
    mapped = member.select("lon_u", "lat_u", "component").join(heads.select("component", "node_id"), "component")
    return heads.select("node_id", "lon_u", "lat_u"), written(mapped.select("lon_u", "lat_u", "node_id"), "node_map")


def segment_lengths(vertices: DataFrame, length: Length = geo.haversine_mm) -> DataFrame:
    """(road_id, pos, step): the length from the vertex before to each vertex but the first."""
    order = Window.partitionBy("road_id").orderBy("pos")
    before = vertices.withColumn("lon0", F.lag("lon_u").over(order)).withColumn("lat0", F.lag("lat_u").over(order))
    return before.where("lon0 is not null").withColumn("step", length(F.col("lon0"), F.col("lat0"), F.col("lon_u"), F.col("lat_u"))).select("road_id", "pos", "step")


def line_segments(vertices: DataFrame, node_map: DataFrame, length: Length = geo.haversine_mm) -> DataFrame:
    """(road_id, seg, u, v, weight, first_pos, last_pos): lines cut at every node vertex."""
    order = Window.partitionBy("road_id").orderBy("pos")
    marked = vertices.join(node_map, ["lon_u", "lat_u"], "left")
    for c in ("lon_u", "lat_u", "node_id", "pos"):
        marked = marked.withColumn(f"{c}0", F.lag(c).over(order))
    seg = F.sum(F.when(F.col("node_id0").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    steps = marked.withColumn("seg", seg).where("pos0 is not null").withColumn("step", length(F.col("lon_u0"), F.col("lat_u0"), F.col("lon_u"), F.col("lat_u")))
    ends = steps.groupBy("road_id", "seg").agg(F.max("node_id0").alias("u0"), F.min_by("node_id0", "pos").alias("u"), F.max_by("node_id", "pos").alias("v"), F.sum("step").alias("weight"), F.min("pos0").alias("first_pos"), F.max("pos").alias("last_pos"))
    return ends.select("road_id", F.col("seg").cast("bigint").alias("seg"), "u", "v", "weight", "first_pos", "last_pos")


def dedupe_parallel(segments: DataFrame) -> DataFrame:
    """segments with kind: 'edge' (the first between its nodes), 'parallel' (another road between them) or 'loop';
    same roads again are left out. In order of (road_id, seg), a length is held against all kept before it.
    Equal lengths are reduced to the first one before a pair's lengths come together."""
    loops = segments.where("u = v").withColumn("kind", F.lit("loop"))
    pairs = segments.where("u <> v").withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v"))
    firsts = pairs.groupBy("lo", "hi", "weight").agg(F.min(F.struct("road_id", "seg")).alias("at"))
    order = F.sort_array(F.collect_list(F.struct(F.col("at.road_id").alias("road_id"), F.col("at.seg").alias("seg"), "weight")))
    listed = firsts.groupBy("lo", "hi").agg(order.alias("all"))

    def fold(kept: Column, s: Column) -> Column:
        same = lambda k: (F.greatest(k.weight, s.weight) > 0) & (F.abs(k.weight - s.weight) * 100 < SAME_PERCENT * F.greatest(k.weight, s.weight))
        return F.when(F.exists(kept, same), kept).otherwise(F.array_append(kept, s))

    kept = listed.select(F.posexplode(F.aggregate("all", F.slice("all", 1, 1), fold)).alias("nth", "k"))
    kept = kept.select(F.col("k.road_id").alias("road_id"), F.col("k.seg").alias("seg"), F.when(F.col("nth") == 0, "edge").otherwise("parallel").alias("kind"))
    return segments.join(kept, ["road_id", "seg"]).unionByName(loops)


def virtual_nodes(kept: DataFrame, first_id: int) -> DataFrame:
    """(road_id, seg, node_id): ids behind the real nodes' for loops and parallel roads, in road order."""
    return dense_ids(kept.where("kind <> 'edge'").select("road_id", "seg"), ["road_id", "seg"], "node_id", first_id)


def midpoints(vertices: DataFrame, virtual: DataFrame, kept: DataFrame) -> DataFrame:
    """(node_id, lon_u, lat_u): the middle of each virtual node's road, in whole millionths."""
    span = kept.join(virtual, ["road_id", "seg"]).select("road_id", "node_id", "first_pos", "last_pos")
    points = vertices.join(span, "road_id").where("pos between first_pos and last_pos")
    lines = points.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("lon_u").alias("x"), F.col("lat_u").alias("y")))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("line"))
    mid = lines.select("node_id", geo.interpolate(F.col("line"), geo.line_length(F.col("line")) / 2).alias("m"))
    return mid.select("node_id", F.floor(F.col("m.x") + 0.5).alias("lon_u"), F.floor(F.col("m.y") + 0.5).alias("lat_u"))


def graph_edges(kept: DataFrame, virtual: DataFrame) -> DataFrame:
    """(src, dst, weight, road_id, seg, kind): plain edges, and two halves for each virtual node."""
    same = ["road_id", "seg"]
    plain = kept.where("kind = 'edge'").select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "weight", *same, "kind")
    halves = kept.where("kind <> 'edge'").join(virtual, same)
    head = F.floor(F.col("weight") / 2).cast("bigint")
    one = halves.select(F.col("u").alias("src"), F.col("node_id").alias("dst"), head.alias("weight"), *same, "kind")
    two = halves.select(F.col("v").alias("src"), F.col("node_id").alias("dst"), (F.col("weight") - head).alias("weight"), *same, "kind")
    # Both halves of a loop join the same two nodes; a simple graph keeps one, the one written last.
    two_only = two.unionByName(one.join(kept.where("kind = 'loop'").select(*same), same, "left_anti"))
    return plain.unionByName(two_only)


def build_graph(vertices: DataFrame, tolerance_m: float = SNAP_M, length: Length = geo.haversine_mm) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the lines; empty tables for no lines."""
    vertices = written(extract_lines(vertices), "vertices")
    ids, node_map = number_nodes(identify_nodes(vertices), tolerance_m)
    kept = written(dedupe_parallel(line_segments(vertices, node_map, length)), "kept")
    virtual = written(virtual_nodes(kept, ids.count()), "virtual")
    nodes = ids.unionByName(midpoints(vertices, virtual, kept))
    return written(nodes, "nodes"), written(graph_edges(kept, virtual), "edges")


def endpoint_graph(vertices: DataFrame, length: Length = geo.haversine_mm) -> tuple[DataFrame, DataFrame]:
    """Only the ends of lines are nodes; of several lines between two ends the last one's length counts."""
    vertices = extract_lines(vertices)
    ends = vertices.groupBy("road_id").agg(F.min_by(F.struct("lon_u", "lat_u"), "pos").alias("a"), F.max_by(F.struct("lon_u", "lat_u"), "pos").alias("b"))
    sizes = segment_lengths(vertices, length).groupBy("road_id").agg(F.sum("step").alias("weight"))
    points = ends.select("a.*").union(ends.select("b.*")).distinct()
    nodes = written(dense_ids(points, ["lon_u", "lat_u"], "node_id"), "ends")
    named = lambda c, k: nodes.select(F.struct("lon_u", "lat_u").alias(c), F.col("node_id").alias(k))
    edges = ends.join(sizes, "road_id").join(named("a", "u"), "a").join(named("b", "v"), "b")
    edges = edges.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "weight", "road_id")
    return nodes.select("node_id", "lon_u", "lat_u"), edges.groupBy("src", "dst").agg(F.max_by("weight", "road_id").alias("weight"))


def load_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) from an edge table with an ordinal: one edge a pair, the last one."""
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    return edges.groupBy(*pair).agg(F.max_by("weight", "ordinal").alias("weight"))


def touching(vertices: DataFrame) -> DataFrame:
    """(road_id, lon_u, lat_u) distinct: lines touch where they share a vertex."""
    return vertices.select("road_id", "lon_u", "lat_u").distinct()


def road_components(vertices: DataFrame) -> DataFrame:
    """(road_id, component): roads that touch, directly or through others. A vertex links each of its roads to the
    smallest one only, so a vertex of many roads makes as many links as roads."""
    at = written(touching(vertices), "touching")
    head = at.groupBy("lon_u", "lat_u").agg(F.min("road_id").alias("src"))
    links = at.join(head, ["lon_u", "lat_u"]).where("road_id <> src").select("src", F.col("road_id").alias("dst")).distinct()
    names = connected_components(at.select(F.col("road_id").alias("node_id")).distinct(), written(links, "links"))
    return names.select(F.col("node_id").alias("road_id"), "component")


def main_component_roads(vertices: DataFrame) -> DataFrame:
    """(road_id): the roads of the largest components; equally large ones all stay."""
    names = written(road_components(vertices), "road_names")
    sizes = names.groupBy("component").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n").alias("n"))
    return names.join(sizes.join(F.broadcast(largest), "n").select("component"), "component", "left_semi").select("road_id")


def sample_stretches(vertices: DataFrame, step: float) -> DataFrame:
    """vertices (road_id, pos, x, y) to the segments (road_id, nth, x1, y1, x2, y2, done, end, size, more, first, last)
    of lines of at least two; done and end are places along the line, and samples that may lie on a segment, at
    multiples of `step`, are the first to last ones."""
    order = Window.partitionBy("road_id").orderBy("pos")
    sound = vertices.where("x is not null and y is not null")
    steps = sound.select("road_id", "pos", F.lag("x").over(order).alias("x1"), F.lag("y").over(order).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.lead("x").over(order).isNotNull().alias("more"))
    steps = steps.where("x1 is not null").withColumn("size", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    steps = steps.withColumn("nth", F.row_number().over(order)).withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("done", F.coalesce(F.lag("end").over(order), F.lit(0.0))).drop("pos")
    return steps.withColumn("first", F.floor(F.col("done") / step)).withColumn("last", F.floor(F.col("end") / step))


def sample_points(stretches: DataFrame, step: float) -> DataFrame:
    """(road_id, i, x, y): the point i * step along each line, up to its length. A sample on a vertex belongs to the
    segment that ends there; quotients round, so products decide."""
    each = stretches.select("*", F.explode(F.sequence("first", F.col("last") + F.when(F.col("more"), 1).otherwise(0))).alias("i"))
    at = F.col("i") * F.lit(float(step))
    own = F.when(F.col("i") == 0, F.col("nth") == 1).otherwise((at > F.col("done")) & (~F.col("more") | (at <= F.col("end"))))
    t = F.when(F.col("size") > 0, F.least(F.lit(1.0), (at - F.col("done")) / F.col("size"))).otherwise(F.lit(0.0))
    return each.where(own).select("road_id", "i", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))
