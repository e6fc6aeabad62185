"""Queries: export layers, reports, lookups and sources on the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import geo

from .operators import reports as R
from .operators import solvers as S

from .plans.fixtures import Fixtures, oracle

from .queries_build import CHORDS, _CROSS, _points, _segments
from .queries_graph import CLOSURE_TREE, _edges
from .sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    def keep(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = oracle(sql, more)
        return fn

    return keep


def _solution(fx: Fixtures) -> DataFrame:
    return S.mst_approximation(_edges(fx), fx.terminals).edges


SOLVED = CLOSURE_TREE + ", so AS (SELECT e.src, e.dst, e.w_mm AS weight FROM fx_edges e JOIN steps s ON s.src = e.src AND s.dst = e.dst)"
_IN = "(SELECT node_id FROM fx_terminals)"
_DEG = "dg AS (SELECT n.node_id, count(a.a) AS degree FROM fx_nodes n LEFT JOIN fx_adj a ON a.a = n.node_id GROUP BY n.node_id)"


@query("SELECT n.node_id, n.lon_u, n.lat_u, degree, t.node_id IS NOT NULL AS is_terminal, CASE WHEN t.node_id IS NOT NULL THEN 'terminal' WHEN degree > 2 THEN 'junction' ELSE 'intermediate' END AS node_type FROM fx_nodes n JOIN dg ON dg.node_id = n.node_id LEFT JOIN fx_terminals t ON t.node_id = n.node_id", _DEG)
def export_graph_nodes(fx):
    return R.graph_nodes_layer(fx.nodes, _edges(fx), fx.terminals)


@query("SELECT e.src AS from_node, e.dst AS to_node, w_mm / 1000 AS weight_m, w_mm / 1000 / 1000 AS weight_km, w_mm / 1000 / 1609.34 AS weight_mi, a.lon_u AS x1, a.lat_u AS y1, b.lon_u AS x2, b.lat_u AS y2 FROM fx_edges e JOIN fx_nodes a ON a.node_id = e.src JOIN fx_nodes b ON b.node_id = e.dst")
def export_graph_edges(fx):
    a, b = F.get("geometry", F.lit(0)), F.get("geometry", F.lit(1))
    return R.graph_edges_layer(fx.nodes, _edges(fx)).select("from_node", "to_node", "weight_m", "weight_km", "weight_mi", a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))


@query("SELECT n.node_id, n.lon_u, n.lat_u, degree, m.loc_count FROM (SELECT (c_custkey * 31) % n AS node_id, count(*) AS loc_count FROM customer CROSS JOIN fx_dim GROUP BY 1) m JOIN fx_nodes n ON n.node_id = m.node_id JOIN dg ON dg.node_id = n.node_id", _DEG)
def export_terminals(fx):
    loc_map = fx.locations.select("loc_id", ((F.col("loc_id") * 31) % fx.n).alias("node_id"))
    return R.terminals_layer(fx.nodes, _edges(fx), loc_map)


@query(f"SELECT src, dst, weight, CASE (src IN {_IN})::INT + (dst IN {_IN})::INT WHEN 2 THEN 'terminal-terminal' WHEN 1 THEN 'terminal-steiner' ELSE 'steiner-steiner' END AS edge_type, 'mst_approximation' AS algorithm FROM so", SOLVED)
def solution_edges_typed(fx):
    return R.solution_edges_typed(_solution(fx), fx.terminals, "mst_approximation")


@query(
    f"""SELECT n.node_id, n.lon_u, n.lat_u, d.degree, n.node_id IN {_IN} AS is_terminal, n.node_id NOT IN {_IN} AS is_steiner, CASE WHEN n.node_id IN {_IN} THEN 'terminal' ELSE 'steiner' END AS node_type, 'mst_approximation' AS algorithm
  FROM (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM so UNION ALL SELECT dst FROM so) GROUP BY node_id) d JOIN fx_nodes n ON n.node_id = d.node_id""",
    SOLVED,
)
def solution_nodes_typed(fx):
    return R.solution_nodes_typed(_solution(fx), fx.nodes, fx.terminals, "mst_approximation")


@query(f"SELECT src, dst, weight, src IN {_IN} OR dst IN {_IN} AS is_terminal_edge FROM so", SOLVED)
def solution_frame(fx):
    return R.solution_frame(_solution(fx), fx.terminals)


_TWO = "two AS (SELECT 'all' AS algorithm, src, dst, w_mm AS weight FROM fx_edges UNION ALL SELECT 'right', src, dst, w_mm FROM fx_edges WHERE dst = src + 1)"


@query(
    """SELECT t.algorithm, mm / 1000 AS total_meters, mm / 1000 / 1000 AS total_kilometers, mm / 1000 / 1609.34 AS total_miles, mm / 1000 * 3.28084 AS total_feet, node_count, edge_count
  FROM (SELECT algorithm, CAST(sum(weight) AS BIGINT) AS mm, count(*) AS edge_count FROM two GROUP BY algorithm) t
  JOIN (SELECT algorithm, count(DISTINCT n) AS node_count FROM (SELECT algorithm, src AS n FROM two UNION ALL SELECT algorithm, dst FROM two) GROUP BY algorithm) c ON c.algorithm = t.algorithm""",
    _TWO,
)
def mileage_summary(fx):
    edges = _edges(fx)
    both = edges.withColumn("algorithm", F.lit("all")).unionByName(edges.where("dst = src + 1").withColumn("algorithm", F.lit("right")))
    return R.mileage_summary(both)


@query("SELECT mm / 1000 AS meters, mm / 1000 / 1000 AS kilometers, mm / 1000 / 1609.34 AS miles, mm / 1000 * 3.28084 AS feet FROM (SELECT CAST(sum(w_mm) AS BIGINT) AS mm FROM fx_edges)")
def mileage_report(fx):
    m = F.sum("weight") / 1000
    return _edges(fx).agg(m.alias("meters"), (m / 1000).alias("kilometers"), (m / geo.MILE_EXPORT).alias("miles"), (m * geo.FEET).alias("feet"))


_RES = "VALUES ('a', 12345.0, 10, 9), ('b', 11000.0, 9, 8), ('c', CAST('Infinity' AS DOUBLE), 0, 0), ('d', 11000.0, 9, 8)"


@query(
    f"""SELECT algorithm, CASE WHEN meters = 'Infinity' THEN 'FAILED' ELSE printf('%.2f', meters / 1000) || 'km' END AS distance, nodes, edges,
  CASE WHEN meters = 'Infinity' THEN '-' WHEN meters > best THEN '+' || printf('%.1f', (meters - best) / best * 100) || '%' ELSE 'BEST' END AS vs_best
  FROM (SELECT *, min(meters) OVER () AS best FROM ({_RES}) t(algorithm, meters, nodes, edges))"""
)
def benchmark_summary(fx):
    rows = [("a", 12345.0, 10, 9), ("b", 11000.0, 9, 8), ("c", float("inf"), 0, 0), ("d", 11000.0, 9, 8)]
    return R.benchmark_summary(fx.spark.createDataFrame(rows, "algorithm string, meters double, nodes int, edges int"))


@query()
def benchmark_rows(fx):
    """Two solvers on the network, one row each."""
    from .api import benchmark

    return benchmark(fx.spark, {"grid": (_edges(fx), fx.terminals)}, ["mst_approximation", "pruned_dijkstra"]).drop("seconds")


INFRA = """
inf AS (SELECT event_id AS id, -73900000 + (event_id * 7919) % (w * 1000) AS x, 42600000 + (event_id * 104729) % (w * 1000) AS y,
  CASE event_type WHEN 'signup' THEN 'Railroad' WHEN 'error' THEN 'Tunnel' ELSE 'Bridges' END AS type FROM events CROSS JOIN fx_dim WHERE event_type IN ('signup', 'error', 'purchase')),
""" + CHORDS


def _infra(fx: Fixtures) -> DataFrame:
    k, side = F.col("event_id"), fx.w * 1000
    kind = F.when(F.col("event_type") == "signup", "Railroad").when(F.col("event_type") == "error", "Tunnel").otherwise("Bridges")
    return fx.table("events").where(F.col("event_type").isin("signup", "error", "purchase")).select(k.alias("id"), (-73900000 + (k * 7919) % side).alias("x"), (42600000 + (k * 104729) % side).alias("y"), kind.alias("type"))


_NEAR = _CROSS.replace("l.lon_u", "i.x").replace("l.lat_u", "i.y")


@query(f"SELECT count(*) FILTER (type = 'Railroad') AS railroads, count(*) FILTER (type = 'Tunnel') AS tunnels, count(*) FILTER (type = 'Bridges') AS bridges FROM inf i WHERE EXISTS (SELECT 1 FROM ch WHERE ch.src % 2 = 0 AND {_NEAR} <= 400)", INFRA)
def infra_crossings(fx):
    near = R.crossings_near(_infra(fx), _segments(fx).where("src % 2 = 0"), 20)
    count = lambda t: F.count_if(F.col("type") == t)
    return near.agg(count("Railroad").alias("railroads"), count("Tunnel").alias("tunnels"), count("Bridges").alias("bridges"))


@query(f"SELECT (SELECT count(*) FROM fx_locations) AS points, count(*) AS on_road, count(*) * 2 > (SELECT count(*) FROM fx_locations) AS connected FROM fx_locations l JOIN ch ON {_CROSS} <= 40000", CHORDS)
def connected_component_vote(fx):
    return R.connected_vote(_points(fx.locations, "loc_id"), _segments(fx), 200)


@query(
    """SELECT 'demo' AS cluster_name, locations, h(road / 1609344.0) AS road_miles_x100, h(locations / (road / 1609344.0)) AS locations_per_mile_x100, units, h(units / (road / 1609344.0)) AS units_per_mile_x100,
  h(drops / 1609344.0 / locations) AS average_drop_miles_x100, railroads, tunnels, bridges FROM (SELECT count(*) AS locations, CAST(sum(unit_count) AS BIGINT) AS units FROM fx_locations),
  (SELECT CAST(sum(w_mm) AS BIGINT) AS road FROM fx_edges), (SELECT CAST(sum(loc_id * 10) AS BIGINT) AS drops FROM fx_locations),
  (SELECT count(*) FILTER (type = 'Railroad') AS railroads, count(*) FILTER (type = 'Tunnel') AS tunnels, count(*) FILTER (type = 'Bridges') AS bridges FROM inf)""".replace("h(", "hh("),
    INFRA,
)
def cluster_summary(fx):
    drops = fx.locations.select((F.col("loc_id") * 10).alias("mm"))
    return R.cluster_summary("demo", fx.locations, _edges(fx).select(F.col("weight").alias("mm")), drops, _infra(fx))


def _rounded(sql: str) -> str:
    """hh(v) in the statement: v in whole hundredths."""
    out, at = "", 0
    while (i := sql.find("hh(", at)) >= 0:
        depth, j = 1, i + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + f"CAST(floor(({sql[i + 3 : j - 1]}) * 100 + 0.5) AS BIGINT)"
        at = j
    return out + sql[at:]


ORACLES["cluster_summary"] = _rounded(ORACLES["cluster_summary"])
_BRANDS = "(SELECT DISTINCT p_brand AS b FROM part ORDER BY 1 LIMIT 3)"
BLOCKS = """
bl AS (SELECT p_brand AS provider, p_partkey AS block, greatest(least(lon_u + 1000, -73894500) - greatest(lon_u, -73898500), 0) * greatest(least(lat_u + 1000, 42605500) - greatest(lat_u, 42601500), 0) AS area
  FROM part JOIN fx_nodes ON node_id = p_partkey)
"""


def _blocks(fx: Fixtures) -> DataFrame:
    part = fx.table("part").select(F.col("p_brand").alias("provider"), F.col("p_partkey").alias("block"))
    area = geo.box_overlap(F.col("lon_u"), F.col("lat_u"), F.col("lon_u") + 1000, F.col("lat_u") + 1000, (-73898500, 42601500, -73894500, 42605500))
    return fx.nodes.join(part, F.col("node_id") == F.col("block")).select("provider", "block", area.cast("bigint").alias("area"))


@query("SELECT provider, block FROM bl WHERE area > 0", BLOCKS)
def provider_blocks(fx):
    return _blocks(fx).where("area > 0").select("provider", "block")


@query(
    f"""SELECT CAST(row_number() OVER (ORDER BY pin, CASE WHEN pin = 0 THEN area END, provider) AS INTEGER) AS position, provider, area FROM (SELECT provider, CAST(sum(area) AS BIGINT) AS area,
  coalesce((SELECT rk FROM (SELECT b, row_number() OVER (ORDER BY b) AS rk FROM {_BRANDS}) WHERE b = provider), 0) AS pin FROM bl GROUP BY provider)""",
    BLOCKS,
)
def provider_share(fx):
    blocks = _blocks(fx)
    pinned = tuple(r[0] for r in blocks.select("provider").distinct().orderBy("provider").limit(3).collect())
    return R.provider_share(blocks, pinned)


@query("SELECT DISTINCT l_partkey AS block, l_suppkey AS provider FROM lineitem")
def dedupe_blocks(fx):
    return fx.table("lineitem").select(F.col("l_partkey").alias("block"), F.col("l_suppkey").alias("provider")).dropDuplicates(["block", "provider"])


@query("SELECT count(DISTINCT (lon_u, lat_u)) AS n FROM fx_locations")
def distinct_locations(fx):
    return fx.locations.agg(F.countDistinct("lon_u", "lat_u").alias("n"))


@query("SELECT l.src, l.dst, l.w_mm AS weight, r.tag FROM fx_edges l JOIN (SELECT src, dst, w_mm % 7 AS tag FROM fx_edges WHERE w_mm % 3 = 0) r ON r.src = l.src AND r.dst = l.dst")
def edge_backjoin(fx):
    tagged = _edges(fx).where("weight % 3 = 0").select("src", "dst", (F.col("weight") % 7).alias("tag"))
    return _edges(fx).join(tagged, ["src", "dst"]).select("src", "dst", "weight", "tag")


@query("SELECT a.loc_id, b.unit_count FROM fx_locations a LEFT JOIN (SELECT lon_u, lat_u, unit_count FROM fx_locations WHERE loc_id % 3 = 0) b ON b.lon_u = a.lon_u AND b.lat_u = a.lat_u")
def unit_count_join(fx):
    units = fx.locations.where("loc_id % 3 = 0").select("lon_u", "lat_u", "unit_count")
    return fx.locations.select("loc_id", "lon_u", "lat_u").join(units, ["lon_u", "lat_u"], "left").select("loc_id", "unit_count")


@query("SELECT n_regionkey AS region FROM (SELECT n_regionkey, min(n_nationkey) * 300 AS lo, max(n_nationkey) * 300 AS hi FROM nation GROUP BY n_regionkey), (SELECT CAST(floor(avg(loc_id)) AS BIGINT) AS c FROM fx_locations) WHERE c BETWEEN lo AND hi")
def centroid_lookup(fx):
    """Regions as ranges along one axis; those that hold the locations' centre."""
    boxes = fx.table("nation").groupBy("n_regionkey").agg((F.min("n_nationkey") * 300).alias("lo"), (F.max("n_nationkey") * 300).alias("hi"))
    centre = fx.locations.agg(F.floor(F.avg("loc_id")).alias("c"))
    return boxes.join(F.broadcast(centre), F.col("c").between(F.col("lo"), F.col("hi"))).select(F.col("n_regionkey").alias("region"))


_LIMITS = [("AUTOMOBILE", 200, True, False, True), ("BUILDING", 400, True, True, False), ("FURNITURE", 100, False, True, True), ("MACHINERY", 350, True, True, True)]


@query(
    f"""SELECT client, region, wanted, CASE WHEN most IS NULL THEN 'unknown client' WHEN NOT coalesce(CASE region WHEN 'r0' THEN r0 WHEN 'r1' THEN r1 WHEN 'r2' THEN r2 END, false) THEN 'region not allowed'
  WHEN wanted > most THEN 'too many locations' ELSE 'ok' END AS verdict FROM (SELECT c_mktsegment AS client, 'r' || (c_nationkey % 4) AS region, count(*) AS wanted FROM customer GROUP BY 1, 2) q
  LEFT JOIN (VALUES {', '.join(str(r).replace('True', 'true').replace('False', 'false') for r in _LIMITS)}) l(c, most, r0, r1, r2) ON l.c = q.client"""
)
def entitlement_check(fx):
    wanted = fx.table("customer").groupBy(F.col("c_mktsegment").alias("client"), F.concat(F.lit("r"), (F.col("c_nationkey") % 4).cast("string")).alias("region")).agg(F.count("*").alias("wanted"))
    return R.entitlement(wanted, fx.spark.createDataFrame(_LIMITS, "client string, most int, r0 boolean, r1 boolean, r2 boolean"))


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')")
def road_class_filter(fx):
    roads = fx.table("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("road_type"), F.col("o_orderpriority").alias("mtfcc"))
    return R.road_class_filter(roads, ["1-URGENT", "2-HIGH", "5-LOW"], "F").select("o_orderkey")


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def roads_by_state(fx):
    state = fx.table("nation").agg(F.min("n_name")).first()[0]
    nation = fx.table("nation").where(F.col("n_name") == state).select(F.col("n_nationkey").alias("c_nationkey"))
    customer = fx.table("customer").join(nation, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return fx.table("orders").join(customer, "o_custkey", "left_semi").select("o_orderkey")


# Sources


@query("SELECT road_id, pos, lon_u / 1e6 AS x, lat_u / 1e6 AS y FROM fx_road_vertices")
def scan_roads(fx):
    """Lines written as GeoJSON and read back."""
    v = fx.road_vertices
    lines = v.groupBy("road_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("lon_u") / 1e6).alias("x"), (F.col("lat_u") / 1e6).alias("y")))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("geom"))
    path = writers.write_geojson(lines, "road_id", "geom", writers.fresh_path(fx.spark, "roads"))
    back = readers.read_geojson(fx.spark, path)
    return back.select(F.col("properties.road_id").cast("bigint").alias("road_id"), F.posexplode("geom").alias("pos", "p")).select("road_id", F.col("pos").cast("bigint").alias("pos"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("SELECT loc_id, lon_u / 1e6 AS x, lat_u / 1e6 AS y FROM fx_locations")
def scan_locations(fx):
    """Points written as GeoJSON and read back, single points passing the gate."""
    points = fx.locations.select("loc_id", F.array(F.struct((F.col("lon_u") / 1e6).alias("x"), (F.col("lat_u") / 1e6).alias("y"))).alias("geom"))
    path = writers.write_geojson(points, "loc_id", "geom", writers.fresh_path(fx.spark, "locations"), kind="Point")
    back = readers.read_geojson(fx.spark, path)
    return readers.point_rows(back.select(F.col("properties.loc_id").cast("bigint").alias("loc_id"), "kind", F.col("geom").alias("points"))).select("loc_id", "x", "y")


@query()
def graph_cache_key(fx):
    return fx.spark.createDataFrame([(writers.content_key(fx.road_vertices, precision=6, snap=1.0),)], "key string")
