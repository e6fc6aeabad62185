"""Queries: graph operators and solvers on the derived grid network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import solvers as S
from .plans.fixtures import Fixtures, oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    """Register fn(fixtures) under its name, with its oracle statement over the fixtures."""

    def keep(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = oracle(sql, more)
        return fn

    return keep


def _edges(fx: Fixtures) -> DataFrame:
    return fx.edges.withColumnRenamed("w_mm", "weight")


#: Least distance and, among equals, least source for each node; parents are the least fitting neighbour.
VORONOI = """
vor(node, dist, source) USING KEY (node) AS (
  SELECT node_id, CAST(0 AS BIGINT), node_id FROM fx_terminals
  UNION
  SELECT x.node, x.st.d, x.st.s FROM (
    SELECT e.b AS node, min({'d': v.dist + e.w, 's': v.source}) AS st FROM vor v JOIN fx_adj e ON e.a = v.node GROUP BY e.b) x
  LEFT JOIN recurring.vor r ON r.node = x.node
  WHERE r.node IS NULL OR x.st.d < r.dist OR (x.st.d = r.dist AND x.st.s < r.source)),
vorp AS (SELECT v.node AS node_id, v.dist, v.source, coalesce(p.parent, v.node) AS parent FROM vor v LEFT JOIN (
  SELECT e.b AS node, min(e.a) AS parent FROM fx_adj e JOIN vor a ON a.node = e.a JOIN vor b ON b.node = e.b
  WHERE a.dist + e.w = b.dist AND a.source = b.source GROUP BY e.b) p ON p.node = v.node),
bor AS (SELECT least(a.source, b.source) AS t1, greatest(a.source, b.source) AS t2,
    min({'c': a.dist + e.w_mm + b.dist, 'u': least(e.src, e.dst), 'v': greatest(e.src, e.dst)}) AS k
  FROM fx_edges e JOIN vor a ON a.node = e.src JOIN vor b ON b.node = e.dst WHERE a.source <> b.source GROUP BY 1, 2)
"""
#: Distances from each terminal.
CLOSURE = """
far(origin, node, dist) USING KEY (origin, node) AS (
  SELECT node_id, node_id, CAST(0 AS BIGINT) FROM fx_terminals
  UNION
  SELECT x.origin, x.node, x.d FROM (
    SELECT v.origin, e.b AS node, min(v.dist + e.w) AS d FROM far v JOIN fx_adj e ON e.a = v.node GROUP BY v.origin, e.b) x
  LEFT JOIN recurring.far r ON r.origin = x.origin AND r.node = x.node
  WHERE r.node IS NULL OR x.d < r.dist),
farp AS (SELECT f.origin, f.node, f.dist, coalesce(p.parent, f.node) AS parent FROM far f LEFT JOIN (
  SELECT a.origin, e.b AS node, min(e.a) AS parent FROM fx_adj e JOIN far a ON a.node = e.a
  JOIN far b ON b.node = e.b AND b.origin = a.origin WHERE a.dist + e.w = b.dist GROUP BY a.origin, e.b) p
  ON p.origin = f.origin AND p.node = f.node),
clo AS (SELECT origin AS src, node AS dst, dist AS weight FROM far WHERE node IN (SELECT node_id FROM fx_terminals) AND origin < node)
"""
#: Prim's tree over the terminals' closure, its paths, and those without dangling ends.
CLOSURE_TREE = (
    CLOSURE
    + """,
cadj AS (SELECT src AS a, dst AS b, weight AS w FROM clo UNION ALL SELECT dst, src, weight FROM clo),
prim(node, other, w) USING KEY (node) AS (
  SELECT (SELECT min(node_id) FROM fx_terminals), CAST(NULL AS BIGINT), CAST(0 AS BIGINT)
  UNION
  SELECT st.b, st.a, st.w FROM (SELECT min({'w': e.w, 'a': e.a, 'b': e.b}) AS st FROM cadj e, prim p0
    WHERE e.a IN (SELECT node FROM recurring.prim) AND e.b NOT IN (SELECT node FROM recurring.prim)) WHERE st IS NOT NULL),
ends AS (SELECT least(node, other) AS origin, greatest(node, other) AS node FROM prim WHERE other IS NOT NULL),
pathway(origin, node) AS (
  SELECT origin, node FROM ends
  UNION
  SELECT f.origin, f.parent FROM pathway w JOIN farp f ON f.origin = w.origin AND f.node = w.node),
steps AS (SELECT DISTINCT least(f.node, f.parent) AS src, greatest(f.node, f.parent) AS dst
  FROM pathway w JOIN farp f ON f.origin = w.origin AND f.node = w.node WHERE f.node <> f.parent)
"""
)


@query("SELECT n.node_id, count(a.a) AS degree FROM fx_nodes n LEFT JOIN fx_adj a ON a.a = n.node_id GROUP BY n.node_id")
def degree(fx):
    return G.degree(fx.nodes, _edges(fx))


#: The grid without the edges whose weight leaves 0 to 2 when divided by 5 falls into many components.
SPARSE = """
thin AS (SELECT src, dst FROM fx_edges WHERE w_mm % 5 >= 3),
tadj AS (SELECT src AS a, dst AS b FROM thin UNION ALL SELECT dst, src FROM thin),
cc(node, label) USING KEY (node) AS (
  SELECT node_id, node_id FROM fx_nodes
  UNION
  SELECT x.node, x.label FROM (SELECT e.b AS node, min(c.label) AS label FROM cc c JOIN tadj e ON e.a = c.node GROUP BY e.b) x
  JOIN recurring.cc r ON r.node = x.node WHERE x.label < r.label)
"""


def _thin(fx: Fixtures) -> DataFrame:
    return _edges(fx).where("weight % 5 >= 3")


@query("SELECT node AS node_id, label AS component FROM cc", SPARSE)
def connected_components(fx):
    return G.connected_components(fx.nodes, _thin(fx))


@query("SELECT count(*) AS n, label AS component FROM cc GROUP BY label", SPARSE)
def closure_sizes(fx):
    return G.connected_components(fx.nodes, _thin(fx)).groupBy("component").agg(F.count("*").alias("n"))


@query(
    """SELECT (SELECT count(*) FROM fx_nodes) AS n_nodes, (SELECT count(*) FROM thin) AS n_edges,
  (SELECT count(*) FROM fx_nodes WHERE node_id NOT IN (SELECT a FROM tadj)) AS isolated,
  CAST(0 AS BIGINT) AS invalid_weights, CAST(0 AS BIGINT) AS missing_coords,
  (SELECT count(DISTINCT label) FROM cc) AS n_components, (SELECT max(c) FROM (SELECT count(*) AS c FROM cc GROUP BY label)) AS largest,
  (SELECT count(DISTINCT label) FROM cc) <= 1 AS is_valid""",
    SPARSE,
)
def validate_graph(fx):
    return G.validate(fx.nodes, _thin(fx))


@query("SELECT count(DISTINCT c.label) = 1 AS is_connected FROM fx_terminals t JOIN cc c ON c.node = t.node_id", SPARSE)
def is_connected(fx):
    return G.is_connected(_thin(fx), fx.terminals)


@query("SELECT label AS component, count(*) AS n_terminals FROM fx_terminals t JOIN cc c ON c.node = t.node_id GROUP BY label", SPARSE)
def component_terminals(fx):
    return G.connected_components(fx.nodes, _thin(fx)).join(fx.terminals, "node_id").groupBy("component").agg(F.count("*").alias("n_terminals"))


@query("SELECT node AS node_id, dist, parent FROM farp WHERE origin = (SELECT min(node_id) FROM fx_terminals)", CLOSURE)
def sssp(fx):
    first = fx.terminals.agg(F.min("node_id")).first()[0]
    return G.sssp(_edges(fx), first)


@query(
    """SELECT e.src, e.dst, e.w_mm AS weight FROM fx_edges e JOIN (SELECT DISTINCT least(f.node, f.parent) AS src, greatest(f.node, f.parent) AS dst
  FROM way w JOIN farp f ON f.origin = w.origin AND f.node = w.node WHERE f.node <> f.parent) s ON s.src = e.src AND s.dst = e.dst""",
    CLOSURE + ", way(origin, node) AS (SELECT min(node_id), max(node_id) FROM fx_terminals UNION SELECT f.origin, f.parent FROM way w JOIN farp f ON f.origin = w.origin AND f.node = w.node)",
)
def shortest_path_pair(fx):
    ends = fx.terminals.agg(F.min("node_id"), F.max("node_id")).first()
    return G.shortest_path(_edges(fx), ends[0], ends[1])


@query("SELECT node AS node_id, count(*) AS reachable, CAST(sum(dist) AS BIGINT) AS total FROM far WHERE dist <= 2000000 GROUP BY node", CLOSURE)
def reach_within(fx):
    return G.reach_totals(_edges(fx), fx.terminals, 2_000_000).withColumnRenamed("node", "node_id")


@query("SELECT node_id, dist, source, parent FROM vorp", VORONOI)
def voronoi_labels(fx):
    return G.voronoi_labels(_edges(fx), fx.terminals)


@query("SELECT t1, t2, k.c AS cost, k.u AS u, k.v AS v FROM bor", VORONOI)
def voronoi_boundaries(fx):
    edges = _edges(fx)
    return G.voronoi_boundaries(edges, G.voronoi_labels(edges, fx.terminals))


@query(
    """SELECT node_id, count(*) AS hits FROM (SELECT unnest([e.src, e.dst]) AS node_id FROM fx_edges e JOIN vor a ON a.node = e.src
  JOIN vor b ON b.node = e.dst WHERE a.source <> b.source) GROUP BY node_id HAVING count(*) >= 3 ORDER BY hits DESC, node_id LIMIT 50""",
    VORONOI,
)
def hubs(fx):
    edges = _edges(fx)
    return G.hubs(edges, G.voronoi_labels(edges, fx.terminals))


@query(
    "SELECT least(node, other) AS src, greatest(node, other) AS dst, w AS weight FROM tree WHERE other IS NOT NULL",
    """tree(node, other, w) USING KEY (node) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT)
  UNION
  SELECT st.b, st.a, st.w FROM (SELECT min({'w': e.w, 'a': e.a, 'b': e.b}) AS st FROM fx_adj e, tree t0
    WHERE e.a IN (SELECT node FROM recurring.tree) AND e.b NOT IN (SELECT node FROM recurring.tree)) WHERE st IS NOT NULL)""",
)
def mst_edges(fx):
    return G.minimum_spanning_forest(_edges(fx))


@query("SELECT src, dst, weight FROM clo", CLOSURE)
def metric_closure(fx):
    return G.metric_closure(_edges(fx), fx.terminals)


@query("SELECT src, dst FROM steps", CLOSURE_TREE)
def path_edges(fx):
    cells = G.Cells.of(_edges(fx), fx.terminals)
    return cells.paths(G.minimum_spanning_forest(cells.closure()))


@query("SELECT e.src, e.dst, e.w_mm AS weight FROM fx_edges e JOIN steps s ON s.src = e.src AND s.dst = e.dst", CLOSURE_TREE)
def extract_subgraph(fx):
    edges = _edges(fx)
    return G.extract_subgraph(edges, path_edges(fx)).select("src", "dst", "weight")


@query("SELECT e.src, e.dst, e.w_mm AS weight FROM fx_edges e JOIN steps s ON s.src = e.src AND s.dst = e.dst", CLOSURE_TREE)
def solve_mst(fx):
    return S.mst_approximation(_edges(fx), fx.terminals).edges


@query(
    """SELECT s.node_id, d.degree, s.reachable, s.total FROM (SELECT node AS node_id, count(*) AS reachable, CAST(sum(dist) AS BIGINT) AS total FROM far
  WHERE dist <= 10000000 AND node NOT IN (SELECT node_id FROM fx_terminals) GROUP BY node HAVING count(*) >= 2) s
  JOIN (SELECT a AS node_id, count(*) AS degree FROM fx_adj GROUP BY a) d ON d.node_id = s.node_id
  ORDER BY d.degree * s.reachable / (s.total / s.reachable / 1000.0 + 1) DESC, s.node_id LIMIT 100""",
    CLOSURE,
)
def steiner_candidates(fx):
    return S.steiner_candidates(_edges(fx), fx.terminals)


@query(
    """SELECT s.node_id FROM (SELECT node AS node_id, count(*) AS reachable, CAST(sum(dist) AS BIGINT) AS total FROM far
  WHERE dist <= 10000000 AND node NOT IN (SELECT node_id FROM fx_terminals) GROUP BY node HAVING count(*) >= 2) s
  JOIN (SELECT a AS node_id, count(*) AS degree FROM fx_adj GROUP BY a) d ON d.node_id = s.node_id
  ORDER BY d.degree * s.reachable / (s.total / s.reachable / 1000.0 + 1) DESC, s.node_id LIMIT 10""",
    CLOSURE,
)
def topk_candidates(fx):
    return S.steiner_candidates(_edges(fx), fx.terminals, most=10).select("node_id")


@query(
    """SELECT node_id FROM fx_terminals UNION SELECT node_id FROM (SELECT s.node_id FROM (SELECT node AS node_id, count(*) AS reachable, CAST(sum(dist) AS BIGINT) AS total FROM far
  WHERE dist <= 10000000 AND node NOT IN (SELECT node_id FROM fx_terminals) GROUP BY node HAVING count(*) >= 2) s
  JOIN (SELECT a AS node_id, count(*) AS degree FROM fx_adj GROUP BY a) d ON d.node_id = s.node_id
  ORDER BY d.degree * s.reachable / (s.total / s.reachable / 1000.0 + 1) DESC, s.node_id LIMIT 10)""",
    CLOSURE,
)
def extended_terminals(fx):
    return fx.terminals.union(S.steiner_candidates(_edges(fx), fx.terminals, most=10).select("node_id")).distinct()


@query("SELECT node_id FROM (SELECT src AS node_id FROM steps UNION SELECT dst FROM steps) WHERE node_id NOT IN (SELECT node_id FROM fx_terminals)", CLOSURE_TREE)
def steiner_points(fx):
    return S.mst_approximation(_edges(fx), fx.terminals).steiner_points


#: Leaves go in rounds: the recursion gathers the nodes that have become leaves.
@query(
    "SELECT src, dst, w_mm AS weight FROM fx_edges WHERE w_mm % 5 >= 2 AND src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)",
    """padj AS (SELECT a, b FROM fx_adj WHERE w % 5 >= 2),
gone(node) USING KEY (node) AS (
  SELECT a FROM padj WHERE a NOT IN (SELECT node_id FROM fx_terminals) GROUP BY a HAVING count(*) = 1
  UNION
  SELECT p.a FROM padj p WHERE p.a NOT IN (SELECT node_id FROM fx_terminals) AND p.a IN (SELECT q.b FROM padj q JOIN gone g ON g.node = q.a)
    AND p.a NOT IN (SELECT node FROM recurring.gone) AND p.b NOT IN (SELECT node FROM recurring.gone) GROUP BY p.a HAVING count(*) = 1)""",
)
def prune_leaves(fx):
    return G.prune_leaves(_edges(fx).where("weight % 5 >= 2"), fx.terminals)


@query(
    """SELECT src, dst, w_mm AS weight FROM fx_edges WHERE src IN (SELECT node_id FROM fx_nodes WHERE lon_u <= -73895000 AND lat_u >= 42602000)
  AND dst IN (SELECT node_id FROM fx_nodes WHERE lon_u <= -73895000 AND lat_u >= 42602000)"""
)
def induced_subgraph(fx):
    return G.induced_subgraph(_edges(fx), fx.nodes.where("lon_u <= -73895000 and lat_u >= 42602000"))


@query("SELECT src, dst, w_mm AS weight FROM fx_edges")
def load_graph(fx):
    """Node and edge tables as they are, pairs in order and once each, the last given weight winning."""
    from .operators.build import load_graph as load

    return load(_edges(fx).withColumn("ordinal", F.monotonically_increasing_id()))


@query()
def solve_dp_cost(fx):
    return S.dijkstra_steiner(_edges(fx), fx.terminals).edges.agg(F.sum("weight").alias("cost"))


@query()
def solve_dp(fx):
    return S.dijkstra_steiner(_edges(fx), fx.terminals).edges


@query()
def solve_pruned(fx):
    return S.pruned_dijkstra(_edges(fx), fx.terminals).edges


@query()
def solve_mst_points(fx):
    return S.mst_steiner_points(_edges(fx), fx.terminals).edges


@query()
def solve_sph(fx):
    return S.shortest_path_heuristic(_edges(fx), fx.terminals).edges


@query()
def solve_genetic(fx):
    return S.genetic(_edges(fx), fx.terminals).edges


@query()
def connect_forest(fx):
    """The edges that leave all terminals, joined to one network."""
    edges = _edges(fx)
    return G.connect_forest(edges.join(fx.terminals.select(F.col("node_id").alias("src")), "src", "left_semi"), edges)


@query("""SELECT * FROM (VALUES ('mst_approximation', true), ('mst_steiner_points', false), ('shortest_path_heuristic', false),
  ('dijkstra_steiner', true), ('pruned_dijkstra', true), ('genetic', false)) t(name, is_fast)""")
def list_algorithms(fx):
    return fx.spark.createDataFrame([(n, fast) for n, (_, fast, _) in S.REGISTRY.items()], "name string, is_fast boolean")


@query()
def run_all(fx):
    solved = S.run_all(_edges(fx), fx.terminals)
    rows = [(n, None if isinstance(s, Exception) else s.total_weight, None if isinstance(s, Exception) else s.is_connected) for n, s in solved.items()]
    return fx.spark.createDataFrame(rows, "algorithm string, total_weight double, is_connected boolean")


@query("SELECT node_id FROM fx_terminals WHERE node_id NOT IN (SELECT node_id FROM fx_nodes WHERE node_id % 7 <> 0)")
def terminal_check(fx):
    """Terminals that are not among the nodes (here every seventh node is missing)."""
    return fx.terminals.join(fx.nodes.where("node_id % 7 <> 0"), "node_id", "left_anti")


@query()
def terminal_sample(fx):
    from .operators.snap import sample_terminals

    return sample_terminals(fx.terminals, 5)
