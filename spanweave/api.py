"""The staged pipeline: load, build, snap, solve, export; and one-call entry points."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build, graph, reports, snap, solvers
from .plans.store import written
from .sources import readers, writers

DEFAULT_ALGORITHM = "pruned_dijkstra"


@dataclass(frozen=True)
class Config:
    snap_tolerance_m: float = 1.0
    max_snap_m: float = snap.MAX_SNAP_M
    algorithm: str = DEFAULT_ALGORITHM
    max_terminals: int | None = None
    seed: int = 42
    connect_forest: bool = True


@dataclass
class Network:
    """Each step fills its part and needs the one before it."""

    config: Config = field(default_factory=Config)
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    terminals: DataFrame | None = None
    loc_map: DataFrame | None = None
    results: dict[str, solvers.Solution] = field(default_factory=dict)

    def build(self, vertices: DataFrame) -> Network:
        self.nodes, self.edges = build.build_graph(vertices, self.config.snap_tolerance_m)
        if self.nodes.isEmpty():
            raise ValueError("the roads hold no usable lines")
        return self

    def load(self, nodes: DataFrame, edges: DataFrame) -> Network:
        self.nodes, self.edges = nodes, edges
        return self

    def map_terminals(self, locations: DataFrame) -> Network:
        if self.nodes is None or self.edges is None:
            raise RuntimeError("build or load a graph first")
        segments = snap.chords(self.nodes, self.edges)
        found = snap.nearest_edge(locations, segments, self.config.max_snap_m)
        first = self.nodes.agg(F.max("node_id")).first()[0] + 1
        edges, new, loc_map = snap.split_edges(self.edges, segments, found, first)
        self.edges, self.loc_map = written(edges, "split"), written(loc_map, "loc_map")
        self.nodes = written(self.nodes.select("node_id", "lon_u", "lat_u").unionByName(new), "nodes")
        chosen = self.loc_map.select("node_id").distinct()
        if self.config.max_terminals:
            chosen = snap.sample_terminals(chosen, self.config.max_terminals, self.config.seed)
        self.terminals = written(chosen, "terminals")
        return self

    def solve(self, algorithm: str | None = None) -> solvers.Solution:
        if self.terminals is None or self.edges is None or self.nodes is None:
            raise RuntimeError("map terminals first")
        solvers.check_terminals(self.nodes, self.terminals)
        name = algorithm or self.config.algorithm
        found = solvers.get(name)(self.edges, self.terminals)
        if self.config.connect_forest and not found.is_connected:
            found = solvers._finish(name, graph.connect_forest(found.edges, self.edges, self.terminals), self.terminals)
        self.results[name] = found
        return found

    def layers(self, name: str) -> dict[str, DataFrame]:
        if name not in self.results:
            raise RuntimeError("solve first")
        found = self.results[name]
        return {
            "graph_nodes": reports.graph_nodes_layer(self.nodes, self.edges, self.terminals),
            "graph_edges": reports.graph_edges_layer(self.nodes, self.edges),
            "terminals": reports.terminals_layer(self.nodes, self.edges, self.loc_map),
            "solution_edges": reports.solution_edges_typed(found.edges, self.terminals, name),
            "solution_nodes": reports.solution_nodes_typed(found.edges, self.nodes, self.terminals, name),
            "mileage_summary": reports.mileage_summary(found.edges.withColumn("algorithm", F.lit(name))),
        }

    def export(self, name: str, path: str) -> None:
        for layer, df in self.layers(name).items():
            df = df.withColumn("geometry", F.to_json("geometry")) if "geometry" in df.columns else df
            writers.write_layer(df, f"{path}/{layer}", "csv" if layer == "mileage_summary" else "parquet")


def solve(vertices: DataFrame, locations: DataFrame, config: Config | None = None) -> tuple[Network, solvers.Solution]:
    """Roads and locations (micro-degree tables) to a connecting network, in one call."""
    network = Network(config or Config(max_snap_m=200.0)).build(vertices).map_terminals(locations)
    return network, network.solve()


def solve_files(spark: SparkSession, roads: str, locations: str, config: Config | None = None) -> tuple[Network, solvers.Solution]:
    """The same from GeoJSON lines in degrees."""
    lines = readers.read_geojson(spark, roads).where(F.col("kind").isin("LineString", "MultiLineString"))
    lines = written(lines.select(F.monotonically_increasing_id().alias("road_id"), "geom"), "lines")
    points = readers.point_rows(readers.read_geojson(spark, locations).select(F.monotonically_increasing_id().alias("loc_id"), "kind", F.col("geom").alias("points")))
    points = written(points.select("loc_id", F.floor(F.col("x") * 1e6 + 0.5).alias("lon_u"), F.floor(F.col("y") * 1e6 + 0.5).alias("lat_u")), "points")
    return solve(build.explode_lines(lines), points, config)


def benchmark(spark: SparkSession, cases: dict[str, tuple[DataFrame, DataFrame]], algorithms: list[str] | None = None) -> DataFrame:
    """One row a case and algorithm: subset, algorithm, seconds, total_weight, edges, terminals, is_connected, error."""
    rows = []
    for subset, (edges, terminals) in cases.items():
        for name in algorithms or solvers.fast_names():
            began = time.perf_counter()
            try:
                found = solvers.get(name)(edges, terminals)
                rows.append((subset, name, time.perf_counter() - began, found.total_weight, found.edges.count(), terminals.count(), found.is_connected, None))
            except Exception as e:  # a failed case leaves the others their turn
                rows.append((subset, name, time.perf_counter() - began, None, None, None, None, str(e)[:200]))
    return spark.createDataFrame(rows, "subset string, algorithm string, seconds double, total_weight double, edges bigint, terminals bigint, is_connected boolean, error string")
