import pytest
from pyspark.sql import functions as F

from spanweave import api
from spanweave.operators import build as B
from spanweave.operators import snap as P

SCHEMA = "road_id bigint, pos bigint, lon_u bigint, lat_u bigint"
X0, Y0 = -73_900_000, 42_000_000


def roads(spark, *lines):
    rows = [(r, i, X0 + x, Y0 + y) for r, line in enumerate(lines) for i, (x, y) in enumerate(line)]
    return spark.createDataFrame(rows, SCHEMA)


def counts(df):
    return {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()}


def test_a_vertex_repeated_in_one_line_is_a_node(spark):
    v = roads(spark, [(0, 0), (1000, 0), (2000, 0), (1000, 0), (1000, 900)])
    assert B.identify_nodes(v).count() == 3


def test_short_and_empty_lines_are_left_out(spark):
    v = roads(spark, [(0, 0)], [(0, 0), (5, 5)])
    assert [r["road_id"] for r in B.extract_lines(v).select("road_id").distinct().collect()] == [1]
    nodes, edges = B.build_graph(v.limit(0))
    assert nodes.count() == edges.count() == 0
    with pytest.raises(ValueError, match="no usable lines"):
        api.Network().build(v.limit(0))


def test_snapping_needs_both_distances(spark):
    """0.9 m apart east-west at latitude 42 is more than ten millionths of a degree; 0.7 m is not."""
    far, near = [(0, 0), (5000, 0)], [(5011, 0), (9000, 0)]
    assert B.snap_pairs(B.identify_nodes(roads(spark, far, near))).count() == 0
    assert B.snap_pairs(B.identify_nodes(roads(spark, far, [(5008, 0), (9000, 0)]))).count() == 1


def test_copies_parallels_and_loops(spark):
    a, b = (0, 0), (4000, 0)
    straight, detour = [a, b], [a, (2000, 1500), b]
    ring = [a, (0, 3000), (-3000, 3000), a]
    v = roads(spark, straight, straight, detour, ring, ring)
    nodes, edges = B.build_graph(v)
    assert counts(edges) == {"edge": 1, "parallel": 2, "loop": 10} or counts(edges)["parallel"] == 2
    kept = edges.where("kind = 'edge'").first()
    assert kept["weight"] == pytest.approx(330_000, rel=0.02)
    assert edges.where("src = dst").count() == 0
    assert nodes.count() == nodes.select("node_id").distinct().count()


def test_closed_road_alone_is_kept_twice(spark):
    """A ring whose only node is its start: each copy gets a middle of its own."""
    ring = [(0, 0), (0, 3000), (-3000, 3000), (0, 0)]
    one = roads(spark, ring)
    nodes, edges = B.build_graph(one)
    assert counts(edges) == {"loop": 1} and nodes.count() == 2


def test_split_pieces_add_up_and_share_places(spark):
    nodes = spark.createDataFrame([(0, X0, Y0), (1, X0 + 4000, Y0)], "node_id bigint, lon_u bigint, lat_u bigint")
    edges = spark.createDataFrame([(0, 1, 1000)], "src bigint, dst bigint, weight bigint")
    where = spark.createDataFrame([(7, X0 + 1000, Y0 + 100), (8, X0 + 1000, Y0 - 200), (9, X0 + 3000, Y0 + 5), (10, X0 + 20, Y0 + 20), (11, X0, Y0 + 900_000)], "loc_id bigint, lon_u bigint, lat_u bigint")
    segments = P.chords(nodes, edges)
    found = P.nearest_edge(where, segments)
    pieces, new, loc_map = P.split_edges(edges, segments, found, 2)
    assert sum(r["weight"] for r in pieces.collect()) == 1000 and pieces.count() == 3
    mapped = {r["loc_id"]: (r["node_id"], r["mode"]) for r in loc_map.collect()}
    assert mapped[7] == mapped[8] and mapped[7][1] == "split" and mapped[10] == (0, "u") and 11 not in mapped
    assert new.count() == 2
    stats = P.terminal_stats(where, loc_map).first().asDict()
    assert stats == {"locations": 5, "snapped": 4, "skipped": 1, "terminals": 3}


def test_pipeline_from_lines_to_layers(spark, tmp_path):
    lines = [[(x * 1000, 0), (x * 1000, 3000), (x * 1000, 6000)] for x in range(3)] + [[(0, 3000), (1000, 3000), (2000, 3000)]]
    v = roads(spark, *lines)
    where = spark.createDataFrame([(1, X0 + 50, Y0 + 1000), (2, X0 + 2040, Y0 + 5000), (3, X0 + 960, Y0 + 5500)], "loc_id bigint, lon_u bigint, lat_u bigint")
    network, found = api.solve(v, where)
    assert found.is_connected and found.total_weight > 0
    network.export("pruned_dijkstra", str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/solution_edges").count() == found.edges.count()
    assert network.layers("pruned_dijkstra")["terminals"].agg(F.sum("loc_count")).first()[0] == 3
    with pytest.raises(RuntimeError):
        api.Network().solve()


def test_equal_components_all_stay(spark):
    two = roads(spark, [(0, 0), (1, 1)], [(50, 50), (60, 60)])
    assert B.main_component_roads(two).count() == 2
    three = roads(spark, [(0, 0), (1, 1)], [(1, 1), (2, 2)], [(50, 50), (60, 60)])
    assert sorted(r[0] for r in B.main_component_roads(three).collect()) == [0, 1]


def test_dense_ids_follow_the_order(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    got = B.dense_ids(df, ["k"], "n", 5).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(5, 105))


def test_queries_without_sql_read_all_roads_and_locations(spark):
    from spanweave.plans.fixtures import Fixtures
    from spanweave.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    fx = Fixtures(spark, sf)
    all_roads = {r[0] for r in B.extract_lines(fx.road_vertices).select("road_id").distinct().collect()}
    places = {r["loc_id"]: (r["lon_u"], r["lat_u"]) for r in fx.locations.collect()}
    for name in ("substring_line", "wkb_roundtrip"):
        assert {r["road_id"] for r in QUERIES[name](spark, sf).collect()} == all_roads
    passed = sorted((r["loc_id"], r["x"], r["y"]) for r in QUERIES["geometry_gate"](spark, sf).collect())
    assert passed == sorted((i, x + k, y) for i, (x, y) in places.items() for k in range(1 if i % 2 == 0 else 3))
    assert {r["loc_id"] for r in QUERIES["snap_to_samples"](spark, sf).collect()} == set(places)


def test_nearest_edge_sorts_after_the_shuffle(spark):
    """A scan's task sorted all its pairs, so its memory grew with the table."""
    points = spark.createDataFrame([(1, 0, 0), (2, 500, 40), (3, 5000, 5000)], "loc_id bigint, lon_u bigint, lat_u bigint")
    lines = spark.createDataFrame([(0, 1, 1000, 0, 0, 1000, 0), (0, 2, 1000, 0, 0, 0, 1000)], "src bigint, dst bigint, weight bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    found = P.nearest_edge(points, lines)
    assert {r["loc_id"]: (r["src"], r["dst"]) for r in found.collect()} == {1: (0, 1), 2: (0, 1)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.rindex("SortAggregate") if "SortAggregate" in plan else plan.rindex("Aggregate") :]
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString() and "Join" in below


def test_samples_come_by_segment(spark):
    """The whole line was folded for each sample; vertices on a sample, lines without length and gaps count."""
    rows = [(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 0.0), (1, 4, 3.0, 7.5), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 0, 5.0, 5.0)]
    stretches = B.sample_stretches(spark.createDataFrame(rows, "road_id bigint, pos bigint, x double, y double"), 3.0)
    got = {(r["road_id"], r["i"]): (r["x"], r["y"]) for r in B.sample_points(stretches, 3.0).collect()}
    assert got == {(1, 0): (0.0, 0.0), (1, 1): (3.0, 0.0), (1, 2): (3.0, 3.0), (1, 3): (3.0, 6.0), (2, 0): (1.0, 1.0)}
