"""Queries against their SQL on the smallest tables."""

import pytest

from spanweave.queries import ORACLES, QUERIES

from .compare import duck, rows_of

SF = "/root/testdata/sf0.001"
#: The other queries with SQL compose these and take minutes together; the driver compares all of them.
CHOSEN = """degree connected_components validate_graph is_connected sssp voronoi_labels voronoi_boundaries mst_edges metric_closure prune_leaves
induced_subgraph terminal_check list_algorithms extract_lines vertex_counts identify_nodes snap_pairs snap_clusters segment_lengths line_segments
dedupe_parallel graph_edges endpoint_graph touching_roads knn_nodes nodes_in_radius nearest_edge edge_splits terminal_stats valid_points roads_in_polygon
planar_length linear_ref interpolate split_edges haversine to_albers parse_polyline overlap_area export_graph_nodes mileage_summary benchmark_summary
infra_crossings cluster_summary provider_share entitlement_check road_class_filter scan_roads scan_locations""".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck(SF, ORACLES[name])
    assert rows_of(got) == rows_of(want)
    assert len(got)


def test_every_oracle_has_its_query():
    assert not set(ORACLES) - set(QUERIES)
