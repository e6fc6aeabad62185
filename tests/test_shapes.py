import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.functions import geo, shapes


def test_geodesic_known_lengths():
    got = shapes.geodesic(np.array([0.0, 0.0, 5.0]), np.array([0.0, 0.0, 5.0]), np.array([0.0, 1.0, 5.0]), np.array([1.0, 0.0, 5.0]))
    assert got == pytest.approx([110574.3886, 111319.4908, 0.0], abs=1e-3)


points = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=40)


@settings(max_examples=50, deadline=None)
@given(points)
def test_hull_holds_all_points(ps):
    corners = shapes.hull(np.array(ps, float))
    if len(corners) < 3:
        return
    ring = list(map(tuple, corners))
    for x, y in ps:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            assert (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=2, max_size=20))
def test_wkb_round_trip(ps):
    line = [{"x": x, "y": y} for x, y in ps]
    assert shapes.wkb_points(shapes.wkb_line(line)) == line


def test_clip_simplify_and_crossing():
    assert shapes.clip_segment((-1, 0.5), (2, 0.5), (0, 0, 1, 1)) == ((0, 0.5), (1, 0.5))
    assert shapes.clip_segment((-1, 5), (2, 5), (0, 0, 1, 1)) is None
    assert len(shapes.simplify(np.array([(0, 0), (1, 0.01), (2, 0)], float), 0.1)) == 2
    assert shapes.crossing((0, 0), (2, 2), (0, 2), (2, 0)) == (0.5, 0.5)
    assert shapes.crossing((0, 0), (1, 0), (0, 1), (1, 1)) is None


def test_line_functions(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)],)], "line array<struct<x:double,y:double>>")
    line = F.col("line")
    r = df.select(
        geo.line_length(line).alias("n"),
        geo.interpolate(line, F.lit(5.0)).alias("p"),
        geo.nearest_on_line(line, F.lit(4.0), F.lit(2.0)).alias("near"),
        geo.substring_line(line, F.lit(1.0), F.lit(5.0)).alias("part"),
        geo.chord_places(geo.line_length(line), 3.0).alias("cuts"),
        geo.parse_polyline(F.lit("1 2, 3 4,bad")).alias("parsed"),
        geo.parse_polyline(F.lit("")).alias("nothing"),
    ).first()
    assert r["n"] == 7 and tuple(r["p"]) == (3, 2) and r["near"]["d2"] == 1 and r["near"]["along"] == 5
    assert [tuple(p) for p in r["part"]] == [(1, 0), (3, 0), (3, 2)]
    assert r["cuts"] == pytest.approx([0, 7 / 3, 14 / 3, 7])
    assert [tuple(p) for p in r["parsed"]] == [(1, 2), (3, 4)] and r["nothing"] is None


def test_short_geodesic_agrees_with_the_long_way(spark):
    df = spark.createDataFrame([(-73.9, 42.0, -73.899993, 42.000004)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    r = df.select(geo.short_geodesic(*cols).alias("s"), shapes.geodesic_m(*cols).alias("g")).first()
    assert r["s"] == pytest.approx(r["g"], abs=1e-6)


def test_long_lines_are_cut_in_one_pass(spark):
    """The work grew with the square of the vertices, and with the line's expression at each of them."""
    n = 300
    line = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y")))
    lines = spark.range(200).select("id", line.alias("line")).withColumn("size", geo.line_length(F.col("line")))
    began = time.perf_counter()
    part = lines.select("id", "size", geo.substring_line(F.col("line"), F.col("size") * 0.25, F.col("size") * 0.75).alias("part"))
    got = part.select(F.sum(geo.line_length(F.col("part"))), F.max(F.size("part"))).first()
    assert tuple(got) == (200 * n / 2, n // 2 + 1)
    cuts = spark.range(200).select(line.alias("line")).select(F.size(geo.chord_places(geo.line_length(F.col("line")), 0.5)).alias("n"))
    assert cuts.agg(F.sum("n")).first()[0] == 200 * (2 * n + 1)
    assert time.perf_counter() - began < 30
