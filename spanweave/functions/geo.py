"""Geometry as Column expressions. A line is array<struct<x, y>>; angles are degrees, lengths metres unless
they are in the line's own units. Everything here stays inside Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii of the mean sphere and of the GRS80/WGS84 ellipsoid, the conic projection for North
# America (standard parallels 20 and 60, origin 40 and -96), and miles and feet as reports define them.
EARTH_M = 6_371_000.0
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257222101
PARALLEL_1, PARALLEL_2, ORIGIN_LAT, ORIGIN_LON = 20.0, 60.0, 40.0, -96.0
MILE_EXPORT, MILE_REPORT, FEET = 1609.34, 1609.344, 3.28084


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def micro(v: Column) -> Column:
    """Degrees to whole millionths, halves up."""
    return F.floor(v * 1e6 + 0.5)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_mm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Of points in millionths of a degree, in whole millimetres."""
    return F.floor(haversine(lon1 / 1e6, lat1 / 1e6, lon2 / 1e6, lat2 / 1e6) * 1000 + 0.5).cast("bigint")


def short_geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """On the ellipsoid, for points a few metres apart (radii of curvature at the middle latitude)."""
    e2 = FLATTENING * (2 - FLATTENING)
    s = F.sin(F.radians((lat1 + lat2) / 2))
    w = F.sqrt(1 - e2 * s * s)
    north = F.radians(lat2 - lat1) * (SEMI_MAJOR * (1 - e2)) / (w * w * w)
    east = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * SEMI_MAJOR / w
    return F.sqrt(north * north + east * east)


def _step(line: Column, i: Column) -> Column:
    return F.hypot(F.get(line, i).x - F.get(line, i - 1).x, F.get(line, i).y - F.get(line, i - 1).y)


def line_length(line: Column) -> Column:
    return F.when(F.size(line) < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(line) - 1), F.lit(0.0), lambda s, i: s + _step(line, i)))


def vertex_places(line: Column) -> Column:
    """The place of each vertex along a line of at least two, summed up once."""
    return F.aggregate(F.sequence(F.lit(1), F.size(line) - 1), F.array(F.lit(0.0)), lambda s, i: F.array_append(s, F.get(s, i - 1) + _step(line, i)))


def _segments(line: Column, x: Column, y: Column) -> Column:
    """For each segment: squared distance to the point, and the place of the nearest point along the line."""

    def one(i: Column) -> Column:
        a, b = F.get(line, i - 1), F.get(line, i)
        dx, dy = b.x - a.x, b.y - a.y
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a.x) * dx + (y - a.y) * dy) / size))).otherwise(F.lit(0.0))
        px, py = a.x + t * dx, a.y + t * dy
        return F.struct((F.pow(x - px, 2) + F.pow(y - py, 2)).alias("d2"), i.alias("i"), (t * F.sqrt(size)).alias("part"), px.alias("px"), py.alias("py"))

    return F.transform(F.sequence(F.lit(1), F.size(line) - 1), one)


def nearest_on_line(line: Column, x: Column, y: Column) -> Column:
    """struct(d2, along, px, py): the nearest point, the first one among equals."""
    before = lambda i: line_length(F.slice(line, F.lit(1), i))
    return let(F.array_min(_segments(line, x, y)), lambda s: F.struct(s.d2.alias("d2"), (before(s.i) + s.part).alias("along"), s.px.alias("px"), s.py.alias("py")))


def interpolate(line: Column, at: Column) -> Column:
    """struct(x, y): the point `at` units along the line, clamped to it."""
    start = F.struct(F.lit(0.0).alias("done"), F.get(line, F.lit(0)).x.cast("double").alias("x"), F.get(line, F.lit(0)).y.cast("double").alias("y"))

    def step(s: Column, i: Column) -> Column:
        a, b = F.get(line, i - 1), F.get(line, i)
        size = F.hypot(b.x - a.x, b.y - a.y)
        t = F.when(size > 0, F.least(F.lit(1.0), (at - s.done) / size)).otherwise(F.lit(0.0))
        return F.when(at > s.done, F.struct((s.done + size).alias("done"), (a.x + t * (b.x - a.x)).alias("x"), (a.y + t * (b.y - a.y)).alias("y"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.size(line) - 1), start, step, lambda s: F.struct(s.x.alias("x"), s.y.alias("y")))


def substring_line(line: Column, begin: Column, end: Column) -> Column:
    """The part between two places along the line, its inner vertices kept."""

    def part(k: Column) -> Column:
        # Bound once: inside a lambda an expression is worked out again wherever it stands.
        inner = F.filter(F.zip_with(k.line, vertex_places(k.line), lambda p, at: F.struct(at.alias("at"), p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))), lambda p: (p.at > k.begin) & (p.at < k.end))
        return F.concat(F.array(interpolate(k.line, k.begin)), F.transform(inner, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))), F.array(interpolate(k.line, k.end)))

    return let(F.struct(line.alias("line"), begin.alias("begin"), end.alias("end")), part)


def oriented(line: Column, x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """The line, reversed if it starts nearer to the second point than to the first."""
    p = F.get(line, F.lit(0))
    away = lambda a, b: F.pow(p.x - a, 2) + F.pow(p.y - b, 2)
    return F.when(away(x, y) > away(x2, y2), F.reverse(line)).otherwise(line)


def sample_places(length: Column, step: float) -> Column:
    """0, step, 2 step, ... up to the length."""
    return F.transform(F.sequence(F.lit(0), F.floor(length / step).cast("int")), lambda i: i * F.lit(float(step)))


def chord_places(length: Column, longest: float) -> Column:
    """The ends of equal pieces no longer than `longest`: n + 1 places."""
    pieces = lambda v: F.greatest(F.lit(1), F.ceil(v / longest)).cast("int")
    both = let(length, lambda v: F.struct(v.alias("v"), pieces(v).alias("n")))
    return let(both, lambda k: F.transform(F.sequence(F.lit(0), k.n), lambda i: k.v * i / k.n))


def bbox(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p.x), F.transform(line, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def parse_polyline(text: Column) -> Column:
    """'x y,x y,...' to a line; empty or null text to null, pieces that are no pair of numbers left out."""
    points = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "\\s+"))
    line = F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return F.when(F.trim(text) != "", F.filter(line, lambda p: p.x.isNotNull() & p.y.isNotNull()))


def polyline_text(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ",")


def kml_ring(line: Column) -> Column:
    """One 'x,y,0' line a vertex."""
    return F.array_join(F.transform(line, lambda p: F.concat(p.x.cast("string"), F.lit(","), p.y.cast("string"), F.lit(",0"))), "\n")


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def _authalic(lat: float) -> tuple[float, float]:
    """m and q of the ellipsoid at a latitude in degrees."""
    e2 = FLATTENING * (2 - FLATTENING)
    e, s = math.sqrt(e2), math.sin(math.radians(lat))
    m = math.cos(math.radians(lat)) / math.sqrt(1 - e2 * s * s)
    q = (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return m, q


def to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres of the equal-area conic projection."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    (m1, q1), (m2, q2), (_, q0) = _authalic(PARALLEL_1), _authalic(PARALLEL_2), _authalic(ORIGIN_LAT)
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho0 = SEMI_MAJOR * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = SEMI_MAJOR * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - ORIGIN_LON)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def box_overlap(minx: Column, miny: Column, maxx: Column, maxy: Column, box: tuple) -> Column:
    """Area shared with a constant box (minx, miny, maxx, maxy)."""
    wide = F.least(maxx, F.lit(box[2])) - F.greatest(minx, F.lit(box[0]))
    high = F.least(maxy, F.lit(box[3])) - F.greatest(miny, F.lit(box[1]))
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def in_convex(x: Column, y: Column, ring: list[tuple]) -> Column:
    """Inside or on a convex ring given anticlockwise."""
    out = F.lit(True)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        out = out & ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0)
    return out
