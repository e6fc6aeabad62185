"""Geometry that needs loops: Arrow-batched functions in numpy."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563  # WGS84


def geodesic(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres on WGS84 by iteration on the auxiliary sphere; nearly antipodal points stop after 200 rounds."""
    a, f = SEMI_MAJOR, FLATTENING
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(lon2 - lon1)
    lam = span.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    for _ in range(200):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.where(ss > 0, c1 * c2 * sl / np.where(ss > 0, ss, 1), 0)
        ca2 = 1 - sa * sa
        mid = np.where(ca2 > 1e-15, cs - 2 * s1 * s2 / np.where(ca2 > 1e-15, ca2, 1), 0)
        k = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        new = span + (1 - k) * f * sa * (sigma + k * ss * (mid + k * cs * (2 * mid * mid - 1)))
        done = np.all(np.abs(new - lam) < 1e-13)
        lam = new
        if done:
            break
    w = ca2 * (a * a - b * b) / (b * b)
    big = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768))
    small = w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
    turn = small * ss * (mid + small / 4 * (cs * (2 * mid * mid - 1) - small / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))
    return b * big * (sigma - turn)


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(geodesic(*(s.to_numpy(float) for s in (a, b, c, d))))

    return run(lon1.cast("double"), lat1.cast("double"), lon2.cast("double"), lat2.cast("double"))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners anticlockwise, by two monotone chains; collinear points are left out."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def hull_partition(batches):
    """Corners of each partition's own hull: what a hull of all points needs of it."""
    kept = np.empty((0, 2))
    for batch in batches:
        kept = hull(np.vstack([kept, batch[["x", "y"]].to_numpy(float)]))
    if len(kept):
        yield pd.DataFrame(kept, columns=["x", "y"])


def wkb_line(points: list) -> bytes:
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in points)


def wkb_points(raw: bytes) -> list[dict]:
    """Vertices of a point, a line or a polygon's rings, in either byte order."""
    order = "<" if raw[0] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", raw, 1)
    at, out = 5, []

    def take(n: int) -> None:
        nonlocal at
        values = struct.unpack_from(f"{order}{2 * n}d", raw, at)
        at += 16 * n
        out.extend({"x": values[i], "y": values[i + 1]} for i in range(0, 2 * n, 2))

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        return n

    if kind % 1000 == 1:
        take(1)
    elif kind % 1000 == 2:
        take(count())
    elif kind % 1000 == 3:
        for _ in range(count()):
            take(count())
    else:
        raise ValueError(f"geometry kind {kind} is not supported")
    return out


def to_wkb(line: Column) -> Column:
    @F.pandas_udf("binary")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda p: None if p is None else wkb_line(p))

    return run(line)


def from_wkb(raw: Column) -> Column:
    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else wkb_points(bytes(b)))

    return run(raw)


def clip_segment(a: tuple, b: tuple, box: tuple) -> tuple | None:
    """The part of a segment inside a box, or None."""
    t0, t1 = 0.0, 1.0
    dx, dy = b[0] - a[0], b[1] - a[1]
    for p, q in ((-dx, a[0] - box[0]), (dx, box[2] - a[0]), (-dy, a[1] - box[1]), (dy, box[3] - a[1])):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    if t0 > t1:
        return None
    return (a[0] + t0 * dx, a[1] + t0 * dy), (a[0] + t1 * dx, a[1] + t1 * dy)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices further than the tolerance from the chord that would replace them stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = points[i], points[j] - points[i]
        off = points[i + 1 : j] - a
        size = np.hypot(*d)
        away = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / size if size else np.hypot(off[:, 0], off[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def crossing(p: tuple, q: tuple, r: tuple, s: tuple) -> tuple[float, float] | None:
    """Where two segments cross or touch, as places (0 to 1) on each; None if apart or parallel."""
    d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
    if d == 0:
        return None
    t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
    u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / d
    return (t, u) if 0 <= t <= 1 and 0 <= u <= 1 else None
