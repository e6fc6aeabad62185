"""Spatial joins as equi-joins on grid cells. Points have x and y in one planar unit; squared distances keep
integer coordinates exact. Ties go to the smaller id. A cell's side is the search radius, so a point
meets candidates from its own and eight neighbouring cells only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes


def cell(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(side)).cast("bigint")


def _around(df: DataFrame, side: float, x: str = "x", y: str = "y") -> DataFrame:
    """df once for each of the nine cells at and around its point."""
    near = [F.struct((cell(F.col(x), side) + i).alias("cx"), (cell(F.col(y), side) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return df.select("*", F.explode(F.array(*near)).alias("c")).select("*", "c.cx", "c.cy").drop("c")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All pairs (columns l_*, r_*, d2) of points at most radius apart."""
    a = _around(left, radius).select(*[F.col(c).alias(f"l_{c}") for c in left.columns], "cx", "cy")
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy"))
    d2 = (F.col("l_x") - F.col("r_x")) * (F.col("l_x") - F.col("r_x")) + (F.col("l_y") - F.col("r_y")) * (F.col("l_y") - F.col("r_y"))
    return a.join(b, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= F.lit(radius) * F.lit(radius)).drop("cx", "cy")


PART_BITS, SIEVE_BITS = 1 << 15, 1 << 26  # of one bitmap, and of all: 8 MB at most


def sieved(rows: DataFrame, cells: DataFrame, side: float) -> DataFrame:
    """rows (x, y) but those whose cell is surely not among cells (cx, cy): the cells' hashes make bitmaps of bounded
    size that are broadcast. An exact join must follow; with very many cells more rows pass."""
    bits = min(SIEVE_BITS, -(-max(1, 16 * cells.count()) // PART_BITS) * PART_BITS)
    slot = F.pmod(F.xxhash64("cx", "cy"), F.lit(bits))
    words = cells.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("held"))
    words = rows.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    # Arrays of words and not binary columns, as reading a byte of those copies them.
    listed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("held", F.lit(0)).alias("held"))))
    maps = words.groupBy(F.floor(F.col("word") * 64 / PART_BITS).alias("_part")).agg(listed.alias("l")).select("_part", F.col("l.held").alias("_held"))
    own = rows.withColumn("cx", cell(F.col("x"), side)).withColumn("cy", cell(F.col("y"), side)).withColumn("_slot", slot)
    met = own.withColumn("_part", F.floor(F.col("_slot") / PART_BITS)).join(F.broadcast(maps), "_part")
    word = F.get("_held", F.floor(F.col("_slot") % PART_BITS / 64).cast("int"))
    return met.where(F.getbit(word, (F.col("_slot") % 64).cast("int")) == 1).select(rows.columns)


def nearest(queries: DataFrame, points: DataFrame, k: int, radius: float, sieve: bool = False) -> DataFrame:
    """(q_id, id, d2, rank): for each query (id, x, y) the k nearest points (id, x, y). Queries with fewer than
    k points within the radius look again at twice that, so the result is exact at any density. With sieve,
    points far from all queries left are dropped before the join; for many more points than queries."""
    from ..plans.store import written

    wanted = points.select("id").limit(k).count()
    left, found = queries.select("id", "x", "y"), None
    best = Window.partitionBy("q_id").orderBy("d2", "id")
    while wanted:
        near = points.select("id", "x", "y")
        if sieve:
            near = sieved(near, _around(left, radius).select("cx", "cy").distinct(), radius)
        pairs = within(left, near, radius).select(F.col("l_id").alias("q_id"), F.col("r_id").alias("id"), "d2")
        ranked = written(pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
        full = ranked.groupBy("q_id").count().where(F.col("count") >= wanted).select("q_id")
        done = ranked.join(full, "q_id", "left_semi")
        found = done if found is None else found.unionAll(done)
        left = written(left.join(full.withColumnRenamed("q_id", "id"), "id", "left_anti"), "left")
        if left.isEmpty():
            break
        radius *= 2
    if found is None:
        found = queries.select(F.col("id").alias("q_id"), "id", F.lit(0).cast("bigint").alias("d2"), F.lit(0).alias("rank")).limit(0)
    return found


def in_box(points: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    return points.where(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))


def in_radius(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The box lets a scan skip row groups; the circle decides."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return in_box(points, x - radius, y - radius, x + radius, y + radius).where(d2 <= F.lit(radius) * F.lit(radius))


def segment_cells(segments: DataFrame, side: float, pad: float) -> DataFrame:
    """segments (x1, y1, x2, y2, ...) once for each cell that their padded box meets."""
    lo = lambda a, b: cell(F.least(a, b) - pad, side)
    hi = lambda a, b: cell(F.greatest(a, b) + pad, side)
    wide = segments.select("*", F.explode(F.sequence(lo(F.col("x1"), F.col("x2")), hi(F.col("x1"), F.col("x2")))).alias("cx"))
    return wide.select("*", F.explode(F.sequence(lo(F.col("y1"), F.col("y2")), hi(F.col("y1"), F.col("y2")))).alias("cy"))


def project(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Nearest point of the segment (x1, y1, x2, y2) to (x, y): its coordinates and its place, 0 to 1."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / size)))
    return F.col("x1") + t * dx, F.col("y1") + t * dy, t


def near_segments(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """All pairs of points (id, x, y) and segments (columns as they are) at most radius apart, with px, py, t, d2."""
    side = max(radius, 1)
    at = points.select(F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"), cell(F.col("x"), side).alias("cx"), cell(F.col("y"), side).alias("cy"))
    px, py, t = project(F.col("p_x"), F.col("p_y"))
    joined = segment_cells(segments, side, radius).join(at, ["cx", "cy"]).select("*", px.alias("px"), py.alias("py"), t.alias("t"))
    d2 = F.pow(F.col("p_x") - F.col("px"), 2) + F.pow(F.col("p_y") - F.col("py"), 2)
    return joined.withColumn("d2", d2).where(F.col("d2") <= F.lit(float(radius)) * F.lit(float(radius))).drop("cx", "cy")


def convex_hull(points: DataFrame) -> DataFrame:
    """(pos, x, y): hulls of the partitions first, so only corners meet in one task."""
    corners = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(shapes.hull_partition, "x double, y double")
    whole = corners.coalesce(1).mapInPandas(shapes.hull_partition, "x double, y double")
    return whole.select(F.monotonically_increasing_id().alias("pos"), "x", "y")


def densest(points: DataFrame, radius: float, sample: int = 100, seed: int = 42) -> DataFrame:
    """(id, neighbours) of the sampled point with most others within the radius."""
    chosen = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    met = within(chosen, points, radius).where("l_id <> r_id").groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("neighbours"))
    return met.orderBy(F.desc("neighbours"), "id").limit(1)


def closest(points: DataFrame, x: float, y: float, size: int) -> DataFrame:
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.withColumn("d2", d2).orderBy("d2", "id").limit(size)
