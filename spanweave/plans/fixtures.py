"""Networks derived from the relational test tables with integer arithmetic: coordinates in millionths
of a degree, weights in millimetres. SQL has the same tables as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LON0, LAT0, STEP = -73_900_000, 42_600_000, 1000

SQL = """
fx_dim AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part),
fx_nodes AS (SELECT p_partkey AS node_id, -73900000 + (p_partkey % w) * 1000 AS lon_u,
  42600000 + CAST(floor(p_partkey / w) AS BIGINT) * 1000 AS lat_u FROM part CROSS JOIN fx_dim),
fx_edges AS (
  SELECT p_partkey AS src, p_partkey + 1 AS dst, 80000 + 2 * ((p_partkey * 7919) % 40009) AS w_mm
  FROM part CROSS JOIN fx_dim WHERE p_partkey % w < w - 1 AND p_partkey + 1 < n
  UNION ALL
  SELECT p_partkey, p_partkey + w, 80000 + 2 * ((p_partkey * 7919) % 40009) + 1
  FROM part CROSS JOIN fx_dim WHERE p_partkey + w < n),
fx_adj AS (SELECT src AS a, dst AS b, w_mm AS w FROM fx_edges UNION ALL SELECT dst, src, w_mm FROM fx_edges),
fx_terminals AS (SELECT DISTINCT (s_suppkey * 7919) % n AS node_id FROM supplier CROSS JOIN fx_dim),
fx_locations AS (SELECT c_custkey AS loc_id, -73900000 + (c_custkey * 7919) % (w * 1000) AS lon_u,
  42600000 + (c_custkey * 104729) % (w * 1000) AS lat_u, 1 + c_custkey % 4 AS unit_count
  FROM customer CROSS JOIN fx_dim),
fx_road_vertices AS (SELECT l_orderkey AS road_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY
  l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS pos,
  -73900000 + (l_partkey % w) * 1000 AS lon_u, 42600000 + CAST(floor(l_partkey / w) AS BIGINT) * 1000 AS lat_u
  FROM lineitem CROSS JOIN fx_dim),
fx_road_vertices_j AS (SELECT road_id, pos, lon_u + CASE WHEN (lon_u + lat_u) % 3 = 0
  THEN 1 + (road_id * 7919) % 997 ELSE 0 END AS lon_u, lat_u FROM fx_road_vertices),
fx_lines AS (SELECT * FROM fx_road_vertices WHERE road_id IN
  (SELECT road_id FROM fx_road_vertices GROUP BY road_id HAVING count(*) >= 2)),
fx_lines_j AS (SELECT * FROM fx_road_vertices_j WHERE road_id IN
  (SELECT road_id FROM fx_road_vertices GROUP BY road_id HAVING count(*) >= 2))
"""


def oracle(select: str, more: str = "") -> str:
    """The fixtures as common table expressions, further ones, and the statement."""
    return f"WITH RECURSIVE {SQL}{', ' + more if more else ''} {select}"


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.n = self.table("part").count()
        root = int(self.n**0.5)
        self.w = root + (root * root < self.n)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _at(self, key: str) -> list:
        return [(LON0 + (F.col(key) % self.w) * STEP).alias("lon_u"), (LAT0 + F.floor(F.col(key) / self.w) * STEP).alias("lat_u")]

    @property
    def nodes(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("node_id"), *self._at("p_partkey"))

    @property
    def edges(self) -> DataFrame:
        k = F.col("p_partkey")
        weight = 80000 + 2 * ((k * 7919) % 40009)
        part = self.table("part").select("p_partkey")
        right = part.where((k % self.w < self.w - 1) & (k + 1 < self.n)).select(k.alias("src"), (k + 1).alias("dst"), weight.alias("w_mm"))
        up = part.where(k + self.w < self.n).select(k.alias("src"), (k + self.w).alias("dst"), (weight + 1).alias("w_mm"))
        return right.unionAll(up)

    @property
    def terminals(self) -> DataFrame:
        return self.table("supplier").select(((F.col("s_suppkey") * 7919) % self.n).alias("node_id")).distinct()

    @property
    def locations(self) -> DataFrame:
        k = F.col("c_custkey")
        side = self.w * STEP
        return self.table("customer").select(k.alias("loc_id"), (LON0 + (k * 7919) % side).alias("lon_u"), (LAT0 + (k * 104729) % side).alias("lat_u"), (1 + k % 4).alias("unit_count"))

    @property
    def road_vertices(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
        return self.table("lineitem").select(F.col("l_orderkey").alias("road_id"), (F.row_number().over(order) - 1).cast("bigint").alias("pos"), *self._at("l_partkey"))

    @property
    def road_vertices_j(self) -> DataFrame:
        moved = F.when((F.col("lon_u") + F.col("lat_u")) % 3 == 0, 1 + (F.col("road_id") * 7919) % 997).otherwise(0)
        return self.road_vertices.withColumn("lon_u", F.col("lon_u") + moved)
