"""Readers. All of them go through Spark, so paths may lie in any store it can open."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geo, shapes

PAIR = "array<double>"


def _geometry(text: str):
    """GeoJSON coordinates at any depth as one line of points."""
    kind = F.get_json_object(text, "$.geometry.type")
    raw = F.get_json_object(text, "$.geometry.coordinates")
    one = F.array(F.from_json(raw, PAIR))
    many = F.from_json(raw, f"array<{PAIR}>")
    nested = F.flatten(F.from_json(raw, f"array<array<{PAIR}>>"))
    pairs = F.when(kind == "Point", one).when(kind.isin("LineString", "MultiPoint"), many).when(kind.isin("MultiLineString", "Polygon"), nested)
    return kind, F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One feature a line: kind, geom array<struct<x, y>>, properties map<string, string>. Lines that are no
    feature are left out."""
    lines = spark.read.text(path).where(F.get_json_object("value", "$.type") == "Feature")
    kind, geom = _geometry("value")
    props = F.from_json(F.get_json_object("value", "$.properties"), "map<string,string>")
    return lines.select(kind.alias("kind"), geom.alias("geom"), props.alias("properties"))


def read_wkb(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """A Parquet table with its WKB column turned into a line of points."""
    return spark.read.parquet(path).withColumn(column, shapes.from_wkb(F.col(column)))


def read_jdbc(spark: SparkSession, options: dict[str, str], table: str, where: str | None = None) -> DataFrame:
    """A database table; simple predicates are pushed to the database. Options (url, user, ...) come from the caller."""
    rows = spark.read.format("jdbc").options(**options).option("dbtable", table).load()
    return rows.where(where) if where else rows


def lines_from_text(rows: DataFrame, column: str = "geom") -> DataFrame:
    """rows with 'x y,x y' text turned into lines."""
    return rows.withColumn(column, geo.parse_polyline(F.col(column)))


def point_rows(shapes_: DataFrame) -> DataFrame:
    """shapes (kind, points, ...) to one row a point with x and y; kinds other than Point and MultiPoint fail."""
    checked = shapes_.withColumn("points", F.when(F.col("kind").isin("Point", "MultiPoint"), F.col("points")).otherwise(F.raise_error(F.concat(F.lit("not a point layer: "), F.col("kind"))).cast(shapes_.schema["points"].dataType)))
    rest = [c for c in shapes_.columns if c not in ("kind", "points")]
    return checked.select(*rest, F.explode("points").alias("p")).select(*rest, F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def bounded(roads: DataFrame) -> DataFrame:
    """Lines (geom) with their bounds as plain columns, so that a box becomes a filter a Parquet scan can push down."""
    return roads.withColumn("_b", geo.bbox(F.col("geom"))).select(*roads.columns, "_b.minx", "_b.miny", "_b.maxx", "_b.maxy")


def read_box(spark: SparkSession, paths: list[str], minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Bounded lines of several Parquet parts that meet a box; no paths at all is an error."""
    if not paths:
        raise FileNotFoundError("no road files given")
    return spark.read.parquet(*paths).where((F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy))


class _SqlitePart(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """spark.read.format('sqlite_layer').option('path', file).option('layer', table): a table of a SQLite layer
    file with its columns as strings and blobs, read in ranges of rowid. The file has to be where executors
    can open it. Without a layer the only table is taken; an unknown one falls back to the first."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_layer"

    def _layer(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            tables = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' order by rowid")]
        wanted = self.options.get("layer")
        if not tables:
            raise ValueError("the file has no tables")
        if wanted is None and len(tables) > 1:
            raise ValueError(f"choose a layer: {', '.join(tables)}")
        return wanted if wanted in tables else tables[0]

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f'pragma table_info("{self._layer()}")').fetchall()
        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self._layer())


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, layer: str):
        self.path, self.layer = path, layer

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{self.layer}"').fetchone()
        step = max(100_000, (high - low + 1) // 64 + 1)
        return [_SqlitePart(i, min(i + step, high + 1)) for i in range(low, high + 1, step)] or [_SqlitePart(0, 0)]

    def read(self, part):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'select * from "{self.layer}" where rowid >= ? and rowid < ?', (part.low, part.high))
