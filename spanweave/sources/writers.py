"""Writers and the content key under which a built graph is kept."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanweave-net/{name}-{uuid.uuid4().hex}"


def write_geojson(df: DataFrame, key: str, geom: str, path: str, kind: str = "LineString") -> str:
    """One feature a line; all other columns become properties."""
    pairs = F.transform(geom, lambda p: F.array(p.x, p.y))
    coordinates = F.to_json(F.get(pairs, F.lit(0)) if kind == "Point" else pairs)
    rest = [c for c in df.columns if c != geom]
    head = F.lit(f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":')
    df.select(F.concat(head, coordinates, F.lit('},"properties":'), F.to_json(F.struct(*rest)), F.lit("}"))).write.text(path)
    return path


def write_layer(df: DataFrame, path: str, form: str = "parquet", by: str | None = None) -> None:
    """Parquet, CSV or JSON lines; `by` makes a folder a value, with blanks and hyphens of the value as underscores."""
    if by:
        df = df.withColumn(by, F.translate(by, " -", "__"))
    out = df.write.mode("overwrite")
    out = out.partitionBy(by) if by else out
    out = out.option("header", "true") if form == "csv" else out
    out.format(form).save(path)


def content_key(vertices: DataFrame, **parameters) -> str:
    """A key of every vertex and the parameters: an order-free sum of row hashes, and the row count."""
    row = F.xxhash64("road_id", "pos", "lon_u", "lat_u").cast("decimal(20,0)")
    total, n = vertices.agg(F.sum(row), F.count("*")).first()
    return hashlib.sha256(json.dumps([str(total), n, parameters], sort_keys=True).encode()).hexdigest()
