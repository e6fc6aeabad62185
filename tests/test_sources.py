import sqlite3

import pytest

from spanweave import cli
from spanweave.operators import solvers
from spanweave.sources import readers, writers


def test_geojson_kinds(spark, tmp_path):
    path = tmp_path / "layer"
    path.mkdir()
    (path / "a.json").write_text('{"type":"FeatureCollection"}\n{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]},"properties":{"n":"x"}}\n{"type":"Feature","geometry":{"type":"Point","coordinates":[5,6]},"properties":{}}\n')
    got = {r["kind"]: r for r in readers.read_geojson(spark, str(path)).collect()}
    assert [tuple(p) for p in got["MultiLineString"]["geom"]] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert tuple(got["Point"]["geom"][0]) == (5, 6) and got["MultiLineString"]["properties"] == {"n": "x"}


def test_point_gate_refuses_lines(spark):
    schema = "id bigint, kind string, points array<struct<x:double,y:double>>"
    good = spark.createDataFrame([(1, "MultiPoint", [(0.0, 0.0), (1.0, 1.0)])], schema)
    assert readers.point_rows(good).count() == 2
    bad = spark.createDataFrame([(1, "LineString", [(0.0, 0.0)])], schema)
    with pytest.raises(Exception, match="not a point layer"):
        readers.point_rows(bad).collect()


def test_sqlite_layer(spark, tmp_path):
    path = str(tmp_path / "layer.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table places (id integer, name text, x real)")
        db.executemany("insert into places values (?, ?, ?)", [(i, f"p{i}", i / 2) for i in range(10)])
    spark.dataSource.register(readers.SqliteSource)
    df = spark.read.format("sqlite_layer").option("path", path).option("layer", "gone").load()
    assert df.where("id = 4").first()["x"] == 2.0 and df.count() == 10


def test_layers_and_content_key(spark, tmp_path):
    df = spark.createDataFrame([("a b-c", 1)], "name string, n int")
    writers.write_layer(df, str(tmp_path / "out"), by="name")
    assert (tmp_path / "out" / "name=a_b_c").exists()
    v = spark.createDataFrame([(1, 0, 5, 5), (1, 1, 6, 6)], "road_id bigint, pos bigint, lon_u bigint, lat_u bigint")
    assert writers.content_key(v, snap=1) == writers.content_key(v.orderBy("pos", ascending=False), snap=1) != writers.content_key(v, snap=2)


def test_box_needs_files(spark):
    with pytest.raises(FileNotFoundError):
        readers.read_box(spark, [], 0, 0, 1, 1)


def test_command_line_choices(capsys):
    assert cli.chosen("all", False) == solvers.fast_names() and len(cli.chosen("all", True)) == 6
    assert cli.chosen("genetic, pruned_dijkstra", False) == ["genetic", "pruned_dijkstra"]
    assert cli.main(["list-algorithms"]) == 0 and "pruned_dijkstra" in capsys.readouterr().out
