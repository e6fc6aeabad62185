from spanweave.operators import snap
from spanweave.streaming.snapping import snap_stream

X0, Y0 = -73_900_000, 42_000_000


def test_stream_gives_what_one_batch_gives(spark, tmp_path):
    nodes = spark.createDataFrame([(0, X0, Y0), (1, X0 + 4000, Y0)], "node_id bigint, lon_u bigint, lat_u bigint")
    edges = spark.createDataFrame([(0, 1, 1000)], "src bigint, dst bigint, weight bigint")
    segments = snap.chords(nodes, edges)
    where = spark.createDataFrame([(i, X0 + 300 * i, Y0 + 100) for i in range(12)], "loc_id bigint, lon_u bigint, lat_u bigint")
    where.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(where.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    snap_stream(stream, segments, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, snap.endpoint_snap(snap.nearest_edge(where, segments)).collect()))
