"""Locations that arrive as a stream, mapped onto a fixed network batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import snap


def snap_stream(locations: DataFrame, segments: DataFrame, path: str, checkpoint: str, max_m: float = snap.MAX_SNAP_M) -> StreamingQuery:
    """Write each batch's nearest edges (see snap.nearest_edge) to path/batch=<n> and end when the input is used
    up. A batch that is repeated after a failure replaces its own folder, so nothing is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        snap.endpoint_snap(snap.nearest_edge(batch, segments, max_m)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return locations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
