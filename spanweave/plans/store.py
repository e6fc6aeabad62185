"""Tables written between the steps of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a local folder only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spanweave-net-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanweave-net/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
