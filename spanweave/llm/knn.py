"""Exact top-k inner product search as a Voronoi join.

Vectors are grouped by their nearest pivot. Each group's size and largest distance to its pivot (a few
numbers a group) bound the inner product of any query with any member: q.p - |q| r and q.p + |q| r. For
each query the lower bounds and sizes, without the rows of the query's own id, give a score that its k-th
result reaches at least; only groups whose upper bound reaches that get the query, and only groups with queries take part. A group
is dealt in blocks of bounded numbers of rows and parts of bounded numbers of queries, each block meeting
each part in one matrix product, and the results merged. So a row travels once for each QUERY_BLOCK
queries that its own group got, and a group with a third of all rows is many tasks.

Components x become floor(256 * x). Vectors that are null, empty or hold null or non-finite components,
and rows without id, take no part. Vectors of unequal length meet as if the shorter ended in zeros.
Rows that repeat an id are all candidates, but none for a query of that id. An empty table, or one
without queries, gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
DATA_BLOCK, QUERY_BLOCK, TILE = 4096, 8192, 1024
MOST_PIVOTS = 4096
RESULT = "query_id bigint, vec_id bigint, score bigint"


def _matrix(column: pa.Array | list, width: int) -> np.ndarray:
    """Rows of doubles from lists; missing components at the end are 0, others unfit make the row nan."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.floor(SCALE * out)


def deal(data: DataFrame, sent: DataFrame, sizes: dict[int, int], data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """data (cell, vec_id, v) and sent (cell, query_id, v), each with block and part: every block of a cell's
    rows meets every part of the queries sent to that cell. sizes: rows a cell."""
    asked = [(r[0], -(-sizes[r[0]] // data_block), -(-r[1] // query_block)) for r in sent.groupBy("cell").count().collect()]  # a row a pivot
    grid = F.broadcast(data.sparkSession.createDataFrame(asked, "cell int, blocks int, parts int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = data.join(grid, "cell").select("cell", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int").alias("block"), every("parts").alias("part"), "vec_id", "v")
    asking = sent.join(grid, "cell").select("cell", every("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "query_id", "v")
    return rows, asking


def top_rows(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """For each query its k best rows, ties to the smaller id; exact also beyond 2 ** 53."""
    reach = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if reach < 2**53:
        scores = (queries @ vectors.T).astype(np.int64)
    else:
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
        scores = whole(queries) @ whole(vectors).T
    out = []
    for q, row in zip(query_ids, scores, strict=True):
        at = np.flatnonzero(ids != q)
        if len(at) > k:
            least = np.sort(row[at])[-k] if row.dtype == object else np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= least]
        best = sorted(zip((-row[at]).tolist(), ids[at].tolist(), strict=True))[:k]
        out += [(q, i, -s) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype=object)


def top_k(vectors: DataFrame, queries_where: str = "vec_id % 50 = 0", k: int = 5, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score); vectors: vec_id, embedding. Pivots: about the square root of the rows
    over four, at most MOST_PIVOTS, chosen by a hash of their ids."""
    spark = vectors.sparkSession
    fit = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.where(fit).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not n:
        return empty
    count = pivots or min(MOST_PIVOTS, max(8, math.isqrt(n) // 4))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    centres = np.unique(_matrix(pa.array([r[1] for r in sample], pa.list_(pa.float64())), width), axis=0)
    squares = (centres**2).sum(axis=1)

    def assign(batches):
        for batch in batches:
            m = _matrix(batch.column(1), width)
            tiles = (m[i : i + TILE] for i in range(0, len(m), TILE))
            cell = np.concatenate([(squares - 2 * t @ centres.T).argmin(axis=1) for t in tiles]) if len(m) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(np.linalg.norm(m - centres[cell], axis=1)), pa.array([x.tobytes() for x in m], pa.binary())], ["vec_id", "cell", "away", "v"])

    data = written(rows.mapInArrow(assign, "vec_id bigint, cell int, away double, v binary"), "cells")
    summary = {r[0]: (r[1], r[2]) for r in data.groupBy("cell").agg(F.count("*"), F.max("away")).collect()}  # a row a pivot
    queries = data.where(queries_where)
    cells = np.array(sorted(summary))
    place = {int(c): i for i, c in enumerate(cells)}
    sizes = np.array([summary[c][0] for c in cells])
    radius = np.array([summary[c][1] for c in cells])

    def reached(q: np.ndarray, home: list, owns: list) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell's place) of the groups that may hold one of a query's k best."""
        middle, spread = q @ centres[cells].T, np.linalg.norm(q, axis=1)[:, None] * radius
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6
        low, high = middle - spread - slack, middle + spread + slack
        order = np.argsort(-low, axis=1, kind="stable")
        # Rows with the query's own id are no results: one in its cell, or those counted in `own`.
        others = np.tile(sizes, (len(q), 1))
        for i, (cell, own) in enumerate(zip(home, owns, strict=True)):
            for c, copies in ((o["cell"], o["n"]) for o in own) if own else ((cell, 1),):
                others[i, place[c]] -= copies
        enough = (np.cumsum(np.take_along_axis(others, order, 1), axis=1) >= k).argmax(axis=1)
        known = np.take_along_axis(low, np.take_along_axis(order, enough[:, None], 1), 1)
        known[others.sum(axis=1) < k] = -np.inf
        return np.nonzero(high >= known)

    def send(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                part = batch.slice(i, TILE)
                q = np.frombuffer(b"".join(part.column(1).to_pylist())).reshape(-1, width)
                row, at = reached(q, part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(cells[at].astype(np.int32)), part.column(1).take(pa.array(row))], ["query_id", "cell", "v"])

    asked = queries.select(F.col("vec_id").alias("of")).distinct()
    per_cell = data.groupBy("vec_id", "cell").agg(F.count("*").alias("n")).join(asked, F.col("vec_id") == F.col("of"), "left_semi")
    repeated = per_cell.groupBy(F.col("vec_id").alias("of")).agg(F.collect_list(F.struct("cell", "n")).alias("own"), F.sum("n").alias("rows")).where("rows > 1").select("of", "own")
    held = queries.join(written(repeated, "repeated"), F.col("vec_id") == F.col("of"), "left")
    sent = held.select("vec_id", "v", "cell", "own").mapInArrow(send, "query_id bigint, cell int, v binary")
    dealt, asking = deal(data, written(sent, "sent"), {int(c): int(n) for c, n in zip(cells, sizes, strict=True)})

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        matrix = lambda f: np.frombuffer(b"".join(f["v"])).reshape(-1, width)
        ids, vectors, asked, q = left["vec_id"].to_numpy(), matrix(left), right["query_id"].to_numpy(), matrix(right)
        tiles = [top_rows(ids, vectors, asked[i : i + TILE], q[i : i + TILE], k) for i in range(0, len(q), TILE)]
        return pd.concat(tiles).astype("int64")

    keys = ["cell", "block", "part"]
    found = dealt.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(solve, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id
  where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
