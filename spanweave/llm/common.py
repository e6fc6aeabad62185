"""Shared pieces: written intermediate tables, text chunks, word scans and their hashes.

All text work happens on byte arrays of about one megabyte at a time, so a task's memory does not
depend on its partition's size; one document larger than that is a chunk of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000  # of an Arrow batch, which is held at once by the JVM and by Python
SHINGLE_WORDS = 5
PART_BITS = 1 << 15  # of one bitmap that bitmap_construct_agg makes
SIEVE_BITS = 1 << 26  # 8 MB at most; with more keys than that has room for, more rows pass

_local_base: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only in local mode without a setting."""
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="spanweave-")
        atexit.register(__import__("shutil").rmtree, _local_base, True)
    return "file://" + _local_base


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def _while_writing(spark: SparkSession, batch_rows: int) -> Iterator[None]:
    """Shuffle files of the jobs in here go with them, as their result is a written table; whole texts travel to
    Python in small batches."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. Rows that
    may be very long travel to Python batch_rows at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanweave/{name}-{uuid.uuid4().hex}"
    with _while_writing(spark, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; others pass unharmed."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            _remove(t.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of df has, whatever those are called."""
    taken = {c.lower() for c in df.columns}
    tail = next(t for t in ("_" * k for k in range(1, len(taken) + 2)) if not any(n + t in taken for n in names))
    return [n + tail for n in names]


def marked(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with a further boolean column: false where key, a bigint, is surely not in the only column of keys. The
    keys' hashes make bitmaps of bounded size that are broadcast, so wide rows that a join would drop or leave as
    they are need no shuffle; an exact join must follow. keys should be cheap to read twice."""
    bits = min(SIEVE_BITS, -(-max(1, 32 * keys.count()) // PART_BITS) * PART_BITS)
    part, held = fresh(rows, "part", "held")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    own = slot(F.col(f"`{keys.columns[0]}`").cast("bigint"))
    maps = keys.groupBy(F.floor(own / PART_BITS).alias(part)).agg(F.bitmap_construct_agg(own % PART_BITS).alias(held))
    place = slot(key) % PART_BITS
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    met = rows.withColumn(part, F.floor(slot(key) / PART_BITS)).join(F.broadcast(maps), part, "left")
    return met.withColumn(name, bit).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def sifted(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows without most of those whose key is none of the keys; see marked."""
    (may,) = fresh(rows, "may")
    return marked(rows, key, keys, may).where(may).drop(may)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches holding about `limit` bytes of text, with the texts; null is the empty text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        lo, n = 0, batch.num_rows
        while lo < n:
            before = int(sizes[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            part = batch.slice(lo, hi - lo)
            yield part, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), vectorised."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            k = min(done, size - done)
            have[done : done + k] = have[:k] * np.uint64(step)
            step = step * step % (1 << 64)
            done += k
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def slice_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[starts[i]:starts[i + 1]] for each i (the last runs to the end).

    Polynomial in an odd base modulo 2 ** 64, made position-free by the base's inverse powers."""
    if not len(starts):
        return np.empty(0, np.uint64)
    weighted = values[data] * powers(BASE, len(data))
    return mix(np.add.reduceat(weighted, starts) * powers(BASE_INV, len(data))[starts])


#: The white space of the word rule (space, and 0x09 to 0x0D).
SPACES = b" \t\n\x0b\x0c\r"


@lru_cache(maxsize=1)
def _word_tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    lower = np.arange(256)
    lower[65:91] += 32
    values = byte_values()[lower]
    values[space] = 0  # so that a word's sum may run on over the space behind it
    return space, values


class Words:
    """The words of some texts: hashes in order, and each text's range lo[i]:hi[i] among them.

    Words are maximal runs of other than ASCII white space; A-Z count as a-z."""

    def __init__(self, texts: list[str], places: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        space, values = _word_tables()
        blank = space[joined]
        first = np.empty(len(blank), bool)
        first[0] = ~blank[0]
        np.logical_and(~blank[1:], blank[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        self.hashes = slice_hashes(joined, starts, values)
        edges = np.cumsum([0] + [len(r) + 1 for r in raw])
        at = np.searchsorted(starts, edges)
        self.lo, self.hi = at[:-1], at[1:]
        if places:  # byte places inside each text, for cutting
            last = np.empty(len(blank), bool)
            last[-1] = False
            np.logical_and(~blank[:-1], blank[1:], out=last[:-1])
            origin = np.repeat(edges[:-1], self.hi - self.lo)
            self.begin, self.end = starts - origin, np.flatnonzero(last) + 1 - origin
            self.raw = raw

    def shingles(self, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of k successive words, and each text's range among them. With fewer than k words
        (but one at least) the whole sequence is the only shingle."""
        h, n = self.hashes, len(self.hashes)
        count = self.hi - self.lo
        sums = np.zeros(max(0, n - k + 1), np.uint64)
        for j, c in enumerate(powers(0xC2B2AE3D27D4EB4F, k)):
            sums += h[j : n - k + 1 + j] * c if len(sums) else sums
        full = mix(sums)
        made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        hi = np.cumsum(made)
        lo = hi - made
        out = np.empty(int(made.sum()), np.uint64)
        long = count >= k
        if long.any():
            reps = made[long]
            inside = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            out[np.repeat(lo[long], reps) + inside] = full[np.repeat(self.lo[long], reps) + inside]
        for i in np.flatnonzero((count > 0) & ~long):
            words = h[self.lo[i] : self.hi[i]]
            salt = powers(0x9FB21C651E98DF25, k + 1)[len(words) :][:1]  # tells lengths apart
            out[lo[i]] = mix((words * powers(0xC2B2AE3D27D4EB4F, len(words))).sum(dtype=np.uint64, keepdims=True) + salt)[0]
        return out, lo, hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 for each i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
