"""Exact substring deduplication: bytes covered by a string of LENGTH bytes that also starts elsewhere.

Equal whole texts are one class: they are told by their hash and need no further look. For the rest,
every string of LENGTH bytes is named by the smallest hash among its grams of GRAM bytes, so equal
strings always share a name. Names that occur once are dropped. A run of neighbouring strings with one
name is a unit: its bytes go to the shard that its name hashes to, equal units only once. Each shard's
suffixes are put in order with common prefixes (see induced.py); neighbours that share LENGTH bytes are
repeats. A name with too many different units for one shard is split into single strings by their hash.
Nothing is sampled or capped, and matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, byte_values, discard, mix, powers, text_chunks, written
from .induced import repeated

LENGTH, GRAM = 200, 100
SHARD_BYTES, LEAST_SHARDS = 1 << 20, 64
HOT_BYTES = 1 << 20
END = b"\xff"  # never part of UTF-8


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


class Names:
    """The names of all strings of `length` bytes in some texts laid end to end."""

    def __init__(self, raw: list[bytes], length: int, gram: int):
        sizes = np.array([len(r) for r in raw], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        data = np.frombuffer(b"".join(raw), np.uint8)
        n, wide = len(data), length - gram + 1
        self.empty = n < length
        if self.empty:
            return
        sums = np.append(np.uint64(0), np.cumsum(byte_values()[data] * powers(BASE, n), dtype=np.uint64))
        self.grams = mix((sums[gram:] - sums[:-gram]) * powers(BASE_INV, n)[: n - gram + 1]) | np.uint64(1)
        self.least = _sliding(self.grams, wide, np.minimum)
        open_ = np.zeros(n - length + 2, np.int64)
        fits = sizes >= length
        np.add.at(open_, self.begins[fits], 1)
        np.add.at(open_, self.ends[fits] - length + 1, -1)
        self.valid = np.cumsum(open_[:-1]) > 0
        self.wide = wide

    def chosen(self) -> np.ndarray:
        """The places whose gram names some string; a name with two of them may hold a repeat."""
        if self.empty:
            return np.empty(0, np.int64)
        pad = np.zeros(self.wide - 1, np.uint64)
        most = _sliding(np.concatenate([pad, np.where(self.valid, self.least, 0), pad]), self.wide, np.maximum)
        return np.flatnonzero(self.grams == most)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of strings with one name: (name, first start, number of starts)."""
        if self.empty or not self.valid.any():
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        fresh = self.valid.copy()
        fresh[1:] &= ~self.valid[:-1] | (self.least[1:] != self.least[:-1])
        stop = self.valid.copy()
        stop[:-1] &= ~self.valid[1:] | fresh[1:]
        first, last = np.flatnonzero(fresh), np.flatnonzero(stop)
        return self.least[first], first, last - first + 1


def _digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def _names_of(length: int, gram: int, units: bool):
    def run(batches):
        for _, texts in text_chunks(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            raw = [r for r in raw if len(r) >= length]
            if not raw:
                continue
            names, ids = Names(raw, length, gram), [_digest(r) for r in raw]
            if units:
                name, first, count = names.units()
                doc = np.searchsorted(names.ends, first, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids, pa.binary()).take(pa.array(doc)), pa.array((first - names.begins[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], ["name", "tid", "first", "starts"])
            else:
                at = names.chosen()
                doc = np.searchsorted(names.ends, at, side="right")
                keys = np.array([int.from_bytes(i[:8], "little") for i in ids], np.uint64)
                place = mix(keys[doc] + (at - names.begins[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(names.grams[at].view(np.int64)), pa.array(place.view(np.int64))], ["name", "place"])

    return run


def _cut_units(length: int):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for tid, text, units in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for u in units:
                    piece = raw[u["first"] : u["first"] + u["starts"] + length - 1]
                    out.append((hashlib.md5(piece, usedforsecurity=False).digest(), u["name"], tid, u["first"], piece))
                    size += len(piece)
                if size > 4 << 20:
                    yield _unit_batch(out)
                    out, size = [], 0
            if out:
                yield _unit_batch(out)

    return run


def _unit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["uid", "name", "tid", "first", "piece"])


def _runs(flags: np.ndarray) -> list[int]:
    """[begin, end, begin, end, ...] of the true stretches."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge).tolist()


def _solve(length: int, budget: int | None):
    def run(table: pa.Table) -> pa.Table:
        uids, pieces, many = (table.column(c).to_pylist() for c in ("uid", "piece", "copies"))
        text = np.frombuffer(END.join(pieces) + END, np.uint8)
        flags = repeated(text, length, **({"budget": budget} if budget else {}))
        found_uid, found = [], []
        at = 0
        for uid, piece, copies in zip(uids, pieces, many, strict=True):
            starts = len(piece) - length + 1
            runs = [0, starts] if copies > 1 else _runs(flags[at : at + starts])
            at += len(piece) + 1
            if runs:
                found_uid.append(uid)
                found.append(runs)
        return pa.table({"uid": pa.array(found_uid, pa.binary()), "runs": pa.array(found, pa.list_(pa.int32()))})

    return run


def _windows(length: int):
    def run(batches):
        for batch in batches:
            for uid, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = [hashlib.md5(piece[i : i + length], usedforsecurity=False).digest() for i in range(len(piece) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([uid] * len(hashes), pa.binary()), pa.array(np.arange(len(hashes), dtype=np.int32))], ["window", "uid", "at"])

    return run


def _spans(length: int):
    """The bytes covered by each document's repeated strings, as maximal runs."""

    def run(batches):
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                begins, ends = [], []
                for u in found:
                    begins += [u["first"] + b for b in u["runs"][::2]]
                    ends += [u["first"] + e + length - 1 for e in u["runs"][1::2]]
                spans: list[dict] = []
                for b, e in sorted(zip(begins, ends, strict=True)):
                    if spans and b <= spans[-1]["end"]:
                        spans[-1]["end"] = max(e, spans[-1]["end"])
                    else:
                        spans.append({"begin": b, "end": e})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], ["tid", "spans"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES, budget: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (rows, spans, texts). rows: doc_id, tid (class of equal texts), sha (of the text), n_bytes,
    n_rows (of the class). spans: tid, spans array<struct<begin, end>> in bytes, for classes of which a
    part repeats elsewhere. texts: tid, text of at least those classes. A class of several rows with
    length bytes or more repeats as a whole, whatever its spans."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2("text", 256)
    rows = written(texts.select("doc_id", F.unhex(F.substring(sha, 1, 32)).alias("tid"), sha.alias("sha"), F.octet_length("text").cast("bigint").alias("n_bytes")), "rows")
    classes = written(rows.groupBy("tid").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("doc_id")), "classes")

    placed = texts.select("text").mapInArrow(_names_of(length, gram, False), "name bigint, place bigint")
    names = written(placed.groupBy("name").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").select("name"), "names")
    units = texts.select("text").mapInArrow(_names_of(length, gram, True), "name bigint, tid binary, first int, starts int")
    wanted = units.join(names, "name", "left_semi").groupBy("tid").agg(F.collect_set(F.struct("name", "first", "starts")).alias("units"))
    held = wanted.join(classes, "tid").select("doc_id", F.col("tid").alias("wanted"), "units")
    same = F.unhex(F.substring(sha, 1, 32)) == F.col("wanted")  # a doc_id may stand for several texts
    held = texts.join(held, texts["doc_id"].eqNullSafe(held["doc_id"])).where(same)
    held = written(held.select(F.col("wanted").alias("tid"), "text", "units").dropDuplicates(["tid"]), "texts")

    discard(names)
    pieces = written(held.mapInArrow(_cut_units(length), "uid binary, name bigint, tid binary, first int, piece binary"), "pieces")
    kinds = written(pieces.groupBy("uid").agg(F.count("*").alias("copies"), F.first("name").alias("name"), F.first("piece").alias("piece")), "kinds")
    per_name = written(kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum(F.octet_length("piece")).alias("size")), "per_name")
    joined = kinds.join(per_name, "name")
    simple = (F.col("kinds") == 1) & (F.col("copies") > 1)
    alike = joined.where(simple).select("uid", F.array(F.lit(0), F.octet_length("piece") - length + 1).alias("runs"))
    total = per_name.where((F.col("size") <= hot_bytes)).agg(F.sum("size")).first()[0] or 0
    shards = max(LEAST_SHARDS, int(total) // SHARD_BYTES)
    dealt = joined.where(~simple & (F.col("size") <= hot_bytes)).select("uid", "piece", "copies", F.pmod(F.xxhash64("name"), F.lit(shards)).alias("shard"))
    solved = dealt.groupBy("shard").applyInArrow(_solve(length, budget), "uid binary, runs array<int>")
    found = alike.union(solved)

    hot = joined.where(~simple & (F.col("size") > hot_bytes)).select("uid", "piece", "copies")
    if not per_name.where(F.col("size") > hot_bytes).isEmpty():
        hot = written(hot, "hot")
        windows = written(hot.select("uid", "piece").mapInArrow(_windows(length), "window binary, uid binary, at int"), "windows")
        twice = written(windows.groupBy("window").agg(F.min(F.struct("uid", "at")).alias("lo"), F.max(F.struct("uid", "at")).alias("hi")).where("lo < hi").select("window"), "twice")
        again = windows.join(twice, "window", "left_semi").join(hot.where("copies = 1").select("uid"), "uid", "left_semi")
        again = again.groupBy("uid").agg(F.sort_array(F.collect_set("at")).alias("at")).select("uid", F.flatten(F.transform("at", lambda a: F.array(a, a + 1))).alias("runs"))
        whole = hot.where("copies > 1").select("uid", F.array(F.lit(0), F.octet_length("piece") - length + 1).alias("runs"))
        found = found.union(again).union(whole)
    found = written(found, "found")
    covered = pieces.select("uid", "tid", "first").join(found, "uid").groupBy("tid").agg(F.collect_list(F.struct("first", "runs")).alias("found"))
    spans = written(covered.mapInArrow(_spans(length), "tid binary, spans array<struct<begin:int,end:int>>"), "spans")
    discard(pieces, kinds, per_name, found)
    return rows.join(classes.select("tid", "n_rows"), "tid"), spans, held


def _removed():
    return F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.getField("end") - s.getField("begin")), F.lit(0).cast("bigint"))


def _kept():
    """The text's bytes outside its spans (sorted, disjoint)."""
    raw = F.encode("text", "UTF-8")
    n = F.size("spans")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1).getField("end"))
    end = lambda i: F.when(i == n, F.octet_length("text")).otherwise(F.get("spans", i).getField("begin"))
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(b""), lambda kept, i: F.concat(kept, F.substring(raw, begin(i) + 1, end(i) - begin(i))))


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row. Null text counts as empty; texts
    under `length` bytes lose nothing; rows that repeat a text lose all of it (the string also starts in
    the other row), and rows that repeat a doc_id are judged each by its text. Extra columns are ignored;
    an empty table gives an empty one."""
    rows, spans, texts = repeats(docs, length, **options)
    cut = texts.join(spans, "tid").select("tid", _removed().alias("removed"), F.size("spans").cast("bigint").alias("runs"), F.sha2(_kept(), 256).alias("kept"))
    whole = (F.col("n_rows") > 1) & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("bigint")
    cut = written(cut, "cut")
    discard(texts, spans)
    return rows.join(cut, "tid", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("bigint")).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def kept_bytes(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, kept binary): each row's bytes outside its repeats; binary, as a cut may fall inside a character."""
    rows, spans, texts = repeats(docs, length, **options)
    cut = texts.join(spans, "tid").select("tid", _kept().alias("kept"))
    whole = (F.col("n_rows") > 1) & (F.col("n_bytes") >= length)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    size = rows.select("tid", whole.alias("whole")).distinct()
    joined = named.join(size, "tid").join(cut, "tid", "left")
    return joined.select("doc_id", F.when(F.col("whole"), F.lit(b"")).otherwise(F.coalesce("kept", F.encode("text", "UTF-8"))).alias("kept"))
