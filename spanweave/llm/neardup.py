"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, star edges.

1. One Arrow pass hashes each text's distinct shingles once into BINS bins, fills empty bins from
   full ones (each empty bin probes the bins in its own pseudo-random order until one is full) and
   folds ROWS bins a band into BANDS bucket keys. Texts with the same shingle set share a class id.
2. A bucket's members are joined to its most typical member only, a star; pairs whose sizes alone
   keep them below the threshold are ruled out, all others are confirmed on the full shingle sets.
3. A star can miss a link between two of its rays. So in every bucket that still spans several
   components, members outside the bucket's largest component meet all others with which they share
   one of their rarest shingles, as many of them as a link could miss, and whose sizes are near enough
   (the join's key holds both); what passes the same rules is confirmed. Nothing is capped.

With 32 bands of 4 rows a pair at the threshold of 0.75 shares no bucket with odds of 5e-6, and much
smaller ones above it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, fresh, marked, mix, sifted, text_chunks, written
from .components import components

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
CLOSE = 75  # per cent


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each bin, all bins in the order in which it probes them."""
    cells = mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)).reshape(BINS, BINS)
    return np.argsort(cells, axis=1).astype(np.int64)


def signature(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of BINS minima for each set; sets: sorted distinct hashes, one set after the other."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    slot = rows * BINS + (sets >> np.uint64(57)).astype(np.int64)
    first = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.empty(0, bool)
    full = np.zeros(len(sizes) * BINS, bool)
    full[slot[first]] = True
    values = np.zeros(len(full), np.uint64)
    values[slot[first]] = sets[first]
    full, values = full.reshape(-1, BINS), values.reshape(-1, BINS)
    out = values.copy()
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    probes = _probes()
    for attempt in range(BINS):
        if not len(row):
            break
        at = probes[bin_, attempt]
        hit = full[row, at]
        out[row[hit], bin_[hit]] = values[row[hit], at[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def distinct_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes, one text after the other, and their numbers."""
    hashes, lo, hi = Words(texts).shingles()
    parts = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        x = np.sort(hashes[a:b])
        parts.append(x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(x) for x in parts], np.int64)


def _class_ids(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each whole set (0 for an empty one)."""
    ends = np.cumsum(sizes)
    sums = np.append(np.uint64(0), np.cumsum(mix(sets ^ np.uint64(0x1D8E4E27C47D124F)), dtype=np.uint64))
    ids = mix((sums[ends] - sums[ends - sizes]) + sizes.astype(np.uint64) * np.uint64(0xEB44ACCAB455D165))
    return np.where(sizes > 0, ids, np.uint64(0)).view(np.int64)


def _features(batches):
    for part, texts in text_chunks(batches):
        sets, sizes = distinct_shingles(texts)
        sig = signature(sets, sizes)
        band = np.zeros((len(sizes), BANDS), np.uint64)
        for r in range(ROWS):
            band = mix(band * np.uint64(31) + sig[:, r::ROWS])
        band = (band ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)
        band[sizes == 0] = 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(band.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(sizes), pa.array(_class_ids(sets, sizes)), lists],
            ["doc_id", "text_key", "n_shingles", "cid", "bands"],
        )


def _sets(batches):
    for part, texts in text_chunks(batches):
        sets, sizes = distinct_shingles(texts)
        edges = np.append(0, np.cumsum(sizes))
        own = pa.array(_class_ids(sets, sizes))  # a doc_id may stand for several texts
        yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(sets.view(np.int64)))], ["cid", "members"])


def _may_link() -> str:
    return f"100 * least(a.n_shingles, b.n_shingles) >= {CLOSE} * greatest(a.n_shingles, b.n_shingles)"


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; b, the hub of a star, may be very common."""
    pairs = written(pairs, "pairs")
    of_a, of_b = (sifted(sets, F.col("cid"), pairs.select(c)).select(F.col("cid").alias(c), F.col("members").alias(f"of_{c}")) for c in ("a", "b"))
    joined = pairs.join(of_a, "a").join(of_b, "b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    counted = joined.select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("total"))
    links = written(counted.where(f"100 * both >= {CLOSE} * (total - both)").select("a", "b"), "links")
    discard(pairs)
    return links


def near_duplicates(docs: DataFrame, with_key: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Null or wordless text: an empty set, linked with nothing (its own component). Fewer than five words:
    one shingle. Rows that repeat a doc_id are judged each by its text. A null doc_id stays null and
    kept; a text that only such rows hold takes no part, so it connects no others. Extra columns are
    ignored; an empty table gives an empty one."""
    features = written(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).mapInArrow(_features, "doc_id bigint, text_key bigint, n_shingles bigint, cid bigint, bands array<bigint>"), "features")
    whole = written(features.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    rows = whole.select("cid", F.explode("bands").alias("bucket"))
    # Tables are written before a join on a key that may be hot, so that both sides are shuffled and can be split.
    mixed = written(rows.groupBy("bucket").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n"), "mixed")
    members = written(rows.join(mixed, "bucket"), "members")
    classes = whole.drop("bands")
    wanted = written(classes.join(members.select("cid").distinct(), "cid", "left_semi").select(F.col("rep").alias("doc_id"), "cid"), "wanted")
    discard(mixed)
    texts = sifted(docs.select("doc_id", "text"), F.col("doc_id"), wanted.select("doc_id")).join(wanted, "doc_id").select("cid", "text")
    sets = written(texts.mapInArrow(_sets, "cid bigint, members array<bigint>").dropDuplicates(["cid"]), "sets")
    discard(wanted)

    # The hub of a bucket is its member that shares most buckets with others: of edited copies the least edited.
    typical = written(members.groupBy("cid").agg(F.sum("n").alias("met")), "typical")
    hubs = written(members.join(typical, "cid").groupBy("bucket").agg(F.max(F.struct("met", "cid")).alias("h")).select("bucket", F.col("h.cid").alias("hub"), F.col("h.met").alias("met")), "hubs")
    stars = members.join(hubs, "bucket").where("cid <> hub").groupBy("cid", "hub", "met").count()
    stars = stars.alias("p").join(classes.alias("a"), F.expr("p.cid = a.cid")).join(classes.alias("b"), F.expr("p.hub = b.cid")).where(_may_link()).select(F.col("p.cid").alias("a"), F.col("p.hub").alias("b"), "p.met")
    stars = written(stars, "stars")
    links = _confirmed(stars.groupBy("a").agg(F.max(F.struct("met", "b")).alias("k")).select("a", F.col("k.b").alias("b")), sets)
    label = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        of = lambda c: F.coalesce(f"r{c}.root", f"p.{c}")
        return pairs.alias("p").join(label.alias("ra"), F.expr("p.a = ra.node"), "left").join(label.alias("rb"), F.expr("p.b = rb.node"), "left").where(of("a") != of("b")).select("p.a", "p.b")

    more = _confirmed(apart(stars), sets)
    if not more.isEmpty():
        discard(label)
        links = links.union(more)
        label = components(links)

    info = classes.join(label, classes.cid == label.node, "left").select(classes["*"], F.coalesce("root", "cid").alias("root")).drop("rep")
    held = members.select("bucket", "cid").join(info, "cid")
    per = held.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    spans = written(per.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("main.root").alias("main")), "spans")
    near = written(held.join(spans, "bucket"), "held")
    # Two texts share `both` = ceil(3 / 7 * (n_a + n_b)) shingles at least, so with shingles from rare to
    # common each has a shared one among its first n - both + 1. Heavily edited copies of a common text
    # begin with their own edits, so they meet few others there.
    tokens = sets.join(near.select("cid").distinct(), "cid", "left_semi").select("cid", F.explode("members").alias("m"))
    rarity = written(tokens.groupBy("m").agg(F.count("*").alias("df")), "rarity")
    listed = tokens.join(rarity, "m").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "m"))).alias("all"))
    first = listed.select("cid", F.posexplode(F.slice("all", F.lit(1), F.size("all") - F.ceil(F.size("all") * (CLOSE / 100)).cast("int") + 1)).alias("place", "t")).select("cid", "place", "t.m")
    first = written(first.join(info.select("cid", "n_shingles", "root"), "cid"), "first")
    outside = first.join(near.where("root <> main").select("cid").distinct(), "cid", "left_semi")
    both = "(3 * (a.n_shingles + b.n_shingles) + 6) div 7"
    size = F.floor(F.log(F.col("n_shingles")) / math.log(100 / CLOSE))  # linked sets are at most one apart
    outside = written(outside.withColumn("size", F.explode(F.array(size - 1, size, size + 1))), "outside")
    first = written(first.withColumn("size", size), "sized")
    rest = outside.alias("a").join(first.alias("b"), F.expr(f"a.m = b.m and a.size = b.size and a.root <> b.root and a.place + {both} <= a.n_shingles and b.place + {both} <= b.n_shingles and {_may_link()}"))
    rest = rest.select(F.least("a.cid", "b.cid").alias("a"), F.greatest("a.cid", "b.cid").alias("b")).distinct()
    last = _confirmed(rest, sets)
    if not last.isEmpty():
        former, label = label, components(links.union(last))
        discard(former)
    discard(near, members, sets, typical, hubs, stars, spans, rarity, first, outside)

    rooted = classes.join(label, classes.cid == label.node, "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    smallest = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "smallest")
    named = rooted.join(smallest, "root").select("cid", "component_id")
    out = features.select("doc_id", "text_key", "n_shingles", "cid").join(named, "cid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", *["text_key"] * with_key, "n_shingles", component.alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near_duplicates")
    discard(features, whole, label, smallest)
    return out


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose document is not kept; all columns stay. Rows that repeat both doc_id and
    text are one document and stay or go together; rows without doc_id stay."""
    id_, key, may = fresh(docs, "id", "key", "may")
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    gone = near_duplicates(keyed, with_key=True).where("not kept").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    gone = written(gone, "gone")
    split = marked(docs, text_key, gone.select(key), may)
    same = (split["doc_id"] == F.col(id_)) & (text_key == F.col(key))
    return split.where(~F.col(may)).union(split.where(may).join(gone, same, "left_anti")).drop(may)
