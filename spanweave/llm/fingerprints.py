"""Document fingerprints by one-permutation MinHash, with Spark's own functions only.

A text's set is its distinct five-word shingles (words: runs of other than ASCII white space, A-Z as
a-z; with fewer words, the whole sequence). Each shingle is hashed once; the top seven bits choose one
of 128 bins, and a bin keeps its smallest hash. An empty bin takes over a full one, found by probing in
its own pseudo-random order (optimal densification). The fingerprint packs the low four bits of each
bin into 128 hexadecimal digits; likeness corrects the share of equal digits for chance agreement.

Texts without words have the empty fingerprint: like each other (1), unlike all others (0). Null text
counts as empty. Order is by doc_id (null first), among rows of one doc_id by the text's 64-bit hash; the
row behind the last is the first, a lone row's next is itself. Repeated rows count each. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BINS, TOP_BITS, LOW_BITS = 128, 7, 4
PROBES = 16
BUCKET = 128
HOT_ROWS, MOST_HOT, SPLIT_ROWS = 4096, 100_000, 1024
NO_ID = -(2**63)
OUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: a lambda variable isn't put in place again at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _probe(attempt: int) -> Column:
    """The bin that each bin tries at this attempt; a rule, not a list."""
    state = [(b * 0x9E3779B97F4A7C15 + (attempt + 1) * 0xC2B2AE3D27D4EB4F) % 2**64 for b in range(BINS)]
    mixed = [((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) % 2**64 for x in state]
    return F.array(*[F.lit((x ^ (x >> 32)) % BINS) for x in mixed])


def shingles(text: Column) -> Column:
    """The text's shingle hashes, array<bigint>, in order; empty without words."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANKS), "")

    def of(h: Column) -> Column:
        five = F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)]))
        return F.when(F.size(h) >= 5, five).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column) -> Column:
    bin_of = lambda x: (F.shiftright(x, 64 - TOP_BITS) + BINS // 2).cast("int")
    digits = F.lit("0123456789abcdef")

    def packed(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: F.substr(digits, (v.bitwiseAND(2**LOW_BITS - 1) + 1).cast("int"), F.lit(1))), "")

    def densified(firsts: Column) -> Column:
        def fill(slots: Column) -> Column:
            def one(v: Column, b: Column) -> Column:
                tried = [F.get(slots, F.get(_probe(j), b)) for j in range(PROBES)]
                last = F.array_min(F.transform(firsts, lambda x: F.struct(F.xxhash64(b, x).alias("o"), x.alias("x")))).getField("x")
                return F.coalesce(v, *tried, last)

            return F.transform(slots, one)

        bins = F.transform(firsts, bin_of)
        slots = let(bins, lambda at: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(firsts, (F.array_position(at, b) - 1).cast("int"))))
        return let(slots, fill)

    def minima(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))

    def whole(firsts: Column) -> Column:
        return F.when(F.size(firsts) == 0, F.lit("")).when(F.size(firsts) == BINS, packed(firsts)).otherwise(packed(densified(firsts)))

    return let(let(F.sort_array(shingles(text)), minima), whole)


def likeness(a: Column, b: Column) -> Column:
    """The estimated similarity of two fingerprints, 0 to 1."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0), lambda n, i: n + F.when(F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)), 1).otherwise(0))
    chance = 2.0**-LOW_BITS
    corrected = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))


def next_of(keys: DataFrame) -> DataFrame:
    """keys (bucket: distinct, orderable) -> (bucket, next_bucket), the last one's next being the first. Ranges
    of keys are ordered in a task each; only one row a range ever meets in one task."""
    placed = written(keys.repartitionByRange("bucket").select("bucket", F.spark_partition_id().alias("g")), "ranges")
    tops = placed.groupBy("g").agg(F.min("bucket").alias("lo"))
    ends = tops.select("g", F.coalesce(F.lead("lo").over(Window.orderBy("lo")), F.min("lo").over(Window.partitionBy())).alias("next_lo"))
    inner = placed.withColumn("n", F.lead("bucket").over(Window.partitionBy("g").orderBy("bucket")))
    return inner.join(ends, "g").select("bucket", F.coalesce("n", "next_lo").alias("next_bucket"))


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs (k, h, ...) with bucket, a struct in the order of (k, h): BUCKET neighbouring ids each. Where one id
    has very many rows (a table of at most MOST_HOT buckets, as each holds that share of all rows), its
    ids are buckets of their own and its rows are told apart by the high bits of h."""
    group = F.floor(F.col("k") / F.lit(float(BUCKET))).cast("bigint")
    per_id = docs.groupBy("k").agg(F.count("*").alias("n"))
    per_group = written(per_id.groupBy(group.alias("g")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")), "groups")
    total = per_group.agg(F.sum("rows")).first()[0] or 0
    hot = per_group.where(F.col("rows") > max(HOT_ROWS, total // MOST_HOT)).select(F.col("g").alias("hot"), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("most") / SPLIT_ROWS))).cast("int").alias("bits"))
    bits = F.when(F.col("bits") > 0, F.expr("shiftright(h, 64 - bits)")).otherwise(F.lit(0).cast("bigint"))
    split = F.struct(F.col("k").alias("id"), bits.alias("part"))
    plain = F.struct((F.col("g") * BUCKET).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("part"))
    joined = docs.withColumn("g", group).join(F.broadcast(hot), F.col("g") == F.col("hot"), "left")
    return joined.withColumn("bucket", F.when(F.col("hot").isNotNull(), split).otherwise(plain)).drop("g", "hot", "bits")


def _edited(n_chars: Column, text: Column, other: Column) -> Column:
    cut = F.floor(n_chars / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), (n_chars - cut).cast("int")), F.substr(other, F.lit(1), cut))


def _finished(rows: DataFrame, *kept: str) -> DataFrame:
    """rows: doc_id, n_chars, fingerprint, edited (null: not known yet), next_fingerprint, and what is kept."""
    rows = rows.withColumn("edited_fingerprint", F.when(F.col("edited").isNotNull(), fingerprint(F.col("edited"))))
    f = F.col("fingerprint")
    return rows.select(*kept, *OUT[:2], F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(f, F.col("edited_fingerprint")).alias("near_edited"), likeness(f, F.col("next_fingerprint")).alias("near_next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its text with the end exchanged for the next row's beginning, and
    the likeness of its fingerprint to that one and to the next row's.

    Rows meet their next one in buckets of neighbouring ids, so texts are shuffled once. Only the first
    and last row of a bucket keep their texts for a second, small step across buckets."""
    order = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    text = F.coalesce("text", F.lit(""))
    keyed = _bucketed(docs.select("doc_id", text.alias("text"), order.alias("k"), F.xxhash64(text).alias("h"))).withColumn("fingerprint", fingerprint(F.col("text")))
    inside = Window.partitionBy("bucket").orderBy("k", "h", "text")
    led = keyed.withColumn("n", F.lead(F.struct("text", "fingerprint")).over(inside)).withColumn("nth", F.row_number().over(inside))
    n_chars = F.char_length("text").cast("bigint")
    edge = (F.col("nth") == 1) | F.col("n").isNull()
    led = led.select("doc_id", "bucket", "nth", F.col("n").isNull().alias("last"), F.when(edge, F.col("text")).alias("text"), n_chars.alias("n_chars"), "fingerprint", F.col("n.fingerprint").alias("next_fingerprint"), _edited(n_chars, F.col("text"), F.col("n.text")).alias("edited"))
    done = written(_finished(led, "bucket", "nth", "last", "text"), "fingerprints")
    heads = done.where("nth = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    turns = next_of(done.where("nth = 1").select("bucket"))
    lasts = done.where("last").select("doc_id", "bucket", "text", "n_chars", "fingerprint").join(turns, "bucket").join(heads, "next_bucket")
    lasts = lasts.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", _edited(F.col("n_chars"), F.col("text"), F.col("next_text")).alias("edited"))
    return done.where("not last").select(*OUT).unionByName(_finished(lasts))
