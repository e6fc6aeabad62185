import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import common, components, fingerprints, induced, neardup, passages, substrings

from . import tables

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, *_) in enumerate(rows)]


def test_near_duplicates_against_all_pairs(spark):
    rows = [r for r in tables.rows() if r[0] is not None]
    words = tables.prose("chain", 100).split()
    for k in range(12):  # a chain: each like the next, the ends unlike
        rows.append((100 + k, " ".join(w if i // 5 >= k else f"{w}{k}" for i, w in enumerate(words)), *[None] * 6))
    got = neardup.near_duplicates(tables.documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_short_near_duplicates_are_all_linked(spark):
    """Seven words, and the same with one more: 3 of 4 shingles, whose few hashes fill all bins."""
    rows = []
    for k, i in enumerate((20, 72, 163, 169, 198, 203, 268, 281, 302, 305, 329, 349)):
        words = [f"w{i}x{j}" for j in range(8)]
        rows += [(2 * k, " ".join(words[:7]), *[None] * 6), (2 * k + 1, " ".join(words), *[None] * 6)]
    got = neardup.near_duplicates(tables.documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows))


def test_near_duplicates_on_nothing(spark):
    assert neardup.near_duplicates(tables.empty(spark)).count() == 0
    lone = neardup.near_duplicates(tables.documents(spark, [(None, "a b c d e f", *[None] * 6)])).first()
    assert lone["doc_id"] is None and lone["component_id"] is None and lone["kept"]
    kept = neardup.drop_near_duplicates(tables.documents(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == tables.documents(spark).columns
    assert 0 in ids and 1 not in ids and 2 not in ids and 7 not in ids and {3, 4, 5, 6, 8, 13, None} <= set(ids)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for size, shared in ((400, 300), (6, 5)):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 2**64, 2 * size - shared, dtype=np.uint64)
            a, b = np.sort(x[:size]), np.sort(x[size - shared :])
            sig = neardup.signature(np.concatenate([a, b]), np.array([size, size]))
            agree.append((sig[0] == sig[1]).mean())
        assert np.mean(agree) == pytest.approx(shared / (2 * size - shared), abs=0.05)


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(90, 91), (91, 90), (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 91: 90}


def test_induced_order_is_the_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 200))).astype(np.uint8)
        depth, raw = int(rng.integers(1, 24)), text.tobytes()
        for options in ({}, {"budget": 50, "in_memory": 2}):  # in memory, and spilling with recursion
            batches = list(induced.induced_order(text, depth, **options))
            places, shared = (np.concatenate([b[i] for b in batches]) for i in (0, 1))
            assert sorted(places.tolist()) == list(range(len(text)))
            for x in range(1, len(places)):
                a, b = raw[places[x - 1] :], raw[places[x] :]
                assert a[:depth] >= b[:depth]
                assert shared[x] == next((i for i in range(min(len(a), len(b), depth)) if a[i] != b[i]), min(len(a), len(b), depth))


def brute_removal(rows, length):
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(r[j : j + length] for r in raw for j in range(len(r) - length + 1))
    out = []
    for (doc, *_), r in zip(rows, raw, strict=True):
        covered = bytearray(len(r))
        for j in range(len(r) - length + 1):
            if seen[r[j : j + length]] > 1:
                covered[j : j + length] = b"\1" * length
        runs = sum(1 for k in range(len(r)) if covered[k] and not (k and covered[k - 1]))
        out.append((doc, len(r), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(r, covered, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_bytes": 300}, {"budget": 500}])
def test_removal_against_all_windows(spark, options):
    rows = [r for r in tables.rows() if r[0] != 11]
    got = substrings.remove_repeats(tables.documents(spark, rows), **options).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=key) == sorted(brute_removal(rows, 200), key=key)


def test_removal_of_nothing_and_kept_bytes(spark):
    assert substrings.remove_repeats(tables.empty(spark)).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in substrings.kept_bytes(tables.documents(spark).where("doc_id in (0, 2, 6, 8, 9, 10)")).collect()}
    assert kept[0] == kept[2] == kept[10] == b"" and kept[6] == b"two words"
    assert tables.PASSAGE[20:80].encode() not in kept[8] and len(kept[8]) > 0


def test_passages_are_found_and_cut(spark):
    docs = tables.documents(spark)
    found = passages.near_duplicate_passages(docs).collect()
    pairs = {frozenset((r["doc_id"], r["other_doc_id"])) for r in found}
    assert frozenset((8, 9)) in pairs and frozenset((0, 1)) in pairs and frozenset((0, 2)) in pairs
    assert not {3, 4, 5, 6, 7, 10, 11, 12} & {r["doc_id"] for r in found}
    texts = {i: t for i, t, *_ in tables.rows()}
    for r in found:
        if {r["doc_id"], r["other_doc_id"]} == {8, 9}:
            a, b = texts[r["doc_id"]][r["begin"] : r["end"]], texts[r["other_doc_id"]][r["other_begin"] : r["other_end"]]
            x, y = shingles(a), shingles(b)
            assert len(x & y) / len(x | y) >= 0.75 and len(a.split()) >= 50
    cut = passages.cut_passages(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert sum(tables.PASSAGE[30:200] in (after[i] or "") for i in (8, 9)) == 1
    assert after[13] == texts[13] and after[3] is None and after[12] == texts[12]
    assert passages.near_duplicate_passages(tables.empty(spark)).count() == 0 == passages.cut_passages(tables.empty(spark)).count()


def test_compact_windows_group_all_subsequences():
    """Every subsequence of at least the width lies in the one window whose place holds its minimum."""
    rng = np.random.default_rng(3)
    values, width = np.concatenate([rng.permutation(60), rng.integers(0, 9, 40), rng.permutation(5)]).astype(np.uint64) + np.uint64(1), 8
    lo, hi = np.array([0, 60, 100]), np.array([60, 100, 105])
    text, places, left, right = passages.compact_windows(values, lo, hi, width)
    assert set(text.tolist()) == {0, 1}
    windows = dict(zip(places.tolist(), zip(left.tolist(), right.tolist(), strict=True), strict=True))
    for begin, end in zip(lo.tolist(), hi.tolist(), strict=True):
        for a in range(begin, end):
            for b in range(a + width, end + 1):
                place = a + int(values[a:b].argmin())
                assert windows[place][0] <= a and b <= windows[place][1]
                assert begin <= windows[place][0] and windows[place][1] <= end


def edited(words, edits, rng):
    """A copy with that many words changed, between words of its own."""
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"changed{rng.randrange(10**6)}"
    return " ".join(f"own{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 60))) + " " + " ".join(out) + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(30))


@pytest.mark.parametrize(("edits", "size"), [(1, 52), (1, 80), (2, 80), (3, 80), (3, 100)])
def test_passages_against_all_pairs(spark, edits, size):
    """Edited copies of one passage, far enough apart that no hub is near them all: of each pair of documents
    that nearly share a passage, one must be cut there, and no pair may be left after cutting."""
    rng = random.Random(edits * 1000 + size)
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    rows = [(i, edited(words, edits, rng)) for i in range(60)] + [(100 + i, edited(words[: size // 2], 0, rng)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    parsed = {i: passages.Passage(t) for i, t in rows}
    true = [(a, b) for a in parsed for b in parsed if a < b and passages.shared_passages(parsed[a], parsed[b])]
    cut = {r["doc_id"] for r in passages.near_duplicate_passages(docs).collect()}
    missed = [p for p in true if not cut & set(p)]
    assert true and len(missed) <= 0.02 * len(true)
    after = [passages.Passage(r["text"]) for r in passages.cut_passages(docs).collect()]
    left = sum(bool(passages.shared_passages(a, b)) for i, a in enumerate(after) for b in after[:i])
    assert left <= 0.02 * len(true)
    if size < 100:  # half of it is too short for a passage
        assert not any(i >= 100 for i in cut)


def test_fingerprints(spark):
    rows = sorted([r for r in tables.rows() if r[0] is not None and r[0] != 13], key=lambda r: r[0])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(tables.documents(spark, rows).repartition(3)).collect()}
    texts = [t or "" for _, t, *_ in rows]
    for i, (doc, *_) in enumerate(rows):
        text, other = texts[i], texts[(i + 1) % len(texts)]
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        want = 1.0 if a == b else len(a & b) / max(1, len(a | b))
        assert r["near_edited"] == pytest.approx(want, abs=0.2) and 0 <= r["near_next"] <= 1
    assert got[0]["fingerprint"] == got[2]["fingerprint"] != got[1]["fingerprint"]
    assert got[3]["fingerprint"] == "" and len(got[13 if 13 in got else 12]["fingerprint"]) == 128
    assert fingerprints.fingerprints(tables.empty(spark)).count() == 0
    lone = fingerprints.fingerprints(tables.documents(spark, rows[:1])).first()
    assert lone["near_next"] == 1.0


def test_fingerprints_of_sparse_ids_and_one_very_frequent_id(spark, monkeypatch):
    """Ids far apart, and two thirds of the rows under one id and under none: each row meets the next one."""
    monkeypatch.setattr(fingerprints, "HOT_ROWS", 100)
    monkeypatch.setattr(fingerprints, "SPLIT_ROWS", 16)
    rng = random.Random(5)
    rows = [(rng.randrange(-(2**62), 2**62), f"text {i} " + "word " * (i % 9)) for i in range(300)]
    rows += [(77, f"many {i % 200} of them " + "x" * (i % 5)) for i in range(400)] + [(None, f"none {i}") for i in range(300)] + [(78, "behind"), (76, "ahead")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order.sort(key=lambda r: (-(2**63) if r[0] is None else r[0], r[2], r[1]))
    want = []
    for (doc, text, _), (_, other, _) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 4
        want.append((doc, hashlib.sha256((text[: len(text) - k] + other[:k]).encode()).hexdigest()))
    got = fingerprints.fingerprints(docs).select("doc_id", "edited_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize(("size", "more"), [(3, 4), (6, 8), (9, 12), (12, 16)])
def test_links_of_short_texts_at_the_threshold(spark, size, more):
    """A text and the same with words added, exactly three quarters of the shingles shared: all are linked."""
    rng = random.Random(size)
    rows = []
    for i in range(500):
        words = [f"w{rng.randrange(10**7)}" for _ in range(more + 4)]
        rows += [(2 * i, " ".join(words[: size + 4])), (2 * i + 1, " ".join(words))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[2 * i + 1] == got[2 * i] == 2 * i for i in range(500))


CLASHES = "_id _key _first _spans _tid _text _after id_ key_ tid_ first_ spans_ after_ score predicted bucket text_key cid root".split()


def test_columns_of_any_name_come_back_unchanged(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(*r[:5], *[f"{c}-{r[0]}" for c in CLASHES]) for r in tables.rows()], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.mode("overwrite").parquet("/tmp/spanweave-clash/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/tmp/spanweave-clash")
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c}-{r['doc_id']}" for c in CLASHES)
            assert r["n_chars"] is None or r["text"] is None or r["doc_id"] == 13 or r["n_chars"] == len(r["text"])


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from spanweave.llm import common

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: "spark://host:7077" if key == "spark.master" else other)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)


@pytest.mark.parametrize("seed", range(6))
def test_verified_stretches_cover_all_near_ones(seed):
    """Of two texts with scattered edits, the places in any stretch at the threshold lie in a verified one."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(160)]
    copy = [f"x{i}" if rng.random() < 0.06 else w for i, w in enumerate(words)]
    a, b = passages.Passage(" ".join(words)), passages.Passage(" ".join(copy))
    same = np.append(0, np.cumsum(a.shingles == b.shingles))
    near = np.zeros(len(a.shingles), bool)
    for i in range(len(near)):
        for j in range(i + passages.SPAN, len(near) + 1):
            shared = same[j] - same[i]
            if same[i + 1] > same[i] and same[j] > same[j - 1] and shared >= passages.LEAST * (2 * (j - i) - shared):
                near[i:j] = True
    found = np.zeros(len(near), bool)
    for first, last, *_ in passages.shared_passages(a, b):
        found[first:last] = True
    assert (found == near).all()


def test_large_family_is_cut_in_few_comparisons(spark, monkeypatch):
    """A text and more than FAMILY edited copies of it, some so edited that they have loose places: nothing near is
    left, with far fewer comparisons than pairs, and the rows grow with the texts."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(f"own{rng.randrange(10**9)}" if rng.random() < 0.08 * (i > 0) else w for w in words)) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    compared, former = [], passages._compared
    monkeypatch.setattr(passages, "_compared", lambda pairs, held: compared.append(pairs.count()) or former(pairs, held))
    found = passages.near_duplicate_passages(docs).collect()
    assert sum(compared) < 0.2 * len(rows) * (len(rows) - 1) / 2
    assert len(found) <= 3 * len(rows) and {r["component_id"] for r in found} == {0}
    after = [passages.Passage(r["text"]) for r in passages.cut_passages(docs).collect()]
    left = sum(bool(passages.shared_passages(a, b)) for i, a in enumerate(after) for b in after[:i])
    assert left <= 0.002 * len(rows) * (len(rows) - 1) / 2, left


@pytest.mark.parametrize("most", [common.SIEVE_BITS, common.PART_BITS])
def test_no_key_is_sifted_out(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIEVE_BITS", most)
    rows = spark.range(-5000, 5000).withColumn("part", F.lit("x")).union(spark.createDataFrame([(None, "y")], "id bigint, part string"))
    keys = spark.range(-5000, 5000, 7).select((F.col("id") - F.col("id") % 2).alias("k"))
    got = common.marked(rows, F.col("id"), keys, "may")
    assert got.columns == ["id", "part", "may"] and got.count() == 10001
    known = {r["k"] for r in keys.collect()}
    may = {r["id"] for r in got.where("may").collect()}
    assert known <= may and len(may - known) < (500 if most > common.PART_BITS else 1000)
    assert common.sifted(rows, F.col("id"), keys.where("false")).count() == 0


@pytest.mark.parametrize("stage", [neardup.drop_near_duplicates, passages.cut_passages])
def test_lone_texts_are_not_shuffled(spark, stage):
    """Texts that lose nothing meet no join, however large the table of what goes."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(800)) for _ in range(100)]
    texts.append(texts[7] + " and more")
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")

    def sent():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stage(docs)
        before = sent()
        got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
        assert sent() - before < sum(map(len, texts)) / 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(got[i] == (texts[i], len(texts[i])) for i in range(100) if i != 7)
    assert out.columns == docs.columns and got.get(7) != got.get(100)
