"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, whatever their label, is the
unlabelled text. Features are the presence of byte 5- and 8-grams of the text with letters folded and
all else made blank, so unseen endings of a known stem still count. A logistic classifier in numpy
minimises the class-prior-corrected risk  pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]);
where the second term falls below zero, its gradient is reversed, as the method asks. pi is the share
of toxic rows among the labelled training rows.

Fitting uses a bounded sample (parameters positives, unlabelled, sample_chars); scoring reads every
whole text of every row, and neither labels, lang, source nor doc_id reach a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, byte_values, mix, powers, text_chunks

GRAMS = (5, 8)
POSITIVES, UNLABELLED, SAMPLE_CHARS = 1500, 3000, 30_000
FEATURES, LEAST_DF, LEAST_Z = 3000, 3, 3.0
ROUNDS, RATE, DECAY = 400, 0.05, 2e-4
THRESHOLD = 0.7
SKETCH = 32


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Letters (A-Z as a-z) and all bytes of non-ASCII characters stay; everything else is a blank."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each byte of the texts, joined by blanks wider than any gram: its text; and its gram of each size."""
    gap = b" " * max(GRAMS)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _fold()[np.frombuffer(gap + gap.join(raw) + gap, np.uint8)]
    sizes = np.array([len(r) for r in raw])
    begin = np.cumsum(sizes + len(gap)) - sizes
    total = np.append(np.uint64(0), np.cumsum(byte_values()[data] * powers(BASE, len(data)), dtype=np.uint64))
    out = []
    for n in GRAMS:
        sums = (total[n:] - total[:-n]) * powers(BASE_INV, len(data))[: len(data) - n + 1]
        out.append(mix(sums + np.uint64(n)))
    return begin, out


def distinct_grams(text: str) -> np.ndarray:
    _, each = grams([text])
    return np.unique(np.concatenate(each))


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.features):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        begin, each = grams(texts)
        maybe = np.zeros(1 << 20, bool)
        maybe[(self.features >> np.uint64(44)).astype(np.int64)] = True
        pairs = []
        for h in each:
            at = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.features, h[at]), len(self.features) - 1)
            real = self.features[k] == h[at]
            # A gram may begin in the blanks in front of its text.
            row = np.searchsorted(begin, at[real] + max(GRAMS) - 1, side="right") - 1
            pairs.append(np.maximum(row, 0) * len(self.features) + k[real])
        hit = np.unique(np.concatenate(pairs))
        total = np.bincount(hit // len(self.features), self.weights[hit % len(self.features)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def _apart(texts: list[str]) -> list[str]:
    """Without near copies of earlier texts, which would count as evidence many times: those that share
    three quarters of their SKETCH smallest gram hashes with one of them. A common head or foot alone is
    no copy."""
    holders: dict[int, list[int]] = {}
    out = []
    for t in texts:
        small = distinct_grams(t)[:SKETCH].tolist()
        met = np.bincount([i for h in small for i in holders.get(h, ())], minlength=1)
        if met.max() >= 0.75 * len(small):
            continue
        for h in small:
            holders.setdefault(h, []).append(len(out))
        out.append(t)
    return out


def fit(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    """Select grams that positives hold more often than unlabelled text, then minimise the nnPU risk.

    Without positives the model has no features and scores every text alike, near zero."""
    positive, unlabelled = _apart(positive), _apart(unlabelled)
    prior = min(max(prior, 1e-3), 0.5)
    bias = float(np.log(prior / (1 - prior)))
    none = Model(np.empty(0, np.uint64), np.empty(0), min(bias, -2.0))
    if not positive or not unlabelled:
        return none
    n_p, n_u = len(positive), len(unlabelled)
    found = [distinct_grams(t) for t in positive]
    hashes, df = np.unique(np.concatenate(found), return_counts=True)
    keep = df >= max(LEAST_DF, 0.004 * n_p)
    hashes, df = hashes[keep], df[keep]
    if not len(hashes):
        return none

    def indices(held: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(hashes, held), len(hashes) - 1)
        return at[hashes[at] == held]

    in_u = np.zeros(len(hashes))
    for t in unlabelled:
        in_u[indices(distinct_grams(t))] += 1
    share = (df + in_u) / (n_p + n_u)
    z = (df / n_p - in_u / n_u) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_p + 1 / n_u))
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    hashes = hashes[best[z[best] >= LEAST_Z]]
    if not len(hashes):
        return none
    rows, cols = [], []
    for i, held in enumerate([*found, *(distinct_grams(t) for t in unlabelled)]):
        k = indices(held)
        rows.append(np.full(len(k), i))
        cols.append(k)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    n = n_p + n_u
    is_p = np.arange(n) < n_p
    w, m, v = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1)
    w[-1] = bias
    for step in range(1, ROUNDS + 1):
        f = np.bincount(rows, w[cols], minlength=n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -50, 50)))  # d l(-f) / d f; and d l(f) / d f is s - 1
        loss = np.logaddexp(0, f)  # l(-f)
        negative = loss[~is_p].mean() - prior * loss[is_p].mean()
        d_neg = np.where(is_p, -prior * s / n_p, s / n_u)
        d = np.where(is_p, prior * (s - 1) / n_p, 0) + d_neg if negative >= 0 else -d_neg
        g = np.append(np.bincount(cols, d[rows], minlength=len(hashes)), d.sum())
        g[:-1] += DECAY * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(hashes, w[:-1], float(w[-1]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most `positives` toxic and `unlabelled` other documents outside the held-out third, each of
    at most sample_chars characters, chosen by a hash of doc_id. Only this bounded sample comes to the driver."""
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.avg("toxic")).first()
    short = docs.where(~held_out()).where(F.coalesce(F.length("text"), F.lit(0)).between(1, sample_chars)).select("doc_id")
    p_ids = known.where("toxic = 1").join(short.distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(True).alias("positive"))
    u_ids = short.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("positive"))
    chosen = p_ids.union(u_ids).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id bigint, positive boolean")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()  # at most positives + unlabelled texts, of bounded length
    texts = {True: {}, False: {}}
    for r in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        if r[1] and len(r[1]) <= sample_chars:
            texts[r[2]].setdefault(r[0], r[1])
    return fit(list(texts[True].values()), list(texts[False].values()), float(counts[0] or 0.0))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with columns score (0 to 1) and predicted (1 if score >= 0.7). Null text scores as empty text.
    All other columns are kept; columns named score or predicted are replaced; an empty table stays empty."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema.fields)

    def run(batches):
        for part, texts in text_chunks(batches, text):
            s = model.scores(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.select(kept).mapInArrow(run, f"{fields}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted to be toxic, with all their columns, whatever those are called."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for part, texts in text_chunks(batches, text):
            yield part.filter(pa.array(model.scores(texts) < THRESHOLD))

    return docs.mapInArrow(run, fields)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. A null doc_id is never held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
