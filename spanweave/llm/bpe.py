"""Byte-level BPE without regular expressions.

Code points map to a few classes (a table), a class may look one or two code points ahead, and an
eight-state automaton over the classes says where slices begin. The automaton's transition functions
form a small monoid; its elements compose associatively, so states for a whole text come from a
blocked prefix scan over monoid ids. Slices are encoded once each by cached pair merging.

Null or empty text: no ids. A text's ids depend on nothing but the text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import byte_values, ragged, slice_hashes, text_chunks

# Classes: letter, number, other, apostrophe opening a contraction of two or three characters, white
# space inside a run, a space that the next slice takes along, a lone white space, text start.
L, N, O, A2, A3, W, SPX, WX, RESET = range(9)
# States: ended, in letters, in numbers, in others, in white space, behind a leading space, two or one to go.
ENDED, IN_L, IN_N, IN_O, IN_W, PREFIX, TWO, ONE = range(8)
CACHE_SLICES = 200_000
BLOCK = 256


def _step(state: int, c: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at this code point."""
    if c == RESET:
        return ENDED, True
    if state == TWO:
        return ONE, False
    if state == ONE:
        return ENDED, False
    run = {L: IN_L, N: IN_N, O: IN_O, W: IN_W}
    if state in (IN_O, PREFIX) and c in (O, A2, A3):
        return IN_O, False
    if c in run and (state == run[c] or state == PREFIX and c != W):
        return run[c], False
    return run.get(c, {A2: ONE, A3: TWO, SPX: PREFIX, WX: ENDED}.get(c)), True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the classes' functions, the composition table, each element's values, begins[state, class]."""
    single = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    found = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *single]))}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in single:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    elements = list(found)
    table = np.array([[found[tuple(g[x] for x in f)] if tuple(g[x] for x in f) in found else -1 for g in elements] for f in elements], np.int16)
    begins = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    return np.array([found[f] for f in single], np.int16), table, np.array(elements, np.int8), begins


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    kinds = {"L": L, "N": N}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)], np.uint8)
    #: Unicode's White_Space.
    for lo, hi in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[lo : hi + 1] = W
    return table


def slice_starts(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each code point. points: texts, each with one code point in front
    (at `resets`) that only marks its start."""
    cls = _class_table()[points]
    cls[resets] = RESET
    ahead = np.append(cls[1:], RESET)
    ahead2 = np.append(ahead[1:], RESET)
    p1 = np.append(points[1:], 0)
    p2 = np.append(p1[1:], 0)
    quote = (points == 39) & (cls == O)
    if quote.any():
        one = quote & (ahead != RESET) & np.isin(p1, [ord(x) for x in "sdmt"])
        two = quote & ~one & (ahead != RESET) & (ahead2 != RESET) & (((p1 == 108) & (p2 == 108)) | ((p1 == 118) & (p2 == 101)) | ((p1 == 114) & (p2 == 101)))
        cls[one], cls[two] = A2, A3
    last = (cls == W) & (ahead != W) & (ahead != RESET)
    cls[last] = np.where(points[last] == 32, SPX, WX)
    ids, compose, values, begins = _monoid()
    n = len(cls)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.int16)  # padded with the identity
    grid[:n] = ids[cls]
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):  # within blocks, all blocks at once
        grid[j] = compose[grid[j - 1], grid[j]]
    before = np.empty(rows, np.int16)
    now = 0
    for i, f in enumerate(grid[-1].tolist()):  # over the blocks' products
        before[i] = now
        now = compose[now, f]
    entry = values[before, ENDED]
    states = values[grid, entry[None, :]].T.reshape(-1)[:n]
    return begins[np.append(np.int8(ENDED), states[:-1]), cls]


class Encoder:
    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # The library's pair merging of one slice; its pre-tokenisation is not used.
        self.merge = tiktoken.Encoding("slices", pat_str=".", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[bytes, list[int]] = {}
        top = max(self.ranks.values()) + 1
        pieces = [b""] * top
        for k, v in self.ranks.items():
            pieces[v] = k
        self.lengths = np.array([len(x) for x in pieces])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All ids one after the other, each text's first id's place (and the end), the texts' bytes."""
        raw = [t.encode("utf-8") for t in texts]
        marked = "\x00" + "\x00".join(texts)
        points = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        resets = np.cumsum(sizes + 1) - sizes - 1
        begins = slice_starts(points, resets)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        width[resets] = 0
        begins[resets] = False
        at = np.cumsum(width, dtype=np.int64) - width
        starts = at[begins]
        data = b"".join(raw)
        if not len(starts):
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64), raw
        hashes = slice_hashes(np.frombuffer(data, np.uint8), starts, byte_values())
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(data))
        if len(self.cache) > CACHE_SLICES:
            self.cache.clear()
        known, cache = [], self.cache
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            piece = data[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(piece) <= 256:
                    cache[piece] = ids
            known.append(ids)
        lengths = np.array([len(x) for x in known])
        flat = np.array([x for ids in known for x in ids], np.int64)
        each = lengths[inverse]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[inverse], each)]
        text_edges = np.cumsum([0] + [len(r) for r in raw])
        slices = np.searchsorted(starts, text_edges)
        return ids, np.append(0, np.cumsum(each))[slices], raw

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, and each id's first byte's place."""
        lengths = self.lengths[ids]
        return self.bytes[ragged(self.offsets[ids], lengths)].tobytes(), np.cumsum(lengths) - lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded_chunks(batches: Iterator[pa.RecordBatch], ranks: str, text: str = "text") -> Iterator[tuple]:
    """(rows, ids, edges, raw bytes) a chunk at a time. Decoding must give the bytes back: a slice
    taken for another by its hash would show there, and its chunk is then merged slice by slice."""
    enc = encoder(ranks)
    for part, texts in text_chunks(batches, text):
        ids, edges, raw = enc.encode(texts)
        decoded, _ = enc.decode(ids)
        if decoded != b"".join(raw):
            alone = [enc.encode([t])[0] for t in texts]
            if any(enc.decode(x)[0] != r for x, r in zip(alone, raw, strict=True)):
                raise ValueError("encoding does not round-trip")
            ids, edges = np.concatenate(alone), np.cumsum([0] + [len(x) for x in alone])
        yield part, ids, edges, raw, decoded


def bpe_codec(docs: DataFrame, ranks: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every text. Returns id_col, ids array<int>, offsets array<long> (of each id's
    first byte) and decoded binary. Null text counts as empty; other columns are not read, so clashing
    names do no harm; an empty table gives an empty one; repeated rows are encoded each."""
    ranks = ranks or default_ranks()

    def run(batches):
        for part, ids, edges, raw, decoded in encoded_chunks(batches, ranks, text):
            lengths = encoder(ranks).lengths[ids]
            at = np.append(0, np.cumsum(lengths))
            offsets = at[:-1] - np.repeat(at[edges[:-1]], np.diff(edges))
            back = [decoded[at[a] : at[b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([part.column(id_col), listed(ids, pa.int32()), listed(offsets, pa.int64()), pa.array(back, pa.binary())], ["doc_id", "ids", "offsets", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text).mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<bigint>, decoded binary").withColumnRenamed("doc_id", id_col)


def codec_digest(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """bpe_codec() reduced to digests inside the same pass, so ids never leave the Python worker."""
    ranks = ranks or default_ranks()

    def run(batches):
        for part, ids, edges, _, decoded in encoded_chunks(batches, ranks):
            at = np.append(0, np.cumsum(encoder(ranks).lengths[ids]))
            wire = ids.astype("<u4")
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([b - a for a, b in spans], pa.int64()), pa.array([hashlib.sha256(wire[a:b].tobytes()).hexdigest() for a, b in spans]), pa.array([hashlib.sha256(decoded[at[a] : at[b]]).hexdigest() for a, b in spans])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
