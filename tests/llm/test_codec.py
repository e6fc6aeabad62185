import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from spanweave.llm import bpe, packing

from . import tables


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(plain):
    rng = random.Random(1)
    alphabet = "ab'sdtlvre  \n\t é1²٣中’!?# \x1c\x85'"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", "   ", "'s", "''ll", "a  ", " \n'd", "a" * 3000, "<|endoftext|>", "it'll we've"]
    enc = bpe.Encoder(bpe.default_ranks())
    ids, edges, raw = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == plain.encode_ordinary(t), t
    assert enc.decode(ids)[0] == b"".join(raw)


def test_the_scan_is_the_automaton():
    """Block-wise composition gives the states that stepping gives."""
    text = "".join(random.Random(2).choice("a1 '\n!s") for _ in range(2000))
    points = np.frombuffer(("\x00" + text).encode("utf-32-le"), np.uint32)
    begins = bpe.slice_starts(points, np.array([0]))
    import regex

    want = {m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)}
    assert {i - 1 for i in np.flatnonzero(begins).tolist() if i} == want


def test_codec_on_odd_rows(spark, plain):
    got = bpe.bpe_codec(tables.documents(spark)).collect()
    assert len(got) == len(tables.rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text, *_ in tables.rows():
        assert all(r["ids"] == plain.encode_ordinary(text or "") and bytes(r["decoded"]) == (text or "").encode() for r in by[doc])
        for r in by[doc]:
            sizes = [len(plain.decode_single_token_bytes(i)) for i in r["ids"]]
            assert r["offsets"] == [sum(sizes[:k]) for k in range(len(sizes))]
    assert bpe.bpe_codec(tables.empty(spark)).count() == 0


def test_digest(spark, plain):
    got = {r["doc_id"]: r for r in bpe.codec_digest(tables.documents(spark)).collect()}
    ids = plain.encode_ordinary(tables.rows()[12][1])
    assert got[12]["n_tokens"] == len(ids) and got[12]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[3]["n_tokens"] == 0 and got[3]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_packing_uses_each_id_once(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    docs = tables.documents(spark).where("doc_id is not null and doc_id <> 13")
    pieces = packing.pack(docs.repartition(2)).toPandas()
    texts = {i: t or "" for i, t, *_ in tables.rows() if i not in (None, 13)}
    for doc, part in pieces.groupby("doc_id"):
        ids = np.array([*tok.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        part = part.sort_values("start")
        assert (part.start == part.length.cumsum() - part.length).all() and part.length.sum() == len(ids) == part.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    assert set(pieces.doc_id) == set(texts)
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        total = part.length.sum()
        assert (part.offset == part.length.cumsum() - part.length).all() and total <= 2048 and (total == 2048 or total & (total - 1) == 0)
    assert packing.pack(tables.empty(spark)).count() == 0


def test_the_level_is_the_best_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        packer = packing.SumOfSquares(16, 0)
        packer.counts[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def after(h, packer=packer, size=size):
            c = packer.counts.copy()
            c[h] -= bool(h)
            c[h + size] += h + size < 16
            return int((c[1:16] ** 2).sum())

        fits = [h for h in range(0, 17 - size) if h == 0 or packer.counts[h]]
        assert after(packer.level(size)) == min(map(after, fits))
