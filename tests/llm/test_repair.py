"""Re-Pair files: exact round trips, ids of the tokenizer library, order, shards and random access."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowloom.llm import crc, repair
from llm_cases import documents, edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, texts):
    return [[*e.ids, 0] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_crc_of_concatenations():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.randrange(40)), rng.randbytes(n)) for n in (0, 1, 2, 3, 17, 255, 256, 257, 5000, 70_000, 1_000_003)]
    found = crc.joined(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([zlib.crc32(b) for _, b in parts], np.uint32),
                       np.array([len(b) for _, b in parts]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("top", [1, 2, 5, 300, 50_000, 200_000])
def test_compress_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (1, 2, 15, 3000, 60_000):
        ids = (top * rng.random(n) ** 3).astype(np.uint32)
        ends = rng.random(n) < 0.02
        ends[-1] = True
        terminals, rules, sizes, symbols = repair.compress(ids, ends)
        width = 2 if len(terminals) + len(rules) <= 1 << 16 else 4
        shard = repair.Shard(*(x.astype("<u4").tobytes() for x in (terminals, rules, sizes)), symbols.astype(f"<u{width}").tobytes(), width)
        assert (shard.ids() == ids).all()
        assert np.isin(np.flatnonzero(ends) + 1, shard.edge).all()  # no rule crosses the end of a document
        used = np.bincount(symbols, minlength=len(terminals) + len(rules)) + np.bincount(rules.ravel(), minlength=len(terminals) + len(rules))
        assert len(rules) == 0 or used[len(terminals):].min() >= 1
        for _ in range(20):
            lo = int(rng.integers(n))
            hi = int(rng.integers(lo, n)) + 1
            assert (shard.ids(lo, hi) == ids[lo:hi]).all()
    if top == 5:
        assert len(symbols) < n / 3


def test_documents(spark, library, tmp_path):
    rows = edge_rows() + [(200 - i, "the cat sat on the mat " * (i % 9)) for i in range(150)] + [(7, "One"), (7, "other")] + [(9, "same")] * 40
    for shard_ids, parts in ((1 << 20, None), (100, 5), (1, 2)):
        own = rows if shard_ids > 1 else rows[:8]
        folder = str(tmp_path / f"f{shard_ids}")
        repair.write_ids(documents(spark, own), PATH, folder, shard_ids=shard_ids, parts=parts)
        found = repair.read_documents(spark, folder).orderBy("start").collect()
        want = ids_of(library, [t for _, t in own])
        key = lambda d: (d is not None, d or 0)
        assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted(
            (key(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(own, want))
        assert [key(r.doc_id) for r in found] == sorted(key(d) for d, _ in own)
        at = 0
        for r in found:
            assert r.start == at
            at += r.n_tokens
        pieces = repair.ids_of(spark, folder, [10 if shard_ids > 1 else 6, 999]).orderBy("part", "at").collect()
        assert [x for p in pieces for x in p.ids] == next(i for (d, _), i in zip(own, want) if d == (10 if shard_ids > 1 else 6))


def test_empty(spark):
    assert repair.encoded_documents(documents(spark, []), PATH).collect() == []
