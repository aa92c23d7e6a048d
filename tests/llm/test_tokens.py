"""Pre-tokens, token counts, language-model scores and packing against the tokenizer library."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowloom.llm import postings, pretokens
from flowloom.llm.lm_score import lm_scores
from flowloom.llm.packing import pack, shortest_pack_first
from flowloom.llm.token_counts import _maker as token_maker, token_counts
from flowloom.llm.words import text_slices
from llm_cases import documents, edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_opening_a_tokenizer_holds_little():
    tracemalloc.start()
    tool = pretokens.Pieces(PATH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # 223 MB with one split of all unknown code points
    assert tool.classes[0x378] == pretokens.OTHER and tool.classes[ord("a")] == pretokens.LETTER


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    signs = [*" \n\t'sstrevmld.,!a1é中 　İ‍😀", "'s", "'ll", "  ", "<|endoftext|>", "<|endof", "text|>", "'re", "\x85", "\x1c"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(20_000)]
    ids, found = pretokens.Ids(PATH), []
    for lo, hi, data, bounds in text_slices(pa.array(texts), 5000):
        own, first = ids.of(data, bounds)
        found += [own[first[i]:first[i + 1]].tolist() for i in range(hi - lo)]
    assert found == ids_of(library, texts)


def test_pre_tokens_go_to_the_model_alone(library, monkeypatch):
    """Neither the library's search for pre-tokens nor its offsets are needed; the ids stay the same, and the next task has them."""
    rng = random.Random(12)
    made = ["".join(chr(rng.choice([rng.randrange(0x61, 0x7B), rng.randrange(0xC0, 0x17F), rng.randrange(0x4E00, 0x9FFF), 0x1F600])) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    every = [chr(c) for c in [*range(0x21), *range(0x7F, 0xA1), 0xAD, 0x2028, 0xE000, 0x10FFFF]]
    text = "".join(f" {w}" for w in made) + " ".join(every) + "it's 12 x<|endoftext|>  y \n"
    data = np.frombuffer(text.encode(), np.uint8)
    want = ids_of(library, [text])[0]
    tool = pretokens.pieces(PATH)

    class Model:
        model = tool.tokenizer.model

    monkeypatch.setattr(tool, "tokenizer", Model)  # has no encode_batch
    monkeypatch.setattr(pretokens, "_kept", {})
    found = pretokens.kept_ids(PATH).of(data, np.array([0, len(data)]))[0]
    assert found.tolist() == want
    monkeypatch.setattr(tool, "encode", None)  # a later task of the worker finds all ids in its cache
    assert pretokens.kept_ids(PATH).of(data, np.array([0, len(data)]))[0].tolist() == want


def test_split_of_every_sign(library):
    tool = pretokens.pieces(PATH)
    texts = [f"a{chr(c)}a 1{chr(c)}1 {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for lo, hi, data, bounds in text_slices(pa.array(texts)):
        text, st, en, _, first = pretokens.split(data, bounds, tool)
        for i in range(hi - lo):
            want = [texts[lo + i][a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(texts[lo + i])]
            assert [text[a:b] for a, b in zip(st[first[i]:first[i + 1]], en[first[i]:first[i + 1]])] == want


def test_token_counts(spark, library):
    rows = edge_rows() + [(20, "the " * 70_000)]
    want = sorted((d is None, d or 0, len((t or "").encode()), len(i), len(i) > 512) for (d, t), i in zip(rows, ids_of(library, [t for _, t in rows])))
    for most in (0, 5, 60, 1 << 17):  # all pre-tokens by the join, some, all by the broadcast
        found = token_counts(documents(spark, rows), PATH, most_frequent=most).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want
    assert token_counts(documents(spark, []), PATH).collect() == []


def test_dictionary_and_frequent_units(spark):
    texts = ["a b a", "b\n c", None, "", "a" * 40 + " é"] * 3
    docs, make = documents(spark, list(enumerate(texts))).repartition(2), token_maker(PATH)
    want = Counter(w for t in texts for w in re.findall(r" ?[^\s]+|\s", t or ""))
    for held in (1, 500_000):
        rows = postings.dictionary(docs, make, held).collect()
        assert Counter({r.name: r.n for r in rows}) == want and len({r.unit for r in rows}) == len(rows)
    counted = spark.createDataFrame([(i, n) for i, n in enumerate([100] * 3 + [40] * 5 + [1] * 20)], "unit long, n long")
    assert [postings.frequent(counted, most).count() for most in (0, 2, 3, 7, 8, 27, 28, 99)] == [0, 0, 3, 3, 8, 8, 28, 28]
    assert postings.frequent(counted.limit(0), 5).count() == 0


def test_lm_scores(spark, library):
    rows = edge_rows()
    ids = ids_of(library, [t for _, t in rows])
    one, two = Counter(), Counter()
    for x in ids:
        one.update(x)
        two.update(zip(x, x[1:]))
    total = sum(one.values())

    def score(x):
        found = 0.0
        for p, t in zip([None, *x], x):
            alone = math.log(one[t] / total)
            found += alone if p is None else math.log(two[p, t] / one[p]) if two[p, t] >= 2 else alone + math.log(0.4)
        return found
    found = sorted(lm_scores(documents(spark, rows), PATH).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = sorted(((d is None, d or 0, len(x)), score(x)) for (d, _), x in zip(rows, ids))
    assert [((r.doc_id is None, r.doc_id or 0, r.n_tokens)) for r in found] == [w[0] for w in want]
    for r, (_, s) in zip(found, want):
        assert r.log_score == pytest.approx(s, abs=1e-4)
        assert (r.mean_log_score is None) == (r.n_tokens == 0)
    assert lm_scores(documents(spark, []), PATH).collect() == []


def test_packing(spark, library):
    rows = [r for r in edge_rows() if r[0] is not None and r[0] not in (12, 13)] + [(100 + i, "the cat " * (i % 37)) for i in range(300)]
    found = pack(documents(spark, rows)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for (d, _), ids in zip(rows, ids_of(library, [t for _, t in rows])):
        ids, at = [*ids, 1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    used = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        used += at
    assert used > 0.9 * 2048 * (len(sequences) - 1)
    assert pack(documents(spark, [(1, "a"), (1, "a"), (None, None)])).count() == 3
    assert pack(documents(spark, [])).collect() == []


def test_shortest_pack_first():
    packs = shortest_pack_first({5: 3, 3: 4, 2: 1}, 8)
    assert sum(n * len(x) for n, x in packs) == 8 and all(sum(x) <= 8 for _, x in packs)
    assert sorted(packs) == [(1, (3, 2)), (3, (5, 3))]


def test_block_puts_few_rows_in_order_at_once(monkeypatch):
    """A block's rows are the same whatever is sorted at once, and no range of units is much larger than that."""
    def rows():
        block, rng = postings.Block(), np.random.default_rng(6)
        for n in (300, 1, 200):
            size = rng.integers(0, 60, n)
            first = np.concatenate([[0], np.cumsum(size)])
            units = rng.integers(0, 700, size.sum()) ** 2
            units[: size[0]] = 4  # more often in one document than a byte counts
            block.add(pa.array(np.arange(n)), first * 5, np.repeat(units, 9), first * 9, None)
        ranges = [len(x[0]) for x in block._ranges()]
        return [x for b in block.rows(7) for x in zip(*(c.to_pylist() for c in b.columns))], ranges
    whole, one = rows()
    monkeypatch.setattr(postings, "SORTED", 1024)
    parts, ranges = rows()
    assert parts == whole and len(one) == 1 and sum(ranges) == one[0] and max(ranges) < 2 * 1024
    assert len({x[1] for x in whole}) == len(whole)
