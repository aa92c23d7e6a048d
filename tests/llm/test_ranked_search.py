"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

import oracle
from flowloom.llm import queries, ranked_search
from llm_cases import documents, edge_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {c: chr(c + 32) for c in range(65, 91)}


def terms(text):
    return [x.translate(LOW) for x in TERM.findall(text or "")]


def brute(rows, items, top=10):
    own = [Counter(terms(t)) for _, t in rows]
    n = [sum(c.values()) for c in own]
    docs, total = sum(x > 0 for x in n), sum(n)
    df = Counter(x for c in own for x in c)
    out = []
    for item, text in items:
        scores = []
        for (d, _), c, k in zip(rows, own, n):
            m = 10 + (90 * k * docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in set(terms(text)) if c[x])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item is None, item or 0, r + 1, unknown, d, -s) for r, (s, unknown, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def got(df):
    return sorted((r.item_id is None, r.item_id or 0, r["rank"], r.doc_id is None, r.doc_id or 0, r.score) for r in df.collect())


ITEMS = [(1, "tie word AB"), (2, None), (3, ""), (None, "c tie"), (1, "tie word AB"), (4, "w1 w2 w3 w4 w5 x"), (5, "nothing-here"), (6, "é ü 中")]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "item_id long, text string, rank int, block string")


def test_edges(spark, monkeypatch):
    rows = edge_rows() + [(300 + i, "tie word " * (10 + i % 7)) for i in range(100)] + [(500, "Ab-c " * 900_000)]
    want = brute(rows, ITEMS)
    assert got(ranked_search.search(documents(spark, rows), items(spark, ITEMS))) == want
    monkeypatch.setattr(ranked_search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ranked_search, "ITEM_BATCH", 3)
    assert got(ranked_search.search(documents(spark, rows), items(spark, ITEMS))) == want
    assert ranked_search.search(documents(spark, []), items(spark, ITEMS)).collect() == []
    assert ranked_search.search(documents(spark, rows), items(spark, [])).collect() == []


def test_many_blocks_and_ties(spark, monkeypatch):
    """Small blocks and ranges, few words, so that bounds lie close to the threshold."""
    rng = random.Random(5)
    pool = [f"w{int(40 * rng.random() ** 2)}" for _ in range(400)]
    rows = [(rng.randrange(900), " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for _ in range(700)]
    asked = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    plain = ranked_search._index
    monkeypatch.setattr(ranked_search, "_index", lambda batches: plain(c for b in batches for c in (b.slice(i, 40) for i in range(0, b.num_rows, 40))))
    assert got(ranked_search.search(documents(spark, rows), items(spark, asked), top=4)) == brute(rows, asked, 4)


def test_bounds_hold_and_pairs_tighten_them(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{int(30 * rng.random() ** 2)}" for _ in range(20))) for i in range(300)]
    asked = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(7))) for i in range(20)]
    one = lambda df: df.toArrow().combine_chunks().to_batches()[0]
    index = one(ranked_search.build_index(documents(spark, rows).coalesce(1)))
    batch = one(ranked_search.mapped(items(spark, asked).select("item_id", "text").coalesce(1), ranked_search._items, ranked_search._ITEMS))
    assert index.num_rows == batch.num_rows == 1
    queries_of = {"item_edges": batch.column("edges"), "terms": batch.column("terms"),
                  "weights": pa.array([np.arange(1, len(batch.column("units")[0].as_py()) // 8 + 1, dtype="<i8").tobytes()], pa.binary())}
    joined = {n: index.column(n) for n in index.schema.names} | {"batch": batch.column("batch"), "wanted": batch.column("units")} | queries_of
    lists = next(ranked_search._lists(300, 6000)([pa.RecordBatch.from_pydict(joined)]))
    joined = {n: lists.column(n) for n in lists.schema.names} | queries_of
    block = ranked_search.Block(next(ranked_search._records([pa.RecordBatch.from_pydict(joined)])))
    saved = 0
    for item in range(len(asked)):
        bounds = block.bounds(item)
        total, alone = bounds.sum(axis=0), block.highest[block.local[block.items[item]]].sum(axis=0)
        docs, scores = block.search(item, bounds, np.ones(block.ranges, bool), 1, len(rows))
        assert len(docs) and (scores <= total[docs // ranked_search.RANGE]).all() and (total <= alone).all()
        saved += int((alone - total).sum())
        for least in (int(scores[3]), int(scores[-1])):  # skipping by bounds gives what is left of the whole list
            some, their = block.search(item, bounds, total >= least, least, 5)
            keep = scores >= least
            assert (some.tolist(), their.tolist()) == (docs[keep][:5].tolist(), scores[keep][:5].tolist())
    assert saved > 0


def test_equals_sql(spark, sf_small):
    name = "op13_ranked_search"
    assert oracle.compare(queries.QUERIES[name](spark, sf_small), oracle.connect(sf_small), queries.SQL[name]) == ""
