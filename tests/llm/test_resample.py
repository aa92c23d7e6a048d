"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import oracle
from flowloom.llm import queries, resample
from llm_cases import documents, edge_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = {c: chr(c + 32) for c in range(65, 91)}


def buckets_of(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target):
    own = [buckets_of(t) for _, t in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in buckets_of(x)[1])
    big_s, big_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10_000)]
    out = []
    for (d, _), (n, f) in zip(rows, own):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d is None, d or 0, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    order = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[4], x[0], x[1]))
    return sorted(x[:5] for x in out), [x[:5] for x in order[:5 * len(order) // 100]]


def check(found, rows, target):
    found = [((r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score), r["rank"]) for r in found]
    want, drawn = brute(rows, target)
    assert sorted(x for x, _ in found) == want
    ranked = sorted((r, x) for x, r in found if r is not None)
    assert [r for r, _ in ranked] == list(range(1, len(drawn) + 1))
    assert [(x[0], x[1], x[4]) for _, x in ranked] == [(x[0], x[1], x[4]) for x in drawn]


def test_edges(spark):
    target = ["tie word five six", "one two", None, "", "tie word five six"]
    rows = edge_rows() + [(300 + i, "tie word " * (10 + i % 7)) for i in range(100)] + [(42, "Ab-c " * 30)] * 25
    rows += [(500, "Ab-c " * 900_000), (501, "x" * 3_000_000 + " y " + "é" * 70), (502, "a" * 64 + " " + "b" * 65 + " " + "c" * 300)]
    goal = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(target)], "item_id long, text string, word string, n int")
    for size in (0, 3, 100_000):
        check(resample.resample(documents(spark, rows), goal, dictionary_words=size).collect(), rows, target)
    check(resample.resample(documents(spark, rows), goal.where("false")).collect(), rows, [])
    assert resample.resample(documents(spark, []), goal).collect() == []


def test_equals_sql(spark, sf_small):
    name = "op12_importance_resampling"
    assert oracle.compare(queries.QUERIES[name](spark, sf_small), oracle.connect(sf_small), queries.SQL[name]) == ""
