import random

import numpy as np

from flowloom.llm import decontaminate
from flowloom.llm.decontaminate import check, common_subsequence, find_leaks
from llm_cases import documents, edge_rows

SF = "/root/testdata/sf0.01"


def slow_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, best[j] = best[j], old + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert common_subsequence(a, b) == slow_lcs(a, b)


def test_answer_must_be_there():
    item = list(range(20))
    assert check(item, item, 0.6)[0] == 20
    assert check(item, item[:15] + [99] * 9, 0.6) == (0, 0)


def test_copies_and_paraphrases(spark):
    """Benchmark items put into documents, as they are and with a fifth of the words changed, dropped or added."""
    rng = random.Random(6)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(d, t) for d, t in docs if not any(b.lower() in (t or "").lower() for _, b in items)]
    vocabulary = clean[1][1].split()
    rows, planted, exact = [], set(), set()
    for n, (d, t) in enumerate(clean[:400]):
        if n % 4 == 0:
            item, text = items[n // 4 % len(items)]
            w = text.split()
            if n % 8:
                for i in rng.sample(range(len(w)), len(w) // 5):
                    w[i] = rng.choice(["", rng.choice(vocabulary), w[i] + " " + rng.choice(vocabulary)])
            else:
                exact.add((d, item))
            have = t.split()
            at = rng.randrange(len(have) + 1)
            t = " ".join([*have[:at], *w, *have[at:]])
            planted.add((d, item))
        rows.append((d, t))
    found = {(r.doc_id, r.item_id) for r in find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert exact <= found
    assert len(found & planted) >= 0.95 * len(planted)
    assert not {d for d, _ in found} - {d for d, _ in planted}


def test_edges(spark):
    rows = edge_rows()
    items = [(1, rows[0][1][:150]), (2, None), (None, "x y z"), (3, ""), (4, rows[0][1][:150]), (5, "one")]
    bench = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, doc_id string")
    found = find_leaks(documents(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(d, i) for d in (1, 2, 8, 12, 13) for i in (1, 4)}
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert find_leaks(documents(spark, []), bench).count() == 0
    assert find_leaks(documents(spark, rows), bench.limit(0)).count() == 0


def test_vectors_are_fitted_on_all_passages(spark, monkeypatch):
    """600,000 documents of one word: their Gram matrix is diagonal."""
    monkeypatch.setattr(decontaminate, "_space", lambda df, idf, y: (df, idf, y))
    docs = spark.range(600_000).selectExpr("id as doc_id", "concat('w', id % 50) as text")
    df, idf, y = decontaminate.latent_space(docs)
    assert df[-1] == df[:-1].sum() == 600_000
    want = (df[:-1] * idf.astype(np.float64) ** 2)[:, None] * decontaminate._random()
    assert np.allclose(y, want, rtol=1e-4, atol=1e-6 * np.abs(want).max())
