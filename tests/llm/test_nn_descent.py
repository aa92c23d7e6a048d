import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from flowloom.llm import nn_descent
from flowloom.llm.nn_descent import nearest


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 0.5, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score double, rank string")


def brute(rows, top=20, every=20):
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = x @ x[k]
        order = [j for j in np.lexsort((ids, -s)) if j != k][:top]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def got(spark, rows):
    out = {}
    for r in sorted(nearest(table(spark, rows)).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16))
    x = x * rng.uniform(0.3, 3, (1500, 1)) if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found, want = got(spark, rows), brute(rows)
    assert found.keys() == want.keys()
    hit = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) > 0.95
    for q in found:
        assert found[q] == sorted(found[q], key=lambda z: (-z[1], z[0])) and q not in {i for i, _ in found[q]}


def test_recall_beside_a_very_long_vector(spark):
    """One vector 100,000 times longer: the others keep their neighbours."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1e5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found, want = got(spark, rows), brute(rows)
    assert found.keys() == want.keys()
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.95


def test_copies_ties_and_unsound_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(0, 200)] + [(200 + i, rng.standard_normal(4).tolist()) for i in range(60)]
    bad = [(None, [1.0] * 4), (1000, None), (1020, [0.0, -0.0, 0.0, 0.0]), (1040, [1.0, None, 0.0, 0.0]), (1060, [float("nan")] * 4),
           (1080, [float("inf"), 0.0, 0.0, 0.0]), (1100, []), (1120, [1.0])]
    found, want = got(spark, rows + bad + [rows[0]]), brute(rows)
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]])


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [-1.0, 0.5])]
    assert {q: [i for i, _ in x] for q, x in got(spark, rows).items()} == {0: [1, 20], 20: [0, 1]}
    assert got(spark, [(0, [1.0, 2.0])]) == {}
    assert got(spark, []) == {}


def listed(sizes, dim=8, seed=6):
    """(ids, codes, first, new, least) of lists of these sizes, drawn from 500 nodes."""
    rng = np.random.default_rng(seed)
    code = np.zeros(500, nn_descent._layout(dim))
    code["scale"], code["whole"] = rng.uniform(0.2, 1, 500), rng.integers(-32000, 32001, (500, dim))
    ids = np.concatenate([rng.choice(500, n, replace=False) for n in sizes])
    first = np.zeros(len(ids), bool)
    first[np.cumsum(sizes) - sizes] = True
    return ids, code[ids], first, rng.random(len(ids)) < 0.5, rng.normal(-1, 0.5, len(ids))


def batches(ids, code, first, new, least, rows):
    for i in range(0, len(ids), rows):
        s = slice(i, i + rows)
        yield pa.RecordBatch.from_arrays([pa.array(first[s]), pa.array(ids[s]), pa.array([c.tobytes() for c in code[s]], pa.binary()), pa.array(new[s]), pa.array(least[s])],
                                         ["first", "id", "code", "new", "least"])


def best(pairs, k):
    """The k best of each node, as far as their scores tell."""
    out = {}
    for (a, b), s in pairs.items():
        out.setdefault(a, []).append((round(s, 5), b))
    return {a: sorted(s for s, _ in x)[-k:] for a, x in out.items()}


@pytest.mark.parametrize("limit", [1, 300, 1 << 20])
@pytest.mark.parametrize("rows", [1, 7, 5000])
def test_lists_over_batches_propose_all_their_best_pairs(rows, limit):
    sizes = [1, 5, 40, 1, 2, 60, 33]
    ids, code, first, new, least = listed(sizes)
    want, begin = {}, np.append(np.flatnonzero(first), len(ids))
    for lo, hi in zip(begin[:-1], begin[1:]):
        for i in range(lo, hi):
            for j in range(lo, hi):
                s = float(code["whole"][i] / 32000 @ (code["whole"][j] / 32000) * code["scale"][i] * code["scale"][j])
                if i != j and (new[i] or new[j]) and s > least[i]:
                    want[ids[i], ids[j]] = s
    found = {}
    for b in nn_descent._propose(8, 4, limit)(batches(ids, code, first, new, least, rows)):
        for a, c, s in zip(*(b.column(i).to_pylist() for i in range(3))):
            assert abs(want[a, c] - s) < 1e-4
            found[a, c] = max(s, found.get((a, c), -9.0))
    assert best(found, 4).keys() == best(want, 4).keys()
    for a, x in best(want, 4).items():
        assert best(found, 4)[a] == pytest.approx(x, abs=1e-4)


def test_a_task_holds_few_pairs_however_many_lists_it_has():
    """600 cells of 100 nodes are 5.9 million pairs of 24 bytes: 143 MB, and as much again to sort them."""
    ids, code, first, new, least = listed([100] * 600)
    rows = batches(ids, code, first, np.ones(len(ids), bool), np.full(len(ids), -2.0), 10_000)
    tracemalloc.start()
    n = sum(b.num_rows for b in nn_descent._propose(8, 24)(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 500 * 24 and peak < 150e6
