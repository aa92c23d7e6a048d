import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from flowloom.llm import ngram_join
from flowloom.llm.common import components
from flowloom.llm.ngram_join import ngram_jaccard_join
from llm_cases import documents, edge_rows, sentences, words


def brute(rows, percent, k):
    sets = []
    for d, t in rows:
        w = words(t, lower=True)
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x
    where = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in where[g])
        for j, common in met.items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                top[find(i)] = find(j)
        for g in s:
            where[g].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d is None, d or 0, len(s), low.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(spark, rows, percent, k):
    found = ngram_jaccard_join(documents(spark, rows), percent, k).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in found)


def test_edges(spark):
    rows = edge_rows()
    assert got(spark, rows, 85, 4) == brute(rows, 85, 4)


def test_several_texts_for_one_id(spark):
    rng = random.Random(3)
    a, b, c = (sentences(rng, 60) for _ in range(3))
    rows = [(1, a), (2, a + " z"), (1, b), (3, b + " y"), (4, c), (4, c), (4, c + " x"), (5, c), (5, a), (6, None), (6, "")]
    rows += [(7, sentences(rng, 30))] * 500
    assert got(spark, rows, 85, 4) == brute(rows, 85, 4)
    assert got(spark, rows, 80, 5) == brute(rows, 80, 5)


def test_cells_are_a_lower_bound():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 900):
        for m in (1, 7, n, 2 * n):
            x = rng.integers(1 << 62, size=n).astype(np.uint64)
            y = np.concatenate([rng.choice(x, min(n, m), replace=False), rng.integers(1 << 62, size=max(m - n, 0) + n // 9).astype(np.uint64)])
            least = ngram_join._differing(*(np.frombuffer(ngram_join._cells(np.unique(s)), np.uint8) for s in (x, y)))
            assert least <= len(np.setxor1d(x, y)) and (least == 0 or len(np.setxor1d(x, y)))


def test_empty(spark):
    assert got(spark, [], 80, 5) == []


def test_families_of_near_copies(spark):
    """Many copies of one text with a few words changed: links near the threshold, no pair may be lost."""
    rng = random.Random(8)
    rows = []
    for family in range(4):
        base = sentences(rng, rng.choice([14, 45, 150, 400])).split()
        for _ in range(60):
            w = base[:]
            for _ in range(rng.randrange(1 + max(1, len(base) // 20))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 % 1009, " ".join(w[:len(w) - rng.randrange(4)])))
    rows += [(2000 + i, sentences(rng, 5 + i % 9, 12)) for i in range(150)]  # short texts that share shingles
    assert got(spark, rows, 85, 4) == brute(rows, 85, 4)
    assert got(spark, rows, 80, 5) == brute(rows, 80, 5)


def test_crowded_root_sends_a_leaf_node_once_for_two_nodes_above(spark):
    J = ngram_join
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, (30, J.LONGS))
    bits = base[np.arange(900) % 30] ^ (1 << rng.integers(0, 62, (900, J.LONGS)))
    n = np.bitwise_count(bits).sum(1).astype(int)
    names = [f"b{i}" for i in range(J.LONGS)]
    rows = [(1, 900, i, int(n[i]), i // 2, i % 3, *map(int, bits[i])) for i in range(900)]
    leaves = spark.createDataFrame(rows, "root long, m long, cls long, n long, component long, excess long, " + ", ".join(f"{b} long" for b in names))
    common = np.bitwise_count(bits[:, None] & bits).sum(2).astype(int)
    e = np.arange(900) % 3
    most = np.minimum(common + np.minimum(e[:, None], e), np.minimum(n[:, None], n))
    fits = (180 * most >= 80 * (n[:, None] + n)) & (100 * n[:, None] >= 80 * n) & (100 * n >= 80 * n[:, None])
    want = {(a, b) for a, b in np.argwhere(fits).tolist() if a < b and a // 2 != b // 2}
    assert want and {tuple(r) for r in J._descend(leaves, 80).collect()} == want
    table = pa.table({"node": [0, 1], **{c: [[5, 6], [7]] for c in ("cls", "n", "component", "excess", *names)}, "xs": [[0, 0]] * 2, "ys": [[1, 0]] * 2})
    assert set(J._met_pairs(1, ["cls", "n", "component", "excess", *names])(table).column_names) == {"a", "b"}


def test_unlike_sets_share_no_empty_slice():
    """Sets at the low end of a band have some empty slices, but enough others to stand under those only."""
    rng = np.random.default_rng(4)
    for percent, size in ((80, 2300), (80, 3000), (85, 2300)):
        n = np.full(20, size)
        row, grams = np.repeat(np.arange(20), n), rng.integers(1 << 62, size=n.sum()).astype(np.uint64)
        for takes, _, slices, r, _, held, lacks, need in ngram_join._slots(row, grams, n, percent):
            assert not lacks.any() and (need[takes] > 1).all()
            assert len(np.unique(held)) == len(held) < slices.sum() or not takes.any()


def test_classes_leave_the_most_crowded_roots_they_may_lose(spark):
    """Three sets under four even roots and one odd root; the sixth root holds one component only."""
    held = {2: (1, 2, 3), 4: (1, 2, 3), 6: (1, 2), 8: (2, 3), 3: (1, 2, 3), 10: (2, 4)}
    part = {1: 1, 2: 2, 3: 3, 4: 2}
    rows = [(root, cls, len(own), 2 if root == 6 else 1, part[cls]) for root, own in held.items() for cls in own]
    members = spark.createDataFrame(rows, "root long, cls long, m long, times long, component long")
    needs = spark.createDataFrame([(c, odd, n) for c, odd, n in ((1, 0, 3), (1, 1, 1), (2, 0, 2), (2, 1, 2), (3, 0, 1), (3, 1, 1), (4, 0, 1))], "cls long, odd int, need long")
    found = {(r.root, r.cls) for r in ngram_join._rarest(members, needs).collect()}
    # class 1 loses 4 and 2; class 2 loses 4, and 3 where it needs two; class 3 loses none; root 10 isn't mixed
    assert found == {(6, 1), (3, 1), (2, 2), (6, 2), (8, 2), (2, 3), (4, 3), (8, 3), (3, 3)}


def test_links_merge_in_few_stages(spark):
    """Each shuffle and each table between jobs has tasks for all partitions, however few the links."""
    context = spark.sparkContext
    context.setJobGroup("few stages", "")
    found = dict(map(tuple, components(spark.createDataFrame([(1, i) for i in range(2, 30)] + [(40, 41), (41, 40)], "a long, b long")).collect()))
    context._jsc.clearJobGroup()
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for s in {s for j in tracker.getJobIdsForGroup("few stages") for s in tracker.getJobInfo(j).stageIds}]
    assert found == {i: 1 for i in range(1, 30)} | {40: 40, 41: 40}
    assert 0 < len([x for x in stages if x is not None and x.numCompletedTasks]) < 14
