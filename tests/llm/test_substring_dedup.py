import hashlib
import random

from flowloom.llm.substring_dedup import substring_dedup
from llm_cases import documents, edge_rows, sentences, words


def brute(rows, size=20):
    """For rows with different ids."""
    first, out = {}, {}
    for d, t in sorted(rows):
        w, gone = words(t), set()
        for i in range(len(w) - size + 1):
            if first.setdefault(tuple(w[i:i + size]), (d, i)) != (d, i):
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def got(spark, rows):
    return [(r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in substring_dedup(documents(spark, rows)).collect()]


def test_random_repeats(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(90):
        a = rng.randrange(120)
        rows.append((d, " ".join(rng.choice([
            ["x"] * rng.randrange(70), ["u", "v", "w"] * rng.randrange(30), base[a:a + rng.randrange(70)],
            [*sentences(rng, rng.randrange(30)).split(), *base[a:a + rng.randrange(60)], *sentences(rng, rng.randrange(9)).split()],
            [*base[:60], "cut", *base[60:]], sentences(rng, 60, 2).split()]))))
    assert dict(got(spark, rows)) == brute(rows)


def test_edges(spark):
    rows = edge_rows()
    single = [r for r in rows if r[0] not in (None, 12, 13)]
    found = got(spark, rows)
    want = brute([*single, (12, rows[0][1])])
    assert len(found) == len(rows)
    assert {d: x for d, x in found if d in want} == want
    assert [x for d, x in found if d == 12] == [want[12]] * 2  # equal rows are one place: cut alike, by document 1
    assert sorted(x[:2] for d, x in found if d == 13) == [(30, 0), (60, 60)]
    assert sorted(x[:2] for d, x in found if d is None) == [(0, 0), (60, 0)]


def test_empty(spark):
    assert got(spark, []) == []
