import random

from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from flowloom.llm import queries
from flowloom.llm.line_dedup import dedup_lines
from llm_cases import documents, edge_rows


def brute(rows, w=3):
    first, out = {}, {}
    for d, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - w + 1):
            if first.setdefault(tuple(lines[i:i + w]), (d, i)) != (d, i):
                gone.update(range(i, i + w))
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_random_runs(spark):
    rng = random.Random(2)
    rows = [(d, "\n".join(rng.choice("abc") if rng.random() < 0.8 else str(rng.random()) for _ in range(rng.randrange(1, 20)))) for d in range(150)]
    found = dedup_lines(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == brute(rows)
    assert all(r.n_chars == len(r.text) for r in found)


def test_edges(spark):
    rows = edge_rows() + [(30, "p\nq\nr\ns"), (31, "x\np\nq\nr"), (31, "x\np\nq\nr"), (31, "other\ntext\nhere"), (None, "p\nq\nr"), (32, "\n\n\n\n")]
    docs = documents(spark, rows)
    found = dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in found.collect())
    assert len(texts) == len(rows)
    assert [t[3] for t in texts if t[1] == 31] == ["other\ntext\nhere", "x", "x"]
    assert [t[3] for t in texts if t[1] == 32] == [""]  # five empty lines; the windows at 2 and 3 repeat the first, so lines 2 to 5 go
    assert [t for t in texts if t[0]] == [(True, 0, False, "p\nq\nr"), (True, 0, False, rows[0][1]), (True, 0, True, "")]
    assert dedup_lines(documents(spark, [])).collect() == []


def test_long_line_is_found_and_names_do_not_clash(spark):
    long = " ".join(f"w{i}" for i in range(200))
    docs = documents(spark, [(1, "a\n" + long), (2, long + "\nb"), (3, "b")])
    for name in ("_tag", "_of", "_doc", "_lines", "_cuts", "_gone", "_ownTag"):
        docs = docs.withColumn(name, F.lit(name))
    docs = docs.withColumn("n_lines", F.lit("own")).withColumn("n_removed", F.lit("own"))
    out = dedup_lines(docs, min_words=50, min_chars=300, counts=False)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r._tag, r._lines, r.n_lines, r.n_chars) for r in out.collect()) == [
        (1, "a\n" + long, "_tag", "_lines", "own", len(long) + 2), (2, "b", "_tag", "_lines", "own", 1), (3, "b", "_tag", "_lines", "own", 1)]
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in dedup_lines(docs, min_words=50).collect()) == [(1, 2, 0), (2, 2, 1), (3, 1, 0)]


def test_equals_sql(spark, sf_small):
    name = "op8_line_dedup"
    assert oracle.compare(queries.QUERIES[name](spark, sf_small), oracle.connect(sf_small), queries.SQL[name]) == ""


def brute_wide(rows, w=3, words=50, chars=300):
    first, out = {}, {}
    for d, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for v in range(1, w + 1):
            for i in range(len(lines) - v + 1):
                own = lines[i:i + v]
                if v < w and sum(len(x.split()) for x in own) < words and sum(map(len, own)) < chars:
                    continue
                if first.setdefault(tuple(own), (d, i)) != (d, i):
                    gone.update(range(i, i + v))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_stage_finds_long_runs_of_few_lines(spark, sf_small):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (3, 5, 20, 25, 30, 30, 49, 50, 60, 80)] + ["z" * 299, "z" * 300, "y" * 160]
    rows = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randrange(1, 8)))) for d in range(150)]
    rows += [(200, pool[9]), (201, pool[9]), (202, pool[4] + "\n" + pool[5]), (203, pool[4] + "\n" + pool[5]), (204, "short"), (205, "short")]
    out = corpus_pipeline.without_repeated_lines(spark, documents(spark, rows), sf_small)
    found = {r.doc_id: r.text for r in out.collect()}
    assert found == brute_wide(rows)
    assert found[201] == found[203] == "" and found[205] == "short"
