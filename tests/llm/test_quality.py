import math
import random
import zlib

from flowloom.llm import quality
from llm_cases import documents, edge_rows
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = quality.with_statistics(docs)
    model = quality.fit(stats, labels)
    scored = quality.score(stats, model)
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    right = sum(r.predicted == r.quality for r in test) / len(test)
    assert right > 0.95 and {r.quality for r in test} == {0, 1}
    assert model.rules and all(0 <= r.score <= 1 for r in rows)
    good = {r.doc_id for r in scored.collect() if r.predicted == 1}
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == good
    assert quality.keep_good(docs, model).columns == docs.columns


def test_edges(spark):
    docs = documents(spark, edge_rows())
    stats = quality.with_statistics(docs)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = quality.score(stats, quality.fit(stats, none)).collect()
    assert len(scored) == len(edge_rows()) and {r.score for r in scored} == {1.0}
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in quality.score(stats, quality.fit(stats, one)).collect())
    assert all(v is not None for r in stats.drop("doc_id").collect() for v in r)
    assert quality.with_statistics(documents(spark, [])).count() == 0


def test_labels_of_the_test_fold_are_not_used(spark):
    rows = [(i, "good words here " * 5 if i % 2 else "BAD!! " * 15) for i in range(400)]
    stats = quality.with_statistics(documents(spark, rows))
    true = [(i, i % 2, 0) for i in range(400)]
    false = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in true]
    schema = "doc_id long, quality int, toxic int"
    a, b = (quality.fit(stats, spark.createDataFrame(x, schema)) for x in (true, false))
    assert a.rules == b.rules and a.bias == b.bias
    assert quality.score(stats, a).where(F.col("predicted") != F.col("doc_id") % 2).count() == 0


def test_rules_of_a_printed_forest():
    text = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= -2.0E-4)
      Predict: 0.0
     Else (feature 1 > -2.0E-4)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    assert quality.tree_rules(text, ["a", "b"]) == [
        [("a", False, 0.5)], [("a", False, 0.5), ("b", False, -2e-4)], [("a", False, 0.5), ("b", True, -2e-4)], [("a", True, 0.5)]]


def test_rules_row_by_row(spark):
    """Memberships and the compiled score against the paths and weights worked out in Python."""
    rng = random.Random(3)
    names = ["x", "y", "z"]
    limits = [-1.5, 0.0, 0.25, 1e-7, 3e10]
    rules = [[(n, rng.random() < 0.5, rng.choice(limits)) for n in rng.sample(names, rng.randrange(1, 4))] for _ in range(40)]
    weights = [rng.uniform(-2, 2) for _ in rules]
    rows = [(i, *(rng.choice([*limits, rng.uniform(-2, 2)]) for _ in names)) for i in range(200)]
    stats = spark.createDataFrame(rows, "doc_id long, x double, y double, z double")
    member = quality.memberships(F.array(*names), names, rules)
    found = {r.doc_id: r for r in quality.score(stats, quality.Model(-0.3, list(zip(rules, weights)))).collect()}
    held = {r.doc_id: r.m for r in stats.select("doc_id", member.alias("m")).collect()}
    for doc_id, *values in rows:
        at = dict(zip(names, values))
        want = [float(all((at[n] > x) == above for n, above, x in rule)) for rule in rules]
        assert held[doc_id] == want
        score = 1 / (1 + math.exp(0.3 - sum(w for w, m in zip(weights, want) if m)))
        assert abs(found[doc_id].score - score) < 1e-12 and found[doc_id].predicted == int(score >= 0.7)
