import random

import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from flowloom.llm import queries
from flowloom.llm.common import components
from llm_cases import documents, edge_rows, sentences


def test_stages_take_effect(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 0.6 * docs.count(), name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small)
    assert {r.doc_id for r in last.collect()} == ids
    again = corpus_pipeline.run(spark, sf_small)
    assert sorted(map(tuple, again.select(last.columns).collect())) == sorted(map(tuple, last.collect()))


def test_near_duplicates_lose_no_text(spark, sf_small):
    rng = random.Random(9)
    a, b, c, d = (sentences(rng, 50) for _ in range(4))
    rows = [(1, a), (2, b), (2, c), (3, c), (4, d), (4, d), (4, d + " x"), (5, None), (5, None), (6, ""), (None, a), (None, None), (7, a + " tail"), (8, "one two")]
    docs = documents(spark, rows).withColumn("kept_tag", F.lit("k")).withColumn("component", F.lit(1)).withColumn("n", F.lit(2))
    out = corpus_pipeline.without_near_duplicates(spark, docs, sf_small)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()))
    four = min((xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 for t in (d, d + " x"))
    four = next(t for t in (d, d + " x") if (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 == four)
    assert kept == sorted([(False, 1, a), (False, 2, b), (False, 2, c), (False, 4, four), (False, 5, ""), (False, 5, ""), (False, 6, ""), (True, 0, a),
                           (True, 0, ""), (False, 8, "one two")])


def test_stages_bear_edges(spark, sf_small):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables in every stage."""
    rows = edge_rows()
    for name, stage in corpus_pipeline.STAGES:
        for docs in (documents(spark, rows), documents(spark, [])):
            docs = docs.withColumn("_score", F.lit(0.5)).withColumn("_tag", F.lit("t")).withColumn("_lines", F.lit(1)).withColumn("n_lines", F.lit("x"))
            out = stage(spark, docs, sf_small)
            if name != "packing":
                assert out.columns == docs.columns, name
            found = out.collect()
            assert len(found) >= 1 or not docs.count(), name
            if name not in ("packing", "quality classifier"):
                assert all((r._score, r._tag, r._lines, r.n_lines, r.root, r.tag) == (0.5, "t", 1, "x", "x", "t") for r in found), name


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.SQL) <= set(entry.oracle_sql())


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1500)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1500)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
