"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, packing.

``run`` applies the stages to ``documents``; each stage's table is written to the shared folder and read again. All
stages but the last return the columns of ``documents``; where a stage changes a text it recounts ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from flowloom.llm.common import new_name, stored

ORACLE_SQL = None  # training and retrieval have no SQL form: tests/llm holds brute-force versions


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows without ``doc_id`` are scored like the rest.

    Statistics of the labelled rows are stored for the fit; those of all rows are computed once, with the score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = docs.join(labels.where("quality is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    model = quality.fit(quality.with_statistics(labelled), labels)
    return quality.keep_good(docs, model).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three lines, 50 words or 300 characters are deleted from the texts."""
    return line_dedup.dedup_lines(docs, min_words=50, min_chars=300, counts=False)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest ``doc_id``, and of its texts in the group one.

    Rows that share a ``doc_id`` but are no near duplicates stay; so do rows without ``doc_id`` and those whose text has no words.
    """
    joined = ngram_join.ngram_jaccard_join(docs, percent=80, words_in_shingle=5).where("doc_id is not null")
    first = joined.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("kept"))
    rows = joined.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.first("component").alias("component"))
    mark = new_name(docs)
    doc, tag, repeated = mark + "doc", mark + "tag", mark + "repeated"
    keep = stored(rows.join(first, "component", "left").where("component is null or (kept.doc_id = doc_id and kept.tag = tag)").select(
        F.col("doc_id").alias(doc), F.col("tag").alias(tag), (F.col("component").isNotNull() & (F.col("n") > 1)).alias(repeated)))
    kept = docs.join(keep, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(tag)))
    once = kept.where(~F.col(repeated)).select(*docs.columns)
    again = kept.where(F.col(repeated)).dropDuplicates([doc, tag]).select(*docs.columns)
    return once.union(again).union(docs.where("doc_id is null"))


def without_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in its words or paraphrased, go."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = leaks.select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
