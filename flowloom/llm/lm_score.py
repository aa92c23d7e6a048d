"""Language-model scores by stupid backoff over counts of the whole corpus.

Units are token ids of a public tokenizer, so the vocabulary is fixed by its file and nothing is unknown. Bigrams are
posted by block of documents, summed in a count table that is hash-partitioned by bigram, and joined back to the
postings; a document's score is the sum over its bigrams. With ``c`` the counts and ``N`` all tokens:

    c(t) / N                    for a text's first token
    c(p, t) / c(p)              if the bigram's count is ``min_count`` or more
    backoff * c(t) / N          else

Logarithms are kept as integers of 1e-9, so sums do not depend on their order. Unigram counts have at most as many rows as
the tokenizer has ids, and are therefore broadcast; nothing else is.

Null or empty text: no tokens, score 0 and null mean. Repeated rows and null ``doc_id`` keep a row each, and count in the
tables like any other. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .postings import post, weighted_sums
from .pretokens import Ids

SHIFT = 20  # bits of an id
START = (1 << SHIFT) - 1
UNIT = 1e-9


def _maker(path: str):
    def make():
        ids = Ids(path)

        def units_of(data, bounds):
            own, first = ids.of(data, bounds)
            own = own.astype(np.int64)
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[first[:-1][first[:-1] < len(own)]] = START
            return (before << SHIFT) | own, first, None
        return units_of
    return make


def lm_scores(docs: DataFrame, path: str, min_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) for each row of ``docs(doc_id, text)``."""
    postings = stored(post(docs, _maker(path)))
    bigrams = (postings.where("total > 0").groupBy("unit").agg(F.sum("total").alias("n"))
               .select("unit", F.shiftright("unit", SHIFT).alias("p"), F.col("unit").bitwiseAND(F.lit(START)).alias("t"), "n"))
    bigrams = stored(bigrams)
    unigrams = bigrams.groupBy("t").agg(F.sum("n").alias("c"))
    total = unigrams.agg(F.sum("c")).first()[0] or 1
    after = F.broadcast(unigrams)
    before = F.broadcast(unigrams.select(F.col("t").alias("p"), F.col("c").alias("pc")))
    alone = F.log(F.col("c") / F.lit(float(total)))
    value = (F.when(F.col("p") == START, alone)
             .when(F.col("n") >= min_count, F.log(F.col("n") / F.col("pc")))
             .otherwise(alone + float(np.log(backoff))))
    weights = bigrams.join(after, "t").join(before, "p", "left").select("unit", F.round(value / UNIT).cast("long").alias("weight"))
    found = weighted_sums(postings, weights)
    score = F.col("total") * UNIT
    return found.select("doc_id", F.col("n_units").alias("n_tokens"), score.alias("log_score"),
                        F.when(F.col("n_units") > 0, score / F.col("n_units")).alias("mean_log_score"))
