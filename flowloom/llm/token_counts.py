"""Token counts: pieces counted once for each distinct pre-token, then summed over documents' pre-token frequencies.

Distinct pre-tokens of the corpus are grouped in Spark with their numbers of occurrences and each is encoded once. The
dictionary is joined to the pre-token frequencies of documents (``postings``), and the sums come back by document; no list
of ids of a text is ever made. The join has two parts, chosen by the counts alone: the most frequent pre-tokens, at most
``FREQUENT``, are broadcast as (hash, number of tokens), 2 MB in all, and met in the scan; all others are dealt by hash, where
one has a row for each block, which Spark can split.

Pre-tokens are compared by 63-bit hashes.

Null text counts as empty: no bytes, no tokens. Repeated rows and rows with null ``doc_id`` keep a row each. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import pretokens
from .common import stored
from .postings import dictionary, frequent, post, weighted_sums

FREQUENT = 1 << 17


def _maker(path: str):
    def make():
        tool = pretokens.pieces(path)

        def units_of(data, bounds):
            text, st, en, h, first = pretokens.split(data, bounds, tool)
            return (h >> np.uint64(1)).astype(np.int64), first, lambda at: [text[a:b] for a, b in zip(st[at].tolist(), en[at].tolist())]
        return units_of
    return make


def _counter(path: str):
    @F.pandas_udf("long")
    def count(words: pd.Series) -> pd.Series:
        return pd.Series(pretokens.pieces(path).encode(words.tolist())[1])
    return count


def token_counts(docs: DataFrame, path: str, limit: int = 512, most_frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs(doc_id, text)`` with the tokenizer file at ``path``."""
    make = _maker(path)
    words = stored(dictionary(docs, make).select("unit", "n", _counter(path)("name").alias("weight")))
    known = frequent(words, most_frequent).select("unit", "weight").toPandas().sort_values("unit")
    shared = docs.sparkSession.sparkContext.broadcast((known["unit"].to_numpy(np.int64), known["weight"].to_numpy(np.int64)))
    found = weighted_sums(post(docs, make, shared), words)
    return found.select("doc_id", "n_bytes", F.col("total").alias("n_tokens"), (F.col("total") > limit).alias("over_limit"))
