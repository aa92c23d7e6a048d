"""Target-distribution importance resampling with an Aho-Corasick dictionary of words.

*Dictionary.* Words of documents and target texts are counted in Spark. The most frequent ones, at most ``dictionary_words`` of at most
``MAX_BYTES`` bytes, go into an automaton, each between two delimiters and with its CRC-32 and length as payload, so the dictionary's
size has a fixed bound. Texts are folded first: ASCII letters to lower case, every other ASCII sign that isn't a digit to one delimiter.
A scan then gives the payload of each whole word; words the dictionary lacks get theirs from their own bytes, so every word counts.

*Buckets.* A feature is a run of one to three words. Its checksum is composed from the payloads of neighbouring words: appending a
word shifts the checksum by the word's length and adds the word's own. The bucket is the checksum modulo ``buckets``.

*Gains.* A first scan sums bucket counts by task, and Spark sums them by bucket. A bucket's gain is the integer logarithm of the
smoothed ratio of its share in the target to that in the documents; a second scan sums gains by document.

*Draw.* A document's score is its weight plus Gumbel noise from a hash of ``doc_id``, so the highest scores are a draw without
replacement. Scores are ranked by ranges of (score, doc_id): ranks inside a range are offset by the sizes of the ranges above it,
and no task sorts them all.

Null text: no words. Texts of any length are scanned in pieces that carry their last two words over. A null ``doc_id`` hashes as an empty
string and ranks behind equal scores. Repeated rows count and are drawn one by one; equal rows rank side by side. Other columns
are ignored. An empty table of documents gives an empty result; an empty target has no features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mapped, stored
from .crc import shift
from .words import CHUNK, batch, text_slices, words

MAX_BYTES = 64
SPACE = 0x20
DELIMITER = np.ones(256, bool)
DELIMITER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[DELIMITER] = SPACE
_FOLD[0x41:0x5B] += 0x20


class Dictionary:
    """Words between delimiters in an automaton; ``payloads`` gives checksum and length of each word of a folded text."""

    def __init__(self, known: list[bytes]):
        self.automaton = ahocorasick.Automaton()
        for word in known:
            self.automaton.add_word(f" {word.decode('latin-1')} ", zlib.crc32(word) | len(word) << 32)
        if known:
            self.automaton.make_automaton()

    def payloads(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``text`` has a delimiter before each word and behind it; a byte is a sign of the automaton."""
        raw = text.tobytes()
        crc, size, missing = np.zeros(len(start), np.uint32), end - start, np.ones(len(start), bool)
        if len(self.automaton):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(raw.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, found[:, 0])
            crc[at], size[at], missing[at] = found[:, 1] & 0xFFFFFFFF, found[:, 1] >> 32, False
        for i in np.flatnonzero(missing).tolist():
            crc[i] = zlib.crc32(raw[start[i]:end[i]])
        return crc, size


_open: dict[str, Dictionary] = {}  # by name


def _dictionary(known) -> Dictionary:
    """One automaton for each worker process; ``known`` broadcasts (name, words)."""
    name, own = known.value
    if name not in _open:
        _open.clear()
        _open[name] = Dictionary(own)
    return _open[name]


def folded(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(folded bytes, start and end of each word, its row) in pieces; a long text is cut between words and goes on in the next piece."""
    for lo, hi, data, bounds in text_slices(texts):
        begin = 0
        while begin < len(data) or (begin == 0 and not len(data)):
            end = len(data)
            if end - begin > 2 * CHUNK:  # one long text
                probe = begin + CHUNK
                while probe < end and not DELIMITER[data[probe:probe + CHUNK]].any():
                    probe += CHUNK
                end = min(end, probe + int(DELIMITER[data[probe:probe + CHUNK]].argmax())) if probe < end else end
            inner = bounds[1:-1][(bounds[1:-1] >= begin) & (bounds[1:-1] <= end)] - begin
            text = np.insert(_FOLD[data[begin:end]], np.concatenate([[0], inner, [end - begin]]), SPACE)
            blank = text == SPACE
            start, stop = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
            if len(bounds) == 2:
                row = np.full(len(start), lo)
            else:
                row = lo + np.searchsorted(bounds[1:-1] + np.arange(1, len(bounds) - 1), start, "right")
            yield text, start, stop, row
            begin = end
            if begin >= len(data):
                break


def feature_buckets(texts: pa.Array, known: Dictionary, buckets: int, longest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each feature, its bucket, row of each word) in pieces."""
    blank = np.uint32(zlib.crc32(b" "))
    old_crc, old_size, old_row = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for text, start, stop, row in folded(texts):
        crc, size = known.payloads(text, start, stop)
        own = len(old_row)  # words of the piece before, only to be continued
        crc, size, every = np.concatenate([old_crc, crc]), np.concatenate([old_size, size]), np.concatenate([old_row, row])
        spaced = shift(np.full(len(crc), blank), size) ^ crc  # of the word behind a blank
        runs, rows, run = [crc[own:]], [row], crc
        for n in range(2, longest + 1):
            run = shift(run[:max(len(every) - n + 1, 0)], size[n - 1:] + 1) ^ spaced[n - 1:]
            whole = every[n - 1:] == every[:max(len(every) - n + 1, 0)]
            whole[:max(own - n + 1, 0)] = False
            runs.append(run[whole])
            rows.append(every[n - 1:][whole])
        yield np.concatenate(rows), (np.concatenate(runs) % np.uint32(buckets)).astype(np.int64), row
        keep = min(longest - 1, len(every))
        old_crc, old_size, old_row = crc[len(every) - keep:], size[len(every) - keep:], every[len(every) - keep:]


def _words(batches):
    """(word, n) of words of at most ``MAX_BYTES`` bytes, summed over many slices."""
    held: dict[bytes, int] = {}
    for b in batches:
        for text, start, stop, _ in folded(b.column(0)):
            raw, short = text.tobytes(), stop - start <= MAX_BYTES
            # words of the piece are told apart by hash, so bytes are taken once for each
            s, _, h, _ = words(text, np.array([0, len(text)]))
            _, at, n = np.unique(h[short], return_index=True, return_counts=True)
            for a, z, k in zip(start[short][at].tolist(), stop[short][at].tolist(), n.tolist()):
                word = raw[a:z]
                held[word] = held.get(word, 0) + k
            if len(held) > 500_000:
                yield batch(["word", "n"], [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())])
                held = {}
    if held:
        yield batch(["word", "n"], [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())])


def frequent_words(texts: DataFrame, most: int) -> list[bytes]:
    """The frequent words of ``texts(text)``, at most ``most`` of at most ``MAX_BYTES`` bytes each.

    Words are counted by steps of their count; the lowest step down to which no more than ``most`` words lie sets the least count, so
    only the words that are kept reach the driver.
    """
    counted = stored(mapped(texts, _words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # at most 8 rows for each doubling
    least, held = None, 0
    for s, words_of in sorted(((r["step"], r["words"]) for r in steps), reverse=True):
        held += words_of
        if held > most:
            break
        least = s
    return [] if least is None else [bytes(r["word"]) for r in counted.where(step >= least).select("word").collect()]


def _counts(known, buckets: int):
    def run(batches):
        dictionary, total = _dictionary(known), np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket, _ in feature_buckets(b.column(0), dictionary, buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield batch(["bucket", "n"], [at.astype(np.int64), total[at]])
    return run


def bucket_counts(texts: DataFrame, known, buckets: int) -> DataFrame:
    """(bucket, n): features of ``texts(text)`` by bucket."""
    return mapped(texts, _counts(known, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _weights(known, gains):
    def run(batches):
        dictionary, gain = _dictionary(known), np.array(gains.value, np.int64)
        for b in batches:
            n_words, n_features, weight = np.zeros((3, b.num_rows), np.int64)
            for row, bucket, word_row in feature_buckets(b.column(1), dictionary, len(gain)):
                for total, r, values in ((n_words, word_row, None), (n_features, row, None), (weight, row, gain[bucket])):
                    if len(r):
                        lo = int(r.min())
                        sums = np.bincount(r - lo, values)
                        total[lo:lo + len(sums)] += sums.astype(np.int64)
            yield batch(["doc_id", "n_words", "n_features", "weight"], [b.column(0), n_words, n_features, weight])
    return run


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with ``rank``: the highest ``percent`` of scores of documents with ``least_words`` words, null for the rest."""
    wide = scored.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    long = wide.where(F.col("n_words") >= least_words).repartitionByRange(*order, "_salt")
    long = stored(long.withColumn("part", F.spark_partition_id()))
    sizes = long.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order, "_salt"))
    drawn = total * percent // 100
    rank = F.col("before") + inside
    long = long.join(before, "part").withColumn("rank", F.when(rank <= drawn, rank).cast("long"))
    short = wide.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return long.select(*scored.columns, "rank").union(short.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42,
             dictionary_words: int = 100_000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs(doc_id, text)``, drawn towards ``target(text)``."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = context.broadcast((uuid4().hex, frequent_words(rows.select("text").union(target.select("text")), dictionary_words)))
    own = {r["bucket"]: r["n"] for r in bucket_counts(rows.select("text"), known, buckets).collect()}  # at most one row for each bucket
    wanted = {r["bucket"]: r["n"] for r in bucket_counts(target.select("text"), known, buckets).collect()}
    s, t = float(sum(own.values()) + buckets), float(sum(wanted.values()) + buckets)
    gains = [int(np.floor(1000 * np.log((wanted.get(b, 0) + 1) * s / ((own.get(b, 0) + 1) * t)))) for b in range(buckets)]
    weighed = stored(mapped(rows, _weights(known, context.broadcast(gains)), "doc_id long, n_words long, n_features long, weight long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long"))
    return ranked(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
