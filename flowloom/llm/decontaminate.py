"""Benchmark decontamination by latent semantic retrieval, then word-order checks.

*Passages* are runs of three blocks of ``BLOCK`` words, one for each block, so any run of two blocks' words lies in one.
*TF-IDF*: words (ASCII case folded, outer ASCII punctuation kept) are hashed to ``FEATURES`` features; document frequencies are
counted over the passages of all documents in Spark.
*Randomised SVD*: with C the Gram matrix of passages that do not overlap and R a fixed random matrix, tasks form parts of
C R and Spark sums them by feature. The singular values and right vectors follow from C R and R (Nystroem), a matrix of fixed
size. The vectors are fitted on all documents, and every passage of every document is then searched. Passages and items are compared
in the whitened latent space by cosine.
*Candidates* are checked in the text: the longest common subsequence of an item and the words around the passage must hold
``share`` of the item's words, and the item's answer, its last quarter of words, must be there by half. So paraphrases that
change, drop or add some words are found as well as copies.

Items are taken in blocks of ``ITEM_BLOCK``; only one block's vectors go to the tasks at a time, and every block meets all
documents.

Null texts have no words. Rows with null ``doc_id`` can't be reported and are skipped; items with null text or null id or without
words match nothing. Items of few words (below ``MIN_WORDS``) are found only as exact runs in passages that their vector finds.
Repeated rows are reported once. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mapped, stored
from .words import U, batch, mix, ragged, text_slices, words

FEATURES, RANK, EXTRA = 1 << 13, 48, 8
BLOCK, RUN = 8, 3  # words of a block, blocks of a passage
ITEM_BLOCK = 4096
MIN_WORDS = 8
SEED = 11


def _features(h: np.ndarray) -> np.ndarray:
    return (mix(h, 21) % U(FEATURES)).astype(np.uint16)


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of blocks from it to the end of the text) of each block of words."""
    count = -(-np.diff(first) // BLOCK)
    text, place = ragged(count)
    return text, first[:-1][text] + place * BLOCK, count[text] - place


def _sums(vectors: np.ndarray, f: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of the word vectors of each block; ``vectors`` has a last row of zeros for places behind a text's end."""
    padded = np.append(f.astype(np.int64), FEATURES)
    total = vectors[padded[at]]
    for j in range(1, BLOCK):
        total += vectors[np.where(at + j < end, padded[np.minimum(at + j, len(f))], FEATURES)]
    return total


def _with_zero(vectors: np.ndarray) -> np.ndarray:
    return np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])


def _frequencies(batches):
    seen, total = np.zeros(FEATURES, np.int64), 0
    for b in batches:
        for _, _, data, bounds in text_slices(b.column(0)):
            _, _, h, first = words(data, bounds, lower=True)
            if not len(h):
                continue
            text, place = ragged(np.diff(first))
            passage = text.astype(np.int64) * (1 << 32) + place // (BLOCK * RUN)
            new = np.cumsum(np.append(0, passage[1:] != passage[:-1]))
            pairs = np.unique(new * FEATURES + _features(h))
            seen += np.bincount(pairs % FEATURES, minlength=FEATURES)
            total += int(new[-1]) + 1
    yield batch(["feature", "n"], [pa.array(np.append(np.arange(FEATURES), -1), pa.int64()), np.append(seen, total)])


def _random() -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((FEATURES, RANK + EXTRA)))[0].astype(np.float32)


def _gram(idf: np.ndarray):
    """A task's part of C R, a row for each feature."""
    def run(batches):
        weighed = _with_zero(_random() * idf[:, None])
        part = np.zeros((RANK + EXTRA, FEATURES), np.float64)
        for b in batches:
            for _, _, data, bounds in text_slices(b.column(0)):
                _, _, h, first = words(data, bounds, lower=True)
                if not len(h):
                    continue
                f = _features(h).astype(np.int64)
                text, at, left = _blocks(first)
                new = (at - first[text]) // BLOCK % RUN == 0
                y = np.add.reduceat(_sums(weighed, f, at, first[text + 1]), np.flatnonzero(new), axis=0)
                of = np.repeat(np.cumsum(new) - 1, np.minimum(BLOCK, first[text + 1] - at))
                for i, own in enumerate(np.ascontiguousarray(y.T, np.float64)):
                    part[i] += np.bincount(f, weights=own[of], minlength=FEATURES)
        part = part.T
        part *= idf[:, None]
        for lo in range(0, FEATURES, 1024):
            yield batch(["feature", *(f"y{i}" for i in range(RANK + EXTRA))],
                        [pa.array(np.arange(lo, lo + 1024), pa.int64()), *(np.ascontiguousarray(part[lo:lo + 1024, i]) for i in range(RANK + EXTRA))])
    return run


@dataclass
class Space:
    """Feature vectors of the whitened latent space."""

    vectors: np.ndarray  # FEATURES x RANK, weights included
    centre: np.ndarray  # mean direction of a word
    idf: np.ndarray


def latent_space(docs: DataFrame) -> Space:
    """Document frequencies over all passages of ``docs(doc_id, text)``, and right singular vectors."""
    counts = mapped(docs.select("text"), _frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows
    df = np.zeros(FEATURES + 1, np.float64)
    for r in counts:
        df[r["feature"]] = r["n"]
    idf = _idf(df)
    names = [f"y{i}" for i in range(RANK + EXTRA)]
    rows = mapped(docs.select("text"), _gram(idf), "feature long, " + ", ".join(f"{n} double" for n in names))
    summed = rows.groupBy("feature").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # a matrix of fixed size
    y = np.zeros((FEATURES, RANK + EXTRA))
    if len(summed):
        y[summed["feature"].to_numpy()] = summed[names].to_numpy()
    return _space(df, idf, y)


def _idf(df: np.ndarray) -> np.ndarray:
    """Cubed, so that not a few frequent words, of which every passage has the same share, span the latent space."""
    return (np.log((1 + df[-1]) / (1 + df[:-1])) ** 3).astype(np.float32)


def _space(df: np.ndarray, idf: np.ndarray, y: np.ndarray) -> Space:
    r = _random().astype(np.float64)
    core = r.T @ y
    core = (core + core.T) / 2
    values, turn = np.linalg.eigh(core)
    keep = values > 1e-9 * max(values.max(), 1e-30)
    left, s, _ = np.linalg.svd(y @ (turn[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    white = np.zeros((FEATURES, RANK), np.float32)
    good = s[:RANK] > 1e-6 * (s[0] if len(s) else 1)
    white[:, :good.sum()] = left[:, :RANK][:, good] * (s[0] if len(s) else 1) / s[:RANK][good]
    vectors = white * idf[:, None]
    weight = df[:-1] / max(df[:-1].sum(), 1)
    return Space(vectors, (weight[:, None] * vectors).sum(0).astype(np.float32), idf)


@dataclass
class Items:
    ids: list[int]
    words: list[list[int]]  # hashes
    query: np.ndarray  # parts x RANK
    of: np.ndarray  # item of each part
    blocks: np.ndarray  # blocks of the passages that each part is compared with


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _items(rows, space: Space) -> Items:
    """Word hashes and latent vectors; a long item is searched by parts of about a passage."""
    ids, held, query, of, blocks = [], [], [], [], []
    for item, text in rows:
        _, _, h, _ = words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), lower=True)
        if not len(h):
            continue
        parts = max(1, round(len(h) / (BLOCK * RUN)))
        cut = np.linspace(0, len(h), parts + 1).astype(int)
        f = _features(h)
        for a, z in zip(cut, cut[1:]):
            query.append((space.vectors[f[a:z]] - space.centre).sum(0))
            of.append(len(ids))
            blocks.append(min(RUN, max(1, round((z - a + 4) / BLOCK))))
        ids.append(item)
        held.append(h.tolist())
    return Items(ids, held, _unit(np.array(query, np.float32).reshape(-1, RANK)), np.array(of, np.int64), np.array(blocks, np.int64))


def common_subsequence(item: list[int], window: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    marks: dict[int, int] = {}
    for i, w in enumerate(item):
        marks[w] = marks.get(w, 0) | 1 << i
    state = full = (1 << len(item)) - 1
    for w in window:
        here = marks.get(w)
        if here:
            used = state & here
            state = (state + used | state - used) & full
    return len(item) - state.bit_count()


def check(item: list[int], near: list[int], share: float) -> tuple[int, int]:
    """(common words, offset) of the best run of ``near`` that passes, or (0, 0)."""
    size = len(item)
    need = size if size < MIN_WORDS else int(np.ceil(share * size))
    own, answer = set(item), item[-max(1, size // 4):]
    width, best = size if size < MIN_WORDS else int(np.ceil(1.3 * size)), (0, 0)
    before = [0]  # words of the item among the first ones: a run can't have more in common
    for w in near:
        before.append(before[-1] + (w in own))
    for at in range(0, max(1, len(near) - size // 2), 1 if size < MIN_WORDS else max(1, size // 8)):
        if before[min(at + width, len(near))] - before[at] < max(need, best[0] + 1):
            continue
        run = near[at:at + width]
        found = common_subsequence(item, run)
        if found >= need and found > best[0] and (size >= MIN_WORDS or run == item) and 2 * common_subsequence(answer, run) >= len(answer):
            best = (found, at)
    return best


def _search(space: Space, items: Items, cosine: float, share: float):
    has = np.zeros((len(items.ids), FEATURES), bool)
    for i, own in enumerate(items.words):
        has[i, _features(np.array(own, U))] = True
    # weight of the words that a passage must share with an item: four tenths of the item's, or of a passage's worth of it
    weight = [space.idf[_features(np.array(w, U))] for w in items.words]
    least = np.array([0.4 * min(w.sum(), w.mean() * BLOCK * RUN) for w in weight])

    vectors = _with_zero(space.vectors - space.centre)

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            for lo, hi, data, bounds in text_slices(b.column(1)):
                _, _, h, first = words(data, bounds, lower=True)
                if not len(h):
                    continue
                f = _features(h)
                text, at, left = _blocks(first)
                sums = _sums(vectors, f, at, first[text + 1])
                passage, met = sums.copy(), []
                for run_ in range(1, RUN + 1):
                    # also a block fewer: then no words beside the item blur the passage
                    own = np.flatnonzero((items.blocks == run_) | (items.blocks == run_ + 1))
                    if len(own):
                        place, part = np.nonzero(_unit(passage) @ items.query[own].T >= cosine)
                        met.append(np.column_stack([place, own[part]]))
                    if run_ < RUN:
                        passage[:-run_] += np.where((left[:-run_] > run_)[:, None], sums[run_:], 0)
                found = np.concatenate(met)
                if not len(found):
                    continue
                block, item = found[:, 0], items.of[found[:, 1]]
                reach = at[block][:, None] + np.arange(BLOCK * RUN)
                inside = reach < first[text[block] + 1][:, None]
                near = f[np.minimum(reach, len(f) - 1)]
                shared = np.where(has[item[:, None], near] & inside, space.idf[near], 0).sum(1)
                keep = shared >= least[item]
                out: dict[tuple[int, int], tuple[int, int]] = {}
                for k, i in zip(block[keep].tolist(), item[keep].tolist()):
                    row, begin = lo + int(text[k]), int(first[text[k]])
                    if out.get((row, i), (0, 0))[0] == len(items.words[i]):
                        continue
                    a = max(begin, int(at[k]) - len(items.words[i]))
                    z = min(int(first[text[k] + 1]), int(at[k]) + BLOCK * RUN + len(items.words[i]))
                    common, offset = check(items.words[i], h[a:z].tolist(), share)
                    if common > out.get((row, i), (0, 0))[0]:
                        out[row, i] = (common, a + offset - begin)
                if out:
                    yield batch(["doc_id", "item_id", "start_word", "common_words", "item_words"],
                                [pa.array(x, pa.int64()) for x in zip(*((int(ids[r]), items.ids[i], s, c, len(items.words[i])) for (r, i), (c, s) in out.items()))])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.55, share: float = 0.6) -> DataFrame:
    """(doc_id, item_id, start_word, common_words, item_words): where a document holds an item of ``benchmark(item_id, text)``."""
    schema = "doc_id long, item_id long, start_word long, common_words long, item_words long"
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-asked.count() // ITEM_BLOCK))
    space = latent_space(known)
    found = None
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = _items(sorted((r["item_id"], r["text"]) for r in own.collect()), space)  # one block of the query set
        if not items.ids:
            continue
        part = mapped(known, _search(space, items, cosine, share), schema)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct("start_word", "common_words", "item_words"), F.struct("common_words", -F.col("start_word"))).alias("b")
    return stored(found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*"))
