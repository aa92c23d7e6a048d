"""Ranked search for a set of items: an index by blocks of documents, searched by MaxScore with bounds on pairs of terms.

*Index.* A task packs blocks of consecutive documents: sorted terms (64-bit hashes), the documents that hold each and how often. No
term is shuffled, so a term that every document holds is spread over all blocks. Statistics (documents, terms, document frequencies of
the items' terms) are summed over the blocks.

*Lists.* For each block and batch of items the impacts of the items' terms are computed, with their largest value in each range
of ``RANGE`` documents. An item's terms are paired by falling weight; for each pair in use the documents that hold both
are intersected, and the largest joint impact in a range is kept.

*Bounds.* In a range a pair adds at most the largest of its joint impact and of each term's alone, which is less than the
two maxima together wherever their documents differ. The sum over an item's pairs bounds every document of the range.

*Search.* First each block scores the documents of each item's most promising range; the ``top``-th best of all these scores is a threshold
that the result can't fall below. Then every range whose bound reaches the threshold is searched. Inside, terms are taken by falling
weight; once the pairs that are left can't reach the threshold alone, no new document is started and documents that can't reach it are
dropped. Ranges and documents are skipped only if their bound lies below the threshold, so results are exact, ties included.

Items come in batches of ``ITEM_BATCH``, and every batch meets every block. A batch is broadcast only if all batches together are
below ``BROADCAST_BYTES``; larger ones are joined by salted keys.

Terms are maximal runs of ASCII letters, digits and signs beyond ASCII; ASCII letters match in either case. Null or empty text: no terms;
such a document isn't counted and such an item finds nothing. Each row of the items is searched on its own, a null id included. Repeated
documents are ranked one by one, and a null ``doc_id`` ranks behind equal scores. Texts of any length are indexed whole. Other columns are
ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import mapped, stored
from .resample import folded
from .words import U, batch, ragged, text_slices, words

BLOCK_BYTES = 4 << 20
ITEM_BATCH = 512
BROADCAST_BYTES = 8 << 20
SALTS = 64
RANGE = 32  # documents of a range
_INDEX = "block long, doc_ids binary, known binary, lengths binary, units binary, edges binary, docs binary, times binary"
_ITEMS = "batch long, ids binary, known binary, units binary, edges binary, terms binary"
_LISTS = "batch long, block long, doc_ids binary, known binary, present binary, edges binary, docs binary, impacts binary, pairs binary, bounds binary"
_FOUND = "batch long, item int, item_id long, doc_id long, score long"


def _occurrences(texts: pa.Array):
    """(row, hash) of each term in pieces."""
    for text, start, _, row in folded(texts):
        if len(start):
            yield row, words(text, np.array([0, len(text)]))[2]


def _packed(rows: list[np.ndarray], units: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Equal (unit, row) summed, sorted: units, first place of each (and the total), rows, times."""
    if not rows:
        return np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, unit, n = np.concatenate(rows), np.concatenate(units), np.concatenate(times)
    order = np.lexsort((row, unit))
    row, unit, n = row[order], unit[order], n[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (unit[1:] != unit[:-1])
    at = np.flatnonzero(new)
    row, unit, n = row[at], unit[at], np.add.reduceat(n, at)
    edge = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    return unit[edge], np.append(edge, len(unit)), row, n


def _distinct(row: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, edge, rows, times = packed = _packed([row], [unit], [np.ones(len(row), np.int64)])
    return rows, np.repeat(packed[0], np.diff(edge)), times


def _index(batches):
    block = TaskContext.get().partitionId() << 32
    for b in batches:
        for lo, hi, _, _ in text_slices(b.column(1), BLOCK_BYTES):
            lengths, rows, units, times = np.zeros(hi - lo, np.int64), [], [], []
            for row, unit in _occurrences(b.column(1).slice(lo, hi - lo)):
                lengths += np.bincount(row, minlength=hi - lo)
                for held, part in zip((rows, units, times), _distinct(row, unit)):
                    held.append(part)
            unit, edge, docs, n = _packed(rows, units, times)
            ids = b.column(0).slice(lo, hi - lo)
            values = [np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_valid()).astype(np.uint8), lengths.astype("<i8"),
                      unit.astype("<u8"), edge.astype("<u4"), docs.astype("<u4"), n.astype("<u4")]
            yield batch([c.split()[0] for c in _INDEX.split(", ")], [pa.array([block], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)])
            block += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs(doc_id, text)``: a row for each block."""
    return stored(mapped(docs.select(F.col("doc_id").cast("long"), "text"), _index, _INDEX))


def _items(batches):
    """Batches of items: their ids, the batch's distinct terms, and the places of each item's terms among them."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        for lo in range(0, b.num_rows, ITEM_BATCH):
            ids = b.column(0).slice(lo, ITEM_BATCH)
            rows, units, times = [], [], []
            for row, unit in _occurrences(b.column(1).slice(lo, ITEM_BATCH)):
                for held, part in zip((rows, units, times), _distinct(row, unit)):
                    held.append(part)
            unit, edge, item, _ = _packed(rows, units, times)
            term = np.repeat(np.arange(len(unit)), np.diff(edge))
            order = np.argsort(item, kind="stable")
            at = np.searchsorted(item[order], np.arange(len(ids) + 1))
            values = [np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_valid()).astype(np.uint8), unit.astype("<u8"),
                      at.astype("<u4"), term[order].astype("<u4")]
            yield batch([c.split()[0] for c in _ITEMS.split(", ")], [pa.array([number], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)])
            number += 1


def _met(blocks: DataFrame, batches: DataFrame, numbers: list[int], small: bool) -> DataFrame:
    """Every block with every batch: an equi join on the batch's number, salted where batches are too large to broadcast."""
    every = F.explode(F.array(*(F.lit(n).cast("long") for n in numbers)) if numbers else F.array().cast("array<long>")).alias("batch")
    if small:
        return blocks.select("*", every).join(F.broadcast(batches), "batch")
    salted = batches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blocks.select("*", every, F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["batch", "salt"]).drop("salt")


def _records(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(n)[i] for n in b.schema.names}


def _array(value, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind) if len(value.as_buffer()) else np.zeros(0, kind)


def _where(units: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``wanted``, places in ``units``) of what both hold; both sorted."""
    at = np.searchsorted(units, wanted)
    hit = np.flatnonzero(units[np.minimum(at, len(units) - 1)] == wanted) if len(units) else np.zeros(0, np.int64)
    return hit, at[hit]


def _frequencies(batches):
    """(batch, term, documents that hold it), summed over a task's blocks."""
    total: dict[int, np.ndarray] = {}
    for r in _records(batches):
        units, edges, wanted = _array(r["units"], "<u8"), _array(r["edges"], "<u4").astype(np.int64), _array(r["wanted"], "<u8")
        own = total.setdefault(r["batch"].as_py(), np.zeros(len(wanted), np.int64))
        hit, at = _where(units, wanted)
        own[hit] += edges[at + 1] - edges[at]
    for number, own in total.items():
        yield batch(["batch", "term", "df"], [np.full(len(own), number), np.arange(len(own)), own])


def _statistics(batches):
    n = terms = 0
    for r in _records(batches):
        lengths = _array(r["lengths"], "<i8")
        n, terms = n + int((lengths > 0).sum()), terms + int(lengths.sum())
    yield batch(["n", "terms"], [pa.array([n], pa.int64()), pa.array([terms], pa.int64())])


def _pairing(weights: np.ndarray, edges: np.ndarray, terms: np.ndarray) -> list[np.ndarray]:
    """Each item's terms by falling weight; the terms at places 0 and 1, 2 and 3, ... are its pairs."""
    return [own[np.lexsort((own, -weights[own]))] for own in (terms[a:z] for a, z in zip(edges[:-1], edges[1:]))]


def _maxima(docs: np.ndarray, values: np.ndarray, ranges: int) -> np.ndarray:
    out = np.zeros(ranges, np.int64)
    np.maximum.at(out, docs // RANGE, values)
    return out


def _lists(n_docs: int, n_terms: int):
    """Impacts of a batch's terms in a block, and the pairs' joint maxima by range."""
    def run(batches):
        for r in _records(batches):
            units, edges, lengths = _array(r["units"], "<u8"), _array(r["edges"], "<u4").astype(np.int64), _array(r["lengths"], "<i8")
            weights = _array(r["weights"], "<i8")
            hit, at = _where(units, _array(r["wanted"], "<u8"))
            size = edges[at + 1] - edges[at]
            term, place = ragged(size)
            place = edges[at][term] + place
            docs, times = _array(r["docs"], "<u4")[place].astype(np.int64), _array(r["times"], "<u4")[place].astype(np.int64)
            m = 100 - 90 + (90 * lengths * n_docs) // n_terms
            impact = weights[hit][term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[docs]))
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
            local = np.full(len(weights), -1)
            local[hit] = np.arange(len(hit))
            ranges = -(-len(lengths) // RANGE)
            pairs, bounds, seen = [], [], set()
            for own in _pairing(weights, _array(r["item_edges"], "<u4").astype(np.int64), _array(r["terms"], "<u4").astype(np.int64)):
                for x, y in zip(own[::2].tolist(), own[1::2].tolist()):
                    a, b = int(local[x]), int(local[y])
                    if a < 0 or b < 0 or (x, y) in seen:
                        continue
                    seen.add((x, y))
                    both, i, j = np.intersect1d(docs[first[a]:first[a + 1]], docs[first[b]:first[b + 1]], assume_unique=True, return_indices=True)
                    if len(both):
                        pairs.append((x, y))
                        bounds.append(_maxima(both, impact[first[a] + i] + impact[first[b] + j], ranges))
            values = [hit.astype("<u4"), first.astype("<u4"), docs.astype("<u4"), impact.astype("<i8"), np.array(pairs, "<u4"),
                      np.array(bounds, "<i8")]
            yield batch([c.split()[0] for c in _LISTS.split(", ")],
                        [pa.array([r[c].as_py()], pa.int64()) for c in ("batch", "block")] + [pa.array([r[c].as_py()], pa.binary()) for c in ("doc_ids", "known")]
                        + [pa.array([v.tobytes()], pa.binary()) for v in values])
    return run


class Block:
    """The lists of one block for one batch of items."""

    def __init__(self, r):
        self.ids, self.known = _array(r["doc_ids"], "<i8"), _array(r["known"], np.uint8)
        self.present, self.first = _array(r["present"], "<u4").astype(np.int64), _array(r["edges"], "<u4").astype(np.int64)
        self.docs, self.impacts = _array(r["docs"], "<u4").astype(np.int64), _array(r["impacts"], "<i8")
        self.ranges = -(-len(self.ids) // RANGE)
        weights = _array(r["weights"], "<i8")
        self.local = np.full(len(weights), -1)
        self.local[self.present] = np.arange(len(self.present))
        term = np.repeat(np.arange(len(self.present)), np.diff(self.first))
        self.highest = np.zeros((len(self.present) + 1, self.ranges), np.int64)  # the last row is for absent terms
        np.maximum.at(self.highest, (term, self.docs // RANGE), self.impacts)
        bounds = _array(r["bounds"], "<i8").reshape(-1, self.ranges) if self.ranges else np.zeros((0, 0), np.int64)
        self.joint = dict(zip(map(tuple, _array(r["pairs"], "<u4").reshape(-1, 2).tolist()), bounds))
        self.items = _pairing(weights, _array(r["item_edges"], "<u4").astype(np.int64), _array(r["terms"], "<u4").astype(np.int64))

    def bounds(self, item: int) -> np.ndarray:
        """A row for each pair (or last single term) of an item: the most it can add to a document, by range."""
        own = self.items[item]
        high = self.highest[self.local[own]]
        rows = np.maximum(high[:-1:2], high[1::2])
        for k, pair in enumerate(zip(own[::2].tolist(), own[1::2].tolist())):
            both = self.joint.get(pair)
            if both is not None:
                np.maximum(rows[k], both, out=rows[k])
        return np.concatenate([rows, high[-1:]]) if len(own) % 2 else rows

    def search(self, item: int, bounds: np.ndarray, alive: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at most ``top`` documents with ``least`` or more, in the ranges that are ``alive``."""
        live = np.repeat(alive, RANGE)[:len(self.ids)]
        rest = np.cumsum(bounds[::-1], axis=0)[::-1]  # what pairs from here on can add
        score, begun = np.zeros(len(self.ids), np.int64), None
        for k in range(len(bounds)):
            if begun is None and int(rest[k][alive].max()) < least:
                begun = np.flatnonzero(live & (score > 0))
            if begun is not None:
                begun = begun[score[begun] + rest[k][begun // RANGE] >= least]
                if not len(begun):
                    return begun, begun
            for term in self.items[item][2 * k:2 * k + 2].tolist():
                at = int(self.local[term])
                if at < 0:
                    continue
                docs, impacts = self.docs[self.first[at]:self.first[at + 1]], self.impacts[self.first[at]:self.first[at + 1]]
                if begun is None:
                    score[docs] += impacts
                else:
                    spot = np.minimum(np.searchsorted(docs, begun), len(docs) - 1)
                    held = docs[spot] == begun
                    score[begun[held]] += impacts[spot[held]]
        found = np.flatnonzero(live & (score >= least)) if begun is None else begun[score[begun] >= least]
        order = np.lexsort((self.ids[found], 1 - self.known[found], -score[found]))[:top]
        return found[order], score[found[order]]


def _best(top: int, seed: bool):
    """The best documents of each item over a task's blocks: of its most promising range (``seed``), or of all ranges its threshold leaves."""
    def run(batches):
        best: dict[tuple[int, int], list] = {}
        names: dict[int, tuple] = {}
        for r in _records(batches):
            block, number = Block(r), r["batch"].as_py()
            if number not in names:
                names[number] = (_array(r["item_ids"], "<i8").copy(), _array(r["item_known"], np.uint8).copy(),
                                 np.maximum(_array(r["least"], "<i8"), 1) if not seed else None)
            least = names[number][2]
            for item in range(len(block.items)):
                if not len(block.items[item]) or not block.ranges:
                    continue
                own = best.setdefault((number, item), [])
                limit = max(1 if seed else int(least[item]), -own[-1][0] if len(own) == top else 1)
                bounds = block.bounds(item)
                total = bounds.sum(axis=0)
                alive = total >= limit
                if seed:
                    alive &= np.arange(block.ranges) == total.argmax()
                if not alive.any():
                    continue
                docs, scores = block.search(item, bounds, alive, limit, top)
                if len(docs):
                    found = zip((-scores).tolist(), (1 - block.known[docs]).tolist(), block.ids[docs].tolist())
                    own.extend(found)
                    own.sort()
                    del own[top:]
        for number, (ids, known, _) in names.items():
            rows = [(item, *x) for (b, item), own in best.items() if b == number for x in own]
            item, score, unknown, doc = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
            yield batch(["batch", "item", "item_id", "doc_id", "score"],
                        [np.full(len(item), number), item.astype(np.int32), pa.array(ids[item], mask=known[item] == 0),
                         pa.array(doc, mask=unknown == 1), -score])
    return run


def _packed_weights(rows: pa.Table) -> pa.Table:
    """A batch's weights in the order of its terms: as many rows as the batch has terms."""
    order = np.argsort(np.asarray(rows["term"].combine_chunks()))
    weights = np.asarray(rows["w"].combine_chunks())[order].astype("<i8")
    return pa.table({"batch": rows["batch"].slice(0, 1), "weights": pa.array([weights.tobytes()], pa.binary())})


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``."""
    index = build_index(docs)
    batches = stored(mapped(items.select(F.col("item_id").cast("long"), "text"), _items, _ITEMS))
    sizes = batches.select("batch", F.length("ids") * 9 + F.length("units") * 3 + F.length("terms")).collect()  # a row for each batch
    numbers, small = sorted(r[0] for r in sizes), sum(r[1] for r in sizes) <= BROADCAST_BYTES
    n_docs, n_terms = mapped(index.select("lengths"), _statistics, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()

    wanted = batches.select("batch", F.col("units").alias("wanted"))
    held = mapped(_met(index.select("block", "units", "edges"), wanted, numbers, small).select("batch", "units", "edges", "wanted"), _frequencies,
                  "batch long, term long, df long").groupBy("batch", "term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((F.lit(2.0) * (n_docs or 0) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = held.select("batch", "term", w.alias("w")).groupBy("batch").applyInArrow(_packed_weights, "batch long, weights binary")
    batches = stored(batches.join(weights, "batch").select("batch", F.col("ids").alias("item_ids"), F.col("known").alias("item_known"),
                                                           F.col("units").alias("wanted"), F.col("edges").alias("item_edges"), "terms", "weights"))

    queries = batches.drop("item_ids", "item_known")
    lists = stored(mapped(_met(index, queries, numbers, small), _lists(n_docs or 0, n_terms or 1), _LISTS))
    about = batches.drop("wanted")
    own = ["present", "edges", "docs", "impacts", "pairs", "bounds"]
    lists = lists.select("batch", "block", "doc_ids", "known", *own)

    def joined(more: DataFrame) -> DataFrame:
        if small:
            return lists.join(F.broadcast(more), "batch")
        salted = more.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return lists.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(salted, ["batch", "salt"]).drop("salt")

    place = Window.partitionBy("batch", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    seeds = mapped(joined(about), _best(top, True), _FOUND).withColumn("rank", F.row_number().over(place)).where(F.col("rank") == top)
    least = seeds.groupBy("batch").agg(F.collect_list(F.struct("item", "score")).alias("found"))  # at most ITEM_BATCH

    def packed(own):
        def one(item_ids, found):
            out = np.zeros(len(item_ids) // 8, "<i8")
            for x in found if found is not None else []:
                out[x["item"]] = x["score"]
            return out.tobytes()
        return F.udf(one, "binary")(*own)
    about = stored(about.join(least, "batch", "left").withColumn("least", packed(["item_ids", "found"])).drop("found"))
    found = mapped(joined(about), _best(top, False), _FOUND).withColumn("rank", F.row_number().over(place))
    return found.where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
