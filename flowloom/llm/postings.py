"""Postings of units (pre-tokens, n-grams) by block of documents, and sums over them.

A block is a run of documents of one scan task with about ``BLOCK_BYTES`` of text. A unit has one row in each block that
holds it: the documents that hold it as 16-bit numbers and, unless each holds it once, how often as bytes. So a unit that every document holds has as
many rows as there are blocks, a join on the unit can be split at any row, and no row grows beyond its block. A block also
has one row of its own, with a unit of its own and total 0: its documents' ids, bytes and numbers of units, and their
sums over units whose weight was known at the scan (a broadcast of bounded size), which have no rows.

Units are 64-bit numbers, those of texts hashes; ``dictionary`` gives their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import mapped
from .words import batch, ragged, text_slices

BLOCK_BYTES = 40 << 20
BLOCK_DOCS = 60_000
ROWS = 4096  # of an Arrow batch
SORTED = 1 << 19  # rows of a block that are put in order at once
HELD = 16 << 20  # sums that a task holds before it hands them on
HELD_NAMES = 500_000  # distinct units that a task counts before it hands them on


class Block:
    """Collects units of documents; ``rows`` gives the packed rows."""

    def __init__(self):
        self.units, self.docs, self.times, self.about, self.n_bytes, self.n_docs = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, bounds: np.ndarray, units: np.ndarray, first: np.ndarray, known):
        doc, size, sums = np.repeat(np.arange(len(ids)), np.diff(first)), np.diff(first), np.zeros(len(ids), np.int64)
        u, back = np.unique(units, return_inverse=True)
        if known is not None and len(known[0]) and len(u):
            place = np.minimum(np.searchsorted(known[0], u), len(known[0]) - 1)
            hit = known[0][place] == u
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(hit, known[1][place], 0)[back])])
            sums = total[first[1:]] - total[first[:-1]]
            rest = ~hit[back]
            doc, back = doc[rest], back[rest]
        pair, times = np.unique(back * len(ids) + doc, return_counts=True) if len(back) else (np.zeros(0, np.int64),) * 2
        many = np.maximum(-(-times // 255), 1)  # a document may hold a unit more often than a byte counts
        if (many > 1).any():
            pair, left = np.repeat(pair, many), np.repeat(times, many)
            times = np.minimum(left - 255 * ragged(many)[1], 255)
        self.units.append(u[pair // max(len(ids), 1)])
        self.docs.append((pair % max(len(ids), 1) + self.n_docs).astype(np.uint16))
        self.times.append(times.astype(np.uint8))
        self.about.append((ids, np.diff(bounds), size, sums))
        self.n_docs += len(ids)
        self.n_bytes += int(bounds[-1])

    def rows(self, block: int):
        ids = pa.concat_arrays([x[0] for x in self.about])
        about = np.concatenate([np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.int64),
                                *(np.concatenate([x[i] for x in self.about]) for i in (1, 2, 3))]).astype("<i8")
        # a negative number is no unit
        yield batch(["block", "unit", "total", "posting"], [pa.array([block], pa.int64()), pa.array([-1 - block], pa.int64()), pa.array([0], pa.int64()),
                                                            pa.array([about.tobytes()], pa.binary())])
        for units, docs, times in self._ranges():
            yield from _packed(block, units, docs, times)

    def _ranges(self):
        """(unit, document, times) by ascending ranges of units of about ``SORTED`` rows, so that no more is copied at once."""
        step = max(SORTED // 64, 1)
        some = np.sort(np.concatenate([u[::step] for u in self.units]))[64::64] if sum(map(len, self.units)) > SORTED else self.units[0][:0]
        places = [np.concatenate([[0], np.searchsorted(u, np.unique(some)), [len(u)]]) for u in self.units]  # a slice's units ascend
        for i in range(len(places[0]) - 1):
            yield [np.concatenate([x[at[i]:at[i + 1]] for x, at in zip(column, places)]) for column in (self.units, self.docs, self.times)]


def _packed(block: int, units: np.ndarray, docs: np.ndarray, times: np.ndarray):
    order = np.argsort(units, kind="stable")
    units, docs, times = units[order], docs[order], times[order]
    edge = np.append(np.flatnonzero(np.append(True, units[1:] != units[:-1])), len(units)) if len(units) else np.zeros(1, np.int64)
    own = units[edge[:-1]]
    keys = own.astype(np.int64)
    total = np.add.reduceat(times.astype(np.int64), edge[:-1]) if len(own) else np.zeros(0, np.int64)
    for lo in range(0, len(own), ROWS):
        hi = min(lo + ROWS, len(own))
        once = total[lo:hi] == np.diff(edge[lo:hi + 1])
        packed = [docs[edge[i]:edge[i + 1]].tobytes() if one else _with_times(docs[edge[i]:edge[i + 1]], times[edge[i]:edge[i + 1]])
                  for i, one in zip(range(lo, hi), once)]
        yield batch(["block", "unit", "total", "posting"], [np.full(hi - lo, block, np.int64), keys[lo:hi], total[lo:hi],
                                                            pa.array(packed, pa.binary())])


def _with_times(docs: np.ndarray, times: np.ndarray) -> bytes:
    """An odd number of bytes, so that it can be told from documents alone."""
    return docs.tobytes() + times.tobytes() + (b"" if len(docs) % 2 else b"\0")


def _posting(body) -> tuple[np.ndarray, np.ndarray | None]:
    if len(body) % 2 == 0:
        return np.frombuffer(body, np.uint16), None
    n = len(body) // 3
    return np.frombuffer(body, np.uint16, n), np.frombuffer(body, np.uint8, n, 2 * n)


def _post(make, known):
    def run(batches):
        units_of, weights = make(), known.value if known is not None else None
        block, number = Block(), TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, data, bounds in text_slices(b.column(1)):
                for i in range(lo, hi, BLOCK_DOCS):  # a slice of empty texts may have any number of rows
                    j = min(hi, i + BLOCK_DOCS)
                    if block.n_docs and (block.n_bytes >= BLOCK_BYTES or block.n_docs + j - i > BLOCK_DOCS):
                        yield from block.rows(number)
                        block, number = Block(), number + 1
                    a, z = bounds[i - lo], bounds[j - lo]
                    cut, edges = data[a:z], bounds[i - lo:j - lo + 1] - a
                    units, first, _ = units_of(cut, edges)
                    block.add(b.column(0).slice(i, j - i), edges, units, first, weights)
        if block.n_docs:
            yield from block.rows(number)
    return run


def post(docs: DataFrame, make, known=None) -> DataFrame:
    """(block, unit, total, posting) of ``docs(doc_id, text)``.

    ``make()`` gives, in the worker, a function from (bytes, offsets) to (unit of each occurrence, first occurrence of each
    text, names or None); units are numbers from 0, ``names(at)`` gives the units' texts for places of occurrences.
    ``known`` may broadcast (ascending units, their weights): these are summed here and not posted.
    """
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), _post(make, known),
                  "block long, unit long, total long, posting binary")


def dictionary(docs: DataFrame, make, held: int = HELD_NAMES) -> DataFrame:
    """(unit, name, n): each unit of ``docs(text)``, its text and how often it occurs."""
    schema = ["unit", "name", "n"]

    def run(batches):
        units_of = make()
        order, at, n, names = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def out():
            by_arrival = np.empty(len(order), np.int64)
            by_arrival[at] = order
            for lo in range(0, len(names), 10 * ROWS):
                yield batch(schema, [by_arrival[lo:lo + 10 * ROWS], pa.array(names[lo:lo + 10 * ROWS], pa.string()), n[lo:lo + 10 * ROWS]])

        for b in batches:
            for _, _, data, bounds in text_slices(b.column(1)):
                units, _, texts = units_of(data, bounds)
                u, where, times = np.unique(units.astype(np.int64), return_index=True, return_counts=True)
                place = np.searchsorted(order, u)
                old = order[np.minimum(place, len(order) - 1)] == u if len(order) else np.zeros(len(u), bool)
                n[at[place[old]]] += times[old]
                order, at = np.insert(order, place[~old], u[~old]), np.insert(at, place[~old], len(n) + np.arange(int((~old).sum())))
                n = np.concatenate([n, times[~old]])
                names += texts(where[~old])
                if len(names) > held:
                    yield from out()
                    order, at, n, names = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        yield from out()
    found = mapped(docs.select("doc_id", "text"), run, "unit long, name string, n long")
    return found.groupBy("unit").agg(F.min("name").alias("name"), F.sum("n").alias("n"))


def frequent(counted: DataFrame, most: int) -> DataFrame:
    """Rows of ``counted(n)`` with the largest ``n``, ``most`` at the most, for a broadcast.

    Counted by steps of ``n``: the lowest step down to which no more than ``most`` rows lie sets the least ``n``, so no task sorts and none sends more.
    """
    step = F.floor(8 * F.log2("n")).cast("int")
    total, least = 0, None
    for s, rows in sorted(((r["step"], r["count"]) for r in counted.groupBy(step.alias("step")).count().collect()), reverse=True):
        total += rows
        if total > most:
            break
        least = s
    return counted.where(F.lit(False) if least is None else step >= least)


def _weigh(batches):
    """Sums by document of weight times occurrences: packed by block, handed on when many are held."""
    held: dict[int, np.ndarray] = {}

    def out():
        for block, sums in held.items():
            at = np.flatnonzero(sums)
            kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not len(at) or np.abs(sums).max() <= np.iinfo(t).max)
            part = bytes([np.dtype(kind).itemsize]) + sums[at].astype(kind).tobytes() + at.astype(np.uint16).tobytes()
            yield batch(["block", "about", "part"], [pa.array([block], pa.int64()), pa.array([False]), pa.array([part], pa.binary())])
        held.clear()

    size = 0
    for b in batches:
        raw = b.column(3)
        for i, (block, weight) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
            body = raw[i].as_buffer()
            if weight is None:
                yield batch(["block", "about", "part"], [pa.array([block], pa.int64()), pa.array([True]), pa.array([body.to_pybytes()], pa.binary())])
                continue
            docs, times = _posting(body)
            if block not in held:
                held[block] = np.zeros(256, np.int64)
                size += 256
            top = int(docs[-1]) + 1
            if len(held[block]) < top:
                bigger = min(1 << 16, max(top, 2 * len(held[block])))
                size += bigger - len(held[block])
                held[block] = np.concatenate([held[block], np.zeros(bigger - len(held[block]), np.int64)])
            if times is not None:
                np.add.at(held[block], docs, times.astype(np.int64) * weight)
            elif len(docs) > 1:
                held[block][docs] += weight
            else:
                held[block][docs[0]] += weight
        if size > HELD:
            yield from out()
            size = 0
    yield from out()


def _unpack(rows: pa.Table) -> pa.Table:
    """The rows of one block, a part for each task of the join at most, as a row for each document."""
    about, total = None, np.zeros(1 << 16, np.int64)  # a block has fewer documents
    for own, part in zip(rows["about"].to_pylist(), rows["part"]):
        body = part.as_buffer()
        if own:
            about = np.frombuffer(body, "<i8").reshape(5, -1)
        else:
            raw = body.to_pybytes()
            width = raw[0]
            n = len(raw) // (width + 2)
            sums = np.frombuffer(raw[1:1 + n * width], f"i{width}")
            np.add.at(total, np.frombuffer(raw[1 + n * width:], np.uint16), sums)
    return pa.Table.from_batches([batch(["doc_id", "n_bytes", "n_units", "total"],
                                        [pa.array(about[0], mask=about[1] == 0), about[2], about[3], about[4] + total[:about.shape[1]]])])


def weighted_sums(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_units, total): for each document the sum of ``weights(unit, weight long)`` over its units."""
    rows = postings.join(weights.select("unit", "weight"), "unit", "left").select("block", "unit", "weight", "posting")
    parts = mapped(rows, _weigh, "block long, about boolean, part binary")
    return parts.groupBy("block").applyInArrow(_unpack, "doc_id long, n_bytes long, n_units long, total long")
