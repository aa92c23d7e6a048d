"""Substring dedup: a compacted de Bruijn graph of word windows finds long repeated spans, coordinates verify them.

Edges are windows of ``size`` words. *Compaction by minimizer*: neighbouring windows whose least hash of ``MINI``
words stands at the same place form one path without branches, a row (minimizer, path hash, document, start, windows), about a ninth of
the words. Equal windows have equal minimizers, so what may be equal meets by minimizer:

* A path that also occurs earlier is removed as a whole; it keeps the coordinates of its first occurrence.
* A minimizer with several different paths is a branching place: of paths that share a side of it, the windows of the
  first occurrence are judged one by one.
* A minimizer with one occurrence is not repeated.

*Compaction across minimizers*: repeated paths of a document that continue each other at one source, in the document
as in the source, become one span. Each span is verified: an independent hash of its words, read again from the text at
both coordinates, must agree. Then covered words are removed; windows are always judged on the input.

A scan task combines equal paths of a block of its documents before the shuffle, and spans of them, so a passage that every document holds
sends one row for each block, and neither a passage nor a minimizer is gathered in one task's memory.

Null text: no words. A row with null ``doc_id`` has no place in the order: it is neither a source nor cut. Rows with one
``doc_id`` and equal text are one place, so neither is earlier; with different texts each keeps its own spans, because
a span applies only where the text has its words. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mapped, stored
from .words import U, batch, mix, ragged, signed, spans, text_slices, windows, words

MINI = 5
BLOCK_ROWS = 600_000  # paths that a task combines before it sends them
SIDE = 8  # words beside a minimizer of which one side must be shared by any window that is shared
PATH = "mini long, path long, doc_id long, start int, n int, sides int, src_doc long, src_start int"


def _least(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each run of ``width`` numbers, and its leftmost place."""
    span, low, at = 1, g, np.arange(len(g))

    def join(by):
        left = low[:-by] <= low[by:]
        return np.where(left, low[:-by], low[by:]), np.where(left, at[:-by], at[by:])
    while 2 * span <= width:
        low, at = join(span)
        span *= 2
    if width > span:
        low, at = join(width - span)
    return low, at


def _paths(h: np.ndarray, first: np.ndarray, size: int):
    """(text, start within the text, windows, minimizer, path hash, sides) of each path; ``first`` has each text's first word.

    A window around a minimizer holds at least ``SIDE`` words on one of its sides, so paths that share a window share the
    hash of one side. Both are kept in 16 bits each: a first sieve for the windows that must be judged one by one.
    """
    count = np.diff(first)
    have = np.maximum(count - size + 1, 0)
    text, place = ragged(have)
    if not len(text):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2 + (np.zeros(0, np.int32),)
    least, spot = (x[first[:-1][text] + place] for x in _least(windows(h, MINI, 11), size - MINI + 1))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (spot[1:] != spot[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(text)))
    text, place, spot = text[at], place[at], spot[at]
    path = spans(h, first[:-1][text] + place, n + size - 1, 13)
    side = windows(h, SIDE, 23)
    left, right = spot - SIDE, spot + MINI
    has_left, has_right = left >= first[:-1][text], right + SIDE <= first[1:][text]
    own = mix(path, 29)  # nothing to share on this side
    top = len(side) - 1
    sides = (np.where(has_left, side[np.clip(left, 0, top)], own) & U(0xFFFF)) << U(16) | np.where(has_right, side[np.clip(right, 0, top)], own) & U(0xFFFF)
    return text, place, n, least[at], path, sides.astype(np.uint32).view(np.int32)


def _scan(size: int):
    names = [c.split()[0] for c in PATH.split(", ")]

    def rows(held):
        mini, path, doc, start, n, sides = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, doc, path, mini))
        mini, path, doc, start, n, sides = (x[order] for x in (mini, path, doc, start, n, sides))
        new = np.ones(len(mini), bool)
        new[1:] = (mini[1:] != mini[:-1]) | (path[1:] != path[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero(~new & ((doc != doc[head]) | (start != start[head])))
        for lo in range(0, len(mini), 200_000):
            at = np.flatnonzero(new[lo:lo + 200_000]) + lo
            yield batch(names, [signed(mini[at]), signed(path[at]), doc[at], start[at].astype(np.int32), n[at].astype(np.int32), sides[at],
                                pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32())])
        # repeated in this block: what continues at one source is one row, sent on under a key that spreads
        src_doc, src_start, doc, start, n = doc[head[later]], start[head[later]], doc[later], start[later], n[later]
        order = np.lexsort((start, src_start - start, src_doc, doc))
        src_doc, src_start, doc, start, n = (x[order] for x in (src_doc, src_start, doc, start, n))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (src_doc[1:] != src_doc[:-1]) | (src_start[1:] - start[1:] != src_start[:-1] - start[:-1]) | (start[1:] != start[:-1] + n[:-1])
        at = np.flatnonzero(new)
        if len(at):
            key = mix(doc[at].astype(U) * U(1 << 24) + start[at].astype(U), 31)
            yield batch(names, [signed(key), signed(key), doc[at], start[at].astype(np.int32), np.add.reduceat(n, at).astype(np.int32),
                                np.zeros(len(at), np.int32), src_doc[at], src_start[at].astype(np.int32)])

    def run(batches):
        held, total = [], 0
        for b in batches:
            ids = np.asarray(b.column(0))
            for lo, hi, data, bounds in text_slices(b.column(1)):
                _, _, h, first = words(data, bounds)
                text, start, n, mini, path, sides = _paths(h, first, size)
                held.append((mini, path, ids[lo + text], start, n, sides))
                total += len(text)
                if total > BLOCK_ROWS:
                    yield from rows(held)
                    held, total = [], 0
        if total:
            yield from rows(held)
    return run


def _first_ones(batches):
    """From rows sorted by (mini, path, doc_id, start): later occurrences with their source, and firsts at branching places.

    Holds one minimizer's last path between batches; the rest is decided row by row.
    """
    names = [c.split()[0] for c in PATH.split(", ")]
    carry = None  # the path read last: mini, path, doc_id, start, n, sides, and whether it was sent
    for b in batches:
        mini, path, doc, start, n, sides = (np.asarray(b.column(i)) for i in range(6))
        known = np.asarray(b.column(6).is_valid())
        src_doc, src_start = np.asarray(b.column(6).fill_null(0)).copy(), np.asarray(b.column(7).fill_null(0)).copy()
        own = np.flatnonzero(~known)
        sent, judged, extra = known.copy(), np.zeros(len(mini), bool), None
        if len(own):
            m, p, d, s = mini[own], path[own], doc[own], start[own]
            new_m, new_p = np.ones(len(own), bool), np.ones(len(own), bool)
            new_m[1:] = m[1:] != m[:-1]
            new_p[1:] = new_m[1:] | (p[1:] != p[:-1])
            if carry is not None:
                new_m[0] = m[0] != carry[0]
                new_p[0] = new_m[0] or p[0] != carry[1]
            # the first occurrence of each row's path: in this batch, or the carried one
            head = np.maximum.accumulate(np.where(new_p, np.arange(len(own)), -1))
            hd = np.where(head >= 0, d[head], carry[2] if carry is not None else 0)
            hs = np.where(head >= 0, s[head], carry[3] if carry is not None else 0)
            later = ~new_p & ((hd != d) | (hs != s))
            src_doc[own[later]], src_start[own[later]] = hd[later], hs[later]
            sent[own[later]] = True
            # the first occurrence of a path is judged if its minimizer has another path before or after it
            starts = np.flatnonzero(new_p)
            if len(starts):
                again = ~new_m[starts]
                judged[own[starts[again | np.append(again[1:], False)]]] = True
                if again[0] and carry is not None and not carry[6]:
                    extra = carry[:6]
                at = own[starts[-1]]
                carry = (mini[at], path[at], doc[at], start[at], n[at], sides[at], bool(again[-1]))
        take = sent | judged
        first = judged[take]
        yield batch(names, [*(x[take] for x in (mini, path, doc, start, n, sides)), pa.array(src_doc[take], mask=first), pa.array(src_start[take], mask=first)])
        if extra is not None:
            yield batch(names, [*(np.array([x]) for x in extra), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())])


def _cut_text(raw: bytes, s: np.ndarray, e: np.ndarray, gone: np.ndarray) -> tuple[int, int, str]:
    kept = np.flatnonzero(~gone)
    return len(s), int(gone.sum()), hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(s[kept].tolist(), e[kept].tolist())])).hexdigest()


OPEN = "kind string, doc_id long, text string, n_words long, n_removed long, kept_sha256 string, hash long, start int, length int"


def _read(size: int):
    """Finished rows of texts that nothing asks about; for the rest the text, span hashes and window hashes."""
    names = [c.split()[0] for c in OPEN.split(", ")]

    def run(batches):
        for b in batches:
            asked = b.column(2)
            for lo, hi, data, bounds in text_slices(b.column(1)):
                s, e, h, first = words(data, bounds)
                made = []
                for i in range(hi - lo):
                    own = slice(first[i], first[i + 1])
                    doc = b.column(0)[lo + i].as_py()
                    todo = asked[lo + i].as_py()
                    if not todo:
                        raw = data[bounds[i]:bounds[i + 1]].tobytes()
                        made.append(("done", doc, None, *_cut_text(raw, s[own] - bounds[i], e[own] - bounds[i], np.zeros(first[i + 1] - first[i], bool)),
                                     None, None, None))
                        continue
                    made.append(("text", doc, b.column(1)[lo + i].as_py(), None, None, None, None, None, None))
                    n = first[i + 1] - first[i]
                    todo = [t for t in todo if t["start"] + t["length"] <= n]
                    if not todo:
                        continue
                    at = np.array([t["start"] for t in todo])
                    length = np.array([t["length"] for t in todo])
                    check = spans(h[own], at, length, 17).view(np.int64).tolist()
                    for t, c in zip(todo, check):
                        if t["path"] is None:
                            made.append(("span", doc, None, None, None, None, c, t["start"], t["length"]))
                    judged = [t["path"] is not None for t in todo]
                    if any(judged):
                        same = spans(h[own], at, length, 13).view(np.int64)
                        ok = np.array(judged) & (same == np.array([t["path"] or 0 for t in todo]))
                        _, place = ragged(np.where(ok, length - size + 1, 0))
                        place += np.repeat(at, np.where(ok, length - size + 1, 0))
                        if len(place):
                            for p, c in zip(place.tolist(), spans(h[own], place, np.full(len(place), size), 19).view(np.int64).tolist()):
                                made.append(("window", doc, None, None, None, None, c, p, size))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (
                    pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=names)
    return run


def _remove(batches):
    for b in batches:
        for lo, hi, data, bounds in text_slices(b.column(1)):
            s, e, h, first = words(data, bounds)
            out = []
            for i in range(hi - lo):
                own = slice(first[i], first[i + 1])
                n = int(first[i + 1] - first[i])
                edge = np.zeros(n + 1, np.int64)
                todo = [t for t in b.column(2)[lo + i].as_py() or [] if t["start"] + t["length"] <= n]
                if todo:
                    at, length = np.array([t["start"] for t in todo]), np.array([t["length"] for t in todo])
                    salt = np.array([t["salt"] for t in todo])
                    fits = np.where(salt == 17, spans(h[own], at, length, 17), spans(h[own], at, length, 19)).view(np.int64) == np.array([t["hash"] for t in todo])
                    np.add.at(edge, at[fits], 1)
                    np.add.at(edge, (at + length)[fits], -1)
                raw = data[bounds[i]:bounds[i + 1]].tobytes()
                out.append((b.column(0)[lo + i].as_py(), *_cut_text(raw, s[own] - bounds[i], e[own] - bounds[i], np.cumsum(edge[:-1]) > 0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, size: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs(doc_id, text)``.

    A word goes if a window of ``size`` words covers it whose words also start earlier: in a smaller ``doc_id``, or earlier
    in the same document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    paths = mapped(docs.where("doc_id is not null"), _scan(size), PATH)
    met = paths.repartition("mini").sortWithinPartitions("mini", "path", "doc_id", "start")
    places = stored(mapped(met, _first_ones, PATH))
    unsure = places.where("src_doc is null").withColumn("left", F.shiftright("sides", 16)).withColumn("right", F.col("sides").bitwiseAND(F.lit(0xFFFF)))
    shared = None
    for side in ("left", "right"):  # a path whose sides no other path of its minimizer has shares no window
        twice = unsure.groupBy("mini", side).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mini", side)
        part = unsure.join(twice, ["mini", side]).select("path", "doc_id", "start", "n")
        shared = part if shared is None else shared.union(part)
    judged = stored(shared.distinct())

    along = Window.partitionBy("doc_id", "src_doc", F.col("src_start") - F.col("start")).orderBy("start")
    again = places.where("src_doc is not null")
    spans_ = (again.withColumn("gap", F.coalesce((F.lag(F.col("start") + F.col("n")).over(along) != F.col("start")).cast("int"), F.lit(1)))
              .withColumn("island", F.sum("gap").over(along))
              .groupBy("doc_id", "src_doc", (F.col("src_start") - F.col("start")).alias("shift"), "island")
              .agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) + size - 1 - F.min("start")).cast("int").alias("length"))
              .select("doc_id", "src_doc", "start", (F.col("start") + F.col("shift")).cast("int").alias("src_start"), "length").distinct())
    spans_ = stored(spans_)
    # one question for each stretch of words, however many spans have it as their source
    stretches = spans_.select("doc_id", "start", "length").union(spans_.select("src_doc", "src_start", "length")).distinct()
    asked = stretches.select("doc_id", F.struct("start", "length", F.lit(None).cast("long").alias("path")).alias("t")).union(
        judged.select("doc_id", F.struct("start", (F.col("n") + size - 1).cast("int").alias("length"), "path")))
    asked = asked.groupBy("doc_id").agg(F.collect_list("t").alias("asked"))
    read = stored(mapped(docs.join(asked, "doc_id", "left").select("doc_id", "text", "asked"), _read(size), OPEN))

    shown = read.where("kind = 'span'").select("doc_id", "start", F.col("length").alias("length"), "hash").distinct()
    here = spans_.join(shown, ["doc_id", "start", "length"])
    there = shown.select(F.col("doc_id").alias("src_doc"), F.col("start").alias("src_start"), "length", "hash")
    sure = here.join(there, ["src_doc", "src_start", "length", "hash"], "left_semi").select("doc_id", F.struct("start", "length", "hash", F.lit(17).alias("salt")).alias("t"))
    seen = read.where("kind = 'window'").select("hash", "doc_id", "start")
    earliest = seen.groupBy("hash").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = (seen.join(earliest, "hash").where("f.doc_id <> doc_id or f.start <> start")
             .select("doc_id", F.struct("start", F.lit(size).alias("length"), "hash", F.lit(19).alias("salt")).alias("t")))
    cuts = sure.union(later).distinct().groupBy("doc_id").agg(F.collect_list("t").alias("cuts"))
    open_ = read.where("kind = 'text'").select("doc_id", "text").join(cuts, "doc_id", "left").select("doc_id", "text", "cuts")
    closed = mapped(open_, _remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return read.where("kind = 'done'").select("doc_id", "n_words", "n_removed", "kept_sha256").union(closed)
