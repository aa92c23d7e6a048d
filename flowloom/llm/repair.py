"""Token-id files compressed by Re-Pair, one grammar for each shard.

*Order.* Documents are dealt to ranges of (``doc_id``, hash of the text, salt) and sorted inside, so tasks hold consecutive
documents and rows that share an id, or even all columns, can lie in several tasks. A task encodes its texts, appends ``end_id`` to each
and cuts the stream of ids into shards of ``shard_ids``; a document may go on in the next shard.

*Grammar.* A shard's ids are renumbered, then frequent pairs of neighbours are replaced by nonterminals round by round.
In a round the pairs are counted by bucket, a bucket counts the pair that owns it, and pairs that occur often enough are ranked by
frequency. Where occurrences overlap, the more frequent pair is replaced, the others wait for the next round. Pairs never
cross the end of a document, and a rule is kept only if it is used ``least`` times. Rounds end when one saves less than ``gain``.

*File.* A Parquet row for each shard, written by Spark below one folder: place in the part, documents with their numbers of
ids, the ids in use, the rules, the number of ids that each rule expands to, and the symbols. ``start`` of a document and any
range of ids follow from sums of the expansion lengths, so ``ids_of`` decodes only the symbols that cover wanted documents,
and shards without one are pruned by their least and largest ``doc_id``.

Null text: empty, only the end id. Null ``doc_id``: first in the order. Repeated rows: a document each, side by side. Very long texts are
spread over shards. Other columns are ignored. An empty table gives files without shards and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import mapped, scratch
from .crc import joined
from .pretokens import kept_ids
from .words import U, batch, ragged, text_slices

END_ID = 0
SHARD_IDS = 1 << 20
ROUNDS, LEAST, GAIN = 16, 8, 0.02
BUCKET_BITS = 18
_ODD = U(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)
_FORMAT = ("part int, shard int, ids_before long, docs_before long, n_ids long, low_doc long, high_doc long, unknown boolean, "
           "docs binary, known binary, lengths binary, terminals binary, rules binary, expansions binary, width int, symbols binary")


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS, least: int = LEAST, gain: float = GAIN) -> tuple[np.ndarray, ...]:
    """(ids in use, rules as pairs of symbols, ids a rule expands to, symbols); ``ends`` marks ids that end a document.

    Symbols below the number of ids in use stand for those; the others for rules, which only use smaller symbols.
    """
    used = np.bincount(ids) > 0
    terminals = np.flatnonzero(used)
    seq = (np.cumsum(used) - 1).astype(np.uint32)[ids]
    size = np.ones(len(terminals), np.int64)
    closed, rules, first_free = ends.copy(), [np.zeros((0, 2), np.uint32)], len(terminals)
    room = max(0, (1 << 16) - first_free) if first_free < 1 << 16 else 1 << 16  # symbols of 16 bits where ids allow it
    for turn in range(rounds):
        if len(seq) < 2 * least or not room:
            break
        key = seq[:-1].astype(U) << U(32) | seq[1:]
        bucket = (key * (_ODD + U(2 * turn)) >> U(64 - BUCKET_BITS)).astype(np.int32)
        open_ = ~closed[:-1]
        owner = np.zeros(1 << BUCKET_BITS, U)
        owner[bucket] = key
        mine = open_ & (owner[bucket] == key)
        count = np.bincount(bucket[mine], minlength=1 << BUCKET_BITS)
        often = np.flatnonzero(count >= least)
        often = often[np.argsort(-count[often], kind="stable")][:room]
        rank = np.full(1 << BUCKET_BITS, _NONE, np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        r = np.where(mine, rank[bucket], _NONE)
        take = r < _NONE
        take[1:] &= r[1:] < r[:-1]
        take[:-1] &= r[:-1] <= r[1:]
        times = np.bincount(r[take], minlength=len(often))
        kept = times >= least
        at = np.flatnonzero(take)
        at = at[kept[r[at]]]
        if len(at) < gain * len(seq):
            break
        symbol = (first_free + np.cumsum(kept) - 1).astype(np.uint32)
        pairs = owner[often[kept]]
        rules.append(np.column_stack([pairs >> U(32), pairs & U(0xFFFFFFFF)]).astype(np.uint32))
        size = np.concatenate([size, size[rules[-1][:, 0]] + size[rules[-1][:, 1]]])
        first_free += int(kept.sum())
        room -= int(kept.sum())
        seq[at] = symbol[r[at]]
        closed[at] = closed[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, closed = seq[keep], closed[keep]
    return terminals, np.concatenate(rules), size[len(terminals):], seq


def _opened(symbols: np.ndarray, n: int, rules: np.ndarray) -> np.ndarray:
    """Symbols with all rules applied, a level of the grammar at a time."""
    while True:
        inner = symbols >= n
        if not inner.any():
            return symbols
        size = 1 + inner
        edge = np.cumsum(size)
        out = np.empty(edge[-1], np.uint32)
        out[edge - size] = np.where(inner, 0, symbols)
        pair = rules[symbols[inner] - n]
        out[edge[inner] - 2], out[edge[inner] - 1] = pair[:, 0], pair[:, 1]
        symbols = out


class Shard:
    """A shard read back; ``ids(lo, hi)`` decodes only the symbols that cover that range of its ids."""

    def __init__(self, terminals: bytes, rules: bytes, expansions: bytes, symbols: bytes, width: int):
        self.terminals = np.frombuffer(terminals, "<u4")
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2)
        self.symbols = np.frombuffer(symbols, f"<u{width}")
        n = len(self.terminals)
        self.size = np.concatenate([np.ones(n, np.int64), np.frombuffer(expansions, "<u4").astype(np.int64)])
        self.begin = np.cumsum(self.size) - self.size
        self.flat = self.terminals[_opened(np.arange(n + len(self.rules), dtype=np.uint32), n, self.rules)]
        self.edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size[self.symbols])])

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = int(self.edge[-1]) if hi is None else hi
        a, z = np.searchsorted(self.edge, lo, "right") - 1, np.searchsorted(self.edge, hi, "left")
        own = self.symbols[a:z]
        symbol, place = ragged(self.size[own])
        return self.flat[self.begin[own][symbol] + place][lo - self.edge[a]:hi - self.edge[a]]


def _encode(path: str, end_id: int, shard_ids: int):
    def run(batches):
        part, ids_of = TaskContext.get().partitionId(), kept_ids(path)
        shard = ids_before = docs_before = held = 0
        docs, known, lengths, parts, ends = [], [], [], [], []

        def row(last: bool):
            nonlocal shard, ids_before, docs_before, held
            own, closes = np.concatenate(parts), np.zeros(held, bool)
            closes[np.cumsum(lengths) - 1] = True
            if not last:
                closes[-1] = True  # a shard's end ends its pairs, too
            terminals, rules, sizes, symbols = compress(own, closes)
            width = 2 if len(terminals) + len(rules) <= 1 << 16 else 4
            given = [d for d, k in zip(docs, known) if k]
            values = [part, shard, ids_before, docs_before, held, min(given, default=None), max(given, default=None), not all(known),
                      np.array(docs, "<i8").tobytes(), np.array(known, np.uint8).tobytes(), np.array(lengths, "<u4").tobytes(),
                      terminals.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), width,
                      symbols.astype(f"<u{width}").tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.bool_(), *[pa.binary()] * 6, pa.int32(), pa.binary()]
            shard, ids_before, docs_before = shard + 1, ids_before + held, docs_before + len(docs) - (not last)
            out = batch([c.split()[0] for c in _FORMAT.split(", ")], [pa.array([v], k) for v, k in zip(values, kinds)])
            held = 0
            for x in (docs, known, lengths, parts):
                x.clear()
            return out

        for b in batches:
            names = b.column(0)
            for lo, hi, data, bounds in text_slices(b.column(1)):
                ids, first = ids_of.of(data, bounds)
                for i in range(hi - lo):
                    doc = names[lo + i].as_py()
                    left = np.append(ids[first[i]:first[i + 1]], np.uint32(end_id))
                    while True:
                        take = min(len(left), shard_ids - held)
                        docs.append(doc or 0)
                        known.append(doc is not None)
                        lengths.append(take)
                        parts.append(left[:take])
                        held += take
                        left = left[take:]
                        if held == shard_ids:
                            yield row(not len(left))
                        if not len(left):
                            break
        if held:
            yield row(True)
    return run


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, parts: int | None = None) -> None:
    """Write the id files of ``docs(doc_id, text)`` with the tokenizer file at ``path`` to ``folder``; ``parts`` tasks, or Spark's default."""
    order = ["doc_id", "_tag", "_salt"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        "*", F.xxhash64("text").alias("_tag"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions(*order).select("doc_id", "text")
    mapped(ordered, _encode(path, end_id, shard_ids), _FORMAT).write.parquet(folder)


def _shards(batches):
    """(row of the batch, its values by name, its shard)."""
    for b in batches:
        for i in range(b.num_rows):
            values = {n: b.column(n)[i].as_py() for n in b.schema.names}
            yield values, Shard(*(values[c] for c in ("terminals", "rules", "expansions", "symbols", "width")))


def _pieces(batches):
    for v, shard in _shards(batches):
        lengths = np.frombuffer(v["lengths"], "<u4").astype(np.int64)
        edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        ids = shard.ids().astype("<u4")
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
        n = len(lengths)
        yield batch(["part", "doc_no", "doc_id", "at", "n", "crc"],
                    [np.full(n, v["part"], np.int32), v["docs_before"] + np.arange(n),
                     pa.array(np.frombuffer(v["docs"], "<i8"), mask=np.frombuffer(v["known"], np.uint8) == 0),
                     v["ids_before"] + edge[:-1], lengths, np.array(crc, np.int64)])


def _joined_crc(pieces: pd.Series) -> pd.Series:
    """Checksum of each document from those of its pieces (at, n, crc), in order."""
    def one(own):
        crc = own[0]["crc"]
        for p in own[1:]:
            crc = int(joined(np.array([crc], np.uint32), np.array([p["crc"]], np.uint32), np.array([4 * p["n"]]))[0])
        return crc
    return pieces.map(one)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document in the files, decoded from them.

    ``start`` adds the ids of earlier parts; a part is one writing task, so their table has a row for each task.
    """
    files = spark.read.schema(_FORMAT).parquet(folder)
    parts = files.groupBy("part").agg(F.max(F.col("ids_before") + F.col("n_ids")).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    pieces = mapped(files, _pieces, "part int, doc_no long, doc_id long, at long, n long, crc long")
    found = pieces.groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.first("crc").alias("crc"),
        F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
    crc = F.when(F.col("k") == 1, F.col("crc")).otherwise(F.pandas_udf(_joined_crc, "long")("pieces"))
    return found.join(before, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", crc.alias("ids_crc32"))


def ids_of(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, part, doc_no, at, ids): the pieces of a few documents, by random access; ``at`` counts ids in the part."""
    wanted = np.array(sorted(doc_ids), np.int64)

    def run(batches):
        for v, shard in _shards(batches):
            docs, lengths = np.frombuffer(v["docs"], "<i8"), np.frombuffer(v["lengths"], "<u4").astype(np.int64)
            edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
            hit = np.flatnonzero(np.isin(docs, wanted) & (np.frombuffer(v["known"], np.uint8) == 1))
            found = [shard.ids(int(edge[i]), int(edge[i + 1])).astype(np.int64) for i in hit]
            yield batch(["doc_id", "part", "doc_no", "at", "ids"],
                        [docs[hit], np.full(len(hit), v["part"], np.int32), v["docs_before"] + hit, v["ids_before"] + edge[hit],
                         pa.array(found, pa.list_(pa.int64()))])
    near = [f"(low_doc <= {d} and high_doc >= {d})" for d in wanted.tolist()] or ["false"]
    files = spark.read.schema(_FORMAT).parquet(folder).where(" or ".join(near))
    return mapped(files, run, "doc_id long, part int, doc_no long, at long, ids array<long>")


def encoded_documents(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files (below ``spark.checkpoint.dir``, or to ``folder``), read them back and describe each document."""
    folder = folder or scratch(docs.sparkSession)
    write_ids(docs, path, folder, end_id)
    return read_documents(docs.sparkSession, folder)
