"""Packing of documents into sequences: shortest-pack-first over the length histogram.

A document's ids are those of the tokenizer file, then an end id. Documents longer than a sequence are cut at every
full sequence; what is left has a length below it. Only the histogram of these lengths (at most ``size`` numbers) reaches
the driver. There the lengths are placed longest first, each into the emptiest pack, with whole groups of equal packs
moved at once: the state is a count for each packing pattern, bounded by the number of lengths and not by the data.
Patterns go back to documents by rank: the n-th document of a length takes the n-th place that the patterns hold for
that length. Ranks come from counts by (length, bucket of documents) and a running count within a bucket, so a length
that very many documents share is not ranked in one task.

A sequence's last pack may be short; packs are filled so that little is padded. Null text: empty, only the end id.
Empty table: empty result. Repeated rows: each is packed on its own. A null ``doc_id`` is packed like any other.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mapped, stored
from .pretokens import Ids
from .words import batch, text_slices

END_ID = 1
BUCKETS = 1024


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cut(path: str, size: int, end_id: int):
    """One row for each piece, with the checksum of its ids."""
    def run(batches):
        ids_of = Ids(path)
        for b in batches:
            for lo, hi, data, bounds in text_slices(b.column(1)):
                ids, first = ids_of.of(data, bounds)
                row, start, length, crc, tokens = [], [], [], [], []
                for i in range(hi - lo):
                    own = np.append(ids[first[i]:first[i + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), size):
                        piece = own[at:at + size]
                        row.append(lo + i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        tokens.append(len(own))
                yield batch(["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                            [b.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))])
    return run


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths in a pack) for a histogram of lengths.

    Longest lengths first; each goes to the packs with most room, as many packs at once as both sides have.
    """
    room: list[tuple[int, tuple[int, ...]]] = []  # heap of (-room, lengths)
    packs: dict[tuple[int, ...], int] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if room and -room[0][0] >= length:
                free, lengths = heapq.heappop(room)
                have = packs.pop(lengths)
                used = min(have, left)
                if used < have:
                    packs[lengths] = have - used
                    heapq.heappush(room, (free, lengths))
                free, lengths = free + length, lengths + (length,)
            else:
                used, free, lengths = left, length - size, (length,)
            if lengths not in packs:
                heapq.heappush(room, (free, lengths))
            packs[lengths] = packs.get(lengths, 0) + used
            left -= used
    return sorted(((n, lengths) for lengths, n in packs.items()), key=lambda x: (-sum(x[1]), x[1]))


def places(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, places in a sequence, offset) of each pattern's lengths.

    Ranks below ``first rank`` of a length are taken by earlier patterns. Equal lengths in one pattern stand side by side.
    """
    taken: dict[int, int] = {}
    found, sequence = [], 0
    for n, lengths in packs:
        offset = 0
        for length in dict.fromkeys(lengths):
            same = lengths.count(length)
            begin = taken.get(length, 0)
            taken[length] = begin + n * same
            found.append((length, begin, taken[length], sequence, same, offset))
            offset += length * same
        sequence += n
    return found


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    pieces = mapped(docs.select(F.col("doc_id").cast("long"), "text"), _cut(path or tokenizer_path(), size, end_id),
                    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = stored(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int")))
    held = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    table = spark.createDataFrame(places(shortest_pack_first(counts, size)),
                                  "length long, from_rank long, to_rank long, sequence long, same long, at long")
    before = held.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    inside = F.col("rank") - F.col("from_rank")
    return (ranked.join(table, "length").where("rank >= from_rank and rank < to_rank")
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("sequence") + F.floor(inside / F.col("same"))).cast("long").alias("sequence_id"),
                    (F.col("at") + (inside % F.col("same")) * F.col("length")).cast("long").alias("offset")))
