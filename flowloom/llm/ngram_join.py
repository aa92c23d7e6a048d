"""N-gram Jaccard self join of documents by a forest of signature trees.

A document's set holds its distinct word shingles. Two documents link when ``100 * overlap >= percent * union``.
Documents with equal sets form one class, named by a number of its own, so copies are never paired and rows that share a
``doc_id`` may hold different texts. Only one text of each class goes on.

*Roots.* Shingles are dealt to ``K`` slices by hash. A linked pair differs in at most ``H`` shingles, and ``K`` is
greater than ``H``, so at least one slice holds the same shingles in both: classes that share a slice's content
stand under one root. ``K`` and ``H`` depend on a band of set sizes; a class whose size reaches into the next
band stands under roots of both. A class with so many empty slices that none of its equal slices need hold a shingle
stands under its empty slices too, so no pair is lost.

*First links.* Below a root, each class is compared with its neighbour in size order and with the class that meets most
others; of all its roots' proposals the two that share most roots are taken. Components of these links merge what is alike.

*Counts.* A linked pair shares most slices, so a class that shares too few of its roots with anybody is left out first. Of roots
with the same classes one is kept, with their number.

*Rarest roots.* A pair of two components shares all the roots it needs where components are mixed, so a class leaves as many of
its most crowded ones as it may lose without losing a link.

*Trees.* Roots that still hold more than one component get a tree: leaf nodes of some classes with their token bitmaps and sizes,
nodes above with OR-combined bitmaps, size ranges and component ranges. Pairs of nodes descend together, level by
level, through equi joins in one job; a pair is pruned if it lies in one component, its sizes can't meet, or its largest
possible overlap (common bits, plus the shingles of a class that share a bit) is too small. The same bound is taken
for each two classes of two leaf nodes. What is left is compared by cells (each shingle changes one cell of a class, so the cells that
differ are a lower bound of the shingles that differ), and then exactly. A root of one leaf node needs no join, and a root of
very many classes is ordered in pieces of ``PIECE``.

Null or empty text: an empty set, no link. Fewer words than a shingle: the whole sequence as one shingle. Repeated
rows: linked like any other equal texts. A row with null ``doc_id`` is returned with its size and, if nothing else is
equal to it, a null component. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, mapped, stars, stored
from .words import U, batch, mix, ragged, signed, text_slices, windows, words

LONGS = 16  # 64-bit numbers of a bitmap
LEAF, FANOUT = 64, 8  # classes of a leaf node, nodes below a node
GROWTH = 1.6  # of a band of sizes
PIECE = 100_000  # classes that one task orders


def _edges(top: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * GROWTH))))
    return np.array(edges)


_EDGES = _edges()


def _slices(level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For bands: the most shingles a linked pair differs in, and the number of slices."""
    most = (100 - percent) * 2 * (_EDGES[level + 1] - 1) // (100 + percent)
    return most, most + 1 + np.ceil(most * 0.05).astype(np.int64) + 2


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each distinct shingle, shingle), both sorted, for runs of rows."""
    for lo, hi, data, bounds in text_slices(texts):
        _, _, h, first = words(data, bounds, lower=True)
        count = np.diff(first)
        whole = np.maximum(count - k + 1, 0)
        row, place = ragged(whole)
        grams = windows(h, k)[first[:-1][row] + place] if len(row) else np.zeros(0, U)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            own = np.concatenate([windows(h[first[i]:first[i + 1]], int(count[i])) for i in short])
            row, grams = np.concatenate([row, short]), np.concatenate([grams, own])
        order = np.lexsort((grams, row))
        row, grams = row[order], grams[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
        yield lo, hi, row[keep], grams[keep]


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sum of 64-bit numbers by sorted row, modulo 2**64."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    edge = np.searchsorted(row, np.arange(rows + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _describe(k: int):
    """Size and two sums that tell sets apart."""
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for lo, hi, row, grams in shingle_sets(b.column(1), k):
                n = np.bincount(row, minlength=hi - lo)
                yield batch(["doc_id", "tag", "n_shingles", "set_a", "set_b"],
                            [ids.slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), n.astype(np.int64), *_tags(row, grams, hi - lo)])
    return run


def _tags(row: np.ndarray, grams: np.ndarray, rows: int) -> list[pa.Array]:
    return [signed(_sums(row, mix(grams, salt), rows)) for salt in (1, 2)]


def _own_sets(batches, k: int):
    """(class, row of each shingle, shingle, sizes) of texts (doc_id, text, cls, n_shingles, set_a, set_b) that hold their class's set."""
    for b in batches:
        for lo, hi, row, grams in shingle_sets(b.column(1), k):
            n = np.bincount(row, minlength=hi - lo)
            found = [pa.array(n.astype(np.int64)), *_tags(row, grams, hi - lo)]
            same = np.ones(hi - lo, bool)
            for want, have in zip((b.column(c).slice(lo, hi - lo) for c in (3, 4, 5)), found):
                same &= np.asarray(want) == np.asarray(have)
            mine = same[row]
            yield np.asarray(b.column(2).slice(lo, hi - lo))[same], (np.cumsum(same) - 1)[row[mine]], grams[mine], n[same]


def _slots(row: np.ndarray, grams: np.ndarray, n: np.ndarray, percent: int):
    """For a set's own band and the next: (sets that take part, band, slices, set of each slice in use, its number, its content,
    fewest slices in use that a linked pair shares)."""
    own = np.searchsorted(_EDGES, n, "right") - 1
    content, place = mix(grams, 3), mix(grams, 4)
    for up in (0, 1):
        takes = 100 * n >= percent * (n + 1)  # sets too small to differ by one shingle link with equal sets only
        if up:
            takes &= 100 * n >= percent * _EDGES[own + 1]
        level = np.where(takes, own + up, 0)
        _, slices = _slices(level, percent)
        mine = takes[row]
        r, c = row[mine], content[mine]
        part = (place[mine] % slices[r].astype(U)).astype(np.int64)
        order = np.lexsort((part, r))
        r, part, c = r[order], part[order], c[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        total = np.concatenate([np.zeros(1, U), np.cumsum(c, dtype=U)])
        size = np.diff(np.append(at, len(r)))
        held = total[at + size] - total[at] + size.astype(U)
        r, part = r[at], part[at]
        full = np.bincount(r, minlength=len(n))
        differ = (100 - percent) * (n + np.minimum(_EDGES[level + 1] - 1, 100 * n // percent)) // (100 + percent)
        lacks = full <= differ
        yield takes, level, slices, r, part, held, takes & lacks, np.where(lacks, 1, full - differ)


def _root_keys(k: int, percent: int):
    """(root, cls, size, fewest roots of the band that a link needs) for each root a class stands under; the lowest bit of a root is that of its band."""
    def run(batches):
        for ids, row, grams, n in _own_sets(batches, k):
            for _, level, slices, r, part, held, lacks, need in _slots(row, grams, n, percent):
                for i in np.flatnonzero(lacks):  # every equal slice may be an empty one
                    empty = np.setdiff1d(np.arange(slices[i]), part[r == i])
                    r, part = np.append(r, np.full(len(empty), i)), np.append(part, empty)
                    held = np.append(held, np.zeros(len(empty), U))
                key = mix(mix(held, 5) ^ mix(part.astype(U) * U(1 << 20) + level[r].astype(U), 6), 7)
                yield batch(["root", "cls", "n", "need"], [signed(key & ~U(1) | (level[r] & 1).astype(U)), ids[r], n[r].astype(np.int64), need[r].astype(np.int64)])
    return run


def _with_sets(k: int):
    """Shingles as bytes, their cells, the bitmap, and the number of shingles that share a bit with another."""
    def run(batches):
        for ids, row, grams, n in _own_sets(batches, k):
            bits = np.zeros((len(ids), LONGS * 64), bool)
            bits[row, (mix(grams, 8) % U(LONGS * 64)).astype(np.int64)] = True
            packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            edge = np.cumsum(n) - n
            raw = [grams[edge[i]:edge[i] + n[i]].tobytes() for i in range(len(ids))]
            cells = [_cells(grams[edge[i]:edge[i] + n[i]]) for i in range(len(ids))]
            yield batch(["cls", "shingles", "cells", "n", "excess", *(f"b{i}" for i in range(LONGS))],
                        [ids, pa.array(raw, pa.binary()), pa.array(cells, pa.binary()), n.astype(np.int64), n - bits.sum(1), *(np.ascontiguousarray(packed[:, i]) for i in range(LONGS))])
    return run


def _linked(percent: int):
    def run(batches):
        for b in batches:
            left, right = b.column(2), b.column(3)
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), U), np.frombuffer(right[i].as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield b.select(["a", "b"]).filter(pa.array(keep))
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")  # only sets of pairs are shuffled
    right = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return stored(mapped(left.join(right, ["a", "b"]).select("a", "b", "x", "y"), _linked(percent), "a long, b long"))


def _cells(grams: np.ndarray) -> bytes:
    """Cells of 4 bits, a power of two of them (2 at least and less than the shingles if there are more): each holds the sum of its shingles modulo 2."""
    size = 1 << max(1, (len(grams) - 1).bit_length() - 1)
    h = mix(grams, 9)
    place, value = (h % U(size)).astype(np.int64), (h >> U(60)).astype(np.int64)
    bits = sum((np.bincount(place, value >> i & 1, size).astype(np.int64) & 1) << i for i in range(4))
    return (bits[::2] | bits[1::2] << 4).astype(np.uint8).tobytes()


def _differing(x: np.ndarray, y: np.ndarray) -> int:
    """Cells that differ, after the larger side is folded to the smaller one's number."""
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    z = x ^ y
    return int(np.count_nonzero(z & 15) + np.count_nonzero(z >> 4))


def _near(percent: int):
    def run(batches):
        for b in batches:
            sizes = np.asarray(b.column(4)) + np.asarray(b.column(5))
            left, right = b.column(2), b.column(3)
            least = np.array([_differing(np.frombuffer(left[i].as_buffer(), np.uint8), np.frombuffer(right[i].as_buffer(), np.uint8))
                              for i in range(b.num_rows)], np.int64)
            yield b.select(["a", "b"]).filter(pa.array((100 + percent) * (sizes - least) >= 2 * percent * sizes))
    return run


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose cells differ in no more places than a linked pair's shingles."""
    left = sets.select(F.col("cls").alias("a"), F.col("cells").alias("x"), F.col("n").alias("x_n"))
    right = sets.select(F.col("cls").alias("b"), F.col("cells").alias("y"), F.col("n").alias("y_n"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "x_n", "y_n")
    return stored(mapped(met, _near(percent), "a long, b long"))


def _leaf_pairs(percent: int):
    """Pairs of classes of two leaf nodes (or of one, if a row has one), in different components, whose largest possible overlap suffices."""
    def side(b, at, i):
        ids, n, component, excess = (np.asarray(b.column(at + j)[i].values) for j in range(4))
        return ids, n, component, excess, np.column_stack([np.asarray(b.column(at + 4 + j)[i].values) for j in range(LONGS)]).view(U)

    def run(batches):
        for b in batches:
            found = []
            for i in range(b.num_rows):
                xi, xn, xc, xe, xb = side(b, 0, i)
                yi, yn, yc, ye, yb = side(b, 4 + LONGS, i) if b.num_columns > 4 + LONGS else (xi, xn, xc, xe, xb)
                met = (xc[:, None] != yc) & (xi[:, None] != yi) & (100 * xn[:, None] >= percent * yn) & (100 * yn >= percent * xn[:, None])
                p, q = np.nonzero(met)
                common = np.bitwise_count(xb[p] & yb[q]).sum(1).astype(np.int64)
                most = np.minimum(common + np.minimum(xe[p], ye[q]), np.minimum(xn[p], yn[q]))
                keep = (100 + percent) * most >= percent * (xn[p] + yn[q])
                if keep.any():
                    x, y = xi[p[keep]], yi[q[keep]]
                    found.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield batch(["a", "b"], [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])])
    return run


def _met_pairs(percent: int, held: list[str]):
    """``_leaf_pairs`` of the pairs (xs, ys) of leaf nodes that a table of such nodes holds."""
    def run(table):
        place = {node: i for i, node in enumerate(table.column("node").to_pylist())}
        own = table.select(held).combine_chunks()
        x, y = (pa.array([place[node] for node in table.column(c)[0].as_py()], pa.int64()) for c in ("xs", "ys"))
        both = [*own.take(x).columns, *own.take(y).columns]
        rows = pa.Table.from_arrays(both, [f"c{i}" for i in range(len(both))]).combine_chunks().to_batches()
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        return pa.Table.from_batches([b.cast(schema) for b in _leaf_pairs(percent)(rows)], schema)
    return run


def _descend(leaves: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that no node rules out; ``leaves`` has root, m, cls, n, component, excess and the bitmap.

    A leaf node holds up to ``LEAF`` classes, neighbours by component and size; nodes above hold ``FANOUT`` nodes.
    """
    bits = [f"b{i}" for i in range(LONGS)]
    held = ["cls", "n", "component", "excess", *bits]
    alone = mapped(leaves.where(F.col("m") <= LEAF).groupBy("root").agg(*(F.collect_list(c).alias(c) for c in held)).drop("root"),
                   _leaf_pairs(percent), "a long, b long")
    piece = _piece("cls")
    rank = F.row_number().over(Window.partitionBy("root", "piece").orderBy("component", "n", "cls")) - 1
    placed = leaves.where(F.col("m") > LEAF).withColumn("piece", piece).select(
        "root", (F.col("piece") * PIECE * 4 + F.floor(rank / LEAF)).alias("node"), *held)
    blocks = stored(placed.groupBy("root", "node").agg(
        *(F.collect_list(c).alias(c) for c in held), F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("c_low"),
        F.max("component").alias("c_high"), F.max("excess").alias("e"), *(F.bit_or(c).alias("o" + c) for c in bits)))
    about = ["low", "high", "c_low", "c_high", "e", *("o" + c for c in bits)]
    level, largest = 0, blocks.agg(F.max("node")).first()[0]
    while largest:
        largest //= FANOUT
        level += 1
    # the nodes of all levels in one table: level 0 are the leaf nodes
    own = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.floor(F.col("node") / FANOUT ** i).alias("node")) for i in range(level + 1))))
    nodes = stored(blocks.select("root", own.alias("own"), *about).groupBy("root", "own.level", "own.node").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("c_low").alias("c_low"), F.max("c_high").alias("c_high"),
        F.max("e").alias("e"), *(F.bit_or("o" + c).alias("o" + c) for c in bits)))
    pairs = nodes.where(F.col("level") == level).select("root", F.col("node").alias("x"), F.col("node").alias("y"))
    for at in range(level - 1, -1, -1):
        def side(mark):
            return nodes.where(F.col("level") == at).select("root", F.floor(F.col("node") / FANOUT).alias(mark), F.col("node").alias(mark + "n"),
                                    *(F.col(c).alias(f"{mark}_{c}") for c in about))
        met = pairs.join(side("x"), ["root", "x"]).join(side("y"), ["root", "y"]).where("xn <= yn")
        met = met.where("not (x_c_low = x_c_high and y_c_low = y_c_high and x_c_low = y_c_low)")
        met = met.where(f"100 * x_high >= {percent} * y_low and 100 * y_high >= {percent} * x_low")
        common = sum((F.bit_count(F.col("x_o" + c).bitwiseAND(F.col("y_o" + c))) for c in bits[1:]),
                     F.bit_count(F.col("x_ob0").bitwiseAND(F.col("y_ob0"))))
        most = F.least(common + F.least("x_e", "y_e"), "x_high", "y_high")
        met = met.where((100 + percent) * most >= percent * (F.col("x_low") + F.col("y_low")))
        pairs = met.select("root", F.col("xn").alias("x"), F.col("yn").alias("y"))
    pairs = stored(pairs)
    # pairs of leaf nodes meet by the nodes above them: a leaf node is sent once for the pairs of two such nodes, not for each pair,
    # and the nodes of a crowded root are dealt to all tasks
    above = pairs.select("root", F.floor(F.col("x") / FANOUT).alias("up_x"), F.floor(F.col("y") / FANOUT).alias("up_y"), "x", "y")
    asked = above.groupBy("root", "up_x", "up_y").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    sent = asked.select("root", "up_x", "up_y", F.explode(F.array_distinct(F.concat("xs", "ys"))).alias("node"))
    met = sent.join(blocks.select("root", "node", *held), ["root", "node"]).join(asked, ["root", "up_x", "up_y"])
    met = met.groupBy("root", "up_x", "up_y").applyInArrow(_met_pairs(percent, held), "a long, b long")
    found = stored(met.union(alone).distinct())
    discard(blocks, nodes, pairs)
    return found


def _piece(name: str):
    """A number for the part of a root of ``m`` classes that one task orders."""
    return F.pmod(F.xxhash64(name), F.ceil(F.col("m") / PIECE)).cast("long")


def _crowded(members: DataFrame) -> DataFrame:
    """``members`` with ``m``, the classes of their root, where that is above 1."""
    return members.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("root"))).where("m > 1")


def _enough(members: DataFrame) -> DataFrame:
    """The rows of classes that share as many roots of a band with anybody as a link ``need``s."""
    has = F.count(F.lit(1)).over(Window.partitionBy("cls", "odd"))
    return members.withColumn("odd", _odd()).withColumn("has", has).where("has >= need").drop("odd", "has")


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of roots that hold more than one component."""
    root = Window.partitionBy("root")
    return members.withColumns({"lo": F.min("component").over(root), "hi": F.max("component").over(root)}).where("lo <> hi").drop("lo", "hi")


def _rarest(members: DataFrame, needs: DataFrame | None = None) -> DataFrame:
    """(root, cls, component) without the most crowded roots of each class in a band, as many as it may lose.

    A linked pair of two components shares at least the ``need`` of either class in roots that hold both, so in one order of all
    roots the first they share comes before the last ``need - 1`` of either. ``members`` has root, cls, m, times, component and
    ``need``, unless ``needs`` (cls, odd, need) has that.
    """
    crowd = Window.partitionBy("cls", "odd").orderBy(F.desc("m"), F.desc("root")).rowsBetween(Window.unboundedPreceding, 0)
    placed = _mixed(members).withColumn("odd", _odd()).withColumn("crowded", F.sum("times").over(crowd))
    if needs is not None:
        placed = placed.join(needs, ["cls", "odd"])
    return placed.where("crowded >= need").select("root", "cls", "component")


def _odd():
    return F.col("root").bitwiseAND(F.lit(1)).cast("int").alias("odd")


def ngram_jaccard_join(docs: DataFrame, percent: int = 80, words_in_shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies, tag, component): one row for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable by links, ``n_copies`` the rows with an equal set, ``tag`` the hash of the text.
    ``component`` tells components apart whose smallest ``doc_id`` is the same; it is null for an empty set.
    """
    k = words_in_shingle
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    sizes = stored(mapped(tagged, _describe(k), "doc_id long, tag long, n_shingles long, set_a long, set_b long"))
    same = ["n_shingles", "set_a", "set_b"]
    rows = sizes.where("n_shingles > 0").groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("c"))
    classes = rows.groupBy(*same).agg(F.min_by(F.struct("doc_id", "c"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("own"),
                                      F.sum("c").alias("n_copies"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cls"), *same, F.col("own.doc_id").alias("rep"), F.col("own.c").alias("c"), "n_copies"))

    def texts(wanted: DataFrame) -> DataFrame:
        """A text for each class; rows that repeat id and text are told by their count, and only those may come twice."""
        return docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "cls", *same, "c")

    linkable = classes.where("rep is not null")  # a text without any id has no place in a component
    repeated = not linkable.where("c > 1").isEmpty()

    def of_texts(wanted: DataFrame, fn, schema: str, key: list[str]) -> DataFrame:
        dealt = texts(wanted)
        once = mapped(dealt.where("c = 1"), fn, schema)
        return once.union(mapped(dealt.where("c > 1"), fn, schema).dropDuplicates(key)) if repeated else once

    rooted = of_texts(linkable, _root_keys(k, percent), "root long, cls long, n long, need long", ["root", "cls"])
    order, root = Window.partitionBy("root").orderBy("cls"), Window.partitionBy("root")
    beside = (rooted.select("*", F.lag("cls").over(order).alias("p"), F.lead("cls").over(order).alias("q"))
              .where("p <> cls or q <> cls").select("root", "cls", "n", "need").distinct())
    # equal slices of a linked pair are many: a class that shares too few of a band's roots links with nobody there
    enough = _crowded(_enough(_crowded(beside)))
    # of a parity's roots with the same classes one stays, with their number
    signs = {name: F.sum(F.xxhash64("cls", *salt) % (1 << 40)).over(root) for name, salt in (("s", []), ("t", [F.lit(7)]))}
    enough = stored(enough.withColumns(signs))
    kept = enough.groupBy(_odd(), "m", "s", "t").agg(F.min("root").alias("root"), F.expr("count(1) div m").alias("times")).select("root", "times")
    members = stored(enough.drop("s", "t").join(kept, "root"))
    discard(enough)

    bits = ", ".join(f"b{i} long" for i in range(LONGS))
    wanted = linkable.join(members.select("cls").distinct(), "cls", "left_semi")
    schema = f"cls long, shingles binary, cells binary, n long, excess long, {bits}"
    sets = stored(of_texts(wanted, _with_sets(k), schema, ["cls"]))

    # first links: with the neighbour in size order, and with the class of the root (of its piece) that meets most others under its roots
    piece = Window.partitionBy("root", "piece")
    weighed = members.withColumn("weight", F.sum(F.col("m") * F.col("times")).over(Window.partitionBy("cls"))).withColumn("piece", _piece("cls"))
    beside = weighed.select("cls", "times", F.lag("cls").over(piece.orderBy("n", "cls")).alias("before"), F.max(F.struct("weight", "cls")).over(piece).alias("hub"))
    near = (beside.select("cls", "times", F.explode(F.array("before", "hub.cls")).alias("other")).where("other <> cls")
            .repartition("cls").groupBy("cls", "other").agg(F.sum("times").alias("shared")))
    best = near.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "other")), False), 1, 2).alias("best"))
    best = best.select("cls", F.explode("best.other").alias("other"))
    pairs = best.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).repartition("a").distinct()
    likely = _possible(pairs, sets, percent)
    first = _verified(likely, sets, percent)
    merged = stars(first)

    left = members.drop("n").join(merged.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    leaves = stored(_crowded(_mixed(_rarest(left))).join(sets.drop("shingles", "cells"), "cls"))
    found = _descend(leaves, percent)
    near = _possible(found, sets, percent)
    second = _verified(near, sets, percent)
    groups = stars(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second))
    named = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = F.min("rep").over(Window.partitionBy("component"))  # the smallest id of all classes of a component
    final = stored(named.select(*same, "component", least.alias("component_id"), "n_copies"))
    discard(classes, members, sets, likely, leaves, found, near, first, second, merged, groups)
    return (sizes.join(final, same, "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "tag", "component"))
