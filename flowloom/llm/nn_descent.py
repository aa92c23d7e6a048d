"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries search it greedily.

Vectors take part if they are not null, have the usual length (the most frequent one), only finite components, and are not
zero. Equal vectors are one node; a node keeps its ``top + 1`` smallest ids, which is all that a result can show of it, so copies
neither crowd lists nor get lost.

*Codes.* Components are rounded to 16 bits of the vector's own largest one, which goes along as a double, so a long vector costs
the others no precision. Codes serve the graph and the search. Results are ranked by the exact product of the original vectors.

*Start.* Random hyperplanes cut the nodes into cells, several times; cells are cut on by order of one projection, so none is
larger than ``cell`` whatever the data. Nodes of a cell propose each other.

*NN-descent.* Each round lists a node's neighbours and the nodes that have it as a neighbour (in parts of about ``k``, each
with the neighbours: reverse lists of hubs are long), joins their codes, and proposes to each other all pairs that have not met:
neighbours of neighbours. The best ``k`` of old and proposed ones stay. Rounds end when few lists change.

*Search.* A query starts at its own node and keeps a pool of the best ``pool`` nodes found; each round it opens the best unopened
ones through a join with the graph, until all of the pool are open.

Null ids are skipped. Repeated rows with one id count once. Other columns are ignored. Fewer candidates than ``top``: all that
exist. An empty table gives an empty result. Every vector is indexed; the sample-free graph covers all nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mapped, stored
from .words import batch

SEED = 5


def _layout(dim: int) -> np.dtype:
    return np.dtype([("scale", "<f8"), ("whole", "<i2", (dim,))])


def _code(vectors: DataFrame, dim: int, largest: float) -> DataFrame:
    """(id, code): a scale and 16-bit numbers as bytes; with ``largest``, the largest component of all, no length is above 1."""
    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            own = np.abs(x).max(axis=1, initial=0)
            code = np.zeros(len(x), _layout(dim))
            code["scale"] = own / largest / np.sqrt(dim)
            code["whole"] = np.round(x / own[:, None] * 32000)
            yield batch(["id", "code"], [b.column(0), pa.array([r.tobytes() for r in code], pa.binary())])
    return mapped(vectors.select("id", "embedding"), run, "id long, code binary")


def _floats(codes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes as numbers of at most 1, and the scale of each row."""
    code = np.frombuffer(b"".join(codes), _layout(dim))
    return code["whole"].astype(np.float32) / 32000, code["scale"]


def _cells(dim: int, trees: int, bits: int):
    """(tree, cell, side, id, code): the side of each hyperplane, and the order within a cell."""
    def run(batches):
        rng = np.random.default_rng(SEED)
        planes = rng.standard_normal((dim, trees * (bits + 1))).astype(np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            x, scale = _floats(b.column(1).to_pylist(), dim)
            side = x @ planes
            for t in range(trees):
                own = side[:, t * (bits + 1):(t + 1) * (bits + 1)]
                cell = (own[:, :bits] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(own), np.int64)
                yield batch(["tree", "cell", "side", "id", "code"], [np.full(len(own), t, np.int32), cell.astype(np.int64),
                                                                     own[:, bits] * scale, b.column(0), b.column(1)])
    return run


def _best(a: np.ndarray, b: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct proposals of each node."""
    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, score = a[keep], b[keep], score[keep]
    if not len(a):
        return a, b, score
    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    return a[rank < k], b[rank < k], score[rank < k]


def _pairs(k: int, ids: np.ndarray, x: np.ndarray, scale: np.ndarray, new: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proposals (a, b, score) of one list: the k best of each node, and those that tie with the last of them."""
    score = x @ x.T * scale[:, None] * scale
    ok = (score > least[:, None]) & (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :])
    if len(ids) > k and np.count_nonzero(ok) > k:
        known = np.where(ok, score, -np.inf)
        ok &= known >= np.partition(known, -k, axis=1)[:, -k, None]
    i, j = np.nonzero(ok)
    return ids[i], ids[j], score[i, j]


def _propose(dim: int, k: int, limit: int = 1 << 20):
    """Pairs within each list: a proposal goes to the side whose list it would enter.

    Rows are (first, id, code, new, least); lists follow each other, each begins with a row that is ``first``. About ``limit``
    pairs are held at once, however many lists a task has.
    """
    def run(batches):
        held, size, rest = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            first, new = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            items = [first, b.column(1).to_numpy(), *_floats(b.column(2).to_pylist(), dim), new, b.column(4).to_numpy()]
            if rest is not None:
                items = [np.concatenate(x) for x in zip(rest, items)]
            begin = np.flatnonzero(items[0])
            for i, j in zip(begin[:-1], begin[1:]):
                held.append(_pairs(k, *(x[i:j] for x in items[1:])))
                size += len(held[-1][0])
                if size >= limit:
                    best = _best(*(np.concatenate(x) for x in zip(*held)), k)
                    held, size = [best], len(best[0])
                    if size >= limit // 2:
                        yield batch(["a", "b", "score"], best)
                        held, size = [], 0
            rest = [x[begin[-1]:].copy() for x in items]
        if rest is not None:
            held.append(_pairs(k, *rest[1:]))
            yield batch(["a", "b", "score"], _best(*(np.concatenate(x) for x in zip(*held)), k))
    return run


def _top(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, score, new): the best k of each node; an edge that was there before is not new."""
    one = edges.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    lists = one.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "b", "new")), False), 1, k).alias("list"))
    return lists.select("a", F.explode("list").alias("x")).select("a", "x.b", "x.score", "x.new")


def neighbour_graph(nodes: DataFrame, n: int, dim: int, k: int = 24, trees: int = 12, cell: int = 192, rounds: int = 8,
                    settled: float = 0.02) -> DataFrame:
    """(a, b, score): about the k best neighbours b of each node a of ``nodes(id, code)``."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / cell))))
    place = F.row_number().over(Window.partitionBy("tree", "cell").orderBy("side", "id")) - 1
    cells = mapped(nodes, _cells(dim, trees, bits), "tree int, cell long, side double, id long, code binary").withColumn("first", place % cell == 0)
    cells = cells.sortWithinPartitions("tree", "cell", "side", "id").select("first", "id", "code", F.lit(True).alias("new"), F.lit(-2.0).alias("least"))
    proposals = mapped(cells, _propose(dim, k), "a long, b long, score double")
    graph = stored(_top(proposals.withColumn("new", F.lit(1)), k))
    for _ in range(rounds):
        degree = graph.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
        parts = F.ceil(F.col("degree") / k)
        back = graph.join(degree, "b").select(F.col("b").alias("at"), F.pmod(F.xxhash64("a", "b"), parts).alias("part"), F.col("a").alias("id"), "new")
        ahead = graph.join(degree.withColumnRenamed("b", "a"), "a", "left").select(
            F.col("a").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1)).cast("long") - 1)).alias("part"), F.col("b").alias("id"), "new")
        lists = ahead.union(back).groupBy("at", "part", "id").agg(F.max("new").alias("new"))
        busy = lists.where("new = 1").select("at", "part").distinct()
        least = graph.groupBy("a").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("have"))
        known = nodes.join(least.withColumnRenamed("a", "id"), "id", "left").select(
            "id", "code", F.when(F.col("have") >= k, F.col("least")).otherwise(-2.0).alias("least"))
        lists = lists.join(busy, ["at", "part"]).join(known, "id").withColumn("first", F.row_number().over(Window.partitionBy("at", "part").orderBy("id")) == 1)
        lists = lists.sortWithinPartitions("at", "part", "id").select("first", "id", "code", F.col("new") == 1, "least")
        proposals = mapped(lists, _propose(dim, k), "a long, b long, score double")
        graph = stored(_top(proposals.withColumn("new", F.lit(1)).union(graph.withColumn("new", F.lit(0))), k))
        changed = graph.where("new = 1").count()
        if changed <= settled * n * k:
            break
    return graph.select("a", "b", "score")


def _open(dim: int):
    """Scores of the neighbours of an opened node for a query."""
    def run(batches):
        for b in batches:
            q, ids, scores = [], [], []
            for i in range(b.num_rows):
                own = b.column(2)[i].values
                x, scale = _floats(b.column(3)[i].as_py(), dim)
                y, own_scale = _floats([b.column(1)[i].as_py()], dim)
                q.append(b.column(0)[i].as_py())
                ids.append(own)
                scores.append(x @ y[0] * scale * own_scale)
            if q:
                size = [len(x) for x in ids]
                yield batch(["q", "id", "score"], [pa.array(np.repeat(q, size), pa.int64()), pa.concat_arrays(ids), np.concatenate(scores)])
    return run


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, dim: int, pool: int = 128, width: int = 16, rounds: int = 24) -> DataFrame:
    """(q, id, score): the pool of each query of ``queries(q, entry, code)``, which starts at the node ``entry``.

    Each round opens up to ``width`` nodes of a pool; with the pool's size this bounds a query's work, not its reach.
    """
    packed = stored(graph.join(nodes.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.collect_list(F.struct("b", "code")).alias("x"))
                    .select(F.col("a").alias("node"), F.transform("x", lambda y: y["b"]).alias("ids"), F.transform("x", lambda y: y["code"]).alias("codes")))
    queries = stored(queries)
    pools = queries.select("q", F.col("entry").alias("id"), F.lit(9.0).alias("score"), F.lit(0).alias("open"))
    for _ in range(rounds):
        order = Window.partitionBy("q").orderBy("open", F.desc("score"), "id")
        front = pools.where("open = 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= width).select("q", "id")
        front = stored(front)
        if not front.take(1):
            break
        asked = front.join(queries.select("q", "code"), "q").withColumnRenamed("id", "node").join(packed, "node").select("q", "code", "ids", "codes")
        found = mapped(asked, _open(dim), "q long, id long, score double").withColumn("open", F.lit(0))
        was = pools.join(front.withColumn("now", F.lit(1)), ["q", "id"], "left").select("q", "id", "score", F.greatest("open", F.coalesce("now", F.lit(0))).alias("open"))
        one = was.union(found).groupBy("q", "id").agg(F.max("score").alias("score"), F.max("open").alias("open"))
        best = one.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id", "open")), False), 1, pool).alias("list"))
        pools = stored(best.select("q", F.explode("list").alias("x")).select("q", "x.id", "x.score", "x.open"))
    return pools.select("q", "id", "score")


def _smallest(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n smallest values of each group, found in salted parts first."""
    part = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(64)))
    for group in ([*keys, "_salt"], keys):
        part = part.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(value))).where(F.col("_n") <= n)
    return part.drop("_n", "_salt")


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, k: int = 24, pool: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["n"]
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    # -0.0 and 0.0 are one number
    rows = rows.where(F.size("embedding") == dim).where(sound & nonzero).dropDuplicates(["vec_id"]).withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))
    reps = rows.groupBy("embedding").agg(F.min("vec_id").alias("id"))
    reps = stored(reps.select("id", "embedding", F.array_max(F.transform("embedding", F.abs)).alias("largest")))
    members = stored(rows.join(reps.select("id", "embedding"), "embedding").select("id", "vec_id"))
    n, largest = reps.agg(F.count(F.lit(1)), F.max("largest")).first()
    if not n:
        return spark.createDataFrame([], schema)
    nodes = stored(_code(reps, dim, largest))
    graph = neighbour_graph(nodes, n, dim, k)
    asked = members.where(F.col("vec_id") % every == 0)
    queries = nodes.join(asked.select("id").distinct(), "id").select(F.col("id").alias("q"), F.col("id").alias("entry"), "code")
    found = greedy_search(queries, nodes, graph, dim, pool)
    near = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= 3 * top + 1).select("q", "id")
    exact = found.join(reps.select("id", F.col("embedding").alias("y")), "id").join(reps.select(F.col("id").alias("q"), F.col("embedding").alias("x")), "q")
    exact = exact.select("q", "id", F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("score"))
    shown = _smallest(members, ["id"], "vec_id", top + 1)
    rows = exact.join(shown, "id").select("q", "vec_id", "score")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).select("q", "vec_id", "score")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    # a query sees its node's list without itself; one that is far down its own list misses nothing by the extra row
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(rows, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
