"""Blocks of near points, their boxes, and the block pairs that can matter.

Groups are cut at medians of their widest attribute, level by level in Spark, until no block holds more than the given
number of points. A block is named by its path in this tree (root 1, children 2p and 2p + 1), so ancestors are shifts
of the name and need no table of their own. Searches walk the tree from the root with equi joins on (group, parent):
``reach`` finds a distance within which every point of a query block has enough weight, ``near_pairs`` the reference
blocks whose box is not farther than that. Only boxes and names move; points join at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...session import freeze
from .blocks import BLOCK_ROWS, spread

SLACK = 1.0 + 1e-9  # for the last bits of distances computed in different orders
MAX_LEVELS = 60


def cut_blocks(points: DataFrame, keys: list[str], rows: int = BLOCK_ROWS, by: str = "attrs") -> DataFrame:
    """``points`` with ``block``, cut along the arrays ``by``; no block holds more than ``rows`` rows unless its points are equal there."""
    width = points.agg(F.max(F.size(by))).first()[0] or 0
    cut = points.withColumn("block", F.lit(1).cast("long"))
    if not width:
        return cut
    for _ in range(MAX_LEVELS):
        at = [F.col(by)[i] for i in range(width)]
        sides = cut.groupBy(*keys, "block").agg(
            F.count(F.lit(1)).alias("_n"),
            *[f(a).alias(f"_{name}{i}") for i, a in enumerate(at) for name, f in (("lo", F.min), ("hi", F.max))],
            *[F.percentile_approx(a, 0.5, 200).alias(f"_m{i}") for i, a in enumerate(at)]).filter(F.col("_n") > rows)
        widest = F.array_max(F.array(*[F.struct((F.col(f"_hi{i}") - F.col(f"_lo{i}")).alias("w"), F.lit(i).alias("dim")) for i in range(width)]))
        sides = sides.withColumn("_dim", widest["dim"]).filter(widest["w"] > 0)

        def of(name):
            return F.element_at(F.array(*[F.col(f"_{name}{i}") for i in range(width)]), F.col("_dim") + 1)
        middle = (of("lo") + of("hi")) / 2
        value = F.when(of("m") < of("hi"), of("m")).when((middle >= of("lo")) & (middle < of("hi")), middle).otherwise(of("lo"))
        sides = freeze(sides.select(*keys, "block", "_dim", value.alias("_cut")))
        if sides.isEmpty():
            return cut
        right = F.element_at(by, F.col("_dim") + 1) > F.col("_cut")
        name = F.when(F.col("_dim").isNull(), F.col("block")).otherwise(F.col("block") * 2 + right.cast("long"))
        cut = freeze(cut.join(sides, [*keys, "block"], "left").withColumn("block", name).drop("_dim", "_cut"))
    return cut


def pack_cut(points: DataFrame, keys: list[str], rows: int = BLOCK_ROWS, by: str = "attrs") -> DataFrame:
    """``(keys, block, n, xs, ws, points, lo, hi)`` of points with weight ``w``: ``xs`` are the arrays ``by``, ``points`` the ``attrs``."""
    cut = cut_blocks(points, keys, rows, by)
    size = points.groupBy(*keys).agg(F.sum("w").alias("n"))
    width = points.agg(F.max(F.size(by))).first()[0] or 0
    entry = F.struct("attrs", "w") if by == "attrs" else F.struct("attrs", "w", by)
    packed = spread(cut, *keys, "block").groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(entry)).alias("_p"),
        F.array(*[F.min(F.col(by)[i]) for i in range(width)]).alias("lo"), F.array(*[F.max(F.col(by)[i]) for i in range(width)]).alias("hi"))
    return packed.join(size, keys).select(
        *keys, "block", "n", F.flatten(F.col("_p")[by]).alias("xs"), F.transform("_p.w", lambda w: w.cast("double")).alias("ws"),
        F.col("_p.attrs").alias("points"), "lo", "hi")


def tree(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, parent, leaf, weight, r_lo, r_hi)``: the blocks and their ancestors."""
    width = blocks.agg(F.max(F.size("lo"))).first()[0] or 0
    depth = F.floor(F.log2(F.col("block").cast("double") + 0.5)).cast("int")
    each = blocks.select(*keys, "block", "lo", "hi", F.aggregate("ws", F.lit(0.0), lambda a, w: a + w).alias("_w"),
                         F.explode(F.sequence(F.lit(0), depth)).alias("_up"))
    each = each.withColumn("node", F.call_function("shiftright", F.col("block"), F.col("_up")))
    return freeze(each.groupBy(*keys, "node").agg(
        F.sum("_w").alias("weight"), F.max(F.col("_up") == 0).alias("leaf"),
        F.array(*[F.min(F.col("lo")[i]) for i in range(width)]).alias("r_lo"),
        F.array(*[F.max(F.col("hi")[i]) for i in range(width)]).alias("r_hi")).withColumn("parent", F.shiftright("node", 1)))


def _zip3(a, b, c, d, f) -> Column:
    """Sum over attributes of a function of four bounds."""
    parts = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), F.col(d).alias("d"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + f(x["a"], x["b"], x["c"], x["d"]))


def least_square() -> Column:
    """Squared distance of the boxes (lo, hi) and (r_lo, r_hi): no two of their points are nearer."""
    def gap(lo, hi, r_lo, r_hi):
        wide = F.greatest(lo - r_hi, r_lo - hi, F.lit(0.0))
        return wide * wide
    return _zip3("lo", "hi", "r_lo", "r_hi", gap)


def most_square() -> Column:
    """Squared largest distance of points of the two boxes."""
    def across(lo, hi, r_lo, r_hi):
        wide = F.greatest(hi - r_lo, r_hi - lo)
        return wide * wide
    return _zip3("lo", "hi", "r_lo", "r_hi", across)


def descend(queries: DataFrame, nodes: DataFrame, keys: list[str], value: Column, fits: Column) -> DataFrame:
    """``(keys, block, best)``: the largest ``value`` of a node met on the way down, by the best child that ``fits`` at each level."""
    about = queries.columns
    here = queries.join(nodes.filter("node = 1"), keys).filter(fits).select(*about, "node", value.alias("best"))
    found = here = freeze(here)
    while True:
        down = here.drop("best").withColumnRenamed("node", "parent").join(nodes, [*keys, "parent"]).filter(fits)
        down = down.select(*about, "node", value.alias("best"))
        ahead = down.groupBy(*keys, "block").agg(F.max_by(F.struct(*[c for c in down.columns if c not in (*keys, "block")]), F.struct("best", "node")).alias("_x"))
        here = freeze(ahead.select(*keys, "block", "_x.*").select(*down.columns))
        if here.isEmpty():
            return freeze(found.groupBy(*keys, "block").agg(F.max("best").alias("best")))
        found = found.unionByName(here)


def reach(queries: DataFrame, nodes: DataFrame, keys: list[str], need: str) -> DataFrame:
    """``(keys, block, reach2)``: squared distance within which each point of the block has references of weight ``need``."""
    found = descend(queries.select(*keys, "block", "lo", "hi", need), nodes, keys, -most_square(), F.col("weight") >= F.col(need))
    return found.select(*keys, "block", (-F.col("best")).alias("reach2"))


def near_pairs(queries: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, block, r_block)``: reference blocks whose box is within the squared distance ``reach2`` of the query block."""
    about = [*keys, "block", "lo", "hi", "reach2"]
    near = least_square() <= F.col("reach2") * SLACK
    here = freeze(queries.select(*about).join(nodes.filter("node = 1"), keys).filter(near).select(*about, "node", "leaf"))
    found = None
    while True:
        ended = here.filter("leaf").select(*keys, "block", F.col("node").alias("r_block"))
        found = ended if found is None else found.unionByName(ended)
        down = here.filter("not leaf").drop("leaf").withColumnRenamed("node", "parent").join(nodes, [*keys, "parent"]).filter(near)
        here = freeze(down.select(*about, "node", "leaf"))
        if here.isEmpty():
            return freeze(found)
