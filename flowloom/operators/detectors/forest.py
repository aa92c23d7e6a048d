"""Isolation forest per state, grown level by level for all trees of all states at once.

One level is one grouped aggregation (size and range of every open node) and one
join that sends each sampled visit to its child. No tree and no state has to fit
in a task. Random choices are hashes of (seed, model, state, tree, node), so a
run can be repeated.

``detect_forest`` grows and scores at once. States of up to ``WHOLE`` visits meet their test points in buckets, where
a tree of all states of the bucket is grown and walked as arrays: a visit moves once, and neither trees nor nodes
move at all. Larger states are grown level by level. Both ways give the same scores.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ...functions.scan import OrderedScan
from ...session import freeze, ship
from .stats import MIN_VISITS, STATE, thin_state

TREES = 100
THRESHOLD = 0.5
_NODE = [*STATE, "tree", "node"]
_EULER = 0.5772156649015329
WHOLE = 1 << 17  # visits of a state that are grown in one task
BUCKET_ROWS = 100_000  # visits and test points that meet in a bucket, about


def _uniform(seed: int, *parts: Column) -> Column:
    """Number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among ``n`` points."""
    long = 2 * (F.log(n - 1) + _EULER) - 2 * (n - 1) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(long)


def sample_visits(visits: DataFrame, order: list[str], trees: int, share: float, seed: int) -> DataFrame:
    """``ceil(share * n)`` visits per state and tree.

    Visits are put in a hashed circular order once; a tree takes one arc of it
    from a hashed starting point, so every sample has exactly the wanted size.
    """
    sizes = visits.groupBy(*STATE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MIN_VISITS)
    mixed = visits.withColumn("_mix", F.xxhash64(F.lit(seed), *order))
    ranked = OrderedScan(mixed, STATE, ["_mix", *order]).index("_place").result()
    joined = ranked.select(*STATE, "_place", "attrs").join(sizes, STATE)
    spread = joined.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    take = F.ceil(F.lit(share) * F.col("n"))
    start = F.floor(_uniform(seed + 1, *STATE, F.col("tree")) * F.col("n"))
    return spread.filter(F.pmod(F.col("_place") - start, F.col("n")) < take).select(
        *STATE, "tree", take.alias("m"), "attrs"
    )


def fit_forest(
    visits: DataFrame, width: int, order: list[str], trees: int = TREES, share: float = 0.3, seed: int = 7
) -> DataFrame:
    """Nodes ``(model_id, state, tree, node, attr, split, size, m)``; leaves have no ``attr``.

    The root is node 1, the children of node i are 2i and 2i + 1. A tree stops at
    depth ``ceil(log2(m))``, at one visit, or where all attributes are constant.
    """
    rows = sample_visits(visits, order, trees, share, seed).withColumn("node", F.lit(1).cast("long"))
    rows = freeze(rows)
    largest = rows.agg(F.max("m")).first()[0]
    depth = max(1, ceil(log2(max(largest or 2, 2))))
    nodes = None
    for level in range(depth + 1):
        found = freeze(_split_nodes(rows, width, level, seed))
        nodes = found if nodes is None else nodes.unionByName(found)
        if level < depth:
            # open nodes lose their leaves, so the rows shrink from level to level
            open_nodes = found.filter(F.col("attr").isNotNull()).select(*_NODE, "attr", "split")
            right = (F.get("attrs", F.col("attr")) > F.col("split")).cast("long")
            rows = rows.join(open_nodes, _NODE).withColumn("node", F.col("node") * 2 + right).drop("attr", "split")
            rows = freeze(rows) if level % 4 == 3 else rows
    return nodes


def _split_nodes(rows: DataFrame, width: int, level: int, seed: int) -> DataFrame:
    lows = [F.min(F.col("attrs")[i]) for i in range(width)]
    highs = [F.max(F.col("attrs")[i]) for i in range(width)]
    stats = rows.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("size"), F.max("m").alias("m"), F.array(*lows).alias("_lo"), F.array(*highs).alias("_hi")
    )
    usable = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("_hi", i) > F.get("_lo", i))
    at = [F.col(c) for c in _NODE]
    picked = F.get("_usable", F.floor(_uniform(seed + 2, *at) * F.size("_usable")).cast("int"))
    limit = F.ceil(F.log2(F.greatest(F.col("m"), F.lit(2))))
    is_open = (F.col("size") > 1) & (F.size("_usable") > 0) & (F.lit(level) < limit)
    low, high = F.get("_lo", F.col("attr")), F.get("_hi", F.col("attr"))
    return (
        stats.withColumn("_usable", usable)
        .withColumn("attr", F.when(is_open, picked))
        .withColumn("split", low + (high - low) * _uniform(seed + 3, *at))
        .select(*_NODE, "attr", "split", "size", "m")
    )


def score_forest(visits: DataFrame, nodes: DataFrame, trees: int = TREES) -> DataFrame:
    """Adds ``score`` (between 0 and 1, high is anomalous) and ``pred`` (score above 0.5).

    Distinct points walk all trees of their state, one join per level.
    """
    return _with_scores(visits, _walked(visits.select(*STATE, "attrs").distinct(), nodes, trees))


def _walked(points: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """Mean path of each point, and the sample size of its trees."""
    known = nodes.select(*STATE).distinct()
    walking = points.join(known, STATE, "left_semi")
    walking = walking.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    walking = walking.withColumn("node", F.lit(1).cast("long"))
    deepest = nodes.agg(F.max("node")).first()[0] or 1
    ended = None
    for level in range(int(log2(deepest)) + 1):
        here = walking.join(nodes, _NODE)
        leaf = here.filter(F.col("attr").isNull()).select(
            *STATE, "attrs", "m", (F.lit(level) + average_path(F.col("size"))).alias("path")
        )
        ended = leaf if ended is None else ended.unionByName(leaf)
        right = (F.get("attrs", F.col("attr")) > F.col("split")).cast("long")
        walking = here.filter(F.col("attr").isNotNull()).select(
            *STATE, "attrs", "tree", (F.col("node") * 2 + right).alias("node")
        )
        walking = freeze(walking) if level % 4 == 3 else walking
    return ended.groupBy(*STATE, "attrs").agg(F.avg("path").alias("_path"), F.max("m").alias("m"))


def _with_scores(visits: DataFrame, paths: DataFrame) -> DataFrame:
    score = F.pow(F.lit(2.0), -F.col("_path") / F.greatest(average_path(F.col("m")), F.lit(1e-12)))
    scores = paths.select(*STATE, "attrs", F.when(F.col("m") > 1, score).otherwise(F.lit(0.5)).alias("score"))
    joined = visits.join(scores, [*STATE, "attrs"], "left")
    return joined.select(*visits.columns, "score", thin_state(F.col("score") > THRESHOLD).alias("pred"))


def detect_forest(
    test: DataFrame, train: DataFrame, width: int, order: list[str], trees: int = TREES, share: float = 0.3, seed: int = 7,
    whole: int = WHOLE,
) -> DataFrame:
    """``score_forest(test, fit_forest(train, ...))`` without the table of nodes."""
    ship(test.sparkSession)
    counted = train.groupBy(*STATE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MIN_VISITS)
    points = test.filter(F.col("attrs").isNotNull()).select(*STATE, "attrs").distinct()
    points = freeze(points.join(counted.select(*STATE), STATE, "left_semi"))
    held = points.groupBy(*STATE).agg(F.count(F.lit(1)).alias("_points"))
    sizes = freeze(counted.join(held, STATE))
    small = sizes.filter(F.col("n") <= whole).withColumn("_pieces", F.ceil(F.col("_points") / BUCKET_ROWS).cast("int"))
    met = small.agg(F.coalesce(F.sum(F.col("_points") + F.col("n") * F.col("_pieces")), F.lit(0))).first()[0]
    paths = _bucketed(points, train, small, max(1, ceil(met / BUCKET_ROWS)), width, order, trees, share, seed)
    large = sizes.filter(F.col("n") > whole)
    if not large.isEmpty():
        nodes = fit_forest(train.join(large.select(*STATE), STATE, "left_semi"), width, order, trees, share, seed)
        paths = paths.unionByName(_walked(points, nodes, trees))
    return _with_scores(test, paths)


def _bucketed(
    points: DataFrame, train: DataFrame, small: DataFrame, buckets: int, width: int, order: list[str], trees: int,
    share: float, seed: int,
) -> DataFrame:
    """Paths of the points of small states; a state with many points has its visits in several buckets."""

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*STATE, "_piece"), F.lit(buckets)).cast("int"))

    values = [F.get("attrs", F.lit(i)).cast("double").alias(f"_a{i}") for i in range(width)]
    mixed = train.join(small.select(*STATE), STATE, "left_semi").withColumn("_mix", F.xxhash64(F.lit(seed), *order))
    ranked = OrderedScan(mixed, STATE, ["_mix", *order]).index("_place").result().select(*STATE, "_place", *values)
    take = F.ceil(F.lit(share) * F.col("n"))
    visits = ranked.join(small, STATE).withColumn("m", take).select(
        *STATE, "_place", *[f"_a{i}" for i in range(width)], "n", "m",
        F.ceil(F.log2(F.greatest(F.col("m"), F.lit(2)))).alias("_limit"),
        *[F.xxhash64(F.lit(seed + 1 + i), *STATE).alias(f"_h{i}") for i in range(3)],
        F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"))
    walkers = points.join(small.select(*STATE, "_pieces"), STATE).select(  # named anew: both sides may come from one table
        *[F.col(c).alias(c) for c in (*STATE, "attrs")], *values, F.pmod(F.xxhash64("attrs"), F.col("_pieces")).cast("int").alias("_piece"))
    by = "_bucket"
    schema = points.select(*STATE, "attrs", F.lit(0.0).cast("double").alias("_path"), F.lit(0).cast("long").alias("m")).schema

    def grow(own: pa.Table, met: pa.Table) -> pa.Table:
        both = pa.concat_tables([own.select(STATE), met.select(STATE)]).to_pandas()
        code = both.groupby(STATE, sort=False).ngroup().to_numpy()
        code, at = code[:own.num_rows], code[own.num_rows:]
        first = np.argsort(code, kind="stable")
        code = code[first]
        total, count = _paths(code, _numbers(own, width)[first], {c: own[c].to_numpy()[first] for c in own.column_names if c in _GIVEN},
                              at, _numbers(met, width), trees)
        rows = np.flatnonzero(count)
        m = np.zeros(code.max(initial=0) + 1, np.int64)
        m[code] = own["m"].to_numpy()[first]
        out = met.select([*STATE, "attrs"]).take(pa.array(rows))
        return out.append_column("_path", pa.array(total[rows] / count[rows])).append_column("m", pa.array(m[at[rows]]))

    return dealt(visits).groupBy(by).cogroup(dealt(walkers).groupBy(by)).applyInArrow(grow, schema)


_GIVEN = ["_place", "n", "m", "_limit", "_h0", "_h1", "_h2"]


def _numbers(rows: pa.Table, width: int) -> np.ma.MaskedArray:
    """Attributes by row; nulls are masked."""
    columns = [rows[f"_a{i}"] for i in range(width)]
    gone = np.column_stack([c.is_null().to_numpy() for c in columns])
    return np.ma.array(np.column_stack([c.fill_null(0.0).to_numpy() for c in columns]), mask=gone)


def _exceeds(x: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Greater in SQL's order, where NaN is the largest."""
    above = x > limit
    odd = np.isnan(x)
    return above | (odd & ~np.isnan(limit)) if odd.any() else above


def _paths(code, x, given, at, points, trees):
    """Sum of path lengths and number of trees that each point ends in.

    ``code`` numbers the states of the sorted visits ``x``, ``at`` those of ``points``.
    """
    u64 = np.uint64
    edge = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
    states = {c: given[c][edge] for c in _GIVEN}
    n, m, limit = (states[c].astype(np.int64) for c in ("n", "m", "_limit"))
    prefix = [states[f"_h{i}"].astype(np.int64).view(u64) for i in range(3)]
    total, count = np.zeros(len(at)), np.zeros(len(at), np.int64)
    if not len(code) or not len(at):
        return total, count
    lows, highs = x.filled(np.inf), x.filled(-np.inf)
    walked = m[at] > 1  # a sample of one visit is a leaf
    count[~walked] = trees
    walked = np.flatnonzero(walked)
    gone, far, lost = np.ma.getmaskarray(x), points.filled(0.0), np.ma.getmaskarray(points)
    width, far = far.shape[1], far.ravel()
    for tree in range(trees):
        begin, pick, cut = (_hash_int(tree, h) for h in prefix)
        start = np.floor(_share_of(begin) * n).astype(np.int64)
        rows = np.flatnonzero((given["_place"] - start[code]) % n[code] < m[code])
        group, state, node = code[rows], np.arange(len(n)), np.ones(len(n), u64)
        walker, stand, level = walked, at[walked], 0
        while len(walker):
            size = np.bincount(group, minlength=len(node))
            edge = np.cumsum(size) - size
            low, high = np.fmin.reduceat(lows[rows], edge), np.maximum.reduceat(highs[rows], edge)
            usable = _exceeds(high, low) & (low < np.inf)
            choices = usable.sum(axis=1)
            is_open = (size > 1) & (choices > 0) & (level < limit[state])
            nth = np.floor(_share_of(_hash_long(node, pick[state])) * choices).astype(np.int64)
            attr = np.argmax(usable & (np.cumsum(usable, axis=1) == nth[:, None] + 1), axis=1)
            own = np.arange(len(node))
            low, high = low[own, attr], high[own, attr]
            with np.errstate(invalid="ignore"):
                split = low + (high - low) * _share_of(_hash_long(node, cut[state]))
            goes = is_open[stand]
            ended = walker[~goes]
            total[ended] += (level + _average_paths(size))[stand[~goes]]
            count[ended] += 1
            rows, group = rows[is_open[group]], group[is_open[group]]
            walker, stand = walker[goes], stand[goes]
            if gone.any():
                here = ~gone[rows, attr[group]]
                rows, group = rows[here], group[here]
            if lost.any():
                here = ~lost[walker, attr[stand]]
                walker, stand = walker[here], stand[here]
            child = 2 * group + _exceeds(lows[rows, attr[group]], split[group])
            moved = np.argsort(child, kind="stable")
            rows, child = rows[moved], child[moved]
            stand = 2 * stand + _exceeds(far[walker * width + attr[stand]], split[stand])
            filled = np.flatnonzero(np.bincount(child, minlength=2 * len(node)))
            number = np.full(2 * len(node), -1)
            number[filled] = np.arange(len(filled))
            group, stand = number[child], number[stand]
            walker, stand = walker[stand >= 0], stand[stand >= 0]
            node, state = node[filled >> 1] * u64(2) + (filled & 1).astype(u64), state[filled >> 1]
            level += 1
    return total, count


def _average_paths(n: np.ndarray) -> np.ndarray:
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + _EULER) - 2 * (big - 1) / big))


# xxhash64 of a further int or long after the columns hashed so far, as ``F.xxhash64`` gives it
_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _P[1]
    h = (h ^ h >> np.uint64(29)) * _P[2]
    return h ^ h >> np.uint64(32)


def _hash_int(value: int, before: np.ndarray) -> np.ndarray:
    word = np.full(1, value, np.uint64) * _P[0]
    return _ended(_turned((before + _P[4] + np.uint64(4)) ^ word, 23) * _P[1] + _P[2])


def _hash_long(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    word = _turned(value * _P[1], 31) * _P[0]
    return _ended(_turned((before + _P[4] + np.uint64(8)) ^ word, 27) * _P[0] + _P[3])


def _share_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << 30) - 1)) / float(1 << 30)
