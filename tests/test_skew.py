"""Groups over the row limit take another way and give the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions.quantiles import exact_quantiles
from flowloom.functions.scan import OrderedScan
from flowloom.operators.detectors import boxes, kde, lof
from flowloom.operators.detectors.blocks import distinct_points
from flowloom.operators.entities import first_n_per_class
from flowloom.session import MAX_GROUP_ROWS


@pytest.fixture
def tight(spark):
    spark.conf.set(MAX_GROUP_ROWS, "40")
    yield
    spark.conf.unset(MAX_GROUP_ROWS)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(12)}", rng.randrange(300), i, rng.random() < 0.1)
            for i in range(900)]
    return spark.createDataFrame(rows, "k string, t long, id long, flag boolean")


def scanned(df):
    scan = OrderedScan(df, ["k"], ["t", "id"]).index("i").previous({"before": "t"}).previous({"twice": "before"})
    scan = scan.with_column("step", F.coalesce(F.col("t") - F.col("before"), F.lit(0)))
    done = scan.running_sum("sum_flag", F.col("flag").cast("long")).running_sum("sum_step", F.col("step")).result()
    return {tuple(r) for r in done.select("k", "t", "id", "i", "before", "twice", "sum_flag", "sum_step").collect()}


def by_hand(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r)
    out = set()
    for k, rows in groups.items():
        rows.sort(key=lambda r: (r.t, r.id))
        flags = steps = 0
        for i, r in enumerate(rows):
            before = rows[i - 1].t if i else None
            twice = rows[i - 2].t if i > 1 else None
            flags += r.flag
            steps += r.t - before if i else 0
            out.add((k, r.t, r.id, i, before, twice, flags, steps))
    return out


def test_scan_plain(spark, skewed):
    assert scanned(skewed) == by_hand(skewed)


def test_scan_cut(spark, skewed, tight):
    assert scanned(skewed) == by_hand(skewed)


def test_scan_without_keys(spark, skewed, tight):
    done = OrderedScan(skewed, [], ["t", "id"]).index("i").previous({"before": "id"}).result()
    rows = sorted(done.collect(), key=lambda r: (r.t, r.id))
    assert [r.i for r in rows] == list(range(900))
    assert [r.before for r in rows] == [None, *[r.id for r in rows[:-1]]]


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles(spark, skewed, keys):
    values = skewed.withColumn("v", F.sqrt("t") * F.when(F.col("id") % 7 != 0, 1.0))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    read = lambda: {
        tuple(r[k] for k in keys): [list(r[c]) for c in ("q_t", "q_v")]
        for r in exact_quantiles(values, keys, ["t", "v"], probs).collect()
    }
    plain = read()
    spark.conf.set(MAX_GROUP_ROWS, "40")
    try:
        assert read() == plain
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)


@pytest.fixture(scope="module")
def states(spark):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        state = "big" if i % 5 else "small"
        rows.append(("m", state, [float(rng.randrange(30)), round(rng.gauss(0, 1), 2)]))
    rows += rows[:60]
    test = [("m", s, [float(rng.randrange(40)), round(rng.gauss(0, 2), 2)]) for s in ("big", "small", "new") for _ in range(25)]
    schema = "model_id string, state string, attrs array<double>"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(test, schema)


def _scores(df):
    return sorted((r.state, tuple(r.attrs), r.pred, None if r.score is None else round(r.score, 8)) for r in df.collect())


def test_lof_in_blocks(spark, states):
    train, test = states
    whole = _scores(lof.score_lof(test, lof.fit_lof(train)))
    cut = _scores(lof.score_lof(test, lof.fit_lof(train, rows=16), rows=8))
    assert whole == cut


def test_kde_in_blocks(spark, states):
    train, test = states
    whole = _scores(kde.score_kde(test, train, kde.fit_kde(train, 2)))
    cut = _scores(kde.score_kde(test, train, kde.fit_kde(train, 2, rows=16), rows=16))
    assert whole == cut


def test_queries_under_tight_limit(spark, tight):
    import oracle
    import workload

    sf = "/root/testdata/sf0.001"
    con = oracle.connect(sf)
    for name in ("index_flows", "first_n_per_class", "sessionize", "window_params", "state_quantiles", "summary", "bin_limits"):
        assert oracle.compare(workload.all_queries()[name](spark, sf), con, workload.all_sql()[name]) == "", name


def _cloud(spark, n, seed=3):
    """Points in a few dense places of a wide plane, with repeats and equal coordinates."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 400, size=(12, 2)) * 25.0
    xy = np.round(centre[rng.integers(12, size=n)] + rng.normal(size=(n, 2)) * [40, 3], 1)
    xy[::7, 1] = 50.0
    xy[::11] = xy[0]
    rows = [("m", "s", i, [float(a), float(b)]) for i, (a, b) in enumerate(xy)]
    return spark.createDataFrame(rows, "model_id string, state string, id long, attrs array<double>")


def test_blocks_hold_near_points(spark):
    points = distinct_points(_cloud(spark, 3000), ["model_id", "state"])
    cut = boxes.cut_blocks(points, ["model_id", "state"], 50)
    sizes = [r["count"] for r in cut.groupBy("block").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == points.count()
    same = spark.createDataFrame([("m", [1.0, 2.0], i) for i in range(40)], "model_id string, attrs array<double>, w long")
    assert boxes.cut_blocks(same, ["model_id"], 8).select("block").distinct().count() == 1  # equal points cannot be cut
    assert boxes.cut_blocks(same.where("false"), ["model_id"], 8).collect() == []


def _by_point(df):
    return {tuple(r.attrs): (r.pred, r.score) for r in df.collect()}


@pytest.mark.parametrize("share, k", [(None, 20), (0.05, None)])
def test_pruned_lof_equals_whole(spark, share, k):
    train, test = _cloud(spark, 1500), _cloud(spark, 400, 5)
    whole = _by_point(lof.score_lof(test, lof.fit_lof(train, share=share, k=k, rows=5000), share=share, k=k, rows=5000))
    cut = _by_point(lof.score_lof(test, lof.fit_lof(train, share=share, k=k, rows=200), share=share, k=k, rows=200))
    assert whole.keys() == cut.keys()
    for i, (pred, score) in whole.items():
        assert cut[i][1] == pytest.approx(score, rel=1e-9) and cut[i][0] == pred


def test_block_pairs_stay_bounded(spark):
    """For a fixed number of neighbours a query block meets itself and the blocks around it, of hundreds."""
    keys = ["model_id", "state"]
    blocks = boxes.pack_cut(distinct_points(_cloud(spark, 16_000), keys), keys, 64).drop("points").cache()
    _, pairs = lof._pruned_kd(blocks, blocks, keys, None, 20, True)
    assert blocks.count() > 200 and pairs.count() < 12 * blocks.count()


def test_pruned_kde_equals_whole(spark):
    train, test = _cloud(spark, 1500), _cloud(spark, 400, 5)
    whole = _by_point(kde.score_kde(test, train, kde.fit_kde(train, 2, rows=5000), rows=5000))
    cut = _by_point(kde.score_kde(test, train, kde.fit_kde(train, 2, rows=200), rows=200))
    assert whole.keys() == cut.keys()
    for i, (pred, score) in whole.items():
        assert cut[i][1] == pytest.approx(score, rel=1e-12) and cut[i][0] == pred


def test_kernels_out_of_reach_are_skipped(spark):
    """Far places of a group do not meet, and the density is the one of all pairs."""
    train = _cloud(spark, 2000).union(_cloud(spark, 2000, 8).selectExpr("model_id", "state", "id + 5000", "transform(attrs, x -> x + 1e6 * (id % 9))"))
    cov = kde.fit_covariance(train, 2)
    narrow = cov.withColumn("cov", F.transform("cov", lambda c: c * 1e-6))
    found = {tuple(r.attrs): r.density for r in kde.densities(train, train, narrow, 64).collect()}
    want = {tuple(r.attrs): r.density for r in kde.densities(train, train, narrow, 10_000).collect()}
    assert found.keys() == want.keys()
    for x, value in want.items():
        assert found[x] == pytest.approx(value, rel=1e-12)
    known = boxes.pack_cut(kde._whitened(distinct_points(train, kde.STATE), narrow), kde.STATE, 64, "at").cache()
    nodes = boxes.tree(known, kde.STATE)
    bound = boxes.descend(known.select(*kde.STATE, "block", "lo", "hi"), nodes, kde.STATE, F.log("weight") - boxes.most_square() / 2, F.lit(True))
    reached = known.join(bound, [*kde.STATE, "block"]).withColumn("reach2", 2 * (kde.LOST + F.log("n") - F.col("best")))
    places = {r.block: {round(x[0] / 1e6) for x in r.points} for r in known.select("block", "points").collect()}
    met = [(r.block, r.r_block) for r in boxes.near_pairs(reached, nodes, kde.STATE).collect()]
    # blocks of one place meet no block of another one; a cut may leave a block in two places, whose box is wide
    inside = [(places[a], places[b]) for a, b in met if len(places[a]) == len(places[b]) == 1]
    assert inside and all(a == b for a, b in inside) and len(met) < len(places) ** 2 / 2


def test_first_of_a_class_never_meets_the_whole_class(spark):
    rows = [(i, 1_000 - i // 3, "c" if i % 50 else None) for i in range(900)]
    flows = spark.createDataFrame(rows, "flow_id long, date_us long, label string")
    got = first_n_per_class(flows, 5, part_rows=100)
    want = {label: sorted(((d, i) for i, d, l in rows if l == label))[:5] for label in ("c", None)}
    found = {label: sorted((r.date_us, r.flow_id) for r in got.collect() if r.label == label) for label in ("c", None)}
    assert found == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
