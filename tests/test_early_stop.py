"""The early stop judges few models behind a match, and gives the rows of a full run."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import evaluate as K
from flowloom.plans import profiles as P
from workload.profile import test_flows as later_flows, train_flows

SF = "/root/testdata/sf0.001"
PAIRS = "entity string, model_id string"


def order_of(spark, n):
    return spark.createDataFrame([(f"m{i:03d}", i + 1) for i in range(n)], "model_id string, model_ord long")


class Judge:
    """Entity ``e<r>`` matches from its r-th model on; keeps the pairs it was asked for."""

    def __init__(self):
        self.rounds = []

    def __call__(self, batch):
        self.rounds.append([tuple(r) for r in batch.collect()])
        place = F.substring("model_id", 2, 3).cast("int") + 1
        hit = place >= F.substring("entity", 2, 3).cast("int")
        level = F.explode(F.array(F.lit("total"), F.lit("label")))
        return batch.select(
            F.lit("t").alias("test_set"), "entity", "model_id", F.lit("m").alias("method"), level.alias("level"),
            F.lit("").alias("key"), F.lit(0).alias("tp"), F.when(hit, 5).otherwise(1).alias("tn"), F.lit(9).alias("fp"),
            F.lit(0).alias("fn"))


@pytest.mark.parametrize("first", [1, 3])
def test_batches_equal_a_full_run(spark, first):
    n, stops = 20, [1, 2, 3, 4, 9, 16, 20, 99]  # the last one never matches
    order = order_of(spark, n)
    pairs = spark.createDataFrame([(f"e{r:03d}", f"m{i:03d}") for r in stops for i in range(n)], PAIRS)
    judge = Judge()
    got = K.match_in_batches(pairs, order, judge, first=first)
    want = K.first_match(Judge()(pairs), order)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    asked = [p for r in judge.rounds for p in r]
    assert len(asked) == len(set(asked))
    for r in stops:
        assert min(r, n) <= sum(e == f"e{r:03d}" for e, _ in asked) <= min(n, first + 2 * r)
    assert len(judge.rounds) <= 5  # 1 + 2 + 4 + 8 + 5


def test_rounds_end_with_the_last_open_entity(spark):
    judge = Judge()
    pairs = spark.createDataFrame([("e001", f"m{i:03d}") for i in range(50)], PAIRS)
    assert K.match_in_batches(pairs, order_of(spark, 50), judge).count() == 2
    assert judge.rounds == [[("e001", "m000")]]


def test_entities_with_few_models_repeated_rows_and_none(spark):
    pairs = spark.createDataFrame([("e099", "m003"), ("e099", "m003"), ("e002", "m001"), ("e002", "m004")], PAIRS)
    judge = Judge()
    got = {(r.entity, r.model_id) for r in K.match_in_batches(pairs, order_of(spark, 5), judge).collect()}
    assert got == {("e099", "m003"), ("e002", "m001")} and [len(r) for r in judge.rounds] == [2]
    empty = K.match_in_batches(pairs.limit(0), order_of(spark, 5), Judge())
    assert empty.count() == 0 and "model_ord" in empty.columns


def test_plan_with_early_stop(spark, tmp_path):
    settings = P.Settings(numeric=["src_bytes", "dst_port"], min_flows=20)
    trained = P.train(spark, train_flows(spark, SF), str(tmp_path / "train"), settings)
    models = trained.states.select("model_id").distinct().limit(4).cache()
    pairs = models.select(F.col("model_id").alias("entity")).crossJoin(models)
    flows = later_flows(spark, SF)
    whole = P.test(spark, trained, flows, pairs, str(tmp_path / "a"), "later").cache()
    share = whole.filter("level = 'total'").agg(F.median(K.benign_share())).first()[0]  # some hosts match, some don't
    got = P.test(spark, trained, flows, pairs, str(tmp_path / "b"), "later", stop_share=share).cache()
    order = got.select("model_id", "model_ord").distinct()
    names = sorted(r.model_id for r in models.collect())
    assert all(names[r.model_ord - 1] == r.model_id for r in order.collect())
    full = spark.createDataFrame([(m, i + 1) for i, m in enumerate(names)], "model_id string, model_ord long")
    want = K.first_match(whole, full, share).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() < whole.count()
