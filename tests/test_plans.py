"""The jobs end to end on the small tables."""

import pytest
from pyspark.sql import functions as F

from flowloom.plans import profiles as P, verdicts as V
from workload.catalog import DAY_US
from workload.profile import test_flows as later_flows, train_flows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("method, windows, scale", [
    ("baseline", "count", True), ("probabilistic", "static", False), ("lof", "dynamic", False), ("forest", "count", False),
    ("gaussian", "count", False),
])
def test_train_test_judge(spark, tmp_path, method, windows, scale):
    settings = P.Settings(
        numeric=["src_bytes", "dst_port"], min_flows=20, windows=windows, method=method, scale=scale, gap_us=DAY_US)
    trained = P.train(spark, train_flows(spark, SF), str(tmp_path / "train"), settings)
    models = trained.states.select("model_id").distinct()
    pairs = models.select(F.col("model_id").alias("entity"), "model_id")
    flows = later_flows(spark, SF)
    conf = P.test(spark, trained, flows, pairs, str(tmp_path / "test"), "later").cache()
    totals = conf.filter("level = 'total'").agg(F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).first()[0]
    judged_hosts = [r.model_id for r in models.collect()]
    assert totals == flows.filter(F.col("src_ip").isin(judged_hosts)).count()  # every flow is predicted once
    judged, summed = V.judge(conf, conf, min_host_flows=None)
    assert judged.filter("level = 'host'").count() == len(judged_hosts)
    assert {r.scenario for r in summed.collect()} == {"later", "total"}


def test_baseline(spark):
    judged = V.baseline(train_flows(spark, SF), later_flows(spark, SF), ["dst_port", "protocol_num", "src_bytes"], 10)
    assert judged.count() == 15 and set(judged.columns) == {"entity", "truth", "verdict"}


@pytest.mark.parametrize("name", ["confusion", "time_windows", "state_lof"])
def test_partition_counts_do_not_matter(spark, name):
    import workload

    fn = workload.all_queries()[name]
    eight = sorted(map(str, fn(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, fn(spark, SF).collect())) == eight
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_verdict_counts_and_entry(spark):
    import __spark_entry__ as S

    assert S.entry(spark).count() == 2
    assert set(S.oracle_sql()) <= set(S.queries())


def test_malicious_hosts_are_judged(spark, sf_small):
    """Hosts without a model of their own are tried on the models of their test set, so both kinds of truth occur."""
    import workload

    queries = workload.all_queries()
    totals = queries["verdict_confusion"](spark, sf_small).filter("level = 'host'").first()
    assert totals.tp + totals.fn > 0 and totals.tn + totals.fp > 0
    assert {r.truth for r in queries["symbolic_verdicts"](spark, sf_small).collect()} == {0, 1}
