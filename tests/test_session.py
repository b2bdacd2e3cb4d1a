import os

import pytest
from pyspark.sql import functions as F

from siltstream import session as S
from siltstream.operators import eligible, evaluate, graph, history, picks, splitting, verify
from siltstream.plans import running


def test_materialise_cuts_lineage(spark):
    df = spark.range(100).withColumn("r", F.rand())
    once = S.materialise(df, "x")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, once.collect())) and once.dtypes == df.dtypes
    assert os.path.isdir(S.checkpoint_dir(spark).removeprefix("file:"))


def test_sized_joins_alike(spark):
    big, small = spark.range(50).withColumn("k", F.col("id") % 7), spark.range(3).withColumnRenamed("id", "k")
    plans = [big.join(S.sized(small, n), "k") for n in (2, 3)]
    assert plans[0].count() == plans[1].count() == 22
    text = [p._jdf.queryExecution().optimizedPlan().toString() for p in plans]
    assert "strategy=merge" in text[0] and "strategy=broadcast" in text[1]


def test_eligible(spark):
    flows = spark.createDataFrame([("f", 1, "x"), ("f", 2, "y"), (None, 3, "z"), ("g", None, "w")], "source_file string, source_row bigint, v string")
    audit = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), (None, 3, "c")], "source_file string, source_row bigint, v string")
    assert {r.v for r in eligible.eligible(flows, audit).collect()} == {"y", "z", "w"}
    assert eligible.eligible(flows.limit(0), audit).count() == 0 and eligible.eligible(flows, audit.limit(0)).count() == 4


@pytest.mark.parametrize("blocks", [1, 3, 9])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, blocks, descending):
    rows = [(k, float((i * 37) % 101), i) for k in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    got = {(r.k, r.v): r.upto_n for r in running.running_totals(df, ["k"], "v", ["n"], descending, blocks).collect()}
    for k, v, _ in rows:
        assert got[k, v] == sum(n for a, b, n in rows if a == k and (b >= v if descending else b <= v))
    assert running.running_totals(df.limit(0), ["k"], "v", ["n"]).count() == 0


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", None, 9), ("b", 2.0, 1), ("c", None, 1)], "k string, v double, w bigint")
    got = {r.k: (r.n, r.m, r.p) for r in running.exact_quantiles(df, ["k"], "v", [0.5, 0.75], ["m", "p"], weight="w").collect()}
    assert got == {"a": (4, 1.0, 2.0), "b": (1, 2.0, 2.0)}


def test_picks(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "g", float(i % 5)) for i in range(90)], "id int, g string, v double")
    one = {r.id for r in picks.uniform_sample(df, "id", 10, 1).collect()}
    assert len(one) == 10 and one == {r.id for r in picks.uniform_sample(df.repartition(7), "id", 10, 1).collect()}
    counts = {r.g: r["count"] for r in picks.group_sample(df, ["g"], "id", 4, 1).groupBy("g").count().collect()}
    assert counts == {None: 4, "g": 4}
    t = sorted((r["rank"], r.value) for r in picks.thinned(df, [], "v", 4).collect())
    ordered = sorted(i % 5 for i in range(90))
    assert t == [(k, ordered[k]) for k in (0, 29, 59, 89)]
    assert len(picks.thinned(df.limit(2), [], "v", 50).collect()) == 2
    table = spark.createDataFrame([("g",)], "g string")
    assert picks.allowed(df, table, ["g"]).count() == 30


def test_small_reports(spark):
    runs = spark.createDataFrame([("m", 1, 2.0), ("m", 1, 2.0), ("m", 2, 4.0)], "model string, seed int, cost double")
    r = evaluate.cost_summary(runs, "seed", "model", ["cost"]).first()
    assert (r.n_seeds, r.cost_mean, r.cost_max) == (2, 3.0, 4.0)
    assert evaluate.latency_ms_per_1000(2.0, 4000) == 500
    s = spark.createDataFrame([("p", 1.0), ("p", 3.0)], "part string, nodes double")
    m = graph.metric_summary(s, ["part"], ["nodes"]).first()
    assert (m.n, m.mean, m.median, m.maximum) == (2, 2.0, 2.0, 3.0) and m.p90 == pytest.approx(2.8)
    cover = spark.createDataFrame([(0, None, 10, 9), (0, 1, 99, 99)], "part int, y int, all_3 int, all_7 int")
    assert history.coverage_gate(cover, 0, "y", 9) and not history.coverage_gate(cover, 0, "y", 10) and not history.coverage_gate(cover, 1, "y", 1)
    events = spark.createDataFrame([("f", 5, "exact_duplicate", 1), ("f", 6, "exact_duplicate", 9), ("f", 7, "exact_duplicate", 2), ("f", 8, "other", None)], "source_file string, source_row bigint, reason string, retained_source_row bigint")
    clean = spark.createDataFrame([("f", 1), ("f", 9)], "source_file string, source_row bigint")
    assert {r.source_row for r in verify.duplicate_links(events, clean).collect()} == {6, 7}
    t = spark.range(100).select(F.timestamp_seconds(F.col("id") * 600).alias("t"), "id")
    c = splitting.elapsed_candidates(t, "t", F.col("id") % 2 == 0, [(0.5, 0.75)]).collect()
    assert {x.part: x.n for x in c} == {0: 50, 1: 24, 2: 26}
    order = spark.createDataFrame([("d", 1, 5, 1), ("d", 2, 5, 2), ("d", 3, 4, 3), ("d", 4, 4, 3)], "d string, p int, t int, r int")
    assert {x.p for x in splitting.out_of_order(order, ["d"], "p", "t", "r").collect()} == {3, 4}
