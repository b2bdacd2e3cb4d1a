import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstream.operators import keyed_chunks as K

SCHEMA = "k string, o bigint, t timestamp, m bigint"


def brute(rows):
    out = {}
    for k, o, t, m in sorted(rows, key=lambda r: r[1]):
        s = out.setdefault(k, {"n": 0, "first": o, "timed": 0, "back": 0, "gap": None, "last": None, "total": None})
        s["n"] += 1
        s["end"] = o
        if m is not None:
            s["total"] = (s["total"] or 0) + m
        if t is not None:
            if s["last"] is not None:
                d = int((t - s["last"]).total_seconds())
                s["back"] += d < 0
                if d > 0:
                    s["gap"] = max(s["gap"] or 0, d)
            s["last"] = t
            s["timed"] += 1
    return {k: (s["n"], s["first"], s["end"], s["timed"], s["back"], s["gap"], s["total"]) for k, s in out.items()}


@pytest.mark.parametrize("chunk,blocks", [(1, 1), (3, 7), (50_000, 16)])
def test_states_equal_brute_force_at_any_chunk_size(spark, chunk, blocks):
    rng = random.Random(chunk)
    base = datetime(2029, 1, 1)
    # one key holds most rows
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i * 3, None if rng.random() < 0.1 else base + timedelta(seconds=rng.randrange(5000)), None if rng.random() < 0.1 else rng.randrange(9)) for i in range(400)]
    rng.shuffle(rows)
    got = K.ordered_states(spark.createDataFrame(rows, SCHEMA).withColumn("_n", F.lit("clash")), ["k"], "o", "t", "m", chunk, blocks).collect()
    assert {r.k: (r.n_rows, r.first_row, r.last_row, r.timed_rows, r.backward_steps, r.max_forward_gap_s, r.total) for r in got} == brute(rows)


def test_numbers_are_dense_per_key(spark):
    rows = [("x" if i % 3 else None, i, None, 1) for i in range(100)]
    got = K.number_rows(spark.createDataFrame(rows, SCHEMA), ["k"], "o", chunk_rows=10, blocks=5)
    per = {}
    for r in got.orderBy("o").collect():
        per.setdefault(r.k, []).append((r._row, r._chunk))
    for v in per.values():
        assert v == [(i, i // 10) for i in range(len(v))]


def test_no_partition_grows_with_a_hot_key(spark):
    # one key holds nine tenths of the rows; ten times the rows make ten times the partitions, not larger ones
    for n in (20_000, 200_000):
        rows = spark.range(n).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), F.col("id").alias("o"))
        ranged = K.range_sorted_rows(rows, ["k"], ["o"], -(-n // 5_000))
        sizes = [r["count"] for r in ranged.groupBy("_block").count().collect()]
        assert max(sizes) < 10_000 and len(sizes) >= n // 10_000
    numbered = K.number_rows(rows, ["k"], "o", blocks=40)
    assert numbered.where("k = 'hot'").agg(F.count_distinct("_row"), F.max("_row")).first()[:] == (180_000, 179_999)


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "PARTITION_ROWS", 10)
    assert K.range_partitions(spark.range(5_000)) == 500 and K.range_partitions(spark.range(0)) == 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert K.ordered_states(empty, ["k"], "o", "t", "m").count() == 0


FLOWS = "row_id bigint, src_ip string, dst_ip string, flow_timestamp timestamp, tot_fwd_pkts bigint, tot_bwd_pkts bigint, ip string"


def test_heavy_endpoints_trims_and_counts_nulls_out(spark):
    rows = [(i, " a " if i < 2 else f"s{i}" if i < 150 else None, "d\t" if i % 2 else "d", None, 1, None, "clash") for i in range(200)]
    got = {tuple(r) for r in K.heavy_endpoints(spark.createDataFrame(rows, FLOWS)).collect()}
    # 2 of 150 rows are at least 1 %, 1 of 150 is not
    assert got == {("src_ip", "a"), ("dst_ip", "d")}
    assert K.heavy_endpoints(spark.createDataFrame([], FLOWS)).count() == 0
