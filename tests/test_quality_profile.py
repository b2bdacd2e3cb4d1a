import math
import random
from datetime import date

import numpy as np
import pytest

from siltstream.operators import quality_profile as Q

FLOWS = "source_file string, file_date date, flow_duration string, flow_byts_s string, flow_pkts_s string, n int, gid string"
REPORT = "filename string, report_scope string, column_name string, nan_values bigint, infinite_values bigint"


def ks(a, b):
    at = sorted(set(a) | set(b))
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in at)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for day in (1, 2, 3):
        for i in range(120):
            value = str(rng.choice([5, 5, 5, 7.5, 1e3, -0.0, 0])) if i % 3 else str(rng.randrange(1000) * day)
            rows.append((f"f{day}_site1.csv", date(2029, 1, day), rng.choice([value, value, " NaN", "-inf", "", None, "N/A", "odd"]), value, None if day == 2 else value, i, "clash"))
    return rows, spark.createDataFrame(rows, FLOWS)


def numbers(rows, file, k):
    out = []
    for r in rows:
        if r[0] == file and r[k] is not None:
            try:
                x = float(r[k].strip())
            except ValueError:
                continue
            if math.isfinite(x):
                out.append(x)
    return out


def test_profile_against_numpy(data):
    rows, df = data
    got = {(r.source_file, r.column_name): r for r in Q.measure_profile(df).collect()}
    assert len(got) == 9
    for k, c in ((2, "flow_duration"), (3, "flow_byts_s"), (4, "flow_pkts_s")):
        for f in ("f1_site1.csv", "f2_site1.csv", "f3_site1.csv"):
            r, x = got[f, c], numbers(rows, f, k)
            assert r.n_number == len(x) and r.n_distinct == len(set(x)) and r.n_rows == 120
            for q in (1, 25, 50, 75, 99):
                assert (r[f"q{q:02d}"] is None and not x) or r[f"q{q:02d}"] == pytest.approx(np.quantile(x, q / 100))


def test_distances_against_brute_force(data):
    rows, df = data
    got = {(r.source_file, r.column_name): r.ks for r in Q.load_distances(df).collect()}
    assert set(f for f, _ in got) == {"f2_site1.csv", "f3_site1.csv"}
    assert got["f3_site1.csv", "flow_byts_s"] == pytest.approx(ks(numbers(rows, "f3_site1.csv", 3), numbers(rows, "f2_site1.csv", 3)))
    assert got["f2_site1.csv", "flow_duration"] == pytest.approx(ks(numbers(rows, "f2_site1.csv", 2), numbers(rows, "f1_site1.csv", 2)))
    assert got["f2_site1.csv", "flow_pkts_s"] is None


def test_findings(spark):
    one = lambda f, d, v: (f, date(2029, 1, d), v, "1", "1", 0, "")
    rows = [one("a_site1", 1, v) for v in ("10", "10", "10", "inf")] + [one("b_site1", 2, v) for v in ("40", "40", "nan", "")] + [one("c_site1", 4, v) for v in ("-1", "odd")] + [one("d_site2", 2, "120000001")]
    report = [("a_site1", "column", "flow_duration", 0, 0), ("b_site1", "column", "flow_duration", 1, 0), ("b_site1", "column", "flow_duration", 1, 0), ("b_site1", "file", "", 9, 9)]
    got = {tuple(r) for r in Q.doubtful(spark.createDataFrame(rows, FLOWS), spark.createDataFrame(report, REPORT)).collect()}
    assert got == {
        ("a_site1", "flow_duration", "infinite_values"),
        ("b_site1", "flow_duration", "null_rate"),
        ("b_site1", "flow_duration", "shift"),
        ("c_site1", "flow_duration", "pattern"),
        ("c_site1", "flow_duration", "value_range"),
        ("d_site2", "flow_duration", "value_range"),
    }


def test_column_profile_and_empty(spark, data):
    rows, df = data
    got = {(r.source_file, r.column_name): r for r in Q.column_profile(df).collect()}
    assert got["f1_site1.csv", "n"].n_distinct == 120 and float(got["f1_site1.csv", "n"].q50) == 59.5
    assert got["f2_site1.csv", "flow_pkts_s"].n_null == 120 and got["f2_site1.csv", "flow_pkts_s"].least is None
    assert got["f1_site1.csv", "gid"].n_distinct == 1 and got["f1_site1.csv", "gid"].least == "clash"
    empty = spark.createDataFrame([], FLOWS)
    assert Q.doubtful(empty, spark.createDataFrame([], REPORT)).count() == 0 and Q.load_distances(empty).count() == 0 and Q.column_profile(empty).count() == 0


def test_all_columns_are_compared_and_tokens_told_from_nulls(spark):
    kinds = "source_file string, file_date date, flow_duration string, protocol string, flow_iat_mean double, dst_port int"
    day = lambda f, d, rows: [(f, date(2029, 1, d), *r) for r in rows]
    rows = day("a_site1", 1, [("1", "tcp", 1.0, 80), ("nan", "tcp", 2.0, 80), ("inf", "udp", math.nan, None), (None, " ", 3.0, 80), ("n/a", None, 4.0, 80), ("odd", "TCP", 5.0, 80)])
    rows += day("b_site1", 2, [("1", "udp", 9.0, 81), ("1", "udp", 8.0, 81)])
    df = spark.createDataFrame(rows, kinds)
    ks_of = {r.column_name: r.ks for r in Q.load_distances(df).collect() if r.source_file == "b_site1"}
    assert ks_of == {"file_date": 1.0, "flow_duration": 0.0, "protocol": pytest.approx(0.8), "flow_iat_mean": 1.0, "dst_port": 1.0}
    got = {r.column_name: r for r in Q.column_profile(df).collect() if r.source_file == "a_site1"}
    names = ["n_null", "n_blank", "n_nan", "n_null_marker", "n_infinite", "n_other"]
    tokens = {c: [r[n] for n in names] for c, r in got.items()}
    assert tokens["flow_duration"] == [1, 0, 1, 1, 1, 1] and tokens["protocol"] == [1, 1, 0, 0, 0, 0]
    assert tokens["flow_iat_mean"] == [0, 0, 1, 0, 0, 0] and tokens["dst_port"] == [1, 0, 0, 0, 0, 0]
