from datetime import date, datetime

from pyspark.sql import functions as F

from siltstream.operators import audit as A
from siltstream.operators import windows as W

RAW = "f string, r bigint, Src string, Dst string, Timestamp string, Rate string, Bytes string, Label string, Constant string"
ROWS = [
    ("x", 1, "a", "b", "02/03/2018 08:00:00", "NaN", "10", "Benign", "0"),
    ("x", 2, "a", "b", "02/03/2018 08:00:00", "NaN", "10", "Benign", "0"),
    ("x", 3, "b", "a", "01/03/2018 09:00:00", "Infinity", "20.5", "Bot", "0"),
    ("x", 4, "b", "a", "bad", "", "NULL", "", "0"),
    ("x", 5, "Src", "Dst", "Timestamp", "Rate", "Bytes", "Label", "Constant"),
]
COLUMNS = ["Src", "Dst", "Timestamp", "Rate", "Bytes", "Label", "Constant"]


def test_raw_profile(spark):
    df = spark.createDataFrame(ROWS, RAW)
    got = {r.column_name: r for r in A.content_types(A.value_profile(df, ["f"], COLUMNS)).collect()}
    total = lambda k: sum(r[k] for r in got.values())
    assert (total("n_nan"), total("n_missing"), total("n_null_marker"), total("n_infinite")) == (2, 2, 1, 1)
    assert not got["Constant"].is_constant and got["Constant"].is_constant_value and got["Constant"].content_type == "mixed numeric/string"
    assert got["Bytes"].has_fraction and not got["Constant"].has_fraction
    status = {r.s: r["count"] for r in df.groupBy(A.label_status(F.col("Label")).alias("s")).count().collect()}
    assert status == {"benign": 2, "malicious": 1, "unclassified": 2}
    assert {tuple(r) for r in A.later_copies(df, "f", COLUMNS, "r").collect()} == {("x", 2, 1)}


def test_duplicates_count_exactly(spark):
    rows = [("f", i, v, None if i % 2 else "x") for i, v in enumerate(["a"] * 6 + [None] * 4 + ["b"])]
    df = spark.createDataFrame(rows, "f string, r bigint, v string, w string")
    got = {(r.r, r.retained) for r in A.later_copies(df, "f", ["v", "w"], "r").collect()}
    assert got == {(2, 0), (4, 0), (3, 1), (5, 1), (8, 6), (9, 7)}
    assert A.later_copies(df.limit(0), "f", ["v"], "r").count() == 0


def test_windows_and_anomalies(spark):
    t = lambda s: datetime.strptime(s, "%d/%m/%Y %H:%M:%S")
    rows = [
        (1, "a", "b", t("20/02/2018 01:00:00"), "NaN", "Benign"),
        (2, "a", "b", t("20/02/2018 01:00:00"), "NaN", "Benign"),
        (3, "a", "b", t("20/02/2018 01:01:00"), "+Infinity", "Attack"),
        (4, "b", "a", t("20/02/2018 01:05:00"), "-inf", "Attack"),
        (5, "a", "b", t("05/01/1970 03:01:17"), "1", "Benign"),
        (6, "Src", "Dst", None, "Rate", "Label"),
    ]
    df = spark.createDataFrame(rows, "r bigint, src string, dst string, t timestamp, Rate string, label string").withColumns({"f": F.lit("f"), "day": F.lit(date(2018, 2, 20))})
    kinds = {(r.kind, r.label): r.n for r in A.special_values(df, ["label"], ["Rate"]).collect()}
    assert kinds == {("nan", "Benign"): 2, ("positive_infinity", "Attack"): 1, ("negative_infinity", "Attack"): 1}
    found = {r.r: r for r in A.anomaly_context(df, "f", "r", "t", "day", "label").collect()}
    assert {k: v.anomaly_type for k, v in found.items()} == {5: "year_1970", 6: "unparseable_timestamp"}
    assert found[5].preceding == "2,3,4" and found[5].following == "6" and found[6].preceding == "3,4,5" and found[6].following == ""
    pairs = {(m, str(r.window_start)): r for m in (5, 10) for r in W.pair_recurrence(df, "t", "src", "dst", m).collect()}
    five, ten = pairs[5, "2018-02-20 01:00:00"], pairs[10, "2018-02-20 01:00:00"]
    assert (five.flows, five.unique_pairs, five.extra_flows) == (3, 1, 2) and (ten.flows, ten.unique_pairs) == (4, 2)
    back = A.backward_transitions(df, "f", "r", "t", "label").collect()
    assert [(r.n, str(r.t)) for r in back] == [(1, "1970-01-05 03:01:17")]
    # 1970 is not joined to 2018 by empty windows
    counts = W.filled(W.window_counts(df, [], "t", 1, F.col("label") == "Attack"), [], 1)
    assert sorted(r.n for r in counts.collect()) == [0, 0, 0, 1, 1, 1, 2]
    times = A.file_times(df, "f", "t", "day").first()
    assert (times.n_timed, times.n_year_1970, times.n_unparseable_timestamp, times.same_time_extra) == (5, 1, 1, 1)


def test_backward_steps_cross_blocks_and_nulls(spark):
    base = datetime(2029, 1, 1)
    rows = [("g" if i % 2 else None, i, None if i % 5 == 0 else datetime(2029, 1, 1, 0, (i * 7) % 60), "l") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o bigint, t timestamp, label string")
    want, last = {}, {}
    for g, _, t, _ in rows:
        if t is not None:
            if g in last and t < last[g]:
                want[g, last[g], t] = want.get((g, last[g], t), 0) + 1
            last[g] = t
    got = {(r.g, r.previous_time, r.t): r.n for r in A.backward_transitions(df, "g", "o", "t", "label").collect()}
    assert got == want and base.year == 2029


def test_episodes_touch_over_midnight(spark):
    at = [datetime(2029, 1, 1, 23, 58), datetime(2029, 1, 1, 23, 59), datetime(2029, 1, 2, 0, 0), datetime(2029, 1, 2, 0, 2)]
    counts = spark.createDataFrame([(t, 2, 1) for t in at], "window_start timestamp, n bigint, n_malicious bigint")
    got = sorted((str(r.episode_start), str(r.episode_end), r.n_windows, r.n) for r in W.episodes(counts, 1, F.col("n_malicious") > 0).collect())
    assert got == [("2029-01-01 23:58:00", "2029-01-02 00:01:00", 3, 6), ("2029-01-02 00:02:00", "2029-01-02 00:03:00", 1, 2)]
