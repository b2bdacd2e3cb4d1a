from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from siltstream.operators import cleaning, preprocess, splitting, verify
from siltstream.queries import preparation
from siltstream.sources import flow_files, sinks

HEADER = "Timestamp,Label,Protocol,Flow Byts/s,Flow Pkts/s,measurement,encoded,copied_label"
FEATURES = ["Protocol", "Flow Byts/s", "Flow Pkts/s", "measurement", "encoded"]


def body(day):
    rows = [("02:00:00,Benign,6,NaN,2,4,0,Benign"), ("01:00:00,Attack,17,Infinity,3,2,1,Attack"), ("01:30:00,Benign,17,4,-inf,8,0,Benign"), ("01:00:00,Attack,6,2,1,10,1,Attack")]
    return [f"{day:02d}/02/2018 {r}" for r in rows]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for day in (14, 15, 16):
        lines = [HEADER, *body(day)]
        if day == 14:
            lines += [body(14)[0], HEADER, HEADER, "05/01/1970 03:00:00,Benign,6,1,1,1,0,Benign"]
        text = ("﻿" if day == 15 else "") + ("\r\n" if day == 16 else "\n").join(lines) + ("" if day == 15 else "\n")
        (folder / f"Day-{day}-02-2018_flows.csv").write_bytes(text.encode())
    return str(folder)


@pytest.fixture(scope="module")
def classified(spark, files):
    raw = flow_files.read_flow_files(spark, files)
    names = HEADER.split(",")
    header = F.lit(True)
    for n in names:
        header = header & (F.col(f"`{n}`") == n)
    time = F.try_to_timestamp(F.col("Timestamp"), F.lit("d/M/yyyy H:m:s"))
    return cleaning.classify(raw.withColumn("time", time), header, [f"`{n}`" if "/" in n else n for n in names], F.col("time"), F.col("file_date")).cache()


def test_reader_numbers_lines(spark, files):
    raw = flow_files.read_flow_files(spark, files).select("source_file", "source_row", "source_line", "byte_offset", "measurement").collect()
    assert len(raw) == 16
    for r in raw:
        data = open(f"{files}/{r.source_file}", "rb").read()
        line = data[r.byte_offset :].split(b"\n")[0].decode().rstrip("\r")
        assert line.split(",")[5] == r.measurement and r.source_line == r.source_row + 1
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        split = {tuple(r) for r in flow_files.numbered_lines(spark, files).select("source_file", "source_line", "byte_offset", "line").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert split == {tuple(r) for r in flow_files.numbered_lines(spark, files).select("source_file", "source_line", "byte_offset", "line").collect()}
    assert {r.n_lines for r in flow_files.line_counts(spark, files).collect()} == {5, 9}


def test_wrong_width_raises(spark, tmp_path):
    (tmp_path / "a_01-01-2018.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="field count"):
        flow_files.read_flow_files(spark, str(tmp_path)).collect()


def test_cleaning_order_and_counts(spark, classified):
    rec = {r.source_file[4:6]: r for r in cleaning.reconciliation(classified).collect()}
    assert (rec["14"].headers, rec["14"].duplicates, rec["14"].quarantined, rec["14"].eligible_rows) == (2, 1, 1, 4)
    assert sum(r.eligible_rows for r in rec.values()) == 12 and all(r.adds_up for r in rec.values())
    spec = cleaning.CleaningSpec(["Flow Byts/s", "Flow Pkts/s", "measurement", "encoded"], ["Protocol"], {"Flow Byts/s", "Flow Pkts/s"})
    clean = cleaning.cleaned(classified, spec, F.col("time"), F.col("file_date"))
    day = clean.where(F.dayofmonth("file_date") == 14).orderBy("timestamp", "source_row").collect()
    assert [r.source_row for r in day] == [2, 4, 3, 1]
    assert sum(r["Flow Byts/s"] is None for r in day) == 2 and sum(r["Flow Pkts/s"] is None for r in day) == 1
    assert verify.cleaned_rules(clean).count() == 0
    bad = cleaning.CleaningSpec(["measurement", "Flow Byts/s"])
    with pytest.raises(Exception, match="infinite"):
        cleaning.cleaned(classified, bad, F.col("time"), F.col("file_date")).collect()
    events = cleaning.audit_events(classified, ["source_line", "byte_offset"]).collect()
    assert {(r.reason, r.source_row, r.retained_source_row) for r in events} == {("exact_duplicate", 5, 1), ("repeated_header", 6, None), ("repeated_header", 7, None), ("year_1970", 8, None)}
    parts = {"clean": clean, "quarantine": cleaning.cleaned(classified, spec, F.col("time"), F.col("file_date"), True), "removed": cleaning.audit_events(classified, []).where("disposition = 'remove'")}
    assert cleaning.unaccounted(classified, parts, ["source_file", "source_row"]).count() == 0
    assert cleaning.unaccounted(classified, {"clean": clean}, ["source_file", "source_row"]).count() == 4


def test_written_once_and_in_order(spark, classified, tmp_path):
    spec = cleaning.CleaningSpec(["measurement"])
    clean = cleaning.cleaned(classified, spec, F.col("time"), F.col("file_date"))
    cleaning.write_sorted(clean, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    with pytest.raises(Exception, match="exists"):
        cleaning.write_sorted(clean, str(tmp_path / "out"))


def test_names_of_the_target():
    shared, reasons = cleaning.common_schema([HEADER.split(","), HEADER.split(",") + ["Src IP"]], {"Timestamp"}, {"Label"})
    assert shared == FEATURES and reasons == {"Timestamp": "identifier", "copied_label": "names the target", "Src IP": "not in every file"}
    assert cleaning.target_alias("is_attack") and not cleaning.target_alias("classic")
    assert verify.leaking_features(["a", "copied_label", "source_row", "b=1"], {"b"}) == ["copied_label", "source_row", "b=1"]


def test_fit_on_training_rows_only(spark, classified):
    spec = cleaning.CleaningSpec(["Flow Byts/s", "Flow Pkts/s", "measurement", "encoded"], ["Protocol"], {"Flow Byts/s", "Flow Pkts/s"})
    clean = cleaning.cleaned(classified, spec, F.col("time"), F.col("file_date"))
    train = clean.where(F.dayofmonth("file_date") == 14)
    state = preprocess.fit(train, FEATURES, ["Protocol"], "attack_label", "Benign")
    assert state.excluded == {"encoded": "one_to_one_binary_target_encoding"} and state.levels == {"Protocol": ["17", "6"]}
    means = dict(zip(state.numeric, state.means))
    assert means["measurement"] == 6 and means["Flow Byts/s"] == 3 and state.training_rows == 4
    other = clean.withColumns({"Protocol": F.lit("99"), "measurement": F.lit(1e6)})
    out = state.transform(other.where(F.dayofmonth("file_date") == 16)).collect()
    assert all(r["Protocol=6"] == r["Protocol=17"] == 0 for r in out)
    assert preprocess.Preprocessor.from_json(state.to_json()) == state
    counts = preprocess.imputation_counts(train, "file_date", state).first()
    assert counts.imputed_cells == 3 and counts.unknown_Protocol == 0
    with pytest.raises(Exception, match="not finite"):
        state.transform(train.withColumn("measurement", F.lit(float("inf")))).collect()


def test_degenerate_columns(spark):
    rows = [(None, 4.0, float(i), None, "Benign" if i % 2 else "Attack") for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "all_missing double, constant double, varying double, Protocol string, attack_label string")
    state = preprocess.fit(df, ["all_missing", "constant", "varying", "Protocol"], ["Protocol"], "attack_label", "Benign")
    assert state.all_missing == ["all_missing"] and state.levels == {"Protocol": ["<ALL_TRAIN_MISSING>"]}
    assert all(r.all_missing == r.constant == 0 for r in state.transform(df).collect())
    with pytest.raises(ValueError, match="missing columns"):
        state.transform(df.drop("varying"))
    with pytest.raises(ValueError, match="empty"):
        preprocess.fit(df.limit(0), ["varying"], [], "attack_label")


def test_split_choice(spark):
    days = [date(2018, 2, d) for d in range(14, 24)]
    rows = [(d, "benign", 200) for d in days] + [(d, f"attack{i % 4}", 150) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "file_date date, label string, n bigint")
    best = splitting.chosen_split(df, splitting.SplitSpec())
    assert (best["train_end"], best["validation_end"]) == (days[6], days[7]) and best["training_attack_classes"] == 4
    with pytest.raises(ValueError, match="No chronological split"):
        splitting.chosen_split(df.where("file_date = '2018-02-14'"), splitting.SplitSpec())


def test_half_open_and_elapsed(spark):
    at = [datetime(2018, 2, 20, 10, 29, 59), datetime(2018, 2, 20, 10, 30), datetime(2018, 2, 20, 10, 30), datetime(2018, 2, 20, 11)]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(at)], "t timestamp, y int")
    a, b = F.lit(datetime(2018, 2, 20, 10, 30)), F.lit(datetime(2018, 2, 20, 11))
    got = df.withColumn("part", splitting.half_open(F.col("t"), a, b))
    assert [r.part for r in got.collect()] == [0, 1, 1, 2]
    one = splitting.split_summary(got, "part", "t", F.col("y") == 1, ["t"])
    two = splitting.split_summary(got.withColumn("y", 1 - F.col("y")), "part", "t", F.col("y") == 1, ["t"])
    assert {r.part: r.digest for r in one.collect()} == {r.part: r.digest for r in two.collect()}
    assert {r.part: r.malicious for r in one.collect()} == {0: 0, 1: 1, 2: 1}


def test_artefacts(tmp_path):
    path = str(tmp_path / "a.json")
    sinks.write_json(path, {"b": 1, "a": [1.5]})
    with pytest.raises(ValueError):
        sinks.write_json(path, {"x": float("nan")})
    before = sinks.manifest(str(tmp_path))
    sinks.compare_manifests(before, sinks.manifest(str(tmp_path)))
    sinks.write_json(path, {"b": 2})
    with pytest.raises(ValueError, match="changed"):
        sinks.compare_manifests(before, sinks.manifest(str(tmp_path)))
    sinks.write_csv(str(tmp_path / "r.csv"), [{"a": 1}, {"b": 2}])
    assert (tmp_path / "r.csv").read_text() == "a,b\n1,\n,2\n"
    with pytest.raises(ValueError):
        sinks.write_csv(str(tmp_path / "e.csv"), [])
    lock = sinks.ThresholdLock([{"t": 0.5}], "h")
    lock.save(str(tmp_path / "lock.json"))
    with pytest.raises(ValueError):
        lock.save(str(tmp_path / "lock.json"))
    with pytest.raises(ValueError):
        sinks.ThresholdLock.load(str(tmp_path / "lock.json"), "other")
    assert sinks.markdown([{"a": 1200, "b": None}, {"a": 0.5, "b": "x|y"}], ["a", "b"]).endswith("| 1,200 | - |\n| 0.5 | x\\|y |")
    sinks.write_json(path, {"raw": "/r", "output": "/o", "fractions": [0.5, 0.3, 0.3]})
    with pytest.raises(ValueError, match="add up"):
        sinks.load_config(path)


def test_transform_apply_covers_all_splits(spark, monkeypatch):
    rows = [(i, split, float(i), 1.0, 2.0, 3.0, "6", "benign") for i, split in enumerate(["train", "train", "validation", "test", None])]
    made = spark.createDataFrame(rows, "row_id bigint, split string, totlen_fwd_pkts double, totlen_bwd_pkts double, flow_iat_mean double, flow_byts_s double, protocol string, label_key string")
    monkeypatch.setattr(preparation, "_train", lambda *_: made)
    got = {r.row_id: r.totlen_fwd_pkts for r in preparation.transform_apply(spark, "").collect()}
    # fitted on 0 and 1 of the train split only
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0] == -got[1] and got[2] == pytest.approx(3 * got[1])
