import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream.llm import sampling as S

FLOWS = "row_id bigint, source_file string, source_row bigint, split string, label string, quota string"
AUDIT = "source_file string, source_row bigint"
CLASSES = "filename string, label string, row_count bigint, class_group string"
TARGETS = "plan_id int, category_kind string, category string, target_share double, min_rows bigint, sample_fraction double"


def data(spark):
    labels = ["Benign"] * 700 + [" benign"] * 100 + ["Port Sweep"] * 150 + ["Bot"] * 30 + [None] * 15 + ["Rare"] * 5
    flows = spark.createDataFrame([(i, "f", i, "train" if i % 10 else "test", x, "clash") for i, x in enumerate(labels)], FLOWS)
    audit = spark.createDataFrame([("f", 1), ("f", 1), ("f", 2)], AUDIT)
    classes = spark.createDataFrame([("f", "Benign", 5, "benign"), ("f", "BENIGN", 1, "benign"), ("f", "Port Sweep", 1, "malicious"), ("f", "Bot", 1, "malicious"), ("f", "Rare", 1, "malicious"), ("f", "", 1, "unclassified")], CLASSES)
    targets = spark.createDataFrame([(1, "label", "benign", 0.2, 10, 0.5), (1, "label", "Port  sweep", 0.25, 10, 0.5), (1, "label", "Rare", 0.1, 2, 0.5), (1, "label", "Bot", 0.05, 20, 0.5), (2, "class_group", "benign", 0.5, 1, 0.2), (2, "class_group", "Malicious", 0.5, 1, 0.2), (3, "label", "absent", 0.0, 0, 0.1), (3, "label", "Absent too", 0.0, 1, 0.1)], TARGETS)
    return flows, audit, classes, targets


def test_report(spark):
    rows = {(r.plan_id, r.category): r for r in S.sample_report(*data(spark)).collect()}
    # 900 train rows, two of them audited
    assert rows[1, "benign"].available == 718 and rows[1, "Port  sweep"].available == 135 and rows[1, "Rare"].available == 5
    assert rows[1, "Rare"].required == pytest.approx(0.1 * 0.5 * 898) and not rows[1, "Rare"].is_met and rows[1, "Rare"].drawn == 5
    # the shares of the plan leave rows over, which may go to any category
    assert rows[1, "Bot"].drawn >= 20 and rows[1, "Port  sweep"].drawn >= 112 and rows[1, "benign"].drawn >= 90
    assert abs(rows[2, "benign"].drawn - rows[2, "Malicious"].drawn) <= 1
    assert rows[3, "absent"].is_met and not rows[3, "Absent too"].is_met
    got = {tuple(r) for r in S.unmet_targets(*data(spark)).collect()}
    assert got == {(1, "Rare"), (3, "Absent too")}


def test_sample_matches_report(spark):
    parts = data(spark)
    drawn = S.draw_samples(*parts).collect()
    assert len({(r.plan_id, r.row_id) for r in drawn}) == len(drawn)
    assert all(r.row_id % 10 and r.row_id not in (1, 2) for r in drawn)
    report = {(r.plan_id, r.category): r.drawn for r in S.sample_report(*parts).collect()}
    assert sum(r.plan_id == 1 and r.label_key == "benign" for r in drawn) == report[1, "benign"]
    assert sum(r.plan_id == 2 and r.group_key == "malicious" for r in drawn) == report[2, "Malicious"]
    assert sum(r.plan_id == 1 for r in drawn) == round(0.5 * 898)
    again = {(r.plan_id, r.row_id) for r in S.draw_samples(*parts).collect()}
    assert again == {(r.plan_id, r.row_id) for r in drawn}


def test_repair_reaches_a_local_optimum():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, c = rng.integers(2, 6), rng.integers(1, 4)
        available = rng.integers(0, 60, n)
        member = rng.integers(0, 2, (c, n))
        want, floors = rng.integers(0, 40, c).astype(float), rng.integers(0, 5, c)
        size = int(rng.integers(0, available.sum() + 1))
        x = S.repair(available, member, want, floors, size, rng)
        least = np.minimum(floors, member @ available)
        assert (x >= 0).all() and (x <= available).all() and (member @ x >= least).all() and x.sum() >= min(size, available.sum())
        off = ((member @ x - want) ** 2).sum()
        for a in range(n):
            for b in range(n):
                if a != b and x[a] and x[b] < available[b]:
                    y = x.copy()
                    y[a] -= 1
                    y[b] += 1
                    assert not (member @ y >= least).all() or ((member @ y - want) ** 2).sum() >= off - 1e-9


def test_empty(spark):
    _, audit, classes, targets = data(spark)
    empty = spark.createDataFrame([], FLOWS)
    assert {tuple(r) for r in S.unmet_targets(empty, audit, classes, targets).collect()} == {(1, "benign"), (1, "Port  sweep"), (1, "Rare"), (1, "Bot"), (2, "benign"), (2, "Malicious"), (3, "Absent too")}
    assert S.draw_samples(empty, audit, classes, targets).count() == 0
    assert S.sample_report(*data(spark)[:3], targets.where(F.lit(False))).count() == 0


def test_counts_of_billions():
    rng = np.random.default_rng(2)
    available = np.array([2_000_000_000, 900_000_000, 7], dtype=np.int64)
    drawn = S.random_counts(available, 1_000_000_000, rng)
    assert drawn.sum() == 1_000_000_000 and (drawn <= available).all()
    assert abs(drawn[0] / 1e9 - 2 / 2.9) < 1e-3
    x = S.repair(available, np.eye(3, dtype=np.int64), np.array([5e8, 5e8, 10.0]), np.array([10, 10, 10]), 1_000_000_000, rng)
    assert x.sum() == 1_000_000_000 and x[2] == 7 and abs(int(x[0]) - int(x[1])) <= 1


def test_random_counts_follow_the_law():
    rng = np.random.default_rng(3)
    made = np.array([S.random_counts(np.array([30, 0, 50, 20]), 40, rng) for _ in range(4000)])
    assert (made.sum(axis=1) == 40).all() and (made[:, 1] == 0).all()
    assert np.allclose(made.mean(axis=0), [12, 0, 20, 8], atol=0.15)
    assert abs(made[:, 0].var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.5


def test_a_surplus_spreads():
    # one category has 10 of 100 rows wanted: the other nine share what is left
    available = np.array([10] + [5000] * 9)
    x = S.repair(available, np.eye(10, dtype=np.int64), np.full(10, 100.0), np.full(10, 100), 1000, np.random.default_rng(4))
    assert x[0] == 10 and x[1:].min() == x[1:].max() == 110


def test_what_is_possible_is_met(spark):
    for r in S.sample_report(*data(spark)).collect():
        assert r.is_met == r.is_possible == (r.available >= r.required) == (r.drawn >= r.required)
