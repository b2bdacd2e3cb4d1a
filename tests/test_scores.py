import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream.operators import drift, evaluate, fusion

nan = float("nan")


def scores(spark, y, s, **more):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double").withColumns({k: F.lit(v) for k, v in more.items()})


def test_confusion(spark):
    r = evaluate.confusion(scores(spark, [0, 0, 0, 1, 1, 1], [0.01, 0.7, 0.4, 0.2, 0.9, 0.8]), [], "y", "s", F.lit(0.5)).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 1, 1, 2) and r.specificity == pytest.approx(2 / 3)
    r = evaluate.confusion(scores(spark, [0, 1], [0.1, 0.2]), [], "y", "s", F.lit(0.5)).first()
    assert r.precision == 0 and r.false_negative_rate == 1
    with pytest.raises(Exception, match="finite"):
        evaluate.confusion(scores(spark, [0, 1], [0.1, nan]), [], "y", "s", F.lit(0.5)).collect()


def brute_thresholds(y, s):
    y, s = np.asarray(y), np.asarray(s, dtype=float)
    points = []
    for t in [*sorted(set(s), reverse=True), math.nextafter(max(s), math.inf)]:
        hit = s >= t
        tp, fp, fn, tn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        bf = 2 * tn / (2 * tn + fp + fn) if tn + fp + fn else 0.0
        points.append((t, f1, (f1 + bf) / 2, tp, fp / (fp + tn) if fp + tn else 0.0))
    made = {"maximum_binary_f1": max(points, key=lambda p: (p[1], p[0]))[0], "maximum_macro_f1": max(points, key=lambda p: (p[2], p[0]))[0]}
    for cap in evaluate.FPR_CAPS:
        made[f"fpr_at_most_{cap:g}"] = max((p for p in points if p[4] <= cap), key=lambda p: (p[3], p[0]))[0]
    return made


@pytest.mark.parametrize("y,s", [([1, 1, 0, 1, 0, 0, 1], [0.95, 0.6, 0.6, 0.6, 0.3, 0.05, 0.05]), ([0, 1, 0, 1, 1, 0], [0.1, 0.1, 0.3, 0.4, 0.7, 0.7]), ([0, 0, 1, 1], [500] * 4), ([0, 0, 1, 1], [10, 20, 1000, 2000])])
def test_thresholds_equal_a_full_scan(spark, y, s):
    got = {r.criterion: r.threshold for r in evaluate.select_thresholds(scores(spark, y, s), [], "y", "s").collect()}
    assert got == brute_thresholds(y, s)


def test_thresholds_of_random_scores(spark):
    rng = random.Random(1)
    y, s, g = zip(*[(rng.randrange(2), rng.choice([0.1, 0.25, 0.5, 0.75, round(rng.random(), 2)]), rng.choice("ab")) for _ in range(300)])
    df = spark.createDataFrame(list(zip(y, s, g)), "y int, s double, g string")
    got = {}
    for r in evaluate.select_thresholds(df, ["g"], "y", "s").collect():
        got.setdefault(r.g, {})[r.criterion] = r.threshold
    for k in "ab":
        assert got[k] == brute_thresholds([a for a, c in zip(y, g) if c == k], [b for b, c in zip(s, g) if c == k])


def test_ranking(spark):
    r = evaluate.ranking(scores(spark, [0, 0, 1, 1], [10, 20, 1000, 2000]), [], "y", "s").first()
    assert r.roc_auc == r.average_precision == r.pr_auc == 1
    rng = random.Random(2)
    y = [rng.randrange(2) for _ in range(80)]
    s = [rng.randrange(7) for _ in range(80)]
    r = evaluate.ranking(scores(spark, y, s), [], "y", "s").first()
    pairs = [(a, b) for a, t in zip(s, y) if t for b, u in zip(s, y) if not u]
    assert r.roc_auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]))
    one = evaluate.ranking(scores(spark, [1, 1], [0.1, 0.2]), [], "y", "s").first()
    assert one.roc_auc is None and one.n_neg == 0


@pytest.mark.parametrize("s", [[1, 2, 3, 4], [1] * 100, [0] * 950 + [1] * 50, [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]])
def test_benign_thresholds_keep_the_cap(spark, s):
    df = scores(spark, [0] * len(s), s)
    rows = evaluate.benign_thresholds(df, [], "s", [0.1, *evaluate.BENIGN_CAPS, 1.0]).collect()
    assert len(rows) == 6
    for r in rows:
        k = math.floor(r.cap * len(s))
        assert r.allowed == k and r.observed == sum(x >= r.threshold for x in s) <= k
        if r.cap < 1:
            assert r.threshold == math.nextafter(sorted(s)[len(s) - k - 1], math.inf)
    if len(s) == 10:
        assert next(r for r in rows if r.cap == 0.1).observed == 0


def test_families(spark):
    df = spark.createDataFrame([("benign", 0.8), ("known", 0.1), ("known", 0.9), ("unseen", 0.4)], "family string, s double")
    book = spark.createDataFrame([("benign",), ("known",), ("unseen",), ("absent",)], "family string")
    got = {r.family: r for r in evaluate.family_recall(df, [], "family", "s", F.lit(0.5), spark.createDataFrame([("known",)], "family string"), book).collect()}
    assert got["known"].recall == 0.5 and got["known"].status == "KNOWN" and got["unseen"].missed == 1 and got["unseen"].status == "UNSEEN"
    assert got["absent"].recall is None and got["absent"].n == 0 and "benign" not in got


def test_calibration_and_grid(spark):
    rng = random.Random(3)
    y, s = zip(*[(rng.randrange(2), rng.choice([0.0, 1.0, 0.05, rng.random()])) for _ in range(200)])
    df = scores(spark, y, s)
    r = evaluate.calibration(df, [], "y", "s").first()
    bins = {}
    for t, p in zip(y, s):
        bins.setdefault(min(int(p * 20), 19), []).append((t, p))
    assert r.ece == pytest.approx(sum(len(v) / 200 * abs(np.mean([p for _, p in v]) - np.mean([t for t, _ in v])) for v in bins.values()))
    assert r.brier == pytest.approx(np.mean([(p - t) ** 2 for t, p in zip(y, s)]))
    grid = {round(g.threshold, 3): g for g in evaluate.threshold_grid(df, [], "y", "s").collect()}
    assert len(grid) == 201
    for t in (0, 0.05, 0.5, 0.995, 1):
        assert grid[t].recall == pytest.approx(sum(a and b >= t for a, b in zip(y, s)) / sum(y))


def test_seeds_and_pairs(spark):
    runs = spark.createDataFrame([(m, s, 0.1 * s + (m == "a")) for m in "ab" for s in range(5)], "model string, seed int, f1 double")
    got = {r.model: r for r in evaluate.seed_summary(runs, ["model"], "seed", ["f1"]).collect()}
    assert got["a"].f1_mean == pytest.approx(1.2) and got["a"].f1_sd == pytest.approx(np.std([0, 0.1, 0.2, 0.3, 0.4], ddof=1))
    with pytest.raises(Exception, match="one row for each seed"):
        evaluate.seed_summary(runs.where("seed < 4"), ["model"], "seed", ["f1"]).collect()
    assert {round(r.f1_delta, 9) for r in evaluate.paired_difference(runs, ["seed"], "model", "a", "b", ["f1"]).collect()} == {1.0}
    with pytest.raises(Exception, match="unmatched"):
        evaluate.paired_difference(runs.where("model = 'a' or seed > 1"), ["seed"], "model", "a", "b", ["f1"]).collect()


def ks(a, b):
    return max(abs(np.mean([x <= v for x in a]) - np.mean([x <= v for x in b])) for v in {*a, *b})


@pytest.mark.parametrize("a,b", [([0, 0, 1, 2], [0, 1, 1, 3]), ([0, 0], [1, 1]), ([0, 0], [0, 0])])
def test_ks(spark, a, b):
    df = spark.createDataFrame([("f", float(x), True) for x in a] + [("f", float(x), False) for x in b], "feature string, value double, ref boolean")
    assert drift.ks_distance(df, ["feature"], F.col("ref")).first().ks == pytest.approx(ks(a, b))
    assert drift.ks_distance(df.where("ref"), ["feature"], F.col("ref")).first().ks is None


def brute_psi(a, b):
    fa, fb = (np.sort([x for x in v if x is not None]) for v in (a, b))
    edges = [-np.inf, np.nextafter(fa[0], -np.inf), np.nextafter(fa[0], np.inf), np.inf] if fa[0] == fa[-1] else np.r_[-np.inf, np.unique(np.quantile(fa, np.arange(0.1, 1, 0.1))), np.inf]
    p, q = (np.maximum(np.r_[np.histogram(f, edges)[0], len(v) - len(f)] / len(v), 1e-6) for f, v in ((fa, a), (fb, b)))
    p, q = p / p.sum(), q / q.sum()
    return float(((q - p) * np.log(q / p)).sum())


@pytest.mark.parametrize("a,b", [([0.0] * 10, [0.0] * 10), ([0.0] * 10, [1.0] * 10), ([0.0] * 10, [0.0] * 5 + [None] * 5), ([float(i % 13) for i in range(60)], [float(i % 9) + 2 for i in range(40)] + [None])])
def test_psi(spark, a, b):
    df = spark.createDataFrame([("f", x, True) for x in a] + [("f", x, False) for x in b], "feature string, value double, ref boolean")
    assert drift.psi(df, ["feature"], F.col("ref")).first().psi == pytest.approx(brute_psi(a, b), abs=1e-9)


def test_summary_of_nothing_observed(spark):
    df = spark.createDataFrame([("p", None, 1.0), ("p", None, nan), ("p", None, float("inf"))], "part string, a double, b double")
    got = {r.feature: r for r in drift.feature_summary(drift.unpivoted(df, ["part"], ["a", "b"]), ["part", "feature"]).collect()}
    assert got["a"].observed == 0 and got["a"].median is None and got["b"].observed == 1 and got["b"].p99 == 1.0


def test_ecdf_and_fusion(spark):
    df = spark.createDataFrame([(i, float(x), True) for i, x in enumerate([1, 2, 2, 4])] + [(10 + x, float(x), False) for x in range(6)] + [(99, None, False)], "id int, s double, ref boolean")
    got = {r.id: r.e for r in fusion.ecdf(df, "s", F.col("ref"), "e").collect()}
    assert [got[10 + x] for x in range(6)] == [0, 0.25, 0.75, 0.75, 1, 1] and got[99] is None
    r = fusion.fused(spark.createDataFrame([(0.2, 0.6)], "a double, b double"), "a", "b").first()
    assert r.maximum == 0.6 and r.weighted_25 == pytest.approx(0.5) and r.weighted_75 == pytest.approx(0.3)


def test_overlap_and_correlation(spark):
    df = spark.createDataFrame([("g", 1.0, 5.0), ("g", 2.0, 5.0), ("g", 2.0, 7.0), ("g", 9.0, 1.0), ("h", 1.0, 1.0), ("h", 1.0, 2.0), ("h", None, 2.0)], "k string, a double, b double")
    o = {r.k: r for r in fusion.overlap(df.na.fill(0.0), ["k"], F.col("a") >= 2, F.col("b") >= 5).collect()}
    assert (o["g"].both, o["g"].only_a, o["g"].only_b, o["g"].neither) == (2, 1, 1, 0) and o["g"].jaccard == 0.5 and o["h"].jaccard is None
    c = {r.k: r for r in fusion.correlations(df, ["k"], "a", "b").collect()}
    assert c["g"].pearson == pytest.approx(np.corrcoef([1, 2, 2, 9], [5, 5, 7, 1])[0, 1])
    assert c["g"].spearman == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [2.5, 2.5, 4, 1])[0, 1])
    assert c["h"].n == 2 and c["h"].pearson is None
