"""Metrics of detectors: confusion, ranking, thresholds, families, calibration, seeds. Scores predict at >= threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.plans.running import exact_quantiles, running_totals
from siltstream.session import materialise, sized

FPR_CAPS = [0.01, 0.005, 0.001]
BENIGN_CAPS = [0.05, 0.01, 0.005, 0.001]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def next_up(x: Column) -> Column:
    """The smallest double above x."""
    return F.call_function("java_method", F.lit("java.lang.Math"), F.lit("nextUp"), x.cast("double")).cast("double")


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy to error rates of confusion counts; 0/0 is 0."""
    f1, benign = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "f1": f1,
        "macro_f1": (f1 + benign) / 2,
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
    }


def confusion(df: DataFrame, keys: list[str], y: str, score: str, threshold: Column) -> DataFrame:
    """Per keys: counts and rates of score >= threshold against y (0 or 1). Rows with a null y or score raise."""
    valid = F.when(F.col(score).isNull() | F.isnan(score) | ~F.coalesce(F.col(y).isin(0, 1), F.lit(False)), F.raise_error(F.lit("scores must be finite and y 0 or 1"))).otherwise(F.col(score) >= threshold)
    rows = df.withColumn("_hit", valid)
    n = lambda a, b: F.count(F.when((F.col(y) == a) & (F.col("_hit") == b), 1))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n(1, True).alias("tp"), n(0, True).alias("fp"), n(1, False).alias("fn"), n(0, False).alias("tn"))
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def sweep(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Per keys and distinct score, as a threshold: pos and neg at it, tp and fp at or above it, and the totals."""
    by_score = df.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))
    by_score = materialise(by_score, "scores")  # read for the bounds, the totals and the sums
    up = running_totals(by_score, keys, "threshold", ["pos", "neg"], descending=True).withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"})
    totals = by_score.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return _with_totals(up, totals, keys)


def _with_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return rows.crossJoin(F.broadcast(totals))  # one row
    key = F.struct(*keys)
    return rows.withColumn("_k", key).join(sized(totals.withColumn("_k", key).drop(*keys)), "_k").drop("_k")


def threshold_sweep(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """sweep with fn, tn and rates, and one more row per key, all_negative, above the highest score."""
    points = sweep(df, keys, y, score).withColumn("all_negative", F.lit(False))
    top = points.groupBy(*keys).agg(F.max("threshold").alias("m"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    none = top.select(*keys, next_up(F.col("m")).alias("threshold"), *[F.lit(0).cast("bigint").alias(c) for c in ("pos", "neg", "tp", "fp")], "n_pos", "n_neg", F.lit(True).alias("all_negative"))
    every = points.unionByName(none).withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")})
    return every.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def select_thresholds(df: DataFrame, keys: list[str], y: str, score: str, caps: list[float] = FPR_CAPS) -> DataFrame:
    """(keys, criterion, threshold, tp, fp, fn, tn): best F1 and macro-F1, and under each cap on the false positive
    rate the most true positives; ties go to the highest threshold."""
    points = threshold_sweep(df, keys, y, score)
    whole = F.struct("threshold", "tp", "fp", "fn", "tn")
    best = lambda value, where=None: F.max_by(whole if where is None else F.when(where, whole), F.struct(value, "threshold") if where is None else F.when(where, F.struct(value, "threshold")))
    wanted = {"maximum_binary_f1": best(F.col("f1")), "maximum_macro_f1": best(F.col("macro_f1"))}
    for cap in caps:
        wanted[f"fpr_at_most_{cap:g}"] = best(F.col("tp"), F.col("false_positive_rate") <= cap)
    picked = points.groupBy(*keys).agg(*[c.alias(name) for name, c in wanted.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("criterion"), F.col(f"`{name}`").alias("at")) for name in wanted])
    return picked.select(*keys, F.inline(rows)).select(*keys, "criterion", "at.*")


def ranking(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """(keys, n_pos, n_neg, roc_auc, average_precision, pr_auc), ties counted half, by steps, by trapezoids from
    (recall 0, precision 1). All three are null where a class is absent."""
    points = sweep(df, keys, y, score)
    tp, fp, pos, neg, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg", "n_pos", "n_neg"))
    before, after = ratio(tp - pos, tp - pos + fp - neg), ratio(tp, tp + fp)
    before = F.when(tp - pos + fp - neg == 0, 1.0).otherwise(before)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    terms = {"roc_auc": ratio(pos, p) * ratio(n - fp + neg / 2, n), "average_precision": ratio(pos, p) * after, "pr_auc": ratio(pos, p) * (before + after) / 2}
    return points.groupBy(*keys, "n_pos", "n_neg").agg(*[F.sum(F.when(both, t)).alias(k) for k, t in terms.items()])


def curve_points(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Full ROC and PR curves: (keys, threshold, tpr, fpr, precision)."""
    points = sweep(df, keys, y, score)
    return points.select(*keys, "threshold", ratio(F.col("tp"), F.col("n_pos")).alias("tpr"), ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def threshold_grid(df: DataFrame, keys: list[str], y: str, score: str, steps: int = 200) -> DataFrame:
    """Recall, false positive rate and precision at thresholds 0 to 1 in ``steps`` equal steps: rows are counted by
    the last grid point they reach, and points add up from above."""
    at = F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps))
    at = F.when(at / steps > F.col(score), at - 1).otherwise(at)
    counts = df.groupBy(*keys, at.alias("step")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))
    slots = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("step", F.struct("pos", "neg")))).alias("m"))  # steps + 1 entries at most
    grid = slots.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    reach = lambda name, lowest: F.aggregate(F.map_values(F.map_filter("m", lambda k, v: k >= lowest)), F.lit(0).cast("bigint"), lambda a, v: a + v[name])
    tp, fp, p, n = reach("pos", F.col("step")), reach("neg", F.col("step")), reach("pos", F.lit(0)), reach("neg", F.lit(0))
    return grid.select(*keys, (F.col("step") / steps).alias("threshold"), ratio(tp, p).alias("recall"), ratio(fp, n).alias("false_positive_rate"), ratio(tp, tp + fp).alias("precision"))


def benign_thresholds(df: DataFrame, keys: list[str], score: str, caps: list[float] = BENIGN_CAPS) -> DataFrame:
    """(keys, cap, n, allowed, observed, threshold) from benign rows only: the value just above the order statistic
    that leaves at most floor(cap * n) rows at or above. With a cap of 1 every row is allowed and the threshold is the
    lowest score."""
    by_score = df.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(F.count(F.lit(1)).alias("k"))
    by_score = materialise(by_score, "scores")
    up = running_totals(by_score, keys, "threshold", ["k"], descending=True)
    points = _with_totals(up, by_score.groupBy(*keys).agg(F.sum("k").alias("n")), keys)
    every = points.select(*keys, "threshold", "k", "upto_k", "n", F.explode(F.array(*map(F.lit, caps))).alias("cap")).withColumn("allowed", F.floor(F.col("cap") * F.col("n")))
    # the order statistic with `allowed` rows above it, itself not among them
    at = every.where((F.col("upto_k") > F.col("allowed")) & (F.col("upto_k") - F.col("k") <= F.col("allowed")))
    found = at.select(*keys, "cap", "n", "allowed", (F.col("upto_k") - F.col("k")).alias("observed"), next_up(F.col("threshold")).alias("threshold"))
    whole = every.where(F.col("allowed") >= F.col("n")).groupBy(*keys, "cap", "n", "allowed").agg(F.max("upto_k").alias("observed"), F.min("threshold").alias("threshold"))
    return found.unionByName(whole)


def family_recall(df: DataFrame, keys: list[str], family: str, score: str, threshold: Column, known: DataFrame, families: DataFrame) -> DataFrame:
    """Per keys and non-benign family of the codebook: status, rows, hits, missed and recall (null if absent).

    families: (family); known: (family) of the training rows. Keys of df are crossed with the codebook.
    """
    hits = df.groupBy(*keys, family).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(score) >= threshold, 1)).alias("hits"))
    book = families.select(family).where(F.col(family) != "benign").distinct().join(known.select(family, F.lit(True).alias("_known")).distinct(), family, "left")
    # keys and families are a handful each
    every = F.broadcast(book).crossJoin(df.select(*keys).distinct()) if keys else book
    joined = every.join(hits, [*keys, family], "left").fillna(0, ["n", "hits"])
    status = F.when(F.col("_known"), "KNOWN").otherwise("UNSEEN")
    return joined.select(*keys, family, status.alias("status"), "n", "hits", (F.col("n") - F.col("hits")).alias("missed"), F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("recall"))


def family_ranking(df: DataFrame, keys: list[str], family: str, score: str) -> DataFrame:
    """AUC and AP of each family against the benign rows of the same keys. Scores are counted first; benign counts
    are repeated for each family, rows never."""
    counts = materialise(df.groupBy(*keys, family, F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("k")), "scores")
    benign = counts.where(F.col(family) == "benign").drop(family)
    attacks = counts.where(F.col(family) != "benign").withColumn("y", F.lit(1))
    book = attacks.select(*keys, family).distinct()
    against = (benign.join(F.broadcast(book), keys) if keys else benign.crossJoin(F.broadcast(book))).withColumn("y", F.lit(0))  # a handful of families
    rows = attacks.unionByName(against).groupBy(*keys, family, F.col("s").alias("threshold")).agg(F.sum(F.col("y") * F.col("k")).alias("pos"), F.sum((1 - F.col("y")) * F.col("k")).alias("neg"))
    group = [*keys, family]
    up = running_totals(rows, group, "threshold", ["pos", "neg"], descending=True)
    points = _with_totals(up, rows.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")), group)
    tp, fp, pos, neg, p, n = (F.col(c).cast("double") for c in ("upto_pos", "upto_neg", "pos", "neg", "n_pos", "n_neg"))
    return points.groupBy(*group, "n_pos", "n_neg").agg(F.sum(pos / p * ratio(n - fp + neg / 2, n)).alias("roc_auc"), F.sum(pos / p * ratio(tp, tp + fp)).alias("average_precision"))


def calibration_bins(df: DataFrame, keys: list[str], y: str, score: str, bins: int = 20) -> DataFrame:
    """(keys, bin, n, mean_score, observed): equal-width bins of a score in [0, 1]; empty bins are left out."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration(df: DataFrame, keys: list[str], y: str, score: str, bins: int = 20) -> DataFrame:
    """(keys, n, ece, brier, reference, skill): reference is the Brier score of the constant prevalence; skill is
    null where that is 0."""
    cells = calibration_bins(df, keys, y, score, bins)
    gap = cells.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))) / F.sum("n")).alias("ece"))
    t = F.col(y).cast("double")
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) - t) ** 2).alias("brier"), (F.avg(t) * (1 - F.avg(t))).alias("reference"))
    return _with_totals(base, gap, keys).withColumn("skill", F.when(F.col("reference") != 0, 1 - F.col("brier") / F.col("reference")))


def score_summary(df: DataFrame, keys: list[str], score: str, threshold: float = 0.5) -> DataFrame:
    """(keys, n, mean, median, p75, p90, p95, p99, maximum, recall): exact percentiles; recall is the share at or
    above the threshold."""
    names = ["median", "p75", "p90", "p95", "p99"]
    ranks = exact_quantiles(df, keys, score, [0.5, 0.75, 0.9, 0.95, 0.99], names).drop("n")
    rest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.max(score).alias("maximum"), F.avg((F.col(score) >= threshold).cast("double")).alias("recall"))
    return _with_totals(rest, ranks, keys)


def seed_summary(runs: DataFrame, keys: list[str], seed: str, metrics: list[str], seeds: int = 5) -> DataFrame:
    """Mean and sample deviation of each metric over exactly ``seeds`` seeds, one row each; anything else raises."""
    whole = (F.count(F.lit(1)) == seeds) & (F.count_distinct(seed) == seeds)
    checked = F.when(~whole, F.raise_error(F.lit("a metric needs one row for each seed"))).otherwise(F.count_distinct(seed))
    return runs.groupBy(*keys).agg(checked.alias("n_seeds"), *[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))])


def paired_difference(runs: DataFrame, on: list[str], model: str, treated: str, control: str, metrics: list[str]) -> DataFrame:
    """(on, <metric>_delta): treated minus control per pairing; a side without partner, or twice, raises."""
    side = lambda m, tag: runs.where(F.col(model) == m).groupBy(*on).agg(F.count(F.lit(1)).alias(f"n_{tag}"), *[F.first(x).alias(f"{x}_{tag}") for x in metrics])
    both = side(treated, "t").join(side(control, "c"), on, "full")
    paired = F.coalesce((F.col("n_t") == 1) & (F.col("n_c") == 1), F.lit(False))
    delta = lambda x: F.when(~paired, F.raise_error(F.lit("unmatched pairs"))).otherwise(F.col(f"{x}_t") - F.col(f"{x}_c"))
    return both.select(*on, *[delta(x).alias(f"{x}_delta") for x in metrics])


def family_pivot(recalls: DataFrame, keys: list[str], family: str, wanted: list[str]) -> DataFrame:
    """Recall of the wanted families as columns, one row per keys; repeated (keys, family) raise."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated family"))).otherwise(F.first("recall"))
    return recalls.groupBy(*keys).pivot(family, wanted).agg(cell)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """(y, n, weight, pos_weight): N / (2 N_c), and negatives per positive."""
    counts = df.groupBy(F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("_neg"), F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("_pos"))
    return counts.crossJoin(F.broadcast(total)).select("y", "n", (F.col("_n") / (2 * F.col("n"))).alias("weight"), (F.col("_neg") / F.col("_pos")).alias("pos_weight"))  # one row


def cost_summary(runs: DataFrame, seed: str, model: str, costs: list[str]) -> DataFrame:
    """Per model: distinct seeds, mean and maximum of each cost, repeated rows of a seed and model counted once."""
    once = runs.groupBy(seed, model).agg(*[F.min(c).alias(c) for c in costs])
    return once.groupBy(model).agg(F.count_distinct(seed).alias("n_seeds"), *[f(c).alias(f"{c}_{n}") for c in costs for f, n in ((F.avg, "mean"), (F.max, "max"))])


def latency_ms_per_1000(seconds: float, rows: int) -> float:
    """Milliseconds for a thousand rows."""
    if rows <= 0:
        raise ValueError("no rows")
    return seconds / rows * 1e6
