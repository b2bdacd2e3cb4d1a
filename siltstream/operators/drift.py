"""Distribution summaries and shifts of features between partitions: KS, PSI, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.plans.running import exact_quantiles, running_totals
from siltstream.session import materialise, sized

DECILES = [i / 10 for i in range(1, 10)]
LEAST_SHARE = 1e-6


def unpivoted(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """(keep, feature, value): one row per feature; NaN and infinite values become null."""
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double") + F.lit(0.0))
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), real(c).alias("value")) for c in features])))


def feature_summary(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys (with feature among them): rows, observed, missing_rate, mean, population sd, median, p10 to p99, over
    the observed values; statistics are null where nothing was observed."""
    base = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("observed"), (1 - F.count("value") / F.count(F.lit(1))).alias("missing_rate"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    ranks = exact_quantiles(values, keys, "value", [0.1, 0.25, 0.5, 0.75, 0.9, 0.99], ["p10", "p25", "median", "p75", "p90", "p99"]).drop("n")
    return base.join(ranks, keys, "left")


def side_counts(values: DataFrame, keys: list[str], is_reference: Column) -> DataFrame:
    """(keys, value, a, b): rows of the reference and of the other side per value, null among the values; written to
    the shared folder, as every comparison reads it several times."""
    rows = values.withColumn("_a", is_reference.cast("int"))
    return materialise(rows.groupBy(*keys, "value").agg(F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b")), "sides")


def _ks(sides: DataFrame, keys: list[str]) -> DataFrame:
    counts = sides.where("value is not null")
    up = running_totals(counts, keys, "value", ["a", "b"])
    totals = counts.groupBy(*keys).agg(F.sum("a").alias("n_reference"), F.sum("b").alias("n_other"))
    gap = F.abs(F.col("upto_a") / F.col("n_reference") - F.col("upto_b") / F.col("n_other"))
    both = (F.col("n_reference") > 0) & (F.col("n_other") > 0)
    return up.join(sized(totals), keys).groupBy(*keys, "n_reference", "n_other").agg(F.max(F.when(both, gap)).alias("ks"))


def ks_distance(values: DataFrame, keys: list[str], is_reference: Column) -> DataFrame:
    """(keys, n_reference, n_other, ks): the exact two-sample KS distance, ties taken together; null if a side is empty."""
    return _ks(side_counts(values, keys, is_reference), keys)


def psi(values: DataFrame, keys: list[str], is_reference: Column) -> DataFrame:
    """(keys, psi) over the reference's deciles, open at both ends, with a bin of missing values; shares have a floor
    and are scaled again. A constant reference has a bin of its own value. Keys without reference rows are absent."""
    return _psi(side_counts(values, keys, is_reference), keys)


def _psi(sides: DataFrame, keys: list[str]) -> DataFrame:
    names = [f"d{i}" for i in range(1, 10)]
    reference = sides.where("a > 0")
    spread = reference.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    edges = spread.join(exact_quantiles(reference, keys, "value", DECILES, names, weight="a").drop("n"), keys, "left")
    edges = edges.select(*keys, "_low", "_high", F.array_distinct(F.array_compact(F.array(*names))).alias("edges"))
    counts = sides.join(sized(edges), keys)
    constant = F.col("_low") == F.col("_high")
    fixed = F.when(F.col("value") < F.col("_low"), 0).when(F.col("value") == F.col("_low"), 1).otherwise(2)
    cut = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    at = F.when(F.col("value").isNull(), -1).when(constant, fixed).otherwise(cut)
    binned = counts.groupBy(*keys, at.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    last = F.when(F.col("_low") == F.col("_high"), 2).otherwise(F.size("edges"))
    every = edges.select(*keys, F.explode(F.sequence(F.lit(-1), last)).alias("bin")).join(binned, [*keys, "bin"], "left").fillna(0, ["a", "b"])
    totals = binned.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    shares = every.join(totals, keys).withColumns({"pa": F.greatest(F.col("a") / F.col("na"), F.lit(LEAST_SHARE)), "pb": F.greatest(F.col("b") / F.col("nb"), F.lit(LEAST_SHARE))})
    all_bins = Window.partitionBy(*keys)  # a dozen rows
    scaled = shares.withColumns({"pa": F.col("pa") / F.sum("pa").over(all_bins), "pb": F.col("pb") / F.sum("pb").over(all_bins)})
    return scaled.groupBy(*keys).agg(F.sum((F.col("pb") - F.col("pa")) * F.log(F.col("pb") / F.col("pa"))).alias("psi"))


def shift(values: DataFrame, part: str, reference: str, others: list[str]) -> DataFrame:
    """(feature, <part>, ks, psi) of each other partition against the reference partition. Values are counted per
    feature and partition once; the reference counts are repeated per comparison."""
    sides = F.when(F.col(part) == reference, F.array(*map(F.lit, others))).otherwise(F.array(part))
    rows = values.where(F.col(part).isin(reference, *others)).withColumn("_ref", F.col(part) == reference).withColumn(part, F.explode(sides))
    keys = ["feature", part]
    sides = side_counts(rows, keys, F.col("_ref"))
    return _ks(sides, keys).select(*keys, "ks").join(_psi(sides, keys), keys, "full")


def top_shifts(shifts: DataFrame, part: str, most: int = 20) -> DataFrame:
    """The ``most`` features of each partition by KS, then PSI, then name; a null KS counts as 0. Adds rank."""
    order = Window.partitionBy(part).orderBy(F.coalesce("ks", F.lit(0.0)).desc(), F.col("psi").desc(), "feature")
    return shifts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)  # one row per feature


def nearest_reference(values: DataFrame, group: str, target: str, references: list[str]) -> DataFrame:
    """(feature, ks_<reference>..., least, rank): KS of the target group against each reference group, ranked by the
    least of them, largest first."""
    made = None
    for r in references:
        one = ks_distance(values.where(F.col(group).isin(target, r)), ["feature"], F.col(group) == r).select("feature", F.col("ks").alias(f"ks_{r}"))
        made = one if made is None else made.join(one, "feature", "full")
    least = F.least(*[F.col(f"ks_{r}") for r in references]) if len(references) > 1 else F.col(f"ks_{references[0]}")
    return made.withColumn("least", least).withColumn("rank", F.row_number().over(Window.orderBy(F.col("least").desc_nulls_last(), "feature")))  # one row per feature
