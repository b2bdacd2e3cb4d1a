"""Combining two detectors: ECDF normalisation, MAX and weighted scores, OR decisions, overlap, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.plans.running import running_totals
from siltstream.session import materialise

WEIGHTS = [0.25, 0.5, 0.75]


def ecdf(df: DataFrame, score: str, is_reference: Column, name: str) -> DataFrame:
    """df with the share of reference scores at or below each row's score: 0 below all, 1 from the greatest on. Null
    scores get null; an empty reference gives null."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_v")).agg(F.sum(is_reference.cast("int")).alias("_n"))
    counts = materialise(counts, "counts")
    up = running_totals(counts, [], "_v", ["_n"])
    total = counts.agg(F.sum("_n").alias("_all"))
    table = up.crossJoin(F.broadcast(total)).select("_v", F.when(F.col("_all") > 0, F.col("upto__n") / F.col("_all")).alias(name))  # one row
    return df.join(table, F.col(score) == F.col("_v"), "left").drop("_v")


def fused(df: DataFrame, a: str, b: str, weights: list[float] = WEIGHTS) -> DataFrame:
    """df with maximum and weighted_<100 w> = w a + (1 - w) b of two scores on one scale."""
    return df.withColumns({"maximum": F.greatest(a, b), **{f"weighted_{round(100 * w)}": w * F.col(a) + (1 - w) * F.col(b) for w in weights}})


def either(a: Column, at_a: Column, b: Column, at_b: Column) -> Column:
    """Decision of two detectors at their own thresholds."""
    return (a >= at_a) | (b >= at_b)


def overlap(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """(keys, n, both, only_a, only_b, neither, jaccard): jaccard is null where neither decides for any row."""
    n = lambda c: F.count(F.when(c, 1))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n(a & b).alias("both"), n(a & ~b).alias("only_a"), n(~a & b).alias("only_b"), n(~a & ~b).alias("neither"))
    union = F.col("both") + F.col("only_a") + F.col("only_b")
    return counts.withColumn("jaccard", F.when(union > 0, F.col("both") / union))


def mid_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the average rank of each row's value within its keys."""
    counts = materialise(df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    ranks = running_totals(counts, keys, "_v", ["_n"]).select(*keys, "_v", (F.col("upto__n") - (F.col("_n") - 1) / 2).alias(name))
    same = F.col(value).cast("double") == F.col("_v")
    for k in keys:
        same = same & (df[k] == ranks[k])
    return df.join(ranks, same).select(df["*"], name)


def correlations(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, pearson, spearman) over rows with both values; null where a side is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = mid_ranks(mid_ranks(rows, keys, a, "_ra"), keys, b, "_rb")
    # the built-in correlation fails for a constant side
    related = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), related(a, b).alias("pearson"), related("_ra", "_rb").alias("spearman"))


def compared_to(metrics: DataFrame, keys: list[str], model: str, base: str, names: list[str]) -> DataFrame:
    """metrics with <name>_delta against the base model of the same keys."""
    own = metrics.where(F.col(model) == base).select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    return metrics.join(own, keys, "left").withColumns({f"{n}_delta": F.col(n) - F.col(f"_{n}") for n in names}).drop(*[f"_{n}" for n in names])
