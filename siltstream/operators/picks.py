"""Picking rows: seeded samples, per-group samples, thinning of an ordered column, allowed criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.operators.keyed_chunks import number_rows
from siltstream.plans.running import running_totals
from siltstream.session import materialise, sized


def drawn_by(key: str, seed: int, portable: bool = False) -> Column:
    """The seeded hash of a unique key by which rows are drawn; the portable one is a digest that other engines have too."""
    return F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))) if portable else F.xxhash64(F.lit(seed), key)


def uniform_sample(df: DataFrame, key: str, size: int, seed: int, portable: bool = False) -> DataFrame:
    """``size`` rows without replacement, the first by a seeded hash of the unique key; all rows if there are fewer.
    Each task keeps only its own first rows before they are merged."""
    return df.orderBy(drawn_by(key, seed, portable), key).limit(size)


def group_sample(df: DataFrame, groups: list[str], key: str, size: int, seed: int, portable: bool = False) -> DataFrame:
    """At most ``size`` rows of each group, by a seeded hash of the unique key. Null groups are a group."""
    rows = number_rows(df.withColumn("_chance", drawn_by(key, seed, portable)), groups, ["_chance", key])
    return rows.where(F.col("_row") < size).select(df.columns)


def thinned(df: DataFrame, keys: list[str], value: str, points: int) -> DataFrame:
    """(keys, rank, value, share): at most ``points`` order statistics per keys, evenly spaced from the first to the
    last, with the share of rows up to their 0-based rank. Nulls are left out."""
    counts = materialise(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    up = running_totals(counts, keys, "value", ["_n"])
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    joined = up.join(sized(totals), keys) if keys else up.crossJoin(F.broadcast(totals))  # one row
    k = F.least(F.lit(points), F.col("_all"))
    at = lambda i: F.floor((F.col("_all") - 1) * i / F.greatest(k - 1, F.lit(1)))
    ranks = F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), at))
    start = F.col("upto__n") - F.col("_n")
    here = F.filter(ranks, lambda r: (r >= start) & (r < F.col("upto__n")))
    return joined.select(*keys, F.explode(here).alias("rank"), "value", "_all").select(*keys, "rank", "value", ((F.col("rank") + 1) / F.col("_all")).alias("share"))


def allowed(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the table lists, as models and their criteria."""
    return df.join(table.select(*keys).distinct(), keys, "left_semi")
