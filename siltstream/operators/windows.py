"""Tumbling time windows: counts, filled gaps, recurring pairs, timelines and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.plans.running import exact_quantiles



def window_start(time: Column, minutes: int) -> Column:
    """Start of the clock-aligned window of a time."""
    return F.window(time.cast("timestamp"), f"{minutes} minutes")["start"]


def window_counts(df: DataFrame, keys: list[str], time: str, minutes: int, malicious: Column) -> DataFrame:
    """(keys, window_start, n, n_malicious) of the windows that hold rows; null times are left out."""
    rows = df.where(F.col(time).isNotNull()).withColumn("window_start", window_start(F.col(time), minutes))
    return rows.groupBy(*keys, "window_start").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(malicious, 1)).alias("n_malicious"))


def rolled_up(counts: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """Counts of narrow windows as counts of wider ones, whose width is a multiple."""
    wide = counts.withColumn("window_start", window_start(F.col("window_start"), minutes))
    return wide.groupBy(*keys, "window_start").agg(F.sum("n").alias("n"), F.sum("n_malicious").alias("n_malicious"))


def filled(counts: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """counts with rows of 0 for the empty windows between the first and last of each key and observed date."""
    span = counts.groupBy(*keys, F.to_date("window_start").alias("_day")).agg(F.min("window_start").alias("_a"), F.max("window_start").alias("_b"))
    every = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {minutes} minutes"))).alias("window_start"))
    joined = every.join(counts, [*keys, "window_start"], "left")
    return joined.fillna(0, [c for c in counts.columns if c not in (*keys, "window_start")])


def pair_recurrence(df: DataFrame, time: str, source: str, target: str, minutes: int) -> DataFrame:
    """Per window: flows, directed pairs, pairs seen again, flows in those, extra flows, most flows of a pair and the
    percentage in repeated pairs. Pairs with a null end are left out. Two steps, so a hot pair is combined early."""
    rows = df.where(F.col(time).isNotNull() & F.col(source).isNotNull() & F.col(target).isNotNull())
    pairs = rows.groupBy(window_start(F.col(time), minutes).alias("window_start"), source, target).agg(F.count(F.lit(1)).alias("n"))
    many = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    return (
        pairs.groupBy("window_start")
        .agg(
            F.sum("n").alias("flows"),
            F.count(F.lit(1)).alias("unique_pairs"),
            F.count(F.when(F.col("n") > 1, 1)).alias("repeated_pairs"),
            F.sum(many).alias("flows_in_repeated"),
            F.sum(F.col("n") - 1).alias("extra_flows"),
            F.max("n").alias("max_flows_per_pair"),
        )
        .withColumn("repeated_percentage", 100 * F.col("flows_in_repeated") / F.col("flows"))
    )


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per keys: n, min, median, mean, p95 and max, percentiles exact and linear. Nulls are left out."""
    ranks = exact_quantiles(df, keys, value, [0.5, 0.95], ["median", "p95"])
    x = F.col(value)
    rest = df.where(x.isNotNull()).groupBy(*keys).agg(F.min(x).alias("minimum"), F.avg(x).alias("mean"), F.max(x).alias("maximum"))
    return rest.join(ranks, keys) if keys else rest.crossJoin(F.broadcast(ranks))  # one row each


def timeline(df: DataFrame, time: str, minutes: int, malicious: Column, source: str, target: str) -> DataFrame:
    """Per window, empty ones between the first and last of a date too: benign, malicious and all rows, distinct
    sources and targets."""
    rows = df.where(F.col(time).isNotNull()).withColumn("window_start", window_start(F.col(time), minutes))
    counts = rows.groupBy("window_start").agg(
        F.count(F.when(~malicious, 1)).alias("n_benign"), F.count(F.when(malicious, 1)).alias("n_malicious"), F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("n_sources"), F.count_distinct(target).alias("n_targets")
    )
    return filled(counts, [], minutes)


def episodes(counts: DataFrame, minutes: int, active: Column) -> DataFrame:
    """(episode_start, episode_end, n_windows, n): runs of adjacent active windows; the end is exclusive.

    Islands are found per day first and merged where days touch, so no window of all rows is ordered in one task.
    """
    unit = minutes * 60
    on = counts.where(active).select(F.floor(F.unix_seconds("window_start") / unit).alias("at"), "n").withColumn("part", F.floor(F.col("at") * unit / 86_400))
    inside = Window.partitionBy("part").orderBy("at")
    islands = on.withColumn("island", F.col("at") - F.row_number().over(inside)).groupBy("part", "island").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    # one row per island of a day: far fewer than rows, and ordered by day
    order = Window.orderBy("a")
    apart = F.coalesce((F.col("a") != F.lag("b").over(order) + 1).cast("int"), F.lit(1))
    merged = islands.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seconds = lambda c: F.timestamp_seconds(c * unit)
    return merged.groupBy("run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("k").alias("n_windows"), F.sum("n").alias("n")).select(seconds(F.col("a")).alias("episode_start"), seconds(F.col("b") + 1).alias("episode_end"), "n_windows", "n")


def sliding_counts(df: DataFrame, time: str, size: int, slide: int) -> DataFrame:
    """(window_start, n) of overlapping windows of ``size`` minutes every ``slide`` minutes."""
    rows = df.where(F.col(time).isNotNull()).select(F.window(F.col(time).cast("timestamp"), f"{size} minutes", f"{slide} minutes")["start"].alias("window_start"))
    return rows.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


def session_counts(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's rows less than ``gap`` minutes apart."""
    rows = df.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(key, F.col(time).cast("timestamp").alias("_t"))
    made = rows.groupBy(key, F.session_window("_t", f"{gap} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
