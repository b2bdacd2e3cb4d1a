"""Chronological train, validation and test splits by whole dates or by elapsed time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ["train", "validation", "test"]


@dataclass
class SplitSpec:
    minimum_dates: tuple[int, int, int] = (3, 1, 2)
    minimum_benign: int = 100
    minimum_malicious: int = 100
    fractions: tuple[float, float, float] = (0.8, 0.1, 0.1)
    benign: str = "benign"


def split_candidates(distribution: DataFrame, spec: SplitSpec) -> DataFrame:
    """Every cut of the dates into three blocks that meets the minima, ranked: most attack classes in training, then
    least deviation from the fractions, then the earliest cuts.

    distribution: (file_date, label, n), whole dates with their class counts, a small table that the rows reduce to.
    """
    benign = F.col("label") == spec.benign
    by_date = distribution.groupBy("file_date").agg(F.sum("n").alias("n"), F.sum(F.when(benign, F.col("n")).otherwise(0)).alias("b"))
    order = Window.orderBy("file_date")  # one row per date
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    dates = by_date.select("file_date", F.row_number().over(order).alias("i"), F.sum("n").over(upto).alias("n"), F.sum("b").over(upto).alias("b"), F.lead("file_date").over(order).alias("after"), F.count(F.lit(1)).over(Window.partitionBy()).alias("days"), F.sum("n").over(Window.partitionBy()).alias("all_n"), F.sum("b").over(Window.partitionBy()).alias("all_b"))
    first = distribution.where(~benign & (F.col("n") > 0)).groupBy("label").agg(F.min("file_date").alias("first"))
    seen = dates.join(first, F.col("first") <= F.col("file_date"), "left").groupBy("i").agg(F.count("label").alias("classes"))
    a = dates.join(seen, "i").select(F.col("i").alias("i1"), F.col("file_date").alias("train_end"), F.col("after").alias("validation_start"), F.col("n").alias("n1"), F.col("b").alias("b1"), F.col("classes").alias("training_attack_classes"))
    z = dates.select(F.col("i").alias("i2"), F.col("file_date").alias("validation_end"), F.col("after").alias("test_start"), F.col("n").alias("n2"), F.col("b").alias("b2"), "days", "all_n", "all_b")
    pairs = a.join(z, F.col("i1") < F.col("i2"))
    rows = [F.col("n1"), F.col("n2") - F.col("n1"), F.col("all_n") - F.col("n2")]
    good = [F.col("b1"), F.col("b2") - F.col("b1"), F.col("all_b") - F.col("b2")]
    span = [F.col("i1"), F.col("i2") - F.col("i1"), F.col("days") - F.col("i2")]
    for r, b, s, least in zip(rows, good, span, spec.minimum_dates):
        pairs = pairs.where((s >= least) & (b >= spec.minimum_benign) & (r - b >= spec.minimum_malicious))
    error = sum((F.abs(r / F.col("all_n") - f) for r, f in zip(rows, spec.fractions)), F.lit(0.0))
    made = pairs.select("train_end", "validation_start", "validation_end", "test_start", "training_attack_classes", F.round(error, 12).alias("fraction_absolute_error"), *[r.alias(f"{p}_rows") for p, r in zip(PARTS, rows)], *[b.alias(f"{p}_benign") for p, b in zip(PARTS, good)])
    rank = Window.orderBy(F.desc("training_attack_classes"), "fraction_absolute_error", "train_end", "validation_end")
    return made.withColumn("rank", F.row_number().over(rank))  # at most dates squared


def chosen_split(distribution: DataFrame, spec: SplitSpec) -> dict:
    """The first candidate; raises if there is none."""
    best = split_candidates(distribution, spec).where("rank = 1").first()
    if best is None:
        raise ValueError("No chronological split meets the minima")
    return best.asDict()


def part_of(day: Column, train_end: Column, validation_end: Column) -> Column:
    return F.when(day <= train_end, "train").when(day <= validation_end, "validation").otherwise("test")


def half_open(value: Column, first: Column, second: Column) -> Column:
    """0 below first, 1 from first to below second, 2 from second on."""
    return F.when(value < first, 0).when(value < second, 1).otherwise(2)


def elapsed_bounds(df: DataFrame, time: str, fractions: tuple[float, float], minutes: int = 10) -> DataFrame:
    """(first, second): boundaries at fractions of the elapsed time, rounded half up to whole ``minutes``. One row."""
    unit = minutes * 60_000_000
    ends = df.agg(F.min(F.unix_micros(F.col(time).cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col(time).cast("timestamp"))).alias("b"))
    at = lambda f: F.timestamp_micros((F.floor((F.col("a") + (F.col("b") - F.col("a")) * f) / unit + 0.5) * unit).cast("bigint"))
    return ends.select(at(fractions[0]).alias("first"), at(fractions[1]).alias("second"))


def elapsed_split(df: DataFrame, time: str, fractions: tuple[float, float], minutes: int = 10) -> DataFrame:
    """df, without rows of null time, with part 0, 1 or 2 by elapsed time."""
    bounds = F.broadcast(elapsed_bounds(df, time, fractions, minutes))  # one row
    rows = df.where(F.col(time).isNotNull()).crossJoin(bounds)
    return rows.withColumn("part", half_open(F.col(time).cast("timestamp"), F.col("first"), F.col("second"))).drop("first", "second")


def split_summary(df: DataFrame, part: str, time: str, malicious: Column, keys: list[str]) -> DataFrame:
    """Per part: rows, benign, malicious, fraction of all, first and last time, and a digest of the keys that depends
    on the set of rows only, not on their labels."""
    made = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~malicious, 1)).alias("benign"), F.count(F.when(malicious, 1)).alias("malicious"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.bit_xor(F.xxhash64(*keys)).alias("digest"))
    return made.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per part


def coverage(df: DataFrame, part: str, label: str, train: str = "train") -> DataFrame:
    """(part, label, n, present, seen_in_training, fraction) for every part and class, absent ones too."""
    counts = df.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
    every = counts.select(part).distinct().crossJoin(F.broadcast(counts.select(label).distinct()))  # classes: a few
    seen = counts.where(F.col(part) == train).select(label, F.lit(True).alias("seen_in_training"))
    joined = every.join(counts, [part, label], "left").join(seen, label, "left").fillna(0, ["n"])
    return joined.select(part, label, "n", (F.col("n") > 0).alias("present"), F.coalesce("seen_in_training", F.lit(False)).alias("seen_in_training"), (F.col("n") / F.sum("n").over(Window.partitionBy(part))).alias("fraction"))


def unseen_labels(df: DataFrame, part: str, label: str, train: str = "train") -> DataFrame:
    """(part, label) of classes that the training part lacks."""
    pairs = df.select(part, label).distinct()
    return pairs.where(F.col(part) != train).join(pairs.where(F.col(part) == train).select(label), label, "left_anti").select(part, label)


def membership(df: DataFrame, part: Column, meta: list[str]) -> DataFrame:
    """The identifying columns of every row with its part."""
    return df.select(*meta, part.alias("part"))


def out_of_order(df: DataFrame, keys: list[str], position: str, time: str, row: str) -> DataFrame:
    """Rows of a stored order that come before their predecessor in time, or, at the same time, in row number."""
    order = Window.partitionBy(*keys).orderBy(position)
    p = F.lag(F.struct(time, row)).over(order)
    return df.where(F.col(time).isNotNull()).withColumn("_p", p).where((F.col(time) < F.col(f"_p.{time}")) | ((F.col(time) == F.col(f"_p.{time}")) & (F.col(row) <= F.col(f"_p.{row}")))).drop("_p")


def elapsed_candidates(df: DataFrame, time: str, malicious: Column, choices: list[tuple[float, float]], minutes: int = 10) -> DataFrame:
    """(train_share, validation_end, part, n, malicious): what splits at several pairs of fractions would hold."""
    made = None
    for first, second in choices:
        rows = elapsed_split(df.withColumn("_m", malicious), time, (first, second), minutes)
        one = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_m"), 1)).alias("malicious")).select(F.lit(first).alias("train_share"), F.lit(second).alias("validation_end"), "part", "n", "malicious")
        made = one if made is None else made.unionByName(one)
    return made
