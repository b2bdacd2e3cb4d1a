"""Strided target cohorts and trailing sequences of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.operators.keyed_chunks import number_rows

WARM_UP = 63
#: Rows of a block in which sequences are gathered; each block also holds the rows that reach into it.
BLOCK_ROWS = 50_000


def slot_targets(df: DataFrame, keys: list[str], second: str, row: str, stride: Column, slot: int = 60, offset: int = 30) -> DataFrame:
    """The rows at or past ``offset`` seconds of their slot, every stride-th of each slot and keys in order of second
    and row, the first among them. Adds slot. The stride starts anew in each slot."""
    late = df.withColumn("slot", F.floor(F.col(second) / slot)).where(F.pmod(F.col(second), F.lit(slot)) >= offset)
    numbered = number_rows(late, [*keys, "slot"], [second, row])
    return numbered.where(F.col("_row") % stride == 0).drop("_key", "_block", "_row", "_chunk")


def day_positions(df: DataFrame, day: str, time: str, row: str) -> DataFrame:
    """df with position, 0-based within its day in order of time and row. Rows without time are left out. Times are
    ordered as microseconds."""
    timed = df.where(F.col(time).isNotNull()).withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    return number_rows(timed, [day], ["_us", row]).withColumnRenamed("_row", "position").drop("_key", "_block", "_chunk", "_us")


def day_targets(positioned: DataFrame, stride: Column, warm_up: int = WARM_UP) -> DataFrame:
    """The rows past the first ``warm_up`` of their day, every stride-th from there."""
    at = F.col("position") - warm_up
    return positioned.where((at >= 0) & (at % stride == 0))


def trailing(positioned: DataFrame, day: str, values: list[str], length: int, wanted: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The wanted rows of day_positions with sequence: the values of the ``length`` rows up to and with each, oldest
    first, none from another day; shorter at a day's start.

    Days are cut into blocks of positions; the last length - 1 rows of a block also stand before the next one, so a
    sequence needs no whole day in one task and is taken before the targets are chosen.
    """
    block = F.floor(F.col("position") / block_rows)
    into_next = (F.col("position") % block_rows) >= block_rows - (length - 1)
    copies = F.explode(F.when(into_next & F.lit(length > 1), F.array(block, block + 1)).otherwise(F.array(block))).alias("_b")
    rows = positioned.select("*", block.alias("_own"), copies)
    frame = Window.partitionBy(day, "_b").orderBy("position").rowsBetween(-(length - 1), 0)
    made = rows.withColumn("sequence", F.collect_list(F.struct(*values)).over(frame))
    return made.where((F.col("_own") == F.col("_b")) & wanted).drop("_own", "_b")


def cohort_violations(positioned: DataFrame, targets: DataFrame, day: str, time: str, length: int) -> DataFrame:
    """(day, position, problem) of targets whose sequence would leave their day, or of a time of 1970 or another day."""
    problem = F.when(F.year(time) == 1970, "year_1970").when(F.to_date(F.col(time)) != F.col(day), "day_mismatch").when(F.col("position") - (length - 1) < 0, "before_day_start")
    return targets.withColumn("problem", problem).where("problem is not null").select(day, "position", "problem")


def matched_scores(cohort: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """cohort with the score of its own record, by key; raises where a record has no score or several."""
    single = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(score).alias("_s"))
    joined = cohort.join(single, keys, "left")
    checked = F.when(F.coalesce(F.col("_n"), F.lit(0)) != 1, F.raise_error(F.lit("a record needs exactly one score")).cast("double")).otherwise(F.col("_s"))
    return joined.withColumn(score, checked).drop("_n", "_s")
