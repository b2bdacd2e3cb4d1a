"""Checks as queries: each gives the rows that break a rule, none if it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.operators.cleaning import META, target_alias


def broken(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """(keep, rule): one row per row and rule that is not true; null counts as broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return df.select(*keep, F.explode(found).alias("rule"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with their multiplicity, as side a or b. Counts are compared, copies never paired."""
    sides = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    left = sides.groupBy(*a.columns).agg(F.sum("_s").alias("n")).where("n != 0")
    return left.withColumn("side", F.when(F.col("n") > 0, "a").otherwise("b")).withColumn("n", F.abs("n"))


def set_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, digest_xor, digest_sum): equal for equal multisets of rows, whatever their order."""
    h = F.xxhash64(*columns)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("digest_xor"), F.sum(h.cast("decimal(38,0)")).alias("digest_sum"))


def cleaned_rules(clean: DataFrame, benign: str = "Benign") -> DataFrame:
    """Cleaned rows whose target, time or date disagree with their label and file."""
    return broken(
        clean,
        {
            "target": F.col("target_binary") == (F.coalesce("attack_label", F.lit("")) != benign).cast("tinyint"),
            "time": F.col("timestamp").isNotNull() & (F.year("timestamp") != 1970),
            "date": F.to_date("timestamp") == F.col("file_date"),
        },
        ["source_file", "source_row"],
    )


def leaking_features(features: list[str], excluded: set[str] = frozenset()) -> list[str]:
    """Features that name the target, identify the record or were excluded."""
    return [f for f in features if target_alias(f.split("=")[0]) or f in META or f.split("=")[0] in excluded]


def window_roll_up(narrow: DataFrame, wide: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """Wide windows whose count is not the sum of the narrow ones inside."""
    summed = narrow.groupBy(*keys, F.window(F.col("window_start").cast("timestamp"), f"{minutes} minutes")["start"].alias("window_start")).agg(F.sum("n").alias("_n"))
    both = wide.join(summed, [*keys, "window_start"], "full")
    return both.where(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("_n", F.lit(0)))).select(*keys, "window_start", "n", F.col("_n").alias("sum_of_parts"))


def confusion_identities(metrics: DataFrame, families: DataFrame | None = None, keys: list[str] = ()) -> DataFrame:
    """Metric rows whose counts don't add up to n, or whose true positives are not the families' hits."""
    made = broken(metrics, {"total": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") == F.col("n")}, list(keys))
    if families is None:
        return made
    hits = families.groupBy(*keys).agg(F.sum("hits").alias("_hits"))
    return made.unionByName(broken(metrics.join(hits, list(keys)), {"family_hits": F.col("tp") == F.col("_hits")}, list(keys)))


def close(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(keys, column_name, a, b) where two computations of one number differ by more than the tolerance, or only one
    has it."""
    pairs = lambda df: df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])))
    both = pairs(a).withColumnRenamed("v", "a").join(pairs(b).withColumnRenamed("v", "b"), [*keys, "column_name"], "full")
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return both.where(~same)


def duplicate_links(events: DataFrame, clean: DataFrame, keys: list[str] = ("source_file", "source_row")) -> DataFrame:
    """Duplicate events whose retained row is no clean or set-aside record, or does not come earlier."""
    file, row = keys
    links = events.where("reason = 'exact_duplicate'").select(F.col(file), F.col(row), F.col("retained_source_row").alias("_kept"))
    known = clean.select(F.col(file), F.col(row).alias("_kept"), F.lit(1).alias("_known")).distinct()
    joined = links.join(known, [file, "_kept"], "left")
    return joined.where(F.col("_known").isNull() | F.col("_kept").isNull() | (F.col("_kept") >= F.col(row))).select(file, row, F.col("_kept").alias("retained_source_row"))
