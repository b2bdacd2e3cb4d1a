"""Audit of raw records: value quality, types, constants, duplicates, time anomalies, roll-ups over scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.functions.text import NAN_TOKENS, NULL_TOKENS, category, number, token_class, trimmed
from siltstream.operators.keyed_chunks import block_bounds, default_blocks, in_block, number_rows

COUNTED = ["missing", "nan", "null_marker", "infinite", "number", "other"]


def label_status(label: Column, rule: str = "folded") -> Column:
    """benign, malicious or unclassified.

    folded: blank, null tokens and the header token are unclassified, benign in any case is benign. exact: only
    'Benign' is benign, 'Label' and blanks are unclassified. header_as_attack: as exact, but anything else is
    malicious, header tokens too, an old rule kept for comparison. Null counts as blank.
    """
    text = F.coalesce(label, F.lit(""))
    if rule == "folded":
        key = category(text)
        absent = (key == "") | key.isin("label", *NAN_TOKENS, *NULL_TOKENS)
        return F.when(absent, "unclassified").when(key == "benign", "benign").otherwise("malicious")
    if rule == "exact":
        return F.when(text == "Benign", "benign").when((trimmed(text) == "") | (text == "Label"), "unclassified").otherwise("malicious")
    if rule == "header_as_attack":
        return F.when(text == "Benign", "benign").otherwise("malicious")
    raise ValueError(f"unknown rule {rule}")


def _unpivoted(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("raw")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def value_profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per keys and column: rows, the count of each class of token, whether a number has a fraction, the number of
    distinct raw values up to 2 as is_constant, and of those that stand for a value as is_constant_value.

    A column that is all null is constant. Header tokens (the column's own name) count as text but not as a value.
    """
    rows = _unpivoted(df, keys, columns).withColumn("kind", token_class(F.col("raw"))).withColumn("v", number(F.col("raw")))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in COUNTED]
    null = F.count(F.when(F.col("raw").isNull(), 1))
    spread = F.min("raw").eqNullSafe(F.max("raw")) & ((null == 0) | (null == F.count(F.lit(1))))
    value = F.when(~F.col("kind").isin("missing", "nan", "null_marker") & (F.col("raw") != F.col("column_name")), F.col("raw"))
    return rows.groupBy(*keys, "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *counts,
        F.coalesce(F.bool_or(F.col("v") % 1 != 0), F.lit(False)).alias("has_fraction"),
        spread.alias("is_constant"),
        (F.min(value).isNotNull() & (F.min(value) == F.max(value))).alias("is_constant_value"),
    )


def content_types(profile: DataFrame) -> DataFrame:
    """value_profile with content_type: string, mixed, float64, integer or missing-only."""
    some = (F.col("n_number") > 0) | (F.col("n_infinite") > 0)
    real = F.col("has_fraction") | (F.col("n_infinite") > 0) | (F.col("n_nan") > 0)
    kind = F.when((F.col("n_other") > 0) & some, "mixed numeric/string").when(F.col("n_other") > 0, "string").when(some & real, "float64").when(some, "integer").otherwise("missing-only")
    return profile.withColumn("content_type", kind)


def special_values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column_name, kind, n): nan, positive_infinity and negative_infinity tokens; none for absent kinds."""
    rows = _unpivoted(df, keys, columns).withColumn("token", F.lower(trimmed(F.col("raw"))))
    signed = F.when(F.col("token").startswith("-"), "negative_infinity").otherwise("positive_infinity")
    kind = F.when(F.col("token").isin(NAN_TOKENS), "nan").when(F.col("token").rlike(r"^[+-]?inf(inity)?$"), signed)
    return rows.withColumn("kind", kind).where("kind is not null").groupBy(*keys, "column_name", "kind").agg(F.count(F.lit(1)).alias("n"))


def repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of df whose columns occur more than once, nulls equal. Hashes pick candidates, so that only those
    rows are moved whole; equal columns are then counted exactly and copies never gathered."""
    hashed = df.withColumn("_h", F.xxhash64(*columns))
    twice = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    return hashed.join(twice, "_h", "left_semi").drop("_h")


def later_copies(df: DataFrame, group: str, columns: list[str], order: str) -> DataFrame:
    """(group, order, retained): every row that repeats an earlier one of its group in all columns, as raw text,
    with the order of the first. Ties in order are impossible where (group, order) is unique."""
    candidates = repeated(df.select(group, order, *[c for c in columns if c not in (group, order)]), [group, *columns]).withColumn("_key", F.struct(group, *columns))
    first = candidates.groupBy("_key").agg(F.min(order).alias("retained"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return candidates.join(first, "_key").where(F.col(order) > F.col("retained")).select(group, order, "retained")


def duplicate_summary(df: DataFrame, group: str, columns: list[str], label: str) -> DataFrame:
    """Per group and label: rows, extra occurrences, duplicate groups, all occurrences in them."""
    rows = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n_rows"))
    keys = list(dict.fromkeys([group, label, *columns]))
    sets = repeated(df.select(*keys), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = sets.groupBy(F.struct(group, label).alias("_k")).agg(F.sum(F.col("n") - 1).alias("extra_occurrences"), F.count(F.lit(1)).alias("duplicate_groups"), F.sum("n").alias("all_occurrences"))
    joined = rows.withColumn("_k", F.struct(group, label)).join(found, "_k", "left").drop("_k")
    return joined.fillna(0, ["extra_occurrences", "duplicate_groups", "all_occurrences"])


def scoped_counts(df: DataFrame, file: str, label: str, status: str) -> DataFrame:
    """(scope, file, label, status, n, denominator, percentage) over files and classes, files, classes, statuses
    and the whole: one pass by grouping sets. The denominator is the file's rows, or all rows."""
    rows = df.groupingSets([[file, label, status], [file], [label, status], [status], []], file, label, status).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(file, label, status).alias("g"))
    scope = F.when(F.col("g") == 0, "file_class").when(F.col("g") == 3, "file_total").when(F.col("g") == 4, "dataset_class").when(F.col("g") == 6, "dataset_status").otherwise("dataset_total")
    of_file = rows.where("g = 3").select(F.col(file).alias("_f"), F.col("n").alias("_fn"))
    of_all = rows.where("g = 7").select(F.col("n").alias("_all"))
    joined = rows.join(of_file, F.col(file).eqNullSafe(F.col("_f")) & F.col("g").isin(0, 3), "left").crossJoin(F.broadcast(of_all))  # one row
    total = F.when(F.col("g").isin(0, 3), F.col("_fn")).otherwise(F.col("_all"))
    return joined.select(scope.alias("scope"), file, label, status, "n", total.alias("denominator"), (100 * F.col("n") / total).alias("percentage"))


def backward_transitions(df: DataFrame, group: str, order: str, time: str, label: str) -> DataFrame:
    """(group, previous_time, time, label, n, backward_seconds): steps from a row's time back to before the last
    non-null time above it in order; null times are passed over. A group's rows are cut into blocks of the order
    column, a bigint, and the last time of the blocks before is carried into each."""
    data = df.select(F.struct(group).alias("_key"), order, F.col(time).alias("_t"), label)
    rows = data.withColumn("_block", in_block(F.col(order), block_bounds(data, order, default_blocks(df.sparkSession))))
    last = rows.where("_t is not null").groupBy("_key", "_block").agg(F.max_by("_t", order).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and block, also for blocks without a time
    carried = rows.groupBy("_key", "_block").agg(F.count(F.lit(1)).alias("_n")).join(last, ["_key", "_block"], "left").select("_key", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    above = Window.partitionBy("_key", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_above", F.last("_t", ignorenulls=True).over(above)).join(carried, ["_key", "_block"])
    steps = inside.select(F.col(f"_key.{group}").alias(group), F.coalesce("_above", "_carried").alias("previous_time"), F.col("_t").alias(time), label).where(F.col(time) < F.col("previous_time"))
    seconds = F.unix_seconds(F.col("previous_time").cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp"))
    return steps.groupBy(group, "previous_time", time, label).agg(F.count(F.lit(1)).alias("n")).withColumn("backward_seconds", seconds)


def time_anomaly(time: Column, expected: Column) -> Column:
    """unparseable_timestamp, year_1970, date_mismatch or null; a null expected date mismatches nothing."""
    return F.when(time.isNull(), "unparseable_timestamp").when(F.year(time) == 1970, "year_1970").when(F.to_date(time) != expected, "date_mismatch")


def anomaly_context(df: DataFrame, group: str, order: str, time: str, expected: str, label: str, span: int = 3) -> DataFrame:
    """(group, order, anomaly_type, label, preceding, following, preceding_min, following_max) of each row with an
    anomalous time: the orders of up to ``span`` rows on either side, and the range of their times. Rows are
    numbered within their group by chunks, and only neighbours of anomalies are joined."""
    rows = number_rows(df.select(group, order, F.col(time).alias("_t"), expected, label), [group], order).select(group, order, "_t", expected, label, "_row")
    rows = rows.withColumn("anomaly_type", time_anomaly(F.col("_t"), F.col(expected)))
    found = rows.where("anomaly_type is not null").select(group, F.col(order).alias("_own"), "anomaly_type", F.col(label).alias("_label"), F.col("_row").alias("_at"))
    near = found.withColumn("_step", F.explode(F.array(*[F.lit(k) for k in range(-span, span + 1)]))).withColumn("_row", F.col("_at") + F.col("_step"))
    joined = near.join(rows.select(group, "_row", order, "_t"), [group, "_row"])
    before, after = F.col("_step") < 0, F.col("_step") > 0
    side = lambda k: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(k, F.struct("_step", order)))), lambda x: x[order].cast("string")))
    made = joined.groupBy(group, "_own", "anomaly_type", "_label").agg(side(before).alias("preceding"), side(after).alias("following"), F.min(F.when(before, F.col("_t"))).alias("preceding_min"), F.max(F.when(after, F.col("_t"))).alias("following_max"))
    return made.withColumnsRenamed({"_own": order, "_label": label})


def file_times(df: DataFrame, group: str, time: str, expected: str) -> DataFrame:
    """Per group: rows, valid and invalid times, first and last, distinct times, rows beyond one a second, anomalies."""
    kind = time_anomaly(F.col(time), F.col(expected))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(time).alias("n_timed"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.count_distinct(time).alias("n_times"),
        (F.count(time) - F.count_distinct(time)).alias("same_time_extra"),
        *[F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in ("unparseable_timestamp", "year_1970", "date_mismatch")],
    )


def cardinalities(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, column_name, n_distinct): exact distinct non-null values. Distinct pairs are counted, so neither a hot
    value nor a hot group meets in one task."""
    rows = _unpivoted(df, [group], columns).where("raw is not null").distinct()
    return rows.groupBy(group, "column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def shares(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, column, n, percentage): histogram of a column with percentages of its group."""
    counts = df.groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percentage", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))
