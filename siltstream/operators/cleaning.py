"""Raw records to clean, quarantined and removed ones, with every record accounted for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.functions.text import INFINITE, NAN_TOKENS, NULL_TOKENS, NUMBER, trimmed
from siltstream.operators.audit import later_copies

#: Words in a column's name that tie it to the target.
TARGET_WORDS = {"label", "target", "attack", "class", "benign", "malicious", "prediction"}
META = ["source_file", "source_row", "timestamp", "file_date", "attack_label", "target_binary"]


def target_alias(name: str) -> bool:
    """Whether a column's name has a word that gives the target away."""
    return bool(TARGET_WORDS & set(re.findall(r"[a-z]+", name.lower())))


def common_schema(headers: list[list[str]], identifiers: set[str], keep: set[str] = frozenset()) -> tuple[list[str], dict[str, str]]:
    """The columns that all files have, in the first file's order, without identifiers and target names; and the
    reason for each column left out. Columns in keep, the label and time among them, are not features."""
    if not headers:
        return [], {}
    shared = set(headers[0]).intersection(*headers[1:])
    reasons: dict[str, str] = {}
    for name in dict.fromkeys(c for h in headers for c in h):
        if name in keep:
            continue
        if name not in shared:
            reasons[name] = "not in every file"
        elif name in identifiers:
            reasons[name] = "identifier"
        elif target_alias(name):
            reasons[name] = "names the target"
    return [c for c in headers[0] if c in shared and c not in reasons and c not in keep], reasons


def present(value: Column) -> Column:
    """Null for tokens that stand for no value."""
    token = F.lower(trimmed(value))
    return F.when((token != "") & ~token.isin(NAN_TOKENS + NULL_TOKENS), value)


def strict_number(value: Column, name: str, infinite: bool) -> Column:
    """A raw text as a number: absent tokens are null, infinities null if the column may hold them; anything else that
    is no number raises, when the row is used."""
    token = F.lower(trimmed(present(value)))
    bad = F.raise_error(F.concat(F.lit(f"{name} is no number: "), token)).cast("double")
    endless = F.lit(None).cast("double") if infinite else F.raise_error(F.lit(f"{name} is infinite")).cast("double")
    return F.when(token.isNull(), None).when(token.rlike(NUMBER), token.try_cast("double")).when(token.rlike(INFINITE), endless).otherwise(bad)


@dataclass
class CleaningSpec:
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    may_be_infinite: set[str] = field(default_factory=set)
    label: str = "Label"
    benign: str = "Benign"


def classify(raw: DataFrame, is_header: Column, record: list[str], time: Column, day: Column) -> DataFrame:
    """raw (with source_file and source_row, together unique) with reason and retained_source_row.

    In this order: repeated_header, exact_duplicate (of an earlier row of the file that is no header, in all columns
    of record as raw text), invalid_timestamp, year_1970, date_mismatch; null for rows that stay.
    """
    headed = raw.withColumn("_header", F.coalesce(is_header, F.lit(False)))
    copies = later_copies(headed.where("not _header"), "source_file", record, "source_row").withColumnRenamed("retained", "retained_source_row")
    joined = headed.join(copies, ["source_file", "source_row"], "left")
    reason = (
        F.when(F.col("_header"), "repeated_header")
        .when(F.col("retained_source_row").isNotNull(), "exact_duplicate")
        .when(time.isNull(), "invalid_timestamp")
        .when(F.year(time) == 1970, "year_1970")
        .when(F.to_date(time) != day, "date_mismatch")
    )
    return joined.withColumn("reason", reason).drop("_header")


def disposition(reason: Column) -> Column:
    return F.when(reason.isin("repeated_header", "exact_duplicate"), "remove").when(reason.isNotNull(), "retain_in_non_temporal_quarantine")


def audit_events(classified: DataFrame, extra: list[str]) -> DataFrame:
    """One row per record with a reason: source, the extra columns, reason, disposition and the row kept instead."""
    return classified.where("reason is not null").select("source_file", "source_row", *extra, "reason", disposition(F.col("reason")).alias("disposition"), "retained_source_row")


def cleaned(classified: DataFrame, spec: CleaningSpec, time: Column, day: Column, quarantine: bool = False) -> DataFrame:
    """The typed records that stay, or those set aside: features, then META; labels keep their spelling and anything
    but the benign label is target 1."""
    chosen = classified.where(disposition(F.col("reason")) == "retain_in_non_temporal_quarantine" if quarantine else F.col("reason").isNull())
    numbers = [strict_number(F.col(f"`{c}`").cast("string"), c, c in spec.may_be_infinite).alias(c) for c in spec.numeric]
    texts = [present(F.col(f"`{c}`")).alias(c) for c in spec.categorical]
    target = (F.coalesce(F.col(f"`{spec.label}`"), F.lit("")) != spec.benign).cast("tinyint")
    return chosen.select(*numbers, *texts, "source_file", "source_row", time.alias("timestamp"), day.alias("file_date"), F.col(f"`{spec.label}`").alias("attack_label"), target.alias("target_binary"))


def write_sorted(clean: DataFrame, path: str) -> None:
    """One folder per day, each file in order of time and source row; days of any size are split over tasks by time.
    Refuses to overwrite."""
    ordered = clean.repartitionByRange("file_date", "timestamp", "source_row").sortWithinPartitions("file_date", "timestamp", "source_row")
    ordered.write.mode("errorifexists").option("compression", "zstd").partitionBy("file_date").parquet(path)


def stage_counts(classified: DataFrame, label: str) -> DataFrame:
    """(source_file, label, stage, n) for the stages raw, deduplicated (no headers, no copies) and eligible."""
    stages = F.array_compact(F.array(F.lit("raw"), F.when(~F.coalesce(F.col("reason").isin("repeated_header", "exact_duplicate"), F.lit(False)), "deduplicated"), F.when(F.col("reason").isNull(), "eligible")))
    return classified.select("source_file", label, F.explode(stages).alias("stage")).groupBy("source_file", label, "stage").agg(F.count(F.lit(1)).alias("n"))


def reconciliation(classified: DataFrame) -> DataFrame:
    """Per source_file: raw, header, duplicate, quarantined and eligible rows, and whether they add up."""
    n = lambda c: F.count(F.when(c, 1))
    r = F.col("reason")
    made = classified.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("raw_rows"), n(r == "repeated_header").alias("headers"), n(r == "exact_duplicate").alias("duplicates"), n(r.isin("invalid_timestamp", "year_1970", "date_mismatch")).alias("quarantined"), n(r.isNull()).alias("eligible_rows")
    )
    return made.withColumn("adds_up", F.col("raw_rows") == F.col("headers") + F.col("duplicates") + F.col("quarantined") + F.col("eligible_rows"))


def unaccounted(raw: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, n, parts): raw records that are in no part or in more than one, and records of parts that are no raw
    record. Empty if every record is accounted for exactly once."""
    made = raw.select(*keys, F.lit("").alias("_part"))
    for name, part in parts.items():
        made = made.unionByName(part.select(*keys, F.lit(name).alias("_part")))
    counted = made.groupBy(*keys).agg(F.count(F.when(F.col("_part") == "", 1)).alias("_raw"), F.count(F.when(F.col("_part") != "", 1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("_part") != "", F.col("_part"))))).alias("parts"))
    return counted.where("_raw != 1 or n != 1").select(*keys, "n", "parts")
