"""Preprocessing fitted on training rows and applied unchanged: imputation, scaling, one-hot categories."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "<ALL_TRAIN_MISSING>"
#: A column with more distinct values than this can't be a direct encoding of the target.
MOST_CODES = 64


@dataclass
class Preprocessor:
    """The fitted state; output columns are numeric, then <category>=<level>."""

    numeric: list[str]
    means: list[float]
    scales: list[float]
    levels: dict[str, list[str]]
    modes: dict[str, str]
    all_missing: list[str]
    excluded: dict[str, str]
    training_rows: int

    @property
    def outputs(self) -> list[str]:
        return self.numeric + [f"{c}={v}" for c, vs in self.levels.items() for v in vs]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, allow_nan=False)

    @staticmethod
    def from_json(text: str) -> Preprocessor:
        return Preprocessor(**json.loads(text))

    def transform(self, df: DataFrame, keep: list[str] = (), scaled: bool = True) -> DataFrame:
        """keep and the output columns. Nulls become the mean or the mode, a category without level all zeros;
        infinite or NaN input raises, a missing column too."""
        absent = [c for c in [*self.numeric, *self.levels] if c not in df.columns]
        if absent:
            raise ValueError(f"missing columns: {absent}")
        made: list[Column] = [F.col(k) for k in keep]
        for c, mean, scale in zip(self.numeric, self.means, self.scales):
            x = F.col(f"`{c}`").cast("double")
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(x)
            x = F.coalesce(x, F.lit(mean))
            made.append(((x - F.lit(mean)) / F.lit(scale) if scaled else x).alias(c))
        for c, levels in self.levels.items():
            value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.modes[c]))
            made += [(value == v).cast("double").alias(f"{c}={v}") for v in levels]
        return df.select(*made)


def target_encodings(train: DataFrame, columns: list[str], label: str, benign: str = "benign") -> DataFrame:
    """(column_name, reason) of columns that encode the target: at most MOST_CODES values, null among them, that map
    one-to-one to benign and malicious, or each to one label of its own, of all labels.

    Values and labels are counted together once per column; a column with many values is dropped after the
    distinct count, without its values being gathered.
    """
    pairs = train.select(F.col(label).alias("_l"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")).alias("v")) for c in columns])))
    distinct = pairs.groupBy("column_name", "v").agg(F.count_distinct("_l").alias("labels"), F.bool_or(F.col("_l") == benign).alias("benign"), F.bool_or(F.col("_l") != benign).alias("malicious"))
    labels = F.broadcast(train.agg(F.count_distinct(label).alias("all_labels")))  # one row
    per = distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("values"), F.max("labels").alias("most"), F.count(F.when(F.col("benign") & ~F.col("malicious"), 1)).alias("only_benign"), F.count(F.when(~F.col("benign") & F.col("malicious"), 1)).alias("only_malicious")).crossJoin(labels)
    binary = (F.col("values") == 2) & (F.col("only_benign") == 1) & (F.col("only_malicious") == 1)
    each = (F.col("values") == F.col("all_labels")) & (F.col("all_labels") > 1) & (F.col("most") == 1)
    reason = F.when(binary, "one_to_one_binary_target_encoding").when(each, "one_to_one_attack_class_encoding")
    return per.where(F.col("values") <= MOST_CODES).withColumn("reason", reason).where("reason is not null").select("column_name", "reason")


def numeric_fit(train: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """(column_name, observed, mean, sd, scale): mean over observed values, or fill without any; population deviation
    after imputation, so the observed deviation times the root of the observed share; scale 1 where that is 0. One
    pass, numerically stable by the engine's own variance."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(f"`{c}`").alias("observed"), F.avg(f"`{c}`").alias("m"), F.var_pop(f"`{c}`").alias("v"), F.count(F.lit(1)).alias("n")) for c in columns]
    rows = train.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    sd = F.sqrt(F.coalesce(F.col("v") * F.col("observed") / F.col("n"), F.lit(0.0)))
    return rows.select("column_name", "observed", F.coalesce("m", F.lit(fill)).alias("mean"), sd.alias("sd"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale"))


def category_fit(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, levels, mode): sorted distinct non-null values and the most frequent, the lowest of ties; the
    placeholder alone where there is none. Categories are few by definition."""
    pairs = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])))
    counts = pairs.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    held = F.col("v").isNotNull()
    best = F.min_by(F.when(held, F.col("v")), F.when(held, F.struct(-F.col("n"), F.col("v"))))
    return counts.groupBy("column_name").agg(F.when(F.count("v") > 0, F.array_sort(F.collect_list("v"))).otherwise(F.array(F.lit(MISSING))).alias("levels"), F.coalesce(best, F.lit(MISSING)).alias("mode"))


def fit(train: DataFrame, features: list[str], categorical: list[str], label: str, benign: str = "benign", fill: float = 0.0) -> Preprocessor:
    """The preprocessor of the training rows; raises for an empty training part or if no numeric feature remains."""
    rows = train.count()
    if not rows:
        raise ValueError("empty training part")
    excluded = {r["column_name"]: r["reason"] for r in target_encodings(train, features, label, benign).collect()}
    numeric = [c for c in features if c not in categorical and c not in excluded]
    kept = [c for c in categorical if c in features and c not in excluded]
    if not numeric:
        raise ValueError("no numeric features remain")
    stats = {r["column_name"]: r for r in numeric_fit(train, numeric, fill).collect()}
    cats = {r["column_name"]: r for r in category_fit(train, kept).collect()} if kept else {}
    return Preprocessor(
        numeric,
        [stats[c]["mean"] for c in numeric],
        [stats[c]["scale"] for c in numeric],
        {c: list(cats[c]["levels"]) for c in kept},
        {c: cats[c]["mode"] for c in kept},
        [c for c in numeric if not stats[c]["observed"]],
        excluded,
        rows,
    )


def imputation_counts(df: DataFrame, part: str, state: Preprocessor) -> DataFrame:
    """Per part: rows, numeric cells imputed, and rows of unknown category per categorical column."""
    cells = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in state.numeric), F.lit(0).cast("bigint"))
    unknown = [F.count(F.when(~F.coalesce(F.col(c).cast("string"), F.lit(state.modes[c])).isin(state.levels[c]), 1)).alias(f"unknown_{c}") for c in state.levels]
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(cells).alias("imputed_cells"), *unknown)
