"""Selection of cases by confusion category and score quantile, from scores joined by checked ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.operators.keyed_chunks import number_rows
from siltstream.operators.picks import drawn_by

QUANTILES = [0.1, 0.5, 0.9]


def joined_scores(records: DataFrame, scores: dict[str, DataFrame], key: str, thresholds: dict[str, float]) -> DataFrame:
    """records with <name>_score and <name>_decision of each detector. Raises where a record has no score or several, a
    score is not finite, or a score belongs to no record."""
    made = records
    for name, df in scores.items():
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("score").cast("double").alias("_s"))
        both = made.withColumn("_here", F.lit(1)).join(one, key, "full")
        ok = F.col("_here").isNotNull() & (F.coalesce(F.col("_n"), F.lit(0)) == 1) & F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") != float("inf"))
        score = F.when(ok, F.col("_s")).otherwise(F.raise_error(F.lit(f"ids of {name} don't match the records")).cast("double"))
        made = both.withColumn(f"{name}_score", score).withColumn(f"{name}_decision", (F.col(f"{name}_score") >= thresholds[name]).cast("int")).drop("_n", "_s", "_here")
    return made


def categorised(df: DataFrame, categories: dict[str, tuple[Column, str]], keep: list[str]) -> DataFrame:
    """(keep, category, score): one row per category that a record falls in, with the score that orders it there."""
    rows = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("category"), F.col(score).alias("score"))) for name, (test, score) in categories.items()]))
    return df.select(*keep, F.inline(rows))


def picked_ranks(n: int, quantiles: list[float] = QUANTILES) -> list[tuple[float, int]]:
    """For each quantile in order the nearest rank of 0..n-1 to q (n - 1) not yet used, the lower of two as near."""
    used: set[int] = set()
    made = []
    for q in quantiles:
        if len(used) == n:
            break
        near = int(q * (n - 1))
        around = [i for i in range(near - len(quantiles), near + len(quantiles) + 2) if 0 <= i < n and i not in used]
        rank = min(around, key=lambda i: (abs(i - q * (n - 1)), i))
        used.add(rank)
        made.append((q, rank))
    return made


def selected_cases(rows: DataFrame, categories: list[str], ids: list[str]) -> DataFrame:
    """(category, status, available, quantile, score, ids): per category the records at the quantile ranks of the order
    (score, ids); one EMPTY row for a category without records. rows: (ids, category, score), ids unique per category.

    The ranks follow from the number of records alone; records are numbered by chunks, not gathered."""
    spark = rows.sparkSession
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("available"))

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(c, n, q, r) for c, n in zip(b["category"], b["available"]) for q, r in picked_ranks(int(n))]
            yield pd.DataFrame(made, columns=["category", "available", "quantile", "_row"])

    wanted = counts.mapInPandas(ranks, "category string, available bigint, quantile double, _row bigint")
    coarse = rows.withColumn("_coarse", F.floor(F.col("score") * 1_000_000).cast("bigint"))
    numbered = number_rows(coarse, ["category"], ["_coarse", "score", *ids]).drop("_key", "_block", "_chunk", "_coarse")
    found = numbered.join(wanted, ["category", "_row"]).select("category", F.lit("SELECTED").alias("status"), "available", "quantile", "score", *ids)
    book = spark.createDataFrame([(c,) for c in categories], "category string")
    empty = book.join(counts, "category", "left_anti").select("category", F.lit("EMPTY").alias("status"), F.lit(0).cast("bigint").alias("available"), F.lit(None).cast("double").alias("quantile"), F.lit(None).cast("double").alias("score"), *[F.lit(None).cast(rows.schema[i].dataType).alias(i) for i in ids])
    return found.unionByName(empty)


def feature_groups(groups: dict[str, list[int]], names: list[str]) -> list[tuple[int, str, str]]:
    """(position, feature, group), positions from 1; raises unless the groups part the features."""
    held = sorted(i for v in groups.values() for i in v)
    if len(set(names)) != len(names) or held != list(range(1, len(names) + 1)):
        raise ValueError("groups must part the features")
    return [(i, names[i - 1], g) for g, v in groups.items() for i in v]


def quota_sample(df: DataFrame, group: str, key: str, size: int, seed: int, portable: bool = False) -> DataFrame:
    """``size`` records with quotas per group in proportion, by largest remainders (ties to the lower name), drawn by a
    seeded hash of the key; all records if there are fewer. Groups are few; their counts come to the driver."""
    counts = sorted((r[group], r["n"]) for r in df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    size = min(size, total)
    quota = {g: size * n // total for g, n in counts} if total else {}
    rest = size - sum(quota.values())
    for g, n in sorted(counts, key=lambda x: (-(size * x[1] % total), x[0]))[:rest]:
        quota[g] += 1
    rows = number_rows(df.withColumn("_chance", drawn_by(key, seed, portable)), [group], ["_chance", key])
    table = df.sparkSession.createDataFrame(list(quota.items()) or [(None, 0)], f"{group} {dict(df.dtypes)[group]}, _quota bigint")
    return rows.join(F.broadcast(table), group).where(F.col("_row") < F.col("_quota")).select(df.columns)  # one row per group
