"""Samples whose category shares meet targets, with minima for small categories (swap repair).

Records are grouped by category signature: the label and the class group as far as the plans name them. Counts
per signature, at most (named labels + 1) x (named groups + 1) numbers, go to the driver. There each plan starts
from a random sample that meets the floors, the whole rows required, and exchanges counts between signatures as long
as an exchange lowers the deviation from the targets. The signature counts that remain are drawn at random, exactly, on the
workers: by a seeded hash of row_id, with counts per range of the hash to find where each quota ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.functions.text import category, trimmed
from siltstream.operators.eligible import eligible

SEED = 20290605
OTHER = "<other>"
#: Records of a signature that share one range of the hash are ranked in one task; the ranges keep them near this.
RANKED_ROWS = 20_000


@dataclass
class Target:
    plan_id: int
    kind: str
    category: str
    key: str
    share: float
    floor: int
    fraction: float


def read_targets(targets: DataFrame) -> list[Target]:
    """The plan rows, the bounded table that steers the sampling."""
    rows = targets.withColumn("_key", category(F.col("category"))).collect()
    return [Target(int(r["plan_id"]), (r["category_kind"] or "").strip().lower(), r["category"], r["_key"], float(r["target_share"] or 0), int(r["min_rows"] or 0), float(r["sample_fraction"] or 0)) for r in rows if r["plan_id"] is not None]


def label_groups(classes: DataFrame) -> DataFrame:
    """(label_key, group_key): the class group of each label as compared; of several the one with most rows."""
    pairs = classes.select(F.coalesce(category(F.col("label")), F.lit("")).alias("label_key"), category(F.col("class_group")).alias("group_key"), "row_count")
    counts = pairs.groupBy("label_key", "group_key").agg(F.sum("row_count").alias("n"))
    return counts.groupBy("label_key").agg(F.max_by("group_key", F.struct("n", "group_key")).alias("group_key"))


def _pool(flows: DataFrame, audit: DataFrame) -> DataFrame:
    train = flows.where(F.lower(trimmed(F.col("split"))) == "train").select("row_id", "source_file", "source_row", F.coalesce(category(F.col("label")), F.lit("")).alias("label_key"))
    return eligible(train, audit)


def _named(key: Column, names: list[str]) -> Column:
    return F.when(key.isin(names), key).otherwise(OTHER) if names else F.lit(OTHER)


def _signed(counted: DataFrame, groups: DataFrame, targets: list[Target]) -> DataFrame:
    labels = sorted({t.key for t in targets if t.kind == "label" and t.key is not None})
    kinds = sorted({t.key for t in targets if t.kind == "class_group" and t.key is not None})
    joined = counted.join(groups, "label_key", "left")
    return joined.withColumns({"label_sign": _named(F.col("label_key"), labels), "group_sign": _named(F.col("group_key"), kinds)})


def random_counts(available: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Counts per signature, size in all, as a random draw of rows would have them: signature by signature with mean and
    variance of the hypergeometric law, rounded to what is there. No row count is too large for it."""
    taken = np.zeros_like(available)
    rows, left = int(available.sum()), int(min(size, available.sum()))
    for k, have in enumerate(map(int, available)):
        rest = rows - have
        mean = left * have / max(rows, 1)
        spread = mean * (rest / max(rows, 1)) * ((rows - left) / max(rows - 1, 1))
        drawn = round(rng.normal(mean, max(spread, 0.0) ** 0.5))
        taken[k] = min(max(drawn, left - rest, 0), have, left)
        rows, left = rest, left - int(taken[k])
    return taken


def repair(available: np.ndarray, member: np.ndarray, want: np.ndarray, floors: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Counts per signature, size in all, that no exchange between two signatures brings nearer to want, as the squares of
    the deviations add up, so that a surplus spreads.

    available: rows per signature; member: categories x signatures, 0 or 1; want, floors: rows per category.
    Floors beyond what is available count as what is available; floors above size raise the size.
    """
    taken = np.zeros_like(available)
    least = np.minimum(floors, member @ available)
    for c, floor in enumerate(least):
        short = int(floor - member[c] @ taken)
        if short > 0:
            taken += random_counts((available - taken) * member[c], short, rng)
    taken += random_counts(available - taken, max(0, min(size, int(available.sum())) - int(taken.sum())), rng)
    step = 1 << max(0, int(taken.sum()).bit_length() - 1)
    while step:
        off = (member @ taken - want).astype(float)
        best = None
        for a in np.flatnonzero(taken >= step):
            for b in np.flatnonzero(available - taken >= step):
                change = step * (member[:, b] - member[:, a])
                # the squares before less those after
                gain = -float((change * (2 * off + change)).sum())
                if gain > 1e-9 and (best is None or gain > best[0]) and (member @ taken + change >= least).all():
                    best = (gain, a, b)
        if best is None:
            step //= 2
        else:
            taken[best[1]] -= step
            taken[best[2]] += step
    return taken


@dataclass
class Plan:
    targets: list[Target]
    available: list[int]
    drawn: list[int]
    required: list[float]
    quota: dict[tuple[str, str], int]


def plan_samples(flows: DataFrame, audit: DataFrame, classes: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[list[Plan], int]:
    """The repaired plans and the number of eligible train records."""
    wanted = read_targets(targets)
    counts = _pool(flows, audit).groupBy("label_key").agg(F.count(F.lit(1)).alias("n"))
    signed = _signed(counts, label_groups(classes), wanted).groupBy("label_sign", "group_sign").agg(F.sum("n").alias("n")).collect()
    signs = sorted((r["label_sign"], r["group_sign"], r["n"]) for r in signed)
    available = np.array([n for *_, n in signs], dtype=np.int64)
    total = int(available.sum())
    plans = []
    for plan_id in sorted({t.plan_id for t in wanted}):
        own = [t for t in wanted if t.plan_id == plan_id]
        member = np.array([[int((s[0] if t.kind == "label" else s[1]) == t.key) for s in signs] for t in own], dtype=np.int64).reshape(len(own), len(signs))
        size = round(own[0].fraction * total)
        goals = np.array([t.share * t.fraction * total for t in own])
        required = [max(float(t.floor), t.share * t.fraction * total) for t in own]
        floors = np.array([math.ceil(r) for r in required], dtype=np.int64)
        taken = repair(available, member, goals, floors, size, np.random.default_rng([seed, plan_id])) if len(signs) else np.zeros(0, np.int64)
        quota = {(a, b): int(k) for (a, b, _), k in zip(signs, taken)}
        plans.append(Plan(own, (member @ available).tolist(), (member @ taken).tolist(), required, quota))
    return plans, total


REPORT = "plan_id bigint, category_kind string, category string, target_share double, required double, available bigint, drawn bigint, drawn_share double, is_possible boolean, is_met boolean"


def sample_report(flows: DataFrame, audit: DataFrame, classes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per target: rows required (the greater of min_rows and target_share * sample_fraction * eligible),
    available and drawn; is_possible: available >= required, is_met: drawn >= required. An empty pool meets only targets
    of 0 rows."""
    plans, _ = plan_samples(flows, audit, classes, targets, seed)
    rows = []
    for p in plans:
        size = sum(p.quota.values())
        for t, have, got, need in zip(p.targets, p.available, p.drawn, p.required):
            rows.append((t.plan_id, t.kind, t.category, t.share, need, int(have), int(got), got / size if size else 0.0, not have < need, not got < need))
    return flows.sparkSession.createDataFrame(rows, REPORT)


def unmet_targets(flows: DataFrame, audit: DataFrame, classes: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, category) of the targets that the repaired sample doesn't meet. It meets all that the eligible train
    records can meet, as whole required rows are floors of the repair."""
    return sample_report(flows, audit, classes, targets).where("not is_met").select("plan_id", "category").distinct()


def draw_samples(flows: DataFrame, audit: DataFrame, classes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(plan_id, row_id, label_key, group_key) of the records drawn, each plan without replacement.

    The same seed draws the same records. row_id must be unique. Empty in, empty out."""
    spark = flows.sparkSession
    plans, total = plan_samples(flows, audit, classes, targets, seed)
    ranges = 1 << max(8, (total // RANKED_ROWS).bit_length())
    pool = _signed(_pool(flows, audit), label_groups(classes), read_targets(targets))
    quotas = [(p.targets[0].plan_id, a, b, k) for p in plans for (a, b), k in p.quota.items() if k]
    quota = F.broadcast(spark.createDataFrame(quotas, "plan_id bigint, label_sign string, group_sign string, quota bigint"))  # plans x signatures
    drawn = pool.join(quota, ["label_sign", "group_sign"])
    chance = F.xxhash64("row_id", "plan_id", F.lit(seed))
    drawn = drawn.withColumn("chance", chance).withColumn("slot", F.pmod(chance, F.lit(ranges)))
    key = ["plan_id", "label_sign", "group_sign"]
    slots = drawn.groupBy(*key, "quota", "slot").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("slot"))
    # the one slot of each quota in which it ends, and how many it takes there
    edge = slots.withColumn("upto", upto).where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
    edge = edge.select(*key, F.col("slot").alias("edge"), (F.col("quota") - F.col("upto") + F.col("n")).alias("left"))
    placed = drawn.join(F.broadcast(edge), key)  # plans x signatures
    whole = placed.where("slot < edge")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("chance", "row_id"))
    part = placed.where("slot = edge").withColumn("rank", rank).where(F.col("rank") <= F.col("left")).drop("rank")
    return whole.unionByName(part).select("plan_id", "row_id", "label_key", "group_key")
