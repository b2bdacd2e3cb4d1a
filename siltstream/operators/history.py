"""History of an entity in earlier slots: for each lag the latest completed flow of the same pair, else source, else
destination. Slots without one stay empty and are not closed up; parts are never crossed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstream.plans.running import exact_quantiles
from siltstream.session import materialise

LAGS = 8
KINDS = {"pair": ["src", "dst"], "source": ["src"], "destination": ["dst"]}


def history_slots(rows: DataFrame, lags: int = LAGS, slot: int = 60, offset: int = 30) -> DataFrame:
    """(id, lag, history_id, kind) of rows (id, part, second, completion_us, src, dst, row): kind 1 is the same directed
    pair, 2 the same source, 3 the same destination; only filled lags are given.

    The latest eligible flow per slot, lag and entity is found first, once, by combining aggregation; rows then look
    it up by key, three times, so that no entity's flows are gathered or paired with one another.
    """
    found = history_lookup(rows, lags, slot, offset).select("id", F.posexplode("history").alias("_k", "_h"))
    return found.select("id", (F.col("_k") + 1).alias("lag"), "_h.history_id", "_h.kind").where("history_id is not null")


def history_lookup(rows: DataFrame, lags: int = LAGS, slot: int = 60, offset: int = 30) -> DataFrame:
    """rows with slot and history, an array of (history_id, kind) for the lags from 1, both null where a lag is empty.
    All lags of an entity's slot are one row, so a row meets three of them, however many lags there are."""
    placed = rows.withColumn("slot", F.floor(F.col("second") / slot))
    ahead = placed.withColumn("lag", F.explode(F.array(*map(F.lit, range(1, lags + 1))))).withColumn("for_slot", F.col("slot") + F.col("lag"))
    done = ahead.where(F.col("completion_us") < (F.col("for_slot") * slot + offset) * 1_000_000)
    made = placed
    each = range(1, lags + 1)
    for name, key in KINDS.items():
        last = [F.max_by(F.when(F.col("lag") == k, F.col("id")), F.when(F.col("lag") == k, F.struct("completion_us", "row"))) for k in each]
        latest = done.groupBy("part", F.col("for_slot").alias("slot"), *key).agg(F.array(*last).alias(name))
        made = made.join(latest, ["part", "slot", *key], "left")

    def at(k: int):
        ids = [F.get(name, F.lit(k - 1)) for name in KINDS]
        kind = F.when(ids[0].isNotNull(), 1).when(ids[1].isNotNull(), 2).when(ids[2].isNotNull(), 3)
        return F.struct(F.coalesce(*ids).alias("history_id"), kind.alias("kind"))

    return made.select(*rows.columns, "slot", F.array(*map(at, each)).alias("history"))


def history_counts(rows: DataFrame, slot: int = 60, offset: int = 30) -> DataFrame:
    """(id, pair_count, source_count, destination_count): the distinct earlier slots of the part in which the entity has
    a flow completed by the row's cutoff. A slot counts from the first later slot whose cutoff lies past its earliest
    completion; these starts add up along the slots of each entity."""
    placed = rows.withColumn("slot", F.floor(F.col("second") / slot))
    made = placed.select("id", "part", "slot", "src", "dst")
    for name, key in KINDS.items():
        slots = placed.groupBy("part", *key, "slot").agg(F.min("completion_us").alias("done"))
        start = F.greatest(F.col("slot") + 1, F.floor((F.col("done") / 1_000_000 - offset) / slot) + 1)
        # at the cutoff itself a flow isn't complete yet
        exact = F.when((start * slot + offset) * 1_000_000 > F.col("done"), start).otherwise(start + 1)
        starts = slots.select("part", *key, exact.alias("slot"), F.lit(1).alias("k"))
        asked = slots.select("part", *key, "slot", F.lit(0).alias("k"))
        steps = starts.union(asked).groupBy("part", *key, "slot").agg(F.sum("k").alias("k"), F.count(F.when(F.col("k") == 0, 1)).alias("asked"))
        upto = F.sum("k").over(Window.partitionBy("part", *key).orderBy("slot"))  # at most the slots of a part
        counted = steps.withColumn(f"{name}_count", upto).where("asked > 0").select("part", *key, "slot", f"{name}_count")
        made = made.join(counted, ["part", *key, "slot"], "left")
    return made.select("id", *[F.coalesce(f"{n}_count", F.lit(0)).alias(f"{n}_count") for n in KINDS])


def history_coverage(rows: DataFrame, slots: DataFrame, counts: DataFrame, y: str) -> DataFrame:
    """Per part and class (y, null for both): rows, how many reach 1, 4 and 8 earlier slots per kind of entity, the
    median, p90 and maximum, how many have all or any of the first 3, 7 and 8 lags, and tokens by kind over 7 lags."""
    per = slots.groupBy("id").agg(*[F.count(F.when(F.col("lag") <= k, 1)).alias(f"first_{k}") for k in (3, 7, 8)], *[F.count(F.when((F.col("lag") <= 7) & (F.col("kind") == i), 1)).alias(f"kind_{i}") for i in (1, 2, 3)])
    joined = rows.select("id", "part", y).join(counts, "id").join(per, "id", "left").fillna(0)
    joined = materialise(joined, "history")
    n = lambda c: F.count(F.when(c, 1))
    aggs = [F.count(F.lit(1)).alias("n")]
    for name in KINDS:
        aggs += [n(F.col(f"{name}_count") >= k).alias(f"{name}_ge{k}") for k in (1, 4, 8)] + [F.max(f"{name}_count").alias(f"{name}_max")]
    for k in (3, 7, 8):
        aggs += [n(F.col(f"first_{k}") == k).alias(f"all_{k}"), n(F.col(f"first_{k}") > 0).alias(f"any_{k}")]
    aggs += [F.sum(f"kind_{i}").alias(f"{name}_tokens") for i, name in enumerate(KINDS, 1)]
    made = joined.groupingSets([["part", y], ["part"]], "part", y).agg(*aggs)
    scopes = joined.select("part", F.explode(F.array(F.col(y).cast("string"), F.lit("all"))).alias("_y"), *[f"{k}_count" for k in KINDS])
    made = made.withColumn("_y", F.coalesce(F.col(y).cast("string"), F.lit("all")))
    for name in KINDS:
        ranks = exact_quantiles(scopes, ["part", "_y"], f"{name}_count", [0.5, 0.9], [f"{name}_median", f"{name}_p90"]).drop("n")
        made = made.join(ranks, ["part", "_y"])
    return made.drop("_y")


def history_violations(rows: DataFrame, slots: DataFrame, slot: int = 60, offset: int = 30) -> DataFrame:
    """(id, lag, problem) of history that breaks a rule: another part, another slot than its lag says, completed too
    late, or an entity that its kind doesn't name."""
    at = lambda tag: rows.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("id", "part", "second", "completion_us", "src", "dst")])
    both = slots.join(at("t"), F.col("id") == F.col("id_t")).join(at("h"), F.col("history_id") == F.col("id_h"))
    here, then = F.floor(F.col("second_t") / slot), F.floor(F.col("second_h") / slot)
    wrong = F.when(F.col("kind") == 1, (F.col("src_t") != F.col("src_h")) | (F.col("dst_t") != F.col("dst_h"))).when(F.col("kind") == 2, F.col("src_t") != F.col("src_h")).otherwise(F.col("dst_t") != F.col("dst_h"))
    problem = F.when(F.col("part_t") != F.col("part_h"), "part").when(then != here - F.col("lag"), "slot").when(F.col("completion_us_h") >= (here * slot + offset) * 1_000_000, "completion").when(wrong, "entity")
    return both.withColumn("problem", problem).where("problem is not null").select("id", "lag", "problem")


def sequence_tensor(slots: DataFrame, features: DataFrame, ids: DataFrame, lags: int = LAGS) -> DataFrame:
    """(id, sequence, mask): the features of the filled lags, oldest first, then the row's own; empty lags are null with
    a false mask. features: (id, x array)."""
    filled = slots.join(features.select(F.col("id").alias("history_id"), "x"), "history_id").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lag", "x"))).alias("m"))  # one entry per lag
    rows = ids.select("id").join(features, "id").join(filled, "id", "left")
    steps = [F.when(F.col("m").isNotNull(), F.col("m")[k]) for k in range(lags, 0, -1)]
    return rows.select("id", F.array(*steps, F.col("x")).alias("sequence")).withColumn("mask", F.transform("sequence", lambda s: s.isNotNull()))


def coverage_gate(coverage: DataFrame, part: int, y: str, least: int = 10_000) -> bool:
    """Whether at least ``least`` rows of a part have all of the first 3, and of the first 7, lags filled."""
    row = coverage.where((F.col("part") == part) & F.col(y).isNull()).first()
    return row is not None and min(row["all_3"], row["all_7"]) >= least
