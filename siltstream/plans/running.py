"""Running totals over a sorted column without ordering all rows of a key in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstream.operators.keyed_chunks import _changes, range_partitions
from siltstream.session import materialise, sized


def _sums(keys: int, values: list[str]):
    """Appends the running total of each value within a key's rows of a sorted partition; the keys are the first columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            starts = np.flatnonzero(_changes(batch.columns[:keys])) if keys else np.zeros(1, np.int64)
            lengths = np.diff(np.r_[starts, n])
            goes_on = last is not None and not (keys and _changes([pa.concat_arrays([a, b]) for a, b in zip(last.columns[:keys], batch.slice(0, 1).columns[:keys])])[1:].any())
            made, ends = [], []
            for k, v in enumerate(values):
                x = batch.column(v).fill_null(0).to_numpy(zero_copy_only=False)
                if np.issubdtype(x.dtype, np.floating):  # each key by itself, as a large one before would cost a small one digits
                    total = np.concatenate([np.cumsum(p) for p in np.split(x, starts[1:])])
                else:
                    total = np.cumsum(x, dtype=np.int64)
                    total = total - np.repeat(total[starts] - x[starts], lengths)
                if goes_on:
                    total[: lengths[0]] += seen[k]
                made.append(pa.array(total))
                ends.append(total[-1])
            last, seen = batch.slice(n - 1, 1), ends
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *[f"_r{v}" for v in values]])

    return run


def running_totals(df: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False, blocks: int | None = None) -> DataFrame:
    """df with upto_<v> for each value: its total over the rows of the same keys up to and with this one in order.

    The order column must be a number without nulls, unique per key (aggregate by it first). Rows are range-sorted by
    keys and order into partitions whose number follows the rows; the totals of a key's earlier partitions give each
    partition's start. Null keys make a group of their own, a null value adds nothing. Written to the shared folder.
    """
    types = {f.name: f.dataType for f in df.schema}
    total = {v: "double" if types[v].typeName() in ("float", "double", "decimal") else "bigint" for v in values}
    rows = df.select(*keys, *[F.col(c).cast(total[c]).alias(c) if c in total else F.col(c) for c in df.columns if c not in keys])
    by = [*keys, F.desc(order) if descending else F.asc(order)]
    ranged = rows.repartitionByRange(blocks or range_partitions(df), *by).sortWithinPartitions(*by).withColumn("_block", F.spark_partition_id())
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema], *[f"`_r{v}` {t}" for v, t in total.items()]])
    placed = materialise(ranged.mapInArrow(_sums(len(keys), values), schema), "running")
    placed = placed.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("k")))
    parts = placed.groupBy("_block", "_key").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # only a partition's first key has rows in earlier ones: at most one row per partition
    starts = parts.select("_block", "_key", F.row_number().over(Window.partitionBy("_key").orderBy("_block")).alias("_nth"), *[F.sum(f"_t{v}").over(before).alias(f"_s{v}") for v in values]).where("_nth > 1").drop("_nth")
    joined = placed.join(F.broadcast(starts), ["_block", "_key"], "left")
    return joined.select(*df.columns, *[(F.col(f"_r{v}") + F.coalesce(f"_s{v}", F.lit(0).cast(total[v]))).alias(f"upto_{v}") for v in values])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], names: list[str], weight: str | None = None) -> DataFrame:
    """(keys, n, <names>): exact quantiles of a number column, linear between the two nearest ranks; a row counts
    ``weight`` times. Values are counted first and ranked by running totals; nulls are left out, so keys with nulls
    only are absent."""
    many = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(many.alias("_n"))
    counts = materialise(counts.where("_n > 0"), "counts")
    up = running_totals(counts, keys, "_v", ["_n"])
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("k"))
    placed = up.withColumn("_k", key).join(sized(totals.withColumn("_k", key).drop(*keys)), "_k").drop("_k")
    start, end = F.col("upto__n") - F.col("_n"), F.col("upto__n")
    here = lambda rank: (rank >= start) & (rank < end)
    at = {name: F.lit(q) * (F.col("n") - 1) for q, name in zip(shares, names)}
    low = {name: F.max(F.when(here(F.floor(a)), F.col("_v"))) for name, a in at.items()}
    high = {name: F.max(F.when(here(F.ceil(a)), F.col("_v"))) for name, a in at.items()}
    made = placed.groupBy(*keys, "n").agg(*[low[x].alias(f"_l{x}") for x in names], *[high[x].alias(f"_h{x}") for x in names])
    part = {name: a - F.floor(a) for name, a in at.items()}
    return made.select(*keys, "n", *[(F.col(f"_l{x}") + (F.col(f"_h{x}") - F.col(f"_l{x}")) * part[x]).alias(x) for x in names])
