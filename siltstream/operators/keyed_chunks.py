"""Per-key ordered results where a few keys hold most rows (exact offset chunking).

Rows are range-sorted by key and order into partitions of about equal size, so that a key of any size spans as many of
them as it fills and no task holds more than its share. Each partition counts its keys; a prefix sum over the
partitions gives each one's offset within its first key, and offset + position numbers a key's rows. States are
made of pieces, the rows of one key among ``chunk_rows`` neighbours of a partition; pieces of a key are merged in
order, with the step across each boundary added. After the single shuffle of the rows only states move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstream.functions.text import trimmed
from siltstream.session import materialise, shuffle_partitions

#: Rows whose pieces are made at once.
CHUNK_ROWS = 50_000
#: Rows of a range-sorted partition; their number follows from the rows.
PARTITION_ROWS = 500_000
#: Below so many rows a partition isn't worth its task.
LEAST_ROWS = 20_000
#: Blocks per shuffle partition; the boundaries (blocks - 1 numbers) are all that reaches the driver.
BLOCKS_PER_PARTITION = 4


def in_block(order: Column, bounds: list[int]) -> Column:
    """The number of bounds <= order, as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order < F.lit(bounds[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(bounds))


def default_blocks(spark: SparkSession) -> int:
    return min(256, BLOCKS_PER_PARTITION * shuffle_partitions(spark))


def block_bounds(df: DataFrame, order: str, blocks: int) -> list[int]:
    """At most blocks - 1 rising split points of the order column."""
    if blocks < 2:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(order, shares, max(10_000, 50 * blocks)).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_partitions(df: DataFrame) -> int:
    """As many partitions as the rows fill; where they are few, one for each core that gets enough of them."""
    rows = df.count()
    return max(-(-rows // PARTITION_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), 1)


def range_sorted_rows(df: DataFrame, keys: list[str], orders: list[str], blocks: int | None = None) -> DataFrame:
    """df range-sorted by keys and orders, with _block, the number of the partition, rising with both."""
    by = [*keys, *orders]
    return df.repartitionByRange(blocks or range_partitions(df), *by).sortWithinPartitions(*by).withColumn("_block", F.spark_partition_id())


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row's key differs from that of the row before; the first row's does."""
    n = len(columns[0]) if columns else 0
    changed = np.zeros(n, dtype=bool)
    changed[:1] = True
    for c in columns:
        if pa.types.is_nested(c.type):
            values = c.to_pylist()
            changed[1:] |= np.array([a != b for a, b in zip(values, values[1:])], dtype=bool)
            continue
        if pa.types.is_floating(c.type):
            nan = pc.fill_null(pc.is_nan(c), False)
            columns_of = [pc.if_else(nan, pa.scalar(0.0, c.type), c), nan]
        else:
            columns_of = [c]
        for x in columns_of:
            gone = x.is_null().to_numpy(zero_copy_only=False)
            other = pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False)
            changed[1:] |= other | (gone[1:] != gone[:-1])
    return changed


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in record batches of ``rows`` rows, the last one shorter."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _positions(keys: int):
    """Appends the position of each row within the rows of its key in a sorted partition; the keys are the first columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(_changes(batch.columns[:keys])) if keys else np.zeros(1, np.int64)
            at = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.r_[starts, batch.num_rows]))
            first, end = batch.slice(0, 1), batch.slice(batch.num_rows - 1, 1)
            if last is not None and not _changes([pa.concat_arrays([a, b]) for a, b in zip(last.columns[:keys], first.columns[:keys])])[1:].any():
                at[: starts[1] if len(starts) > 1 else len(at)] += seen
            last, seen = end, int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "_at"])

    return run


def number_rows(df: DataFrame, keys: list[str], order: str | list[str], chunk_rows: int = CHUNK_ROWS, blocks: int | None = None) -> DataFrame:
    """df with _key (the keys as a struct), _block, _row (0-based position within its key, in order) and _chunk.

    Null keys are numbered as a key of their own. The order columns must be unique within a key; ties would be
    numbered in any order. An empty df stays empty. The numbered rows are written to the shared folder.
    """
    orders = [order] if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys]
    ranged = range_sorted_rows(df.select(*keys, *rest), keys, orders, blocks)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", _at bigint"
    placed = materialise(ranged.mapInArrow(_positions(len(keys)), schema), "numbered")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("k"))
    placed = placed.withColumn("_key", key)
    counts = placed.groupBy("_block", "_key").agg((F.max("_at") + 1).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # only a partition's first key has rows in earlier ones: at most one row per partition
    offsets = counts.withColumn("_offset", F.sum("_n").over(before)).where("_offset > 0").drop("_n")
    numbered = placed.join(F.broadcast(offsets), ["_block", "_key"], "left")
    numbered = numbered.withColumn("_row", F.col("_at") + F.coalesce("_offset", F.lit(0)))
    return numbered.withColumn("_chunk", F.floor(F.col("_row") / F.lit(chunk_rows))).select(*df.columns, "_block", "_key", "_row", "_chunk")


def _pieces(keys: int, chunk_rows: int, whole: bool):
    """States of the pieces of a sorted partition: keys, then order, time in microseconds, measure, partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(_gathered(batches, chunk_rows)):
            order, time, measure = (batch.column(keys + k) for k in range(3))
            n = batch.num_rows
            starts = np.flatnonzero(_changes(batch.columns[:keys]))
            ends = np.r_[starts[1:], n]
            add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            timed = time.is_valid().to_numpy(zero_copy_only=False)
            micros = time.fill_null(0).to_numpy()
            seconds = micros // 1_000_000
            # the last timed row up to each, and the one before it
            upto = np.maximum.accumulate(np.where(timed, np.arange(n), -1))
            before = np.r_[-1, upto[:-1]]
            start_of = np.repeat(starts, ends - starts)
            linked = timed & (before >= start_of)
            step = np.where(linked, seconds - seconds[before], 0)
            gap = np.maximum.reduceat(np.where(step > 0, step, 0), starts)
            has = add(timed.astype(np.int64)) > 0
            first = np.minimum.reduceat(np.where(timed, np.arange(n), n), starts)
            last = upto[ends - 1]
            known = measure.is_valid().to_numpy(zero_copy_only=False)
            total = add(measure.fill_null(0).to_numpy())
            orders = order.to_numpy()
            made = [
                pa.array(ends - starts, pa.int64()),
                pa.array(orders[starts]),
                pa.array(orders[ends - 1]),
                pa.array(add(timed.astype(np.int64)), pa.int64()),
                pa.array(micros[np.where(has, first, 0)], mask=~has),
                pa.array(micros[np.where(has, last, 0)], mask=~has),
                pa.array(add((step < 0).astype(np.int64)), pa.int64()),
                pa.array(gap, pa.int64(), mask=gap == 0),
                pa.array(total, pa.int64() if whole else pa.float64(), mask=add(known.astype(np.int64)) == 0),
            ]
            at = pa.array(starts)
            block = batch.column(keys + 3).take(at)
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:keys]], block, pa.array(np.full(len(starts), number), pa.int32()), *made], [*batch.schema.names[:keys], "_block", "_piece", *_STATE])

    return run


_STATE = ["n", "first_order", "last_order", "timed", "first_us", "last_us", "backward", "gap", "total"]


def ordered_states(df: DataFrame, keys: list[str], order: str, time: str, measure: str, chunk_rows: int = CHUNK_ROWS, blocks: int | None = None) -> DataFrame:
    """One row per key: rows, first and last order value, timed rows, first and last non-null time in order,
    backward steps (time before the last non-null time of the same key), largest forward step in seconds, and
    the sum of the measure.

    The order column is a bigint without nulls, unique per key. Null times count in n_rows only; a null measure adds
    nothing. Ties in time are no step. Empty in, empty out.
    """
    types = {f.name: f.dataType for f in df.schema}
    whole = types[measure].typeName() in ("byte", "short", "integer", "long")
    time_type, total_type = types[time].simpleString(), "bigint" if whole else "double"
    data = df.select(*keys, F.col(order).cast("bigint").alias("_order"), F.unix_micros(F.col(time).cast("timestamp")).alias("_time"), F.col(measure).cast(total_type).alias("_measure"))
    schema = ", ".join(f"`{k}` {types[k].simpleString()}" for k in keys) + f", _block int, _piece int, n bigint, first_order bigint, last_order bigint, timed bigint, first_us bigint, last_us bigint, backward bigint, gap bigint, total {total_type}"
    states = range_sorted_rows(data, keys, ["_order"], blocks).mapInArrow(_pieces(len(keys), chunk_rows, whole), schema).withColumn("_key", F.struct(*keys))
    across = Window.partitionBy("_key").orderBy("_block", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    second = lambda c: F.floor(c / F.lit(1_000_000))
    jump = second(F.col("first_us")) - second(F.last("last_us", ignorenulls=True).over(across))
    at = F.struct("_block", "_piece")
    is_timed = F.col("timed") > 0
    return (
        states.withColumn("_jump", jump)
        .groupBy("_key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.min("first_order").alias("first_row"),
            F.max("last_order").alias("last_row"),
            F.sum("timed").alias("timed_rows"),
            F.timestamp_micros(F.min_by("first_us", F.when(is_timed, at))).cast(time_type).alias("first_time"),
            F.timestamp_micros(F.max_by("last_us", F.when(is_timed, at))).cast(time_type).alias("last_time"),
            (F.sum("backward") + F.sum(F.coalesce((F.col("_jump") < 0).cast("long"), F.lit(0)))).alias("backward_steps"),
            F.greatest(F.max("gap"), F.max(F.when(F.col("_jump") > 0, F.col("_jump")))).alias("max_forward_gap_s"),
            F.sum("total").alias("total"),
        )
        .select("_key.*", "*")
        .drop("_key")
    )


def endpoint_rows(flows: DataFrame) -> DataFrame:
    """(endpoint_role, ip, row_id, flow_timestamp, n_packets), one row per non-null address and role."""
    role = lambda name: F.struct(F.lit(name).alias("endpoint_role"), trimmed(F.col(name)).alias("ip"))
    packets = F.coalesce("tot_fwd_pkts", F.lit(0)) + F.coalesce("tot_bwd_pkts", F.lit(0))
    rows = flows.select("row_id", "flow_timestamp", packets.alias("n_packets"), F.inline(F.array(role("src_ip"), role("dst_ip"))))
    return rows.where(F.col("ip").isNotNull())


def endpoint_states(flows: DataFrame, **options) -> DataFrame:
    """ordered_states of every address in each role, in row_id order, with its share of the role's rows."""
    states = materialise(ordered_states(endpoint_rows(flows), ["endpoint_role", "ip"], "row_id", "flow_timestamp", "n_packets", **options), "endpoint-states")
    totals = states.groupBy("endpoint_role").agg(F.sum("n_rows").alias("_rows"))
    # two rows, one per role
    return states.join(F.broadcast(totals), "endpoint_role").withColumn("share", F.col("n_rows") / F.col("_rows")).drop("_rows")


def heavy_endpoints(flows: DataFrame, percent: int = 1, **options) -> DataFrame:
    """(endpoint_role, ip) of the addresses that hold at least ``percent`` % of their role's rows."""
    states = materialise(ordered_states(endpoint_rows(flows), ["endpoint_role", "ip"], "row_id", "flow_timestamp", "n_packets", **options).select("endpoint_role", "ip", "n_rows"), "endpoint-rows")
    totals = states.groupBy("endpoint_role").agg(F.sum("n_rows").alias("_rows"))
    found = states.join(F.broadcast(totals), "endpoint_role")  # two rows, one per role
    return found.where(F.col("n_rows") * 100 >= F.col("_rows") * percent).select("endpoint_role", "ip")
