"""Snapshots of causal graphs as rows, for training on the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.models.networks import Snapshot
from siltstream.models.tensor import Tensor, logistic_loss
from siltstream.models.training import matrix
from siltstream.operators.graph import SNAPSHOT

NODE_FEATURES = ["in_count", "out_count", "in_bytes", "out_bytes", "tcp", "udp", "low_src_port", "low_dst_port"]


def snapshot_rows(nodes: DataFrame, message_edges: DataFrame, targets: DataFrame, features: DataFrame) -> DataFrame:
    """One row per snapshot: nodes, their features, message edges with features, targets with features, y and weight.

    message_edges are capped and nodes are those of edges and targets, so a row has a bounded size as long as a slot's
    targets do. features: (row, x array); targets: (part, cutoff, row, src, dst, y, weight).
    """
    x = features.select("row", "x")
    n = nodes.groupBy(*SNAPSHOT).agg(F.array_sort(F.collect_list(F.struct("node", F.array(*NODE_FEATURES).alias("f")))).alias("nodes"))
    e = message_edges.join(x, "row").groupBy(*SNAPSHOT).agg(F.array_sort(F.collect_list(F.struct("row", "src", "dst", "x"))).alias("edges"))
    t = targets.join(x, "row").groupBy(*SNAPSHOT).agg(F.array_sort(F.collect_list(F.struct("row", "src", "dst", "x", F.col("y").cast("double").alias("y"), "weight"))).alias("targets"))
    return t.join(n, SNAPSHOT).join(e, SNAPSHOT, "left")


@dataclass
class Targets:
    """The answers to a snapshot's pairs, their weights and rows."""

    y: np.ndarray
    weight: np.ndarray
    row: np.ndarray


def unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[Snapshot, Targets]]:
    """The snapshots of a batch as arrays, cut from the columns' own buffers."""
    fields, starts = {}, {}
    for name in ("nodes", "edges", "targets"):
        column = batch.column(name)
        starts[name] = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
        items = column.flatten()
        fields[name] = dict(zip((f.name for f in items.type), items.flatten()))
    # matrix() would take no rows at all for an unknown width
    block = lambda name, key, n: matrix(fields[name][key]).reshape(-1, n) if len(fields[name][key]) else np.zeros((0, n))
    hosts, link_features, pair_features = block("nodes", "f", len(NODE_FEATURES)), block("edges", "x", width), block("targets", "x", width)
    y, weight, row = (fields["targets"][k].to_numpy(zero_copy_only=False) for k in ("y", "weight", "row"))
    for i in range(batch.num_rows):
        n, e, t = (slice(int(starts[k][i]), int(starts[k][i + 1])) for k in ("nodes", "edges", "targets"))
        known = fields["nodes"]["node"][n]
        ends = lambda name, at: np.array([_places(fields[name][side][at], known) for side in ("src", "dst")], dtype=np.int64).reshape(2, -1)  # noqa: B023, E731
        yield Snapshot(hosts[n], ends("edges", e), link_features[e], ends("targets", t), pair_features[t]), Targets(y[t].astype(float), weight[t].astype(float), row[t].astype(np.int64))


def _places(items: pa.Array, known: pa.Array) -> np.ndarray:
    found = pc.index_in(items, value_set=known)
    if found.null_count:
        raise ValueError("an edge or target touches a node that its snapshot lacks")
    return found.to_numpy(zero_copy_only=False)


def snapshot_loss(width: int) -> Callable:
    """Mean loss over all targets of a batch of snapshots."""

    def loss(model, batch: pa.RecordBatch) -> tuple[Tensor, float]:
        total, weight = Tensor(0.0), 0.0
        for s, t in unpacked(batch, width):
            total, weight = total + logistic_loss(model.logits(s), t.y, t.weight) * float(len(t.y)), weight + float(t.weight.sum())
        return total * (1 / max(weight, 1e-9)), weight

    return loss


def target_scores(rows: DataFrame, network, make: Callable, width: int) -> DataFrame:
    """(row, y, score) of every target."""
    state = rows.sparkSession.sparkContext.broadcast(network.state())

    def run(batches):
        model = make().load(state.value)
        for batch in batches:
            for s, t in unpacked(batch, width):
                score = 1 / (1 + np.exp(-np.clip(model.logits(s).value, -60, 60)))
                yield pa.RecordBatch.from_arrays([pa.array(t.row), pa.array(t.y.astype(np.int32)), pa.array(score)], ["row", "y", "score"])

    return rows.mapInArrow(run, "row bigint, y int, score double")
