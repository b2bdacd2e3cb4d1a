"""Causal graphs of flows: endpoint joins, prefix snapshots, node features, topology, components, attention.

A flow is an edge (part, second, completion_us, src, dst, protocol, src_port, dst_port, bytes, row). Time is cut into
slots; the cutoff of a slot lies ``offset`` seconds into it. An edge is history of a cutoff in its part if it began
before it, within the same calendar window, and was complete strictly before it.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstream.plans import components
from siltstream.plans.running import exact_quantiles
from siltstream.session import materialise, shuffle_partitions, sized

EDGE_CAP = 8192
#: Parts in which a snapshot's latest edges are first sought, so that no snapshot is sorted whole in one task.
CAP_PARTS = 16
#: Distinct links of a group up to which one task finds its components, in some 100 MB.
LOCAL_LINKS = 500_000
SNAPSHOT = ["part", "cutoff"]


def joined_endpoints(records: DataFrame, endpoints: DataFrame, keys: list[str], names: list[str], agree: dict[str, str] | None = None) -> DataFrame:
    """records with the endpoint columns of the same key. Raises where a record has no or several endpoints, or where
    columns that both carry (record column: endpoint column) differ."""
    agree = agree or {}
    sides = endpoints.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in names], *[F.first(c).alias(f"_c{i}") for i, c in enumerate(agree.values())])
    joined = records.join(sides, keys, "left")
    same = F.lit(True)
    for i, c in enumerate(agree):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    ok = (F.coalesce(F.col("_n"), F.lit(0)) == 1) & same
    first = F.when(ok, F.col(names[0])).otherwise(F.raise_error(F.lit("endpoints don't match the records")))
    return joined.withColumn(names[0], first).drop("_n", *[f"_c{i}" for i in range(len(agree))])


def edges(flows: DataFrame, part: Column, time: str, duration: Column, row: str) -> DataFrame:
    """Edges of flows with a time and both ends. Raises for a negative duration; a missing one counts as 0."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    length = F.when(duration < 0, F.raise_error(F.lit("negative duration")).cast("bigint")).otherwise(F.coalesce(duration.cast("bigint"), F.lit(0)))
    size = F.coalesce("totlen_fwd_pkts", F.lit(0.0)) + F.coalesce("totlen_bwd_pkts", F.lit(0.0))
    rows = flows.where(F.col(time).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return rows.select(part.alias("part"), F.floor(us / 1_000_000).alias("second"), (us + length).alias("completion_us"), "src", "dst", F.col("protocol").try_cast("int").alias("protocol"), "src_port", "dst_port", size.alias("bytes"), F.col(row).alias("row"))


def cutoffs(targets: DataFrame, slot: int = 60, offset: int = 30) -> DataFrame:
    """(part, cutoff) of the slots that hold targets; a slot in two parts raises."""
    made = targets.select("part", (F.col("slot") * slot + offset).alias("cutoff")).distinct()
    return made


def prefixes(history: DataFrame, cuts: DataFrame, window: int, slot: int = 60) -> DataFrame:
    """history edges once per cutoff they precede, with cutoff: an equi-join on part and calendar window of ``window``
    slots, the time conditions as a residue. An edge meets at most ``window`` cutoffs."""
    width = window * slot
    left = history.withColumn("_w", F.floor(F.col("second") / width))
    right = cuts.select("part", "cutoff", F.floor(F.col("cutoff") / width).alias("_w"))
    met = left.join(sized(right), ["part", "_w"])
    return met.where((F.col("second") < F.col("cutoff")) & (F.col("completion_us") < F.col("cutoff") * 1_000_000)).drop("_w")


def node_features(prefix: DataFrame) -> DataFrame:
    """(part, cutoff, node, in_count, out_count, in_bytes, out_bytes, tcp, udp, low_src_port, low_dst_port), each as
    log(1 + x), from all history of the snapshot. A self-loop counts on both sides."""
    side = lambda role, other: F.struct(F.col(role).alias("node"), F.lit(role).alias("role"))  # noqa: ARG005, E731
    rows = prefix.select(*SNAPSHOT, "protocol", "src_port", "dst_port", F.greatest("bytes", F.lit(0.0)).alias("bytes"), F.inline(F.array(side("src", "dst"), side("dst", "src"))))
    out, into = F.col("role") == "src", F.col("role") == "dst"
    n = lambda c: F.log1p(F.count(F.when(c, 1)))
    total = lambda c: F.log1p(F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0.0)))
    return rows.groupBy(*SNAPSHOT, "node").agg(
        n(into).alias("in_count"),
        n(out).alias("out_count"),
        total(into).alias("in_bytes"),
        total(out).alias("out_bytes"),
        n(F.col("protocol") == 6).alias("tcp"),
        n(F.col("protocol") == 17).alias("udp"),
        n(out & (F.col("src_port") < 1024)).alias("low_src_port"),
        n(into & (F.col("dst_port") < 1024)).alias("low_dst_port"),
    )


def latest_edges(prefix: DataFrame, cap: int = EDGE_CAP) -> DataFrame:
    """The ``cap`` edges of each snapshot completed last, ties to the larger row."""
    order = [F.desc("completion_us"), F.desc("row")]
    piece = prefix.withColumn("_p", F.pmod(F.xxhash64("row"), F.lit(CAP_PARTS)))
    some = piece.withColumn("_r", F.row_number().over(Window.partitionBy(*SNAPSHOT, "_p").orderBy(*order))).where(F.col("_r") <= cap)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*SNAPSHOT).orderBy(*order))).where(F.col("_r") <= cap).drop("_r", "_p")


def kept_nodes(features: DataFrame, message_edges: DataFrame, targets: DataFrame, slot: int = 60, offset: int = 30) -> DataFrame:
    """The nodes with features that touch a retained edge or a target, and target nodes without history, whose features
    are 0. Features are those of the full history."""
    at = targets.select("part", (F.col("slot") * slot + offset).alias("cutoff"), "src", "dst")
    ends = lambda df: df.select(*SNAPSHOT, F.explode(F.array("src", "dst")).alias("node"))
    used = ends(message_edges).union(ends(at)).distinct()
    names = [c for c in features.columns if c not in (*SNAPSHOT, "node")]
    return used.join(features, [*SNAPSHOT, "node"], "left").fillna(0.0, names)


def snapshot_summary(prefix: DataFrame, message_edges: DataFrame, targets: DataFrame, slot: int = 60, offset: int = 30) -> DataFrame:
    """Per snapshot with targets: target edges, history edges, message edges, and target endpoints without history,
    counted per endpoint."""
    at = targets.select("part", (F.col("slot") * slot + offset).alias("cutoff"), "src", "dst")
    seen = prefix.select(*SNAPSHOT, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("_seen", F.lit(1))
    ends = at.select(*SNAPSHOT, F.explode(F.array("src", "dst")).alias("node")).join(seen, [*SNAPSHOT, "node"], "left")
    cold = ends.groupBy(*SNAPSHOT).agg((F.count(F.lit(1)) / 2).cast("bigint").alias("target_edges"), F.count(F.when(F.col("_seen").isNull(), 1)).alias("cold_endpoints"))
    count = lambda df, name: df.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias(name))
    return cold.join(count(prefix, "history_edges"), SNAPSHOT, "left").join(count(message_edges, "message_edges"), SNAPSHOT, "left").fillna(0)


def topology(flows: DataFrame, seconds: int) -> DataFrame:
    """Per calendar window: nodes, edges, distinct directed pairs, repeated pairs, extra parallel edges and density (0
    up to one node). Self-pairs don't count for density."""
    rows = flows.select(F.floor(F.col("second") / seconds).alias("window"), "src", "dst")
    pairs = rows.groupBy("window", "src", "dst").agg(F.count(F.lit(1)).alias("k"))
    nodes = pairs.select("window", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("window").agg(F.count(F.lit(1)).alias("nodes"))
    made = pairs.groupBy("window").agg(F.sum("k").alias("edges"), F.count(F.lit(1)).alias("unique_pairs"), F.count(F.when(F.col("k") > 1, 1)).alias("repeated_pairs"), F.sum(F.col("k") - 1).alias("parallel_edges"), F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("nonself"))
    n = F.col("nodes")
    return made.join(nodes, "window").withColumn("density", F.when(n > 1, F.col("nonself") / (n * (n - 1))).otherwise(0.0)).drop("nonself")


def _links(pairs: DataFrame, group: str) -> DataFrame:
    """The distinct pairs, once for all that read them."""
    return materialise(pairs.select(group, "src", "dst").dropna().distinct(), "links")


def _by_size(links: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None, int]:
    """The links of groups that one task can label, those of larger groups, and the tasks for the former."""
    sizes = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if not total:
        return None, None, 1
    parts = max(shuffle_partitions(links.sparkSession), -(-total // LOCAL_LINKS))
    if largest <= LOCAL_LINKS:
        return links, None, parts
    large = sized(sizes.where(F.col("_n") > LOCAL_LINKS).select(*keys))
    return links.join(large, keys, "left_anti"), links.join(large, keys, "left_semi"), parts


def _weak(links: DataFrame, group: str) -> DataFrame:
    small, large, parts = _by_size(links, [group])
    if small is None:
        return links.select(group, F.col("src").alias("node"), F.col("src").alias("component"))
    made = components.labelled(small, [group], parts, components.weak_labels)
    return made if large is None else made.unionByName(_weak_pieces(materialise(large, "links"), group))


def _weak_pieces(links: DataFrame, group: str) -> DataFrame:
    """Components of groups of any size: pieces of the links are labelled, each in one task, and what is left is links
    between the labels of nodes that lie in several pieces. Where that isn't half the links, as the order of the nodes
    says nothing about their links, the rest is left to rounds."""
    before = links.count()
    own = components.pieces(links, [group], -(-before // LOCAL_LINKS))
    made = own.groupBy(group, "node").agg(F.min("component").alias("_low"), F.collect_set("component").alias("_all"))
    made = materialise(made.select(group, "node", "_low", F.array_remove("_all", F.col("_low")).alias("_others")), "pieces")
    rest = materialise(made.select(group, F.col("_low").alias("src"), F.explode("_others").alias("dst")).distinct(), "links")
    # the least node of a component is its own label in every piece, so labels of labels are least nodes too
    found = materialise((_weak if rest.count() <= before / 2 else _weak_rounds)(rest, group), "labels")
    named = sized(found.withColumnRenamed("node", "_low"))
    return made.join(named, [group, "_low"], "left").select(group, "node", F.coalesce("component", "_low").alias("component"))


def _weak_rounds(pairs: DataFrame, group: str) -> DataFrame:
    both = pairs.select(group, "src", "dst").union(pairs.select(group, F.col("dst"), F.col("src"))).distinct()
    links = materialise(both.withColumnsRenamed({"src": "node", "dst": "other"}), "links")
    labels = materialise(links.groupBy(group, "node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        # merged, as the size of a compressed table says little about the memory of a broadcast
        near = links.join(labels.select(group, F.col("node").alias("other"), "component").hint("merge"), [group, "other"]).groupBy(group, "node").agg(F.min("component").alias("_near"))
        jump = labels.select(group, F.col("node").alias("component"), F.col("component").alias("_jump"))
        after = labels.join(near.hint("merge"), [group, "node"]).join(jump.hint("merge"), [group, "component"])
        after = materialise(after.select(group, "node", F.least("component", "_near", "_jump").alias("component"), (F.least("_near", "_jump") < F.col("component")).alias("_moved")), "labels")
        moved = not after.where("_moved").isEmpty()
        labels = after.drop("_moved")
        if not moved:
            return labels


def weak_components(pairs: DataFrame, group: str) -> DataFrame:
    """(group, node, component): the least node of each weak component, per group.

    pairs: (group, src, dst). Groups of up to LOCAL_LINKS distinct links are labelled whole, each in one task. Larger ones
    are cut into pieces and shrunk to the links between these (`_weak_pieces`). Only where that doesn't halve them do
    labels pass along edges and jump to their label's label, so rounds grow with the logarithm of the longest path rather
    than its length; each round is written to the shared folder.
    """
    return _weak(_links(pairs, group), group)


def _farthest(links: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, node, color): the greatest node from which each node can be reached, from start to end of the links. Colors
    jump to their color's color, so rounds grow with the logarithm of a path."""
    nodes = links.select(*keys, F.explode(F.array(start, end)).alias("node")).distinct()
    colors = materialise(nodes.withColumn("color", F.col("node")), "colors")
    while True:
        into = links.join(colors.withColumnRenamed("node", start).hint("merge"), [*keys, start]).groupBy(*keys, F.col(end).alias("node")).agg(F.max("color").alias("_in"))
        jump = colors.select(*keys, F.col("node").alias("color"), F.col("color").alias("_jump"))
        after = colors.join(into.hint("merge"), [*keys, "node"], "left").join(jump.hint("merge"), [*keys, "color"])
        up = F.greatest("color", "_in", "_jump")  # nulls are skipped
        after = materialise(after.select(*keys, "node", up.alias("color"), (up > F.col("color")).alias("_moved")), "colors")
        moved = not after.where("_moved").isEmpty()
        colors = after.drop("_moved")
        if not moved:
            return colors


def _strong_rounds(links: DataFrame, group: str) -> DataFrame:
    """Components of groups of any size, found part by part; a part is what may still be one component.

    Links that no cycle can hold, as nothing enters their start or leaves their end, are taken off while that takes a
    tenth of them. Then the greatest nodes spread forward and backward: nodes with the same two are a part, and a
    component where the two are one. Parts that became small enough are labelled whole, each in one task.
    """
    nodes = materialise(links.select(group, F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    keys = [group, "_forward", "_backward"]
    none = nodes.schema["node"].dataType.simpleString()
    rest = materialise(links.where("src != dst").withColumns({k: F.lit(0).cast(none) for k in keys[1:]}), "links")
    found: list[DataFrame] = []
    while True:
        before = rest.count()
        entered, left = rest.select(*keys, F.col("dst").alias("src")).distinct(), rest.select(*keys, F.col("src").alias("dst")).distinct()
        kept = materialise(rest.join(entered.hint("merge"), [*keys, "src"], "left_semi").join(left.hint("merge"), [*keys, "dst"], "left_semi"), "links")
        small, large, parts = _by_size(kept, keys)
        if small is None:
            break
        if large is None or kept.count() > 0.9 * before:
            found.append(components.labelled(small, keys, parts, components.strong_labels).select(group, "node", "component"))
            if large is None:
                break
            large = materialise(large, "links")
            inside = large
            for k, start, end in (("_ahead", "src", "dst"), ("_behind", "dst", "src")):
                colors = _farthest(inside, keys, start, end)
                for side in ("src", "dst"):
                    inside = inside.join(colors.select(*keys, F.col("node").alias(side), F.col("color").alias(f"{k}_{side}")).hint("merge"), [*keys, side])
                inside = materialise(inside.where(f"{k}_src = {k}_dst").drop(f"{k}_dst").withColumnRenamed(f"{k}_src", k), "inside")
            whole = inside.where("_ahead = _behind")
            found.append(whole.select(group, F.explode(F.array("src", "dst")).alias("node"), F.col("_ahead").alias("component")).distinct())
            rest = inside.where("_ahead != _behind").select(group, F.col("_ahead").alias("_forward"), F.col("_behind").alias("_backward"), "src", "dst")
        else:
            rest = kept
    if not found:
        return nodes.withColumn("component", F.col("node"))
    known = materialise(functools.reduce(DataFrame.unionByName, found), "found")
    return nodes.join(known.hint("merge"), [group, "node"], "left").select(group, "node", F.coalesce("component", "node").alias("component"))


def _strong(links: DataFrame, group: str) -> DataFrame:
    small, large, parts = _by_size(links, [group])
    if small is None:
        return links.select(group, F.col("src").alias("node"), F.col("src").alias("component"))
    made = components.labelled(small, [group], parts, components.strong_labels)
    return made if large is None else made.unionByName(_strong_rounds(large, group))


def strong_components(pairs: DataFrame, group: str) -> DataFrame:
    """(group, node, component): per group the strong components, each named by one of its nodes. Groups of up to
    LOCAL_LINKS distinct links are labelled whole, each in one task; larger ones in rounds (`_strong_rounds`)."""
    return _strong(_links(pairs, group), group)


def component_counts(pairs: DataFrame, group: str) -> DataFrame:
    """(group, weak_components, strong_components)."""
    links = _links(pairs, group)
    # a component has one node of its name
    count = lambda df, name: df.groupBy(group).agg(F.count(F.when(F.col("node") == F.col("component"), 1)).alias(name))
    return count(_weak(links, group), "weak_components").join(count(_strong(links, group), "strong_components"), group)


def attention_layer(nodes: DataFrame, links: DataFrame, weights: dict[str, np.ndarray], heads: int, slope: float = 0.2) -> DataFrame:
    """(node, h array<double>): the forward pass of one graph attention layer with dynamic attention.

    nodes: (node, x array<double>); links: (src, dst, e array<double>), parallel links allowed; weights: source,
    target (out x in), edge (out x edge size), attention (heads x out / heads) and bias (out). Every node has a loop
    with a zero edge. Softmax is taken per target node and head; all sums combine before the shuffle, so a node with
    most links is no task of its own. Weights are constants of the plan.
    """
    out = weights["bias"].shape[0]
    width = out // heads
    dot = lambda m, x, i: sum((F.lit(float(w)) * F.get(x, F.lit(k)) for k, w in enumerate(m[i])), F.lit(0.0))
    ahead = nodes.select("node", *[dot(weights["source"], F.col("x"), i).alias(f"s{i}") for i in range(out)], *[dot(weights["target"], F.col("x"), i).alias(f"t{i}") for i in range(out)])
    size = weights["edge"].shape[1]
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.array(*[F.lit(0.0)] * size).alias("e"))
    pairs = links.select("src", "dst", "e").unionByName(loops)
    met = pairs.join(ahead.select(F.col("node").alias("src"), *[f"s{i}" for i in range(out)]), "src").join(ahead.select(F.col("node").alias("dst"), *[f"t{i}" for i in range(out)]), "dst")

    def logit(h: int) -> Column:
        total = F.lit(0.0)
        for c in range(width):
            i = h * width + c
            v = F.col(f"s{i}") + F.col(f"t{i}") + dot(weights["edge"], F.col("e"), i)
            total = total + F.when(v >= 0, v).otherwise(v * slope) * F.lit(float(weights["attention"][h, c]))
        return total

    scored = met.select("dst", *[f"s{i}" for i in range(out)], *[logit(h).alias(f"l{h}") for h in range(heads)])
    top = scored.groupBy("dst").agg(*[F.max(f"l{h}").alias(f"m{h}") for h in range(heads)])
    eased = scored.join(top, "dst").select("dst", *[f"s{i}" for i in range(out)], *[F.exp(F.col(f"l{h}") - F.col(f"m{h}")).alias(f"w{h}") for h in range(heads)])
    sums = eased.groupBy("dst").agg(*[F.sum(f"w{h}").alias(f"w{h}") for h in range(heads)], *[F.sum(F.col(f"w{i // width}") * F.col(f"s{i}")).alias(f"o{i}") for i in range(out)])
    return sums.select(F.col("dst").alias("node"), F.array(*[F.col(f"o{i}") / F.col(f"w{i // width}") + float(weights["bias"][i]) for i in range(out)]).alias("h"))


def slot_counts(targets: DataFrame) -> DataFrame:
    """(part, slot, n, first_second, last_second): targets per slot."""
    return targets.groupBy("part", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("second").alias("first_second"), F.max("second").alias("last_second"))


def completion_overlap(all_edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """(part, n, n_overlapping): flows that complete at or after the end of their part. bounds: (part, end_us)."""
    return all_edges.join(F.broadcast(bounds), "part").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("completion_us") >= F.col("end_us"), 1)).alias("n_overlapping"))  # one row per part


def metric_summary(snapshots: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, n, mean, median, p90, maximum) over snapshots, one row each."""
    values = snapshots.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    group = [*keys, "metric"]
    ranks = exact_quantiles(values, group, "value", [0.5, 0.9], ["median", "p90"])
    return values.groupBy(*group).agg(F.avg("value").alias("mean"), F.max("value").alias("maximum")).join(ranks, group)
