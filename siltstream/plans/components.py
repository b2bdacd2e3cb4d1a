"""Components of graphs whose links fit one task: labels in arrays, whole groups at a time."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Links that are labelled at once; groups are never cut, so at most so many and those of one group.
AT_ONCE = 200_000


def weak_labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each of n nodes' weak component: roots hang on lower roots, then every path is closed up."""
    label = np.arange(n)
    while True:
        a, b = label[src], label[dst]
        apart = a != b
        if not apart.any():
            return label
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, above := label[label]):
            label = above


def strong_labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each of n nodes' strong component.

    Links from a node that none leads to, or to a node that none leaves, are on no cycle; they are taken off while that
    takes a tenth of them. The rest is walked in depth once (Tarjan).
    """
    label = np.arange(n)
    on = src != dst
    src, dst = src[on], dst[on]
    while len(src):
        entered, left = np.zeros(n, bool), np.zeros(n, bool)
        entered[dst], left[src] = True, True
        on = entered[src] & left[dst]
        before, src, dst = len(src), src[on], dst[on]
        if len(src) > 0.9 * before:
            break
    if not len(src):
        return label
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    order = np.argsort(a, kind="stable")
    onward, first = b[order].tolist(), np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist()
    seen, low, at = [-1] * len(nodes), [0] * len(nodes), first[:-1]
    owner, stack, number = [-1] * len(nodes), [], 0
    for root in range(len(nodes)):
        if seen[root] >= 0:
            continue
        path = [root]
        seen[root] = low[root] = number
        number += 1
        stack.append(root)
        while path:
            v = path[-1]
            if at[v] < first[v + 1]:
                w = onward[at[v]]
                at[v] += 1
                if seen[w] < 0:
                    seen[w] = low[w] = number
                    number += 1
                    stack.append(w)
                    path.append(w)
                elif owner[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                cut = bisect_left(stack, seen[v], key=seen.__getitem__)  # a stack is in the order of its numbers
                members, stack[cut:] = stack[cut:], []
                least = min(members)
                for w in members:
                    owner[w] = least
    label[nodes] = nodes[owner]
    return label


def labelled(links: DataFrame, keys: list[str], parts: int, labels: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """(keys, node, component) of links (keys, src, dst): labels gets the links of whole groups, one group after another,
    with nodes numbered in their order. A group goes to one task."""
    placed = links.select(*keys, "src", "dst").repartition(parts, *keys).sortWithinPartitions(*keys)
    return _solved(placed, keys, labels, True)


def pieces(links: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(keys, node, component): links in the order of keys and src, cut every AT_ONCE of them or so, wherever that is; a
    node has a row in each piece that holds it, with the least node of its weak component there."""
    placed = links.select(*keys, "src", "dst").repartitionByRange(parts, *keys, "src", "dst").sortWithinPartitions(*keys, "src")
    return _solved(placed, keys, weak_labels, False)


def _solved(placed: DataFrame, keys: list[str], labels: Callable[[np.ndarray, np.ndarray, int], np.ndarray], entire: bool) -> DataFrame:
    """entire: groups are never cut."""
    kinds = dict(placed.dtypes)

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        rows = len(whole)
        fresh = np.zeros(rows, bool)
        for k in keys:
            column = whole.column(k)
            fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows - 1)).to_numpy()
        group = np.cumsum(fresh)
        ends = np.concatenate([whole.column(c).to_numpy() for c in ("src", "dst")])
        values = None
        if ends.dtype == object:
            values, ends = np.unique(ends, return_inverse=True)
        both = np.concatenate([group, group])
        order = np.lexsort((ends, both))
        new = np.ones(2 * rows, bool)
        new[1:] = (ends[order][1:] != ends[order][:-1]) | (both[order][1:] != both[order][:-1])
        number = np.empty(2 * rows, np.int64)
        number[order] = np.cumsum(new) - 1
        places = order[new]  # one row of each node
        label = labels(number[:rows], number[rows:], len(places))
        named = whole.select(keys).take(pa.array(places % rows)).combine_chunks()
        node = ends[places] if values is None else values[ends[places]]
        return pa.Table.from_arrays([*named.columns, pa.array(node), pa.array(node[label])], [*keys, "node", "component"]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        key = lambda batch, i: [batch.column(k)[i].as_py() for k in keys]
        for batch in filter(len, batches):
            ended = bool(held) and key(held[-1], -1) != key(batch, 0)
            held.append(batch)
            rows += len(batch)
            if rows < AT_ONCE:
                continue
            if not entire:
                yield solved(held)
                held, rows = [], 0
                continue
            other = np.zeros(len(batch), bool)
            for k in keys:
                other |= pc.not_equal(batch.column(k), batch.column(k)[-1]).to_numpy(zero_copy_only=False)
            start = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if start or ended:  # where the last group begins
                yield solved([*held[:-1], *[batch.slice(0, start)] * bool(start)])
                held, rows = [batch.slice(start)], len(batch) - start
        if held:
            yield solved(held)

    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return placed.mapInArrow(run, f"{named}, node {kinds['src']}, component {kinds['src']}")
