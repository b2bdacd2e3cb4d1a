"""Fitting on the cluster: gradients are summed over all rows on the workers, steps are taken on the driver."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.models.networks import Network
from siltstream.models.tensor import Adam, Tensor

#: Rows whose gradient is taken at once.
BATCH_ROWS = 2_048


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def matrix(column: pa.Array, shape: tuple[int, ...] = ()) -> np.ndarray:
    """A list column, lists of equal length, as (rows, length) or (rows, *shape)."""
    flat = column
    while pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):
        flat = flat.flatten()
    rows = len(column)
    values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
    return values.reshape((rows, *shape) if shape else (rows, -1))


def fit(rows: DataFrame, make: Callable[[], Network], loss: Callable[[Network, pa.RecordBatch], tuple[Tensor, float]], epochs: int, steps: int, rate: float = 1e-2, decay: float = 1e-4, check: Callable[[Network], float] | None = None, patience: int = 2, least: float = 1e-5) -> tuple[Network, list[float]]:
    """A network trained on all rows, and its checks.

    Each epoch takes ``steps`` steps, every one over its own share of the rows of each partition; a step's gradient
    is summed batch by batch on the workers and only the sums reach the driver, so rows are neither sampled nor
    gathered. loss gives the mean loss of a batch and its weight. With a check, a larger value better, the best state
    is kept and training ends after ``patience`` epochs without a gain of ``least``; ties keep the earlier state.
    """
    network = make()
    optimiser = Adam(network.parameters, rate, decay)
    cached = rows.withColumn("_step", F.pmod(F.xxhash64(*rows.columns), F.lit(steps))).persist()
    kept, best, bad, checks = network.state(), -np.inf, 0, []
    for _ in range(epochs):
        for step in range(steps):
            state = rows.sparkSession.sparkContext.broadcast(_pack(network.state()))

            def gradients(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
                model = make().load(_unpack(state.value))
                total, weight = {k: np.zeros(p.shape) for k, p in model.parameters.items()}, 0.0
                for batch in batches:
                    for start in range(0, batch.num_rows, BATCH_ROWS):
                        value, share = loss(model, batch.slice(start, BATCH_ROWS))
                        value.backward()
                        for k, p in model.parameters.items():
                            if p.grad is not None:
                                total[k] += share * p.grad
                            p.grad = None
                        weight += share
                if weight:
                    yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([_pack(total)], pa.binary())], ["weight", "gradient"])

            parts = cached.where(F.col("_step") == step).drop("_step").mapInArrow(gradients, "weight double, gradient binary").toLocalIterator()
            weight, total = 0.0, None
            for r in parts:  # one row per partition, added as it comes
                part = _unpack(r["gradient"])
                total = part if total is None else {k: total[k] + part[k] for k in total}
                weight += r["weight"]
            state.unpersist()
            if total is not None:
                optimiser.step({k: g / weight for k, g in total.items()})
        if check is not None:
            checks.append(check(network))
            if checks[-1] > best + least:
                kept, best, bad = network.state(), checks[-1], 0
            else:
                bad += 1
                if bad >= patience:
                    break
    cached.unpersist()
    return network.load(kept) if check is not None else network, checks


def scored(rows: DataFrame, network: Network, make: Callable[[], Network], score: Callable[[Network, pa.RecordBatch], np.ndarray], keep: list[str]) -> DataFrame:
    """keep and the score of every row, by the network on the workers."""
    state = rows.sparkSession.sparkContext.broadcast(_pack(network.state()))
    kinds = ", ".join(f"{c} {k}" for c, k in rows.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make().load(_unpack(state.value))
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(score(model, part), pa.float64())], [*keep, "score"])

    return rows.mapInArrow(run, f"{kinds}, score double")


def isolation_forest(rows: DataFrame, usual_rows: DataFrame, features: list[str], keep: list[str], trees: int = 100, sample: int = 256, seed: int = 42, most: int = 250_000) -> DataFrame:
    """keep and the anomaly score of every row, in (0, 1], by trees grown on a sample of at most ``most`` of the usual
    rows, drawn by a hash of keep. Without usual rows every score is 1."""
    drawn = usual_rows.select(*keep, *features).orderBy(F.xxhash64(F.lit(seed), *keep), *keep).limit(most).select(*features).toPandas()
    data = drawn.to_numpy(dtype=np.float64)
    rng = np.random.default_rng(seed)
    size = min(sample, len(data))
    deepest = _levels(size)
    forest = [_tree(data[rng.choice(len(data), size, replace=False)], 0, deepest, rng) for _ in range(trees)] if size else []
    known = rows.sparkSession.sparkContext.broadcast(forest)
    kinds = ", ".join(f"{c} {k}" for c, k in rows.select(*keep).dtypes)
    usual = _path(size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[features].to_numpy(dtype=np.float64)
            depth = np.zeros(len(x))
            for tree in known.value:
                _descend(tree, x, np.arange(len(x)), 0, depth)
            score = 2 ** (-depth / max(len(known.value), 1) / max(usual, 1e-9))
            yield frame[keep].assign(score=score)

    return rows.select(*keep, *[c for c in features if c not in keep]).mapInPandas(run, f"{kinds}, score double")


def _levels(n: int) -> int:
    return max(1, int(np.ceil(np.log2(max(n, 2)))))


def _path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


def _tree(x: np.ndarray, depth: int, deepest: int, rng: np.random.Generator):
    low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(0), np.zeros(0))
    wide = np.flatnonzero(high > low)
    if depth >= deepest or len(x) < 2 or not len(wide):
        return len(x)
    feature = int(rng.choice(wide))
    cut = float(rng.uniform(low[feature], high[feature]))
    side = x[:, feature] < cut
    return feature, cut, _tree(x[side], depth + 1, deepest, rng), _tree(x[~side], depth + 1, deepest, rng)


def _descend(node, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if not len(at):
        return
    if isinstance(node, int):
        out[at] += depth + _path(node)
        return
    feature, cut, left, right = node
    side = x[at, feature] < cut
    _descend(left, x, at[side], depth + 1, out)
    _descend(right, x, at[~side], depth + 1, out)
