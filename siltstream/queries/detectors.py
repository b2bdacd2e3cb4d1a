"""Queries that train and evaluate detectors on flows. What they learn has no SQL form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstream.functions.text import number, trimmed
from siltstream.models import networks, snapshots, supervised, training
from siltstream.models.tensor import logistic_loss
from siltstream.operators import evaluate, graph, history, preprocess, sequences
from siltstream.queries.audit import base
from siltstream.queries.general import rounded
from siltstream.queries.graphs import OFFSET, SLOT, _prefix, flow_edges
from siltstream.session import materialise, sized

NUMERIC = ["src_port", "dst_port", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_byts_s", "flow_pkts_s", "flow_iat_mean", "init_fwd_win_byts"]


def prepared(spark, d):
    """(row_id, split, file_date, flow_timestamp, y) and the scaled features f0, f1, ... of the classified flows."""
    rows = base(spark, d).where("status != 'unclassified' and split is not null")
    rows = rows.withColumns({c: number(F.col(c)) for c in ("flow_duration", "flow_byts_s", "flow_pkts_s")} | {"protocol": trimmed(F.col("protocol")), "y": (F.col("status") == "malicious").cast("int"), "split": F.lower(F.trim("split"))})
    # heavy tails are drawn in, as the learners expect
    rows = rows.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in NUMERIC})
    state = preprocess.fit(rows.where("split = 'train'"), [*NUMERIC, "protocol"], ["protocol"], "label_key")
    made = state.transform(rows, ["row_id", "split", "file_date", "flow_timestamp", "y"])
    names = {c: f"f{i}" for i, c in enumerate(state.outputs)}
    return made.withColumnsRenamed(names), list(names.values())


def _metrics(scores, model, threshold=0.5):
    made = evaluate.confusion(scores, ["split"], "y", "score", F.lit(threshold)).join(evaluate.ranking(scores, ["split"], "y", "score").drop("n_pos", "n_neg"), "split")
    return rounded(made.withColumn("model", F.lit(model)))


def _supervised(spark, d, name):
    rows, features = prepared(spark, d)
    data = supervised.assembled(rows, features)
    train = supervised.weighted(data.where("split = 'train'"), "y").persist()
    fits = {
        "logistic_regression": lambda: supervised.logistic_regression(train, "y"),
        "random_forest": lambda: supervised.random_forest(train, "y", 16),
        "boosted_trees": lambda: supervised.boosted_trees(train, "y", 10),
        "perceptron": lambda: supervised.perceptron(train, "y", len(features), iterations=30),
    }
    model = fits[name]()
    train.unpersist()
    return _metrics(supervised.predicted(model, data.where("split != 'train'"), ["split", "y"]), name)


def model_logistic_regression(spark, d):
    return _supervised(spark, d, "logistic_regression")


def model_random_forest(spark, d):
    return _supervised(spark, d, "random_forest")


def model_boosted_trees(spark, d):
    return _supervised(spark, d, "boosted_trees")


def model_perceptron(spark, d):
    return _supervised(spark, d, "perceptron")


def model_isolation_forest(spark, d):
    rows, features = prepared(spark, d)
    scores = training.isolation_forest(rows, rows.where("split = 'train' and y = 0"), features, ["row_id", "split", "y"])
    return _metrics(scores.where("split != 'train'"), "isolation_forest")


def _stack(batch, name="x"):
    return training.matrix(batch.column(name))


def model_autoencoder(spark, d):
    """Trained on benign training rows; alarms above the threshold that 1 % of benign validation rows reach."""
    rows, features = prepared(spark, d)
    data = rows.select("row_id", "split", "y", F.array(*features).alias("x"))
    make = lambda: networks.Autoencoder(len(features), [32, 8, 32])
    network, _ = training.fit(data.where("split = 'train' and y = 0").select("row_id", "x"), make, lambda m, b: (m.loss(_stack(b)), float(b.num_rows)), epochs=3, steps=4)
    scores = training.scored(data.where("split != 'train'"), network, make, lambda m, b: m.scores(_stack(b)), ["split", "y"])
    at = evaluate.benign_thresholds(scores.where("split = 'validation' and y = 0"), [], "score", [0.01]).first()
    return _metrics(scores, "autoencoder", at["threshold"] if at else float("inf"))


def _loss(x, missing=None):
    def loss(m, b: pa.RecordBatch):
        y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
        w = b.column("weight").to_numpy(zero_copy_only=False).astype(float)
        return logistic_loss(m.logits(x(b), missing(b) if missing else None), y, w), float(w.sum())

    return loss


def _probability(x, missing=None):
    return lambda m, b: 1 / (1 + np.exp(-np.clip(m.logits(x(b), missing(b) if missing else None).value, -60, 60)))


def model_transformer(spark, d, length=8):
    rows, features = prepared(spark, d)
    placed = sequences.day_positions(rows.where("flow_timestamp is not null and to_date(flow_timestamp) = file_date"), "file_date", "flow_timestamp", "row_id")
    stride = F.when(F.col("split") == "train", 16).otherwise(8)
    wanted = (F.col("position") >= sequences.WARM_UP) & ((F.col("position") - sequences.WARM_UP) % stride == 0)
    made = sequences.trailing(placed, "file_date", features, length, wanted)
    data = made.select("row_id", "split", "y", F.transform("sequence", lambda s: F.array(*[s[f] for f in features])).alias("x"))
    make = lambda: networks.FlowTransformer(len(features), 16, 2, 1)
    x = lambda b: training.matrix(b.column("x"), (length, len(features)))
    train = supervised.weighted(data.where("split = 'train'"), "y")
    network, _ = training.fit(train, make, _loss(x), epochs=3, steps=3)
    return _metrics(training.scored(data.where("split != 'train'"), network, make, _probability(x), ["split", "y"]), f"transformer_l{length}")


def model_history_head(spark, d, lags=3):
    """A head over the flow and its last slots of the same entity."""
    rows, features = prepared(spark, d)
    edges = flow_edges(spark, d).withColumn("id", F.col("row")).join(rows.select(F.col("row_id").alias("id"), "y", "split", F.array(*features).alias("x")), "id")
    edges = materialise(edges.select("id", "part", "second", "completion_us", "src", "dst", "row", "y", "split", "x"), "edges")
    none = F.array(*[F.lit(0.0)] * len(features))

    def data(edges, *more):
        """Of whole parts, as history never leaves its part. The flows that are history are far fewer than the times that
        they are: they are sought out first, and rows take their features by the id of each lag."""
        narrow = history.history_lookup(edges.select("id", "part", "second", "completion_us", "src", "dst", "row"), lags, SLOT, OFFSET)
        ids = materialise(narrow.select("id", *[F.col("history")[k - 1]["history_id"].alias(f"h{k}") for k in range(1, lags + 1)]), "history")
        used = ids.select(F.explode(F.array(*[f"h{k}" for k in range(1, lags + 1)])).alias("h")).where("h is not null").distinct()
        used = sized(materialise(used.join(edges.select(F.col("id").alias("h"), "x"), "h"), "history"))
        made = edges.select("id", "split", "y", "x", *more).join(ids, "id")
        for k in range(1, lags + 1):
            made = made.join(used.withColumnsRenamed({"h": f"h{k}", "x": f"x{k}"}), f"h{k}", "left")
        steps = [f"x{k}" for k in range(lags, 0, -1)]
        sequence = F.array(*[F.coalesce(s, none) for s in steps], F.col("x"))
        empty = F.array(*[F.col(s).isNull().cast("double") for s in steps], F.lit(0.0))
        return made.select("id", "split", "y", sequence.alias("x"), empty.alias("missing"), *more)

    make = lambda: networks.HistoryHead(len(features), 16, 2, 1)
    x = lambda b: training.matrix(b.column("x"), (lags + 1, len(features)))
    missing = lambda b: training.matrix(b.column("missing")) > 0
    train = data(supervised.weighted(edges.where("split = 'train'"), "y"), "weight")
    network, _ = training.fit(train, make, _loss(x, missing), epochs=2, steps=3)
    scores = materialise(training.scored(data(edges.where("split != 'train'")), network, make, _probability(x, missing), ["split", "y"]), "scores")
    return _metrics(scores, f"history_l{lags + 1}")


def model_graph_attention(spark, d, kind="gat"):
    rows, features = prepared(spark, d)
    known = materialise(rows.select(F.col("row_id").alias("row"), "y", "split", F.array(*features).alias("x")), "known")
    prefix, targets = _prefix(spark, d)
    messages = materialise(graph.latest_edges(prefix).select(*graph.SNAPSHOT, "row", "src", "dst"), "messages")
    targets = materialise(targets.select("part", "slot", "row", "src", "dst"), "targets")
    wanted = targets.select("part", (F.col("slot") * SLOT + OFFSET).alias("cutoff"), "row", "src", "dst").join(known.select("row", "y"), "row")
    nodes = graph.kept_nodes(graph.node_features(prefix), messages, targets, SLOT, OFFSET)
    data = snapshots.snapshot_rows(nodes, messages, supervised.weighted(wanted, "y"), known)
    make = lambda: networks.snapshot_network(kind, len(features), len(features))
    network, _ = training.fit(data.where("part = 0"), make, snapshots.snapshot_loss(len(features)), epochs=2, steps=2)
    scores = materialise(snapshots.target_scores(data.where("part > 0"), network, make, len(features)), "scores")
    return _metrics(scores.join(known.select("row", "split"), "row"), kind)


def model_self_only(spark, d):
    return model_graph_attention(spark, d, "self_only")


def model_edge_mlp(spark, d):
    return model_graph_attention(spark, d, "edge_mlp")


QUERIES = {f.__name__: f for f in (model_logistic_regression, model_random_forest, model_boosted_trees, model_perceptron, model_isolation_forest, model_autoencoder, model_transformer, model_history_head, model_graph_attention, model_self_only, model_edge_mlp)}
SQL: dict[str, str] = {}
