import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstream.models import networks, snapshots, supervised, training
from siltstream.models.tensor import Tensor, logistic_loss, sum_by
from siltstream.operators import graph

rng = np.random.default_rng(0)


def numeric(network, loss, names=6, eps=1e-6):
    value = loss()
    value.backward()
    for k, p in network.parameters.items():
        g = p.grad if p.grad is not None else np.zeros(p.shape)
        for _ in range(names):
            at = tuple(rng.integers(0, s) for s in p.shape)
            keep = p.value[at]
            p.value[at] = keep + eps
            up = loss().value
            p.value[at] = keep - eps
            down = loss().value
            p.value[at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=1e-5), k


def snapshot():
    return networks.Snapshot(rng.normal(size=(5, 8)), np.array([[0, 1, 1, 3], [1, 2, 2, 3]]), rng.normal(size=(4, 3)), np.array([[0, 4], [2, 1]]), rng.normal(size=(2, 6)))


@pytest.mark.parametrize("kind", ["gat", "self_only", "edge_mlp"])
def test_graph_gradients(kind):
    m, s, y = networks.snapshot_network(kind, 6, 3, 8, 2), snapshot(), np.array([0.0, 1.0])
    numeric(m, lambda: logistic_loss(m.logits(s), y, np.ones(2)))


def test_sequence_gradients():
    y, w = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    t, x = networks.FlowTransformer(4, 8, 2, 1), rng.normal(size=(3, 5, 4))
    numeric(t, lambda: logistic_loss(t.logits(x), y, w))
    h, missing = networks.HistoryHead(4, 8, 2, 1), np.array([[True, False, True, False, False]] * 3)
    numeric(h, lambda: logistic_loss(h.logits(x, missing), y, w))
    before = h.logits(x, missing).value
    x[:, 0], x[:, 2] = 99, -99  # empty slots change nothing
    assert np.allclose(before, h.logits(x, missing).value)


def test_autoencoder_gradients():
    a, x = networks.Autoencoder(5, [4, 2, 4]), rng.normal(size=(7, 5))
    for k, p in a.parameters.items():  # with biases of 0 some units stand at the kink of ReLU
        if k.endswith(".b"):
            p.value = rng.normal(size=p.shape)
    numeric(a, lambda: a.loss(x))


def test_attention_layer_equals_the_relational_form(spark):
    m, s = networks.GraphAttention(6, 3, 8, 2), snapshot()
    x = rng.normal(size=(5, 8))
    p = m.state()
    weights = {"source": p["a0.send.w"].T, "target": p["a0.receive.w"].T, "edge": p["a0.link.w"].T, "attention": p["a0.score"][0], "bias": p["a0.shift"]}
    nodes = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "node int, x array<double>")
    links = spark.createDataFrame([(int(a), int(b), e.tolist()) for a, b, e in zip(*s.links, s.link_features)], "src int, dst int, e array<double>")
    got = {r.node: r.h for r in graph.attention_layer(nodes, links, weights, 2).collect()}
    want = m.layer(0, Tensor(x), s.links, s.link_features).value
    assert np.allclose([got[i] for i in range(5)], want)


def test_fit_on_the_cluster_learns(spark):
    x = rng.normal(size=(400, 3))
    rows = spark.createDataFrame([(i, v.tolist(), int(v[0] > 0), 1.0) for i, v in enumerate(x)], "id int, x array<double>, y int, weight double").repartition(4)
    make = lambda: networks.FlowTransformer(3, 8, 2, 1)
    data = lambda b: training.matrix(b.column("x"), (1, 3))

    def loss(m, b):
        return logistic_loss(m.logits(data(b)), b.column("y").to_numpy().astype(float), b.column("weight").to_numpy()), float(b.num_rows)

    score = lambda m, b: m.logits(data(b)).value
    accuracy = lambda m: training.scored(rows, m, make, score, ["y"]).agg(F.avg(((F.col("score") > 0).cast("int") == F.col("y")).cast("double"))).first()[0]
    network, checks = training.fit(rows, make, loss, epochs=6, steps=4, rate=0.02, check=accuracy)
    assert max(checks) > 0.9 and accuracy(network) == pytest.approx(max(checks))


def test_isolation_forest_finds_the_far_rows(spark):
    x = np.r_[rng.normal(size=(500, 2)), rng.normal(8, 0.1, size=(5, 2))]
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    got = training.isolation_forest(rows, rows.where("id < 500"), ["a", "b"], ["id"], trees=50).orderBy(F.desc("score")).limit(5).collect()
    assert {r.id for r in got} == set(range(500, 505)) and all(0 < r.score <= 1 for r in got)


def test_supervised_checkpoints(spark):
    x = rng.normal(size=(300, 2))
    rows = spark.createDataFrame([(i, float(a), float(b), int(a + b > 1)) for i, (a, b) in enumerate(x)], "id int, a double, b double, y int")
    data = supervised.weighted(supervised.assembled(rows, ["a", "b"]), "y").cache()
    weights = {r.y: r.weight for r in data.select("y", "weight").distinct().collect()}
    n = sum(x.sum(axis=1) > 1)
    assert weights[1] == pytest.approx(300 / (2 * n)) and weights[0] == pytest.approx(300 / (2 * (300 - n)))
    model, at, seen = supervised.checkpoints(lambda k: supervised.random_forest(data, "y", k), [2, 4, 8], data, "y")
    assert seen[[2, 4, 8].index(at)] == max(seen) > 0.8
    lr = supervised.logistic_regression(data, "y")
    good = supervised.predicted(lr, data, ["y"]).agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert good > 0.9
    assert supervised.by_seed(lambda s: rows.limit(1).select("id"), [1, 2]).count() == 2


def test_snapshots_are_cut_from_columns():
    rows = [
        {"nodes": [{"node": "a", "f": [float(i)] * 8}, {"node": "b", "f": [9.0] * 8}, {"node": "c", "f": [7.0] * 8}], "edges": None if i == 1 else [{"row": 5, "src": "b", "dst": "a", "x": [1.0, i]}, {"row": 6, "src": "a", "dst": "a", "x": [2.0, i]}], "targets": [{"row": 10 + i, "src": "c", "dst": "b", "x": [3.0, i], "y": float(i % 2), "weight": 0.5}]}
        for i in range(3)
    ]
    batch = pa.RecordBatch.from_pylist(rows).slice(1)
    batch_rows = list(snapshots.unpacked(batch, 2))
    assert len(batch_rows) == 2
    for i, (s, t) in enumerate(batch_rows, 1):
        assert s.hosts[:, 0].tolist() == [i, 9, 7] and s.pairs.tolist() == [[2], [1]] and s.pair_features.tolist() == [[3, i]]
        assert s.links.tolist() == ([[], []] if i == 1 else [[1, 0], [0, 0]]) and s.link_features.tolist() == ([] if i == 1 else [[1, i], [2, i]])
        assert (t.y.tolist(), t.weight.tolist(), t.row.tolist()) == ([i % 2], [0.5], [10 + i])


def test_sums_by_owner():
    owner, values = np.array([3, 0, 3, 3, 0]), rng.normal(size=(5, 2, 3))
    want = np.zeros((5, 2, 3))
    np.add.at(want, owner, values)
    assert np.allclose(sum_by(values, owner, 5), want) and not sum_by(values[:0], owner[:0], 5).any()
