import itertools
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream.operators import cases, graph, history, sequences, verify
from siltstream.plans import components
from siltstream.queries import detectors, graphs
from siltstream.queries.graphs import SLOT
from siltstream.streaming import windows as live

EDGE = "part int, second bigint, completion_us bigint, src int, dst int, protocol int, src_port int, dst_port int, bytes double, row bigint"


def edges(spark, rows):
    return spark.createDataFrame([(0, s, c, a, b, 6, 80, 80, float(x), r) for s, c, a, b, r, x in rows], EDGE)


F5 = [(0, 1_000_000, 0, 1, 1, 10), (10, 50_000_000, 1, 2, 2, 20), (20, 30_000_000, 2, 0, 3, 30), (30, 31_000_000, 0, 2, 4, 40), (40, 41_000_000, 3, 0, 5, 50)]


def test_prefix_is_strict_and_causal(spark):
    def history_of(rows):
        e = edges(spark, rows)
        targets = sequences.slot_targets(e, ["part"], "second", "row", F.lit(1))
        prefix = graph.prefixes(e, graph.cutoffs(targets), 1)
        return prefix, targets

    prefix, targets = history_of(F5)
    assert [r.row for r in prefix.collect()] == [1] and {r.row for r in targets.collect()} == {4, 5}
    changed = F5[:4] + [(40, 41_000_000, 999, 0, 5, 1e12)]
    same = graph.node_features(history_of(changed)[0])
    assert sorted(map(tuple, graph.node_features(prefix).collect())) == sorted(map(tuple, same.collect()))
    features = {r.node: r for r in graph.node_features(prefix).collect()}
    assert features[0].out_count == pytest.approx(np.log1p(1)) and features[1].in_bytes == pytest.approx(np.log1p(10)) and features[1].tcp == pytest.approx(np.log1p(1))
    s = graph.snapshot_summary(prefix, graph.latest_edges(prefix), targets).first()
    assert (s.target_edges, s.history_edges, s.cold_endpoints) == (2, 1, 2)
    kept = {r.node: r.in_count for r in graph.kept_nodes(graph.node_features(prefix), graph.latest_edges(prefix), targets).collect()}
    assert set(kept) == {0, 1, 2, 3} and kept[3] == 0


def test_cap_keeps_the_latest(spark):
    rows = [(i % 30, 1_000_000 + (i // 2) * 10, 1, 2, i, 1) for i in range(100)]
    prefix = edges(spark, rows).withColumn("cutoff", F.lit(30).cast("bigint"))
    got = {r.row for r in graph.latest_edges(prefix, 7).collect()}
    assert got == {r[4] for r in sorted(rows, key=lambda r: (r[1], r[4]))[-7:]}


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    pairs = {(g, rng.randrange(14), rng.randrange(14)) for g in "ab" for _ in range(13)} | {("chain", i, i + 1) for i in range(20)} | {("loop", 1, 1)}
    df = spark.createDataFrame(sorted(pairs), "g string, src int, dst int")
    nodes = {(g, n) for g, a, b in pairs for n in (a, b)}

    def reach(g, n, both):
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for h, a, b in pairs:
                for u, v in ((a, b), (b, a)) if both else ((a, b),):
                    if h == g and u == x and v not in seen:
                        seen.add(v)
                        todo.append(v)
        return seen

    weak = {(r.g, r.node): r.component for r in graph.weak_components(df, "g").collect()}
    assert weak == {(g, n): min(reach(g, n, True)) for g, n in nodes}
    strong = {(r.g, r.node): r.component for r in graph.strong_components(df, "g").collect()}
    assert set(strong) == nodes
    for (g, a), (h, b) in itertools.combinations(sorted(nodes), 2):
        if g == h:
            assert (strong[g, a] == strong[h, b]) == (b in reach(g, a, False) and a in reach(g, b, False))
    assert graph.weak_components(df.limit(0), "g").count() == 0 and graph.strong_components(df.limit(0), "g").count() == 0


@pytest.mark.parametrize("local", [500_000, 4])
def test_components_of_groups_beyond_a_task(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_LINKS", local)
    monkeypatch.setattr(components, "AT_ONCE", 5)
    rng = random.Random(local)
    links = {(g, rng.randrange(12), rng.randrange(12)) for g in "ab" for _ in range(14)} | {("chain", i + 1, i) for i in range(9)} | {("ring", i, (i + 1) % 12) for i in range(12)} | {("loop", 3, 3), ("two", 0, 1), ("two", 1, 0)}
    nodes = sorted({(g, n) for g, a, b in links for n in (a, b)})
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for g, a, b in links:
            reach[g, a] |= reach[g, b]
    df = spark.createDataFrame([*sorted(links), (None, 1, 2), ("a", None, 1)], "g string, src bigint, dst bigint")
    rows = graph.strong_components(df, "g").collect()
    strong = {(r.g, r.node): r.component for r in rows}
    assert sorted(strong) == nodes and len(rows) == len(nodes)
    for x, y in itertools.combinations(nodes, 2):
        if x[0] == y[0]:
            assert (strong[x] == strong[y]) == (y in reach[x] and x in reach[y])
    owner = {x: x[1] for x in nodes}
    for _ in nodes:
        for g, a, b in links:
            owner[g, a] = owner[g, b] = min(owner[g, a], owner[g, b])
    rows = graph.weak_components(df, "g").collect()
    assert {(r.g, r.node): r.component for r in rows} == owner and len(rows) == len(nodes)
    counts = {r.g: (r.weak_components, r.strong_components) for r in graph.component_counts(df, "g").collect()}
    assert counts == {g: (len({owner[x] for x in nodes if x[0] == g}), len({strong[x] for x in nodes if x[0] == g})) for g in {x[0] for x in nodes}}


def test_component_rounds_follow_size_not_structure(spark, monkeypatch):
    """A path whose components came off one by one takes a bounded number of tables."""
    written = []
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(name) or keep(df, name))
    df = spark.createDataFrame([("d", i + 1, i) for i in range(60)], "g string, src bigint, dst bigint")
    assert [tuple(r) for r in graph.component_counts(df, "g").collect()] == [("d", 1, 61)]
    assert len(written) <= 2


def test_weak_components_of_a_long_path_write_one_table(spark, monkeypatch):
    written = []
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(name) or keep(df, name))
    df = spark.createDataFrame([("d", i + 1, i) for i in range(60)], "g string, src bigint, dst bigint")
    assert {r.component for r in graph.weak_components(df, "g").collect()} == {0} and written == ["links"]


def test_weak_components_of_a_large_group_take_no_rounds(spark, monkeypatch):
    """Pieces of a group beyond a task are labelled where they lie; labels don't go round by round through all links."""
    monkeypatch.setattr(graph, "LOCAL_LINKS", 100)
    monkeypatch.setattr(components, "AT_ONCE", 40)
    written = []
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(name) or keep(df, name))
    path, star = [("path", i + 1, i) for i in range(300)], [("star", 1_000 + i, i % 3) for i in range(400)] + [("star", 5_000 + i, 7) for i in range(50)]
    df = spark.createDataFrame(random.Random(3).sample(path + star, len(path + star)) + [("small", 9, 8)], "g string, src bigint, dst bigint")
    rows = graph.weak_components(df, "g").collect()
    want = {("path", i): 0 for i in range(301)} | {("small", 8): 8, ("small", 9): 8}
    want |= {("star", n): x for _, a, x in star for n in (a, x)}
    assert {(r.g, r.node): r.component for r in rows} == want and len(rows) == len(want)
    assert sorted(written) == ["labels", "links", "links", "links", "pieces"]


def test_topology_density(spark):
    r = graph.topology(edges(spark, [(1, 1, 0, 0, 1, 1), (2, 1, 0, 1, 2, 1), (3, 1, 0, 1, 3, 1), (70, 1, 5, 5, 4, 1)]), 60).orderBy("window").collect()
    assert (r[0].nodes, r[0].edges, r[0].unique_pairs, r[0].repeated_pairs, r[0].parallel_edges, r[0].density) == (2, 3, 2, 1, 1, 0.5)
    assert r[1].density == 0 and r[1].nodes == 1


def test_attention_equals_dense(spark):
    rng = np.random.default_rng(0)
    w = {"source": rng.normal(size=(6, 3)), "target": rng.normal(size=(6, 3)), "edge": rng.normal(size=(6, 2)), "attention": rng.normal(size=(2, 3)), "bias": rng.normal(size=6)}
    x = rng.normal(size=(5, 3))
    links = [(0, 1), (0, 1), (2, 1), (1, 3), (3, 3)]
    e = rng.normal(size=(len(links), 2))
    nodes = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "node int, x array<double>")
    pairs = spark.createDataFrame([(a, b, e[k].tolist()) for k, (a, b) in enumerate(links)], "src int, dst int, e array<double>")
    got = {r.node: r.h for r in graph.attention_layer(nodes, pairs, w, 2).collect()}
    every = [(a, b, e[k]) for k, (a, b) in enumerate(links)] + [(i, i, np.zeros(2)) for i in range(5)]
    for n in range(5):
        into = [(a, z) for a, b, z in every if b == n]
        out = np.zeros(6)
        for h in range(2):
            sl = slice(3 * h, 3 * h + 3)
            pre = [w["source"][sl] @ x[a] + w["target"][sl] @ x[n] + w["edge"][sl] @ z for a, z in into]
            logits = np.array([np.where(v > 0, v, 0.2 * v) @ w["attention"][h] for v in pre])
            p = np.exp(logits - logits.max())
            p /= p.sum()
            out[sl] = sum(q * (w["source"][sl] @ x[a]) for q, (a, _) in zip(p, into))
        assert np.allclose(got[n], out + w["bias"])


def test_endpoints_must_match(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, label string")
    b = spark.createDataFrame([(1, "s1", "x"), (2, "s2", "y")], "k int, src string, raw string")
    assert {r.src for r in graph.joined_endpoints(a, b, ["k"], ["src"], {"label": "raw"}).collect()} == {"s1", "s2"}
    for bad in (b.where("k = 1"), b.unionByName(b), b.withColumn("raw", F.lit("x"))):
        with pytest.raises(Exception, match="don't match"):
            graph.joined_endpoints(a, bad, ["k"], ["src"], {"label": "raw"}).collect()


def positioned(spark, sizes):
    base = datetime(2029, 6, 5)
    rows = [(date(2029, 6, 5 + d), base + timedelta(days=d, seconds=i // 2), d * 1000 + i) for d, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    return sequences.day_positions(spark.createDataFrame(rows, "day date, t timestamp, row bigint"), "day", "t", "row")


@pytest.mark.parametrize("length", [1, 16, 64])
@pytest.mark.parametrize("block", [70, 50_000])
def test_sequences_stay_in_their_day(spark, length, block):
    p = positioned(spark, [100, 101])
    got = sequences.trailing(p, "day", ["row"], length, (F.col("position") >= 63) & ((F.col("position") - 63) % 8 == 0), block).collect()
    assert sorted(r.row for r in got) == [d * 1000 + i for d, n in ((0, 100), (1, 101)) for i in range(63, n, 8)]
    for r in got:
        assert [s.row for s in r.sequence] == list(range(r.row - length + 1, r.row + 1))
    assert sequences.cohort_violations(p, sequences.day_targets(p, F.lit(8)), "day", "t", 64).count() == 0


def test_matched_scores(spark):
    cohort = spark.createDataFrame([(1,), (2,)], "k int")
    s = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.9)], "k int, score double")
    assert {r.score for r in sequences.matched_scores(cohort, s, ["k"], "score").collect()} == {0.5, 0.7}
    with pytest.raises(Exception, match="exactly one"):
        sequences.matched_scores(cohort, s.where("k = 1"), ["k"], "score").collect()


HIST = "id int, second bigint, completion_us bigint, src int, dst int, part int, row bigint"
F7 = [(0, 30, 150_000_000, 1, 2, 0, 1), (1, 31, 40_000_000, 1, 3, 0, 2), (2, 32, 41_000_000, 9, 9, 0, 3), (3, 150, 160_000_000, 1, 2, 0, 4), (4, 151, 160_000_000, 8, 8, 0, 5), (5, 210, 211_000_000, 1, 2, 1, 6)]


def test_history_slots(spark):
    df = spark.createDataFrame(F7, HIST)
    got = {(r.id, r.lag): (r.history_id, r.kind) for r in history.history_slots(df).collect()}
    assert got == {(3, 2): (1, 2)}
    tie = spark.createDataFrame([(0, 30, 40_000_000, 1, 2, 0, 1), (1, 31, 40_000_000, 1, 2, 0, 2), (2, 32, 50_000_000, 1, 3, 0, 3), (3, 90, 100_000_000, 1, 2, 0, 4)], HIST)
    slots = history.history_slots(tie)
    assert {(r.id, r.lag): (r.history_id, r.kind) for r in slots.collect()} == {(3, 1): (1, 1)}
    assert history.history_violations(tie, slots).count() == 0
    broken = slots.withColumn("history_id", F.lit(2))
    assert [r.problem for r in history.history_violations(tie, broken).collect()] == ["entity"]
    seq = history.sequence_tensor(slots, tie.select("id", F.array(F.col("row").cast("double")).alias("x")), tie.where("id = 3"), 2).first()
    assert seq.sequence == [None, [2.0], [4.0]] and seq.mask == [False, True, True]


def test_history_counts_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        s = rng.randrange(1200)
        rows.append((i, s, (s + rng.choice([0, 5, 30, 200])) * 1_000_000 + rng.randrange(2), rng.randrange(3), rng.randrange(3), rng.randrange(2), i))
    got = {r.id: (r.pair_count, r.source_count, r.destination_count) for r in history.history_counts(spark.createDataFrame(rows, HIST)).collect()}
    for i, s, _, a, b, p, _ in rows:
        cut = (s // 60 * 60 + 30) * 1_000_000
        past = [r for r in rows if r[5] == p and r[1] // 60 < s // 60 and r[2] < cut]
        count = lambda f: len({r[1] // 60 for r in past if f(r)})
        assert got[i] == (count(lambda r: r[3] == a and r[4] == b), count(lambda r: r[3] == a), count(lambda r: r[4] == b))
    df = spark.createDataFrame(rows, HIST).withColumn("y", F.col("id") % 2)
    cover = history.history_coverage(df, history.history_slots(df), history.history_counts(df), "y").collect()
    assert len(cover) == 6 and all(r.source_median == np.median([got[x[0]][1] for x in rows if x[5] == r.part and r.y in (None, x[0] % 2)]) for r in cover)


def test_case_ranks():
    assert [r for _, r in cases.picked_ranks(11)] == [1, 5, 9]
    assert len(cases.picked_ranks(1)) == 1 and len(cases.picked_ranks(2)) == 2 and cases.picked_ranks(0) == []
    for n in range(1, 40):
        used, want = set(), []
        for q in cases.QUANTILES:
            if len(used) < n:
                want.append(min((i for i in range(n) if i not in used), key=lambda i: (abs(i - q * (n - 1)), i)))
                used.add(want[-1])
        assert [r for _, r in cases.picked_ranks(n)] == want


def test_cases(spark):
    rows = spark.createDataFrame([(i, "C", float(i)) for i in range(11)] + [(i, "T", 0.5) for i in (3, 1, 2)], "id int, category string, score double")
    got = cases.selected_cases(rows, ["C", "T", "NONE"], ["id"]).collect()
    assert sorted(r.id for r in got if r.category == "C") == [1, 5, 9]
    assert [r.id for r in sorted((r for r in got if r.category == "T"), key=lambda r: r.quantile)] == [1, 2, 3]
    assert [(r.status, r.available) for r in got if r.category == "NONE"] == [("EMPTY", 0)]
    records = spark.createDataFrame([(1,), (2,)], "id int")
    good = spark.createDataFrame([(2, 0.9), (1, 0.1)], "id int, score double")
    joined = {r.id: r.a_decision for r in cases.joined_scores(records, {"a": good}, "id", {"a": 0.5}).collect()}
    assert joined == {1: 0, 2: 1}
    for bad in (good.where("id = 1"), good.unionByName(good), good.unionByName(spark.createDataFrame([(3, 0.1)], good.schema)), good.withColumn("score", F.lit(float("inf")))):
        with pytest.raises(Exception, match="don't match"):
            cases.joined_scores(records, {"a": bad}, "id", {"a": 0.5}).collect()
    with pytest.raises(ValueError):
        cases.feature_groups({"a": [1, 2], "b": [2]}, ["x", "y"])
    sample = cases.quota_sample(rows, "category", "id", 7, 1).groupBy("category").count().collect()
    assert {r.category: r["count"] for r in sample} == {"C": 6, "T": 1} or {r.category: r["count"] for r in sample} == {"C": 5, "T": 2}


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x"), (3, "z")], "k int, v string")
    assert {(r.k, r.side, r.n) for r in verify.set_difference(a, b).collect()} == {(1, "a", 1), (3, "b", 1)}
    one, two = (verify.set_digest(d, [], ["k", "v"]).first() for d in (a, a.orderBy(F.desc("k"))))
    assert one == two
    m = spark.createDataFrame([(1, 2, 3, 4, 10), (1, 1, 1, 1, 5)], "tp int, fp int, fn int, tn int, n int")
    assert [r.rule for r in verify.confusion_identities(m).collect()] == ["total"]
    assert verify.close(a.withColumn("x", F.lit(1.0)).limit(1), a.withColumn("x", F.lit(1.1)).limit(1), ["k"], ["x"]).count() == 1


def test_live_windows(spark, tmp_path):
    rows = [(i, datetime(2029, 1, 1, 0, i % 50, i % 7), "error" if i % 5 == 0 else "view", i % 3) for i in range(200)]
    spark.createDataFrame(rows, "id int, ts timestamp, kind string, user int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp, kind string, user int").parquet(str(tmp_path / "in"))
    got = live.run_once(live.live_counts(stream, "ts", 5, F.col("kind") == "error"), "live_counts").collect()
    assert sum(r.n for r in got) == 200 and sum(r.n_malicious for r in got) == 40 and len(got) == 10
    seen = live.run_once(live.live_last_seen(stream, "user", "ts"), "live_seen", "update").collect()
    assert sum(r.n for r in seen) == 200 and all(r.backward_steps > 0 for r in seen)
    unique = live.run_once(live.live_duplicates(stream.withColumn("k", F.col("id") % 10), ["k"], "ts"), "live_unique", "append").collect()
    assert len(unique) == 10


@pytest.mark.parametrize("folder", [True, False])
def test_live_table(spark, tmp_path, folder):
    df = spark.createDataFrame([(i, datetime(2029, 1, 1, 0, i % 50)) for i in range(100)], "id int, ts timestamp")
    df.repartition(3 if folder else 1).write.parquet(str(tmp_path / "raw"))
    if folder:
        (tmp_path / "raw").rename(tmp_path / "t.parquet")
    else:
        next((tmp_path / "raw").glob("*.parquet")).rename(tmp_path / "t.parquet")
    stream = live.stream_of(spark, str(tmp_path), "t")
    got = live.written_once(live.live_counts(stream, "ts", 10, F.col("id") < 10)).collect()
    assert len(got) == 5 and sum(r.n for r in got) == 100 and sum(r.n_malicious for r in got) == 10
    rows = live.written_once(live.stream_of(spark, str(tmp_path), "t").select("id"), "append")
    assert rows.count() == 100


def test_component_queries_take_every_link(spark, tmp_path):
    rng = random.Random(9)
    links = [(day, rng.randrange(200, 240), rng.randrange(100)) for day in (1, 2) for _ in range(35)]
    events = spark.createDataFrame([(datetime(2024, 1, day, 5), a, f'{{"k": {b}}}') for day, a, b in links], "ts timestamp, user_id bigint, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    owner = {(day, n): n for day, a, b in links for n in (a, b)}
    for _ in owner:
        for day, a, b in links:
            owner[day, a] = owner[day, b] = min(owner[day, a], owner[day, b])
    got = graphs.weak_components(spark, str(tmp_path)).collect()
    assert {(int(r.day[-2:]), r.node): r.component for r in got} == owner and len(got) == len(owner)
    counts = {int(r.day[-2:]): (r.weak_components, r.strong_components) for r in graphs.component_counts(spark, str(tmp_path)).collect()}
    nodes = lambda day: [n for d, n in owner if d == day]
    # users and values are disjoint, so no link leads back and every node is a strong component
    assert counts == {day: (len({owner[day, n] for n in nodes(day)}), len(nodes(day))) for day in (1, 2)}


def test_snapshot_queries_keep_the_latest_8192(spark, monkeypatch):
    rows = [(1 + i % 200, (i % 200) * 1_000_000, i % 7, 10 + i % 600, i, 1) for i in range(8_200)] + [(SLOT - 10, SLOT * 1_000_000, 1, 2, 9_000, 1)]
    monkeypatch.setattr(graphs, "flow_edges", lambda *_: edges(spark, rows))
    kept = {r.row for r in graphs.causal_prefix_edges(spark, "").collect()}
    assert kept == {r[4] for r in sorted(rows[:-1], key=lambda r: (r[1], r[4]))[-8192:]}
    s = graphs.snapshot_summary(spark, "").first()
    assert (s.history_edges, s.message_edges) == (8_200, 8_192)
    ends = {n for r in rows if r[4] in kept or r[4] == 9_000 for n in r[2:4]}
    assert {r.node for r in graphs.kept_nodes(spark, "").collect()} == ends


def test_model_graph_attention_reads_the_latest_8192(spark, monkeypatch):
    class Asked(Exception):
        pass

    def latest(prefix, cap=graph.EDGE_CAP):
        raise Asked(cap)

    known = spark.createDataFrame([(1, 0, "train", 0.5)], "row_id bigint, y int, split string, f double")
    monkeypatch.setattr(detectors, "prepared", lambda *_: (known, ["f"]))
    monkeypatch.setattr(detectors, "_prefix", lambda *_: (None, None))
    monkeypatch.setattr(graph, "latest_edges", latest)
    with pytest.raises(Asked, match="^8192$"):
        detectors.model_graph_attention(spark, "")


def test_history_sequence_of_all_partitions(spark, monkeypatch):
    rows = [(p, 600 * k + 10, (600 * k + 10) * 1_000_000, 1, 2, 6, 80, 80, 1.0, 10 * p + k) for p in range(3) for k in range(2)]
    monkeypatch.setattr(graphs, "flow_edges", lambda *_: spark.createDataFrame(rows, EDGE))
    got = {r.id: (r.filled, r.total) for r in graphs.history_sequence(spark, "").collect()}
    assert got == {10 * p + k: (k + 1, k + 1.0) for p in range(3) for k in range(2)}


def test_history_lookup_is_one_row_a_flow(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, s, s * 1_000_000 + rng.randrange(1_500_000_000), rng.randrange(3), rng.randrange(3), i) for i in range(80) for s in [rng.randrange(6_000)]]
    df = spark.createDataFrame(rows, "id int, part int, second bigint, completion_us bigint, src int, dst int, row int")
    made = history.history_lookup(df, 3, SLOT, 300)
    got = {r.id: [(h.history_id, h.kind) for h in r.history] for r in made.collect()}
    assert len(got) == len(rows)
    for i, part, second, _, src, dst, _ in rows:
        for lag in (1, 2, 3):
            here = [r for r in rows if r[1] == part and r[2] // SLOT == second // SLOT - lag and r[3] < (second // SLOT * SLOT + 300) * 1_000_000]
            want = (None, None)
            for kind, same in ((3, lambda r: r[5] == dst), (2, lambda r: r[4] == src), (1, lambda r: r[4:6] == (src, dst))):
                if found := [r for r in here if same(r)]:
                    want = (max(found, key=lambda r: (r[3], r[6]))[0], kind)
            assert got[i][lag - 1] == want
