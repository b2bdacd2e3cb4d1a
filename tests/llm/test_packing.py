import random

import numpy as np
from pyspark.sql import functions as F

from siltstream.llm import packing as P

DOCS = "doc_id bigint, text string, term string"


def test_every_token_once_and_nearly_full(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60))), "clash") for i in range(200)]
    rows += [(1000, "flow " * 2000, ""), (1001, None, None), (1002, "", ""), (1003, rows[0][1], ""), (1004, "flow " * 127 + "flow", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = P.pack(df, capacity=128, shard_items=80).collect()
    encode = P.encoding(P.TOKENIZER).encode_ordinary
    size = {d: len(encode(t or "")) for d, t, _ in rows}
    pieces = {}
    fill = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.n_tokens))
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert set(pieces) == set(size) and max(fill.values()) <= 128
    for d, parts in pieces.items():
        parts.sort()
        assert sum(p[2] for p in parts) == size[d] and [p[1] for p in parts] == [128 * k for k in range(len(parts))]
        assert len(parts) == max(1, -(-size[d] // 128))
    # each of the three shards may leave a container or two part empty
    assert len(fill) <= -(-sum(size.values()) // 128) + 6
    assert len({(r.container_id, r.position) for r in got}) == len(got)
    found = {r.doc_id for r in P.oversized(df, capacity=128).collect()}
    assert found == {d for d, n in size.items() if n > 128} and 1004 not in found


def test_neighbours_meet(spark):
    lengths = np.array([50] * 8)
    terms = [np.array([1, 2, 3]), np.array([7, 8, 9])] * 4
    counts = [np.ones(3, dtype=np.int32)] * 8
    index = P.Index(lengths, terms, counts, np.full(10, 4), 8, 50.0)
    held = P.pack_shard(lengths, index, 200)
    assert sorted(map(sorted, held)) == [[0, 2, 4, 6], [1, 3, 5, 7]]


def test_scores_equal_brute_force():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 30, 12)
    terms = [np.sort(rng.choice(20, rng.integers(0, 8), replace=False)) for _ in range(12)]
    counts = [rng.integers(1, 4, len(t)).astype(np.int32) for t in terms]
    df = np.array([sum(k in t for t in terms) for k in range(20)])
    index = P.Index(lengths, terms, counts, df, 12, float(lengths.mean()))
    for q in range(12):
        want = np.zeros(12)
        for d in range(12):
            for t in terms[q]:
                if t in terms[d]:
                    tf = counts[d][list(terms[d]).index(t)]
                    want[d] += np.log1p((12 - df[t] + 0.5) / (df[t] + 0.5)) * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * lengths[d] / lengths.mean()))
        assert np.allclose(index.scores(q), want)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert P.pack(empty).count() == 0 and P.oversized(empty).count() == 0 and P.fill_report(empty).first().n_containers == 0


def test_near_items_share_a_shard(spark):
    rng = random.Random(4)
    themes = [w.split() for w in ("apple pear cherry plum grape lemon orange banana", "river lake ocean pond stream harbour island coast", "violin piano drum flute guitar trumpet organ harp", "king queen duke baron prince knight emperor bishop")]
    rows = [(i, " ".join(rng.choices(themes[i % 4], k=40)), "clash") for i in range(400)] + [(1000, "", ""), (1001, None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = P.neighbour_recall(docs, shard_items=101, neighbours=5).agg(F.count(F.lit(1)).alias("n"), F.avg("n_found").alias("k")).first()
    # by chance a quarter of five
    assert got.n == 8 and got.k > 4
    packed = P.pack(docs, shard_items=101).collect()
    assert len(packed) == 402 and len({(r.doc_id, r.piece) for r in packed}) == 402
