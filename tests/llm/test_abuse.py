import random

import numpy as np

from siltstream.llm import abuse as A

DOCS = "doc_id bigint, text string, source string, y string"
LABELS = "doc_id bigint, abusive tinyint, category string, reviewer string"


def corpus(n, seed, rng=None):
    rng = random.Random(seed)
    plain = ["the {0} window stood at {1} flows", "we dropped {1} rows from the {0} file", "no packet of the {0} set was larger than {1}", "the {0} worker was killed after {1} seconds", "a stupid {0} default cost us {1} minutes"]
    bad = ["you are a {2} and everyone knows it", "shut up you {2} nobody asked", "whoever wrote this is a {2}"]
    insult = ["moron", "m0r0n", "m o r o n", "mooooron", "idiot", "1d10t", "i.d.i.o.t", "IdIoT"]
    rows = []
    for i in range(n):
        y = rng.random() < 0.25
        parts = [rng.choice(plain).format(rng.choice(["packet", "byte", "flow", "label"]), rng.randrange(999), "") for _ in range(rng.randrange(2, 7))]
        if y:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(bad).format("", "", rng.choice(insult)))
        rows.append((i, ". ".join(parts), rng.choice(["a", "b", None]), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(*r[:3], "clash") for r in rows] + [(5000, None, "a", ""), (5001, "", "a", ""), (5002, "x " * 50_000, "a", "")], DOCS)
    # a few verdicts are wrong, repeated, tied or null
    labels = [(i, int(y) if i % 31 else int(not y), None, "r") for i, _, _, y in rows[:500]] + [(0, 1, None, "r"), (0, 0, None, "r"), (3, None, None, "r")]
    table = spark.createDataFrame(labels, LABELS)
    got = {r.doc_id for r in A.abusive_documents(docs, table).collect()}
    want = {i for i, _, _, y in rows[500:] if y}
    held = {i for i in got if 500 <= i < 5000}
    assert len(held & want) >= 0.97 * len(want) and len(held - want) <= 0.03 * len(want)
    assert not got & {5000, 5001, 5002}
    rates = {r.source: r for r in A.source_rates(docs, table).collect()}
    assert set(rates) == {"a", "b", None} and sum(r.n_documents for r in rates.values()) == 903


def test_disguises_are_read():
    same = [A.sentences(t) for t in ("You are a moron", "you are a m0r0n", "You are a m o r o n", "you are a MORON", "you are a moooron", "you are a m.o.r.o.n")]
    words = [[[A.plain_word(w) for w in form] for form in s] for s in same]
    assert all(words[0][0] in forms for forms in words) and len(words[2]) == 2
    assert A.sentences(None) == A.sentences("") == A.sentences(" ... ") == []


def test_features_do_not_cross_sentences():
    x, at, owner = A.features([[["a", "b"], ["c"]], [], [["a", "b"]]])
    assert owner.tolist() == [0, 0, 2] and np.array_equal(np.sort(x[at == 0]), np.sort(x[at == 2]))
    assert (at == 0).sum() == 3 and (at == 1).sum() == 1
    x, at, owner = A.features([[]])
    assert len(x) == len(owner) == 0


def test_no_verdicts_or_one_kind(spark):
    docs = spark.createDataFrame([(1, "you there", "a", ""), (2, None, "a", "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert A.abusive_documents(docs, none).count() == 0
    assert A.abusive_documents(docs, spark.createDataFrame([(1, 0, None, "r")], LABELS)).count() == 0
    assert A.scores(spark.createDataFrame([], DOCS), none).count() == 0


def test_fit_finds_the_sentence_that_answers():
    rng = np.random.default_rng(0)
    docs = [[np.unique(rng.integers(10, 500, 12).astype(np.int32))] for _ in range(400)]
    y = rng.random(400) < 0.3
    for d, t in zip(docs, y):
        if t:
            d.append(np.array([3, 5], dtype=np.int32))
    w, bias = A.fit(docs, y)
    assert w[3] > 0.5 and w[5] > 0.5 and bias < 0
    assert np.quantile(np.abs(w[10:500]), 0.9) < w[3]


def test_l1_drops_what_is_rare():
    model = A.Ftrl(-2.0)
    for _ in range(3):
        model.learn(np.array([1, 2], dtype=np.int32), 1.0, 1.0)
    model.learn(np.array([7], dtype=np.int32), 1.0, 0.2)
    w = model.weights(np.array([1, 2, 7, 9]))
    assert w[0] > 0 and w[1] > 0 and w[2] == w[3] == 0


def test_short_cuts_for_plain_text_change_no_token():
    rng = random.Random(1)
    pieces = ["a", "b", "I", " ", " ", ".", ". ", "! ", "*", "@", "$", "!", "-", "_", "\n", "1", ";", "x y z", "s.t.u", "  "]
    for _ in range(3_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        # a sign outside ASCII that is no part of any word takes the long way
        assert A.sentences(text) == A.sentences(text + "\n…"), text


def test_folds_on_the_cluster_equal_those_here(spark, tmp_path):
    rng = np.random.default_rng(5)
    docs = [[np.unique(rng.integers(0, 40, 5).astype(np.int32)) for _ in range(rng.integers(1, 4))] for _ in range(60)]
    y = np.array([any(3 in x for x in d) for d in docs])
    here, there = A.fit(docs, y), A.fit(docs, y, A.on_cluster(spark))
    assert np.array_equal(here[0], there[0]) and here[1] == there[1] and np.count_nonzero(here[0])
    kept = np.flatnonzero(here[0]).astype(np.int32)
    A.save_model(spark, (kept, here[0][kept], here[1]), str(tmp_path / "model"))
    again = A.load_model(spark, str(tmp_path / "model"))
    assert np.array_equal(again[0], kept) and np.array_equal(again[1], here[0][kept]) and again[2] == here[1]
