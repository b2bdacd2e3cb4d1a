import heapq
import random

import numpy as np

from siltstream.llm import leakage as L

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, benchmark_name string, split string, text string"
VOCABULARY = [f"w{i}" for i in range(40)]


def brute(item, doc):
    """Whether some item words of at least 20, with an edit for each 10, stand in doc; ends match."""
    n, m = len(item), len(doc)
    most = max(1, n // 10)
    for i in range(n):
        for j in range(m):
            if item[i] != doc[j]:
                continue
            state = {(i + 1, j + 1): 0}
            frontier = [(0, i + 1, j + 1)]


            while frontier:
                e, a, b = heapq.heappop(frontier)
                if state.get((a, b), 99) < e:
                    continue
                if item[a - 1] == doc[b - 1] and a - i >= 20 and e * 10 <= a - i:
                    return True
                steps = []
                if a < n and b < m and item[a] == doc[b]:
                    steps.append((e, a + 1, b + 1))
                if e < most:
                    if a < n and b < m:
                        steps.append((e + 1, a + 1, b + 1))
                    if a < n:
                        steps.append((e + 1, a + 1, b))
                    if b < m:
                        steps.append((e + 1, a, b + 1))
                for s in steps:
                    if state.get(s[1:], 99) > s[0]:
                        state[s[1:]] = s[0]
                        heapq.heappush(frontier, s)
    return False


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(1, len(words) - 1)
        kind = rng.choice("rla")
        if kind == "r":
            words[k] = "zzz"
        elif kind == "l":
            del words[k]
        else:
            words.insert(k, "yyy")
    return words


def test_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, "b", "test", " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([15, 20, 28, 45])))) for i in range(8)]
    docs = []
    for d in range(60):
        words = items[rng.randrange(8)][3].split()
        size = rng.choice([8, 18, 19, 20, 21, 25, 40])
        a = rng.randrange(max(1, len(words) - size + 1))
        part = edited(rng, words[a : a + size], rng.choice([0, 1, 2, 3, 4]))
        fill = lambda: [rng.choice([*VOCABULARY, "other", "else"]) for _ in range(rng.randrange(12))]
        docs.append((100 + d, " ".join(fill() + part + fill()), "clash"))
    want = {(i, d) for i, *_, t in items for d, x, _ in docs if brute(t.split(), x.split())}
    got = {tuple(r) for r in L.leaked_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == want and 10 < len(want) < 60
    blocks = {(r.item_id, r.doc_id) for r in L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_items=3).collect()}
    assert blocks == want


def test_forms_do_not_count(spark):
    text = "The quick Brown fox, cafe number 12 jumps over one lazy dog and then runs far away from all the zero-length noise here"
    forms = [
        text.upper().replace(" ", "  \n"),
        "".join(chr(ord(c) + 0xFEE0) if c.isalpha() and i % 3 == 0 else c for i, c in enumerate(text)),
        text.replace("fox", "**fox**").replace("dog", "<b class='x'>dog</b>").replace("cafe", "café"),
        text.replace(" ", " ​", 5).replace(" ", "\xa0", 7).replace("zero-length", "zero&nbsp;length"),
    ]
    docs = [(i, "intro. " + f, None) for i, f in enumerate(forms)] + [(90, None, None), (91, "", None), (92, text[:60], None)]
    items = spark.createDataFrame([(7, "b", "test", text), (8, "b", "test", None), (9, "b", "test", "")], ITEMS)
    df = spark.createDataFrame(docs, DOCS)
    assert {tuple(r) for r in L.leaked_pairs(df, items).collect()} == {(7, i) for i in range(4)}
    assert {r.doc_id for r in L.clean_documents(df, items).collect()} == {90, 91, 92}
    assert L.leak_report(df, items).first().n_leaked == 1


def test_matches_are_all_maximal_ones():
    rng = random.Random(5)
    items = L.Items([{"item_id": i, "text": " ".join(rng.choice("abc") for _ in range(30))} for i in range(3)])
    get = items.number.get
    shard = np.array([get(rng.choice("abcx"), 0) for _ in range(400)] + [0])
    for least in (3, 6):
        i, j, n = L.verbatim_matches(shard, items, least)
        want = set()
        for a in range(len(items.flat)):
            for b in range(len(shard)):
                k = 0
                while a + k < len(items.flat) and b + k < len(shard) and items.flat[a + k] == shard[b + k] and shard[b + k]:
                    k += 1
                left = a > 0 and b > 0 and items.flat[a - 1] == shard[b - 1] and shard[b - 1]
                if k >= least and not left:
                    want.add((a, b, k))
        assert set(zip(i.tolist(), j.tolist(), n.tolist())) == want


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert L.leaked_pairs(docs, items).count() == 0
    assert L.leaked_pairs(spark.createDataFrame([(1, "a b", None)], DOCS), items).count() == 0
    assert L.least_run() == 6
