import random

import pytest

from siltstream.llm import overlap as O

FLOWS = "row_id bigint, source_file string, source_row bigint, split string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flow_duration string, tot_fwd_pkts bigint, tot_bwd_pkts bigint, totlen_fwd_pkts double, totlen_bwd_pkts double, flow_byts_s string, flow_pkts_s string, flow_iat_mean double, init_fwd_win_byts int, label string, is_eval string"
AUDIT = "source_file string, source_row bigint, reason string"


def record(i, split, values):
    return (i, "f", i, split, *values, "clash")


def value(rng, field):
    if field in ("src_ip", "dst_ip"):
        return rng.choice(["a", " a", "b", "c\t", None, ""])
    if field in ("protocol", "label"):
        return rng.choice(["Benign", "benign ", "Port  Sweep", "port sweep", None])
    if field in ("flow_duration", "flow_byts_s", "flow_pkts_s"):
        return rng.choice(["1", "1.0", " 1e0", "2", "nan", "inf", "", None, "x"])
    if field in ("totlen_fwd_pkts", "totlen_bwd_pkts", "flow_iat_mean"):
        return rng.choice([0.0, -0.0, 1.5, float("nan"), None])
    return rng.choice([1, 2, None])


def canonical(field, v):
    if v is None or v != v:
        return None
    if field in ("src_ip", "dst_ip"):
        return v.strip()
    if field in ("protocol", "label"):
        return " ".join(v.split()).lower()
    if isinstance(v, str):
        try:
            x = float(v)
            return x if abs(x) != float("inf") and x == x else None
        except ValueError:
            return None
    return v


@pytest.mark.parametrize("crowd", [0, 1_000])
def test_all_pairs_and_no_other(spark, crowd):
    rng = random.Random(9)
    sound = lambda f: next(v for v in iter(lambda: value(rng, f), object()) if canonical(f, v) is not None)
    base = [[sound(f) if rng.random() < 0.97 else None for f in O.FIELDS] for _ in range(6)]
    rows = []
    for i in range(240):
        values = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5])):
            k = rng.randrange(15)
            values[k] = value(rng, O.FIELDS[k])
        rows.append(record(i, rng.choice(["train", "train", "Test", "validation ", None, "other"]), values))
    audit = [("f", i, "x") for i in range(0, 240, 17)] * 2
    want = set()
    removed = {a[1] for a in audit}
    key = {r[0]: [canonical(f, v) for f, v in zip(O.FIELDS, r[4:19])] for r in rows}
    for a in rows:
        for b in rows:
            if a[0] in removed or b[0] in removed or not a[3] or a[3].strip().lower() not in ("test", "validation") or b[3] != "train":
                continue
            if sum(x is not None and x == y for x, y in zip(key[a[0]], key[b[0]])) >= 12:
                want.add((a[0], b[0]))
    got = [(r.e, r.t) for r in O.overlaps(spark.createDataFrame(rows, FLOWS), spark.createDataFrame(audit, AUDIT), crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_blocks_leave_no_gap():
    assert sorted(f for b in O.BLOCKS for f in b) == sorted(O.FIELDS)
    assert len(O.BLOCKS) == len(O.FIELDS) - O.AGREE + 1
    todo, seen = [O._mask(b) for b in O.BLOCKS], set()
    while todo:
        mask = todo.pop()
        parts = [p & ~mask for p in O.refined(mask)]
        # the parts share no field and leave none out; without parts every pair counts
        assert sum(parts) == (1 << 15) - 1 - mask if parts else mask.bit_count() >= O.AGREE
        assert len(parts) in (0, 4) and all(parts)
        todo += [mask | p for p in parts if mask | p not in seen]
        seen |= {mask | p for p in parts}


def test_constant_fields_make_no_crowd_of_candidates(spark):
    # idle flows: six fields never differ, the others nearly always do
    constant = {"tot_fwd_pkts": 0, "tot_bwd_pkts": 0, "totlen_fwd_pkts": 0.0, "totlen_bwd_pkts": 0.0, "dst_ip": "x", "protocol": "6", "label": "benign"}
    sizes = []
    for n in (500, 2_000):
        rows = [record(i, "train" if i % 2 else "test", [constant.get(f, f"{i}" if f in ("src_ip", "dst_ip", "protocol", "flow_duration", "flow_byts_s", "flow_pkts_s", "label") else float(i) if f == "flow_iat_mean" else i) for f in O.FIELDS]) for i in range(n)]
        rows.append(record(n, "test", list(rows[1][4:19])))
        made, agreed = O._found(spark.createDataFrame(rows, FLOWS), spark.createDataFrame([], AUDIT), 100)
        sizes.append(made.pairs.count())
        assert [r.agree for r in agreed.collect()] == [15]
    assert sizes[1] <= 4 * sizes[0] + 10 and sizes[1] < 2_000


def test_copies_are_compared_once(spark):
    values = ["a", "b", 1, 2, "6", "1", 1, 1, 1.0, 1.0, "1", "1", 1.0, 1, "x"]
    rows = [record(i, "train" if i % 2 else "test", values) for i in range(600)]
    flows, audit = spark.createDataFrame(rows, FLOWS), spark.createDataFrame([], AUDIT)
    made, _ = O._found(flows, audit, 1_000)
    assert made.pairs.count() == 1 and made.classes.count() == 2
    assert [tuple(r) for r in O.overlap_report(flows, audit).collect()] == [("test", "f", 90_000, 90_000, 300, 300)]
    assert O.overlap_pairs(flows, audit).distinct().count() == 90_000


def test_report_and_empty(spark):
    values = ["a", "b", 1, 2, "6", "1", 1, 1, 1.0, 1.0, "1", "1", 1.0, 1, "x"]
    df = spark.createDataFrame([record(1, "train", values), record(2, "test", values), record(3, "test", values)], FLOWS)
    audit = spark.createDataFrame([], AUDIT)
    row = O.overlap_report(df, audit).collect()
    assert [(r.split, r.n_pairs, r.n_exact_pairs, r.n_eval_records, r.n_train_records) for r in row] == [("test", 2, 2, 2, 1)]
    assert O.overlap_pairs(spark.createDataFrame([], FLOWS), audit).count() == 0
