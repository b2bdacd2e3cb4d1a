"""Queries of sequences, graphs, history and cases over flows and events, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siltstream.functions.text import number
from siltstream.operators import cases, graph, history, picks, sequences
from siltstream.queries.audit import BASE_SQL, base
from siltstream.queries.general import TOKEN_SQL, rounded
from siltstream.queries.scores import SCORED_SQL, scored
from siltstream.session import table

SLOT, OFFSET = 600, 300


def flow_edges(spark, d):
    """Edges of the classified flows whose time lies on their file's date, with y. Slots of ten minutes suit these tables."""
    rows = base(spark, d).where("flow_timestamp is not null and to_date(flow_timestamp) = file_date and split is not null")
    part = F.when(F.lower(F.trim("split")) == "train", 0).when(F.lower(F.trim("split")) == "validation", 1).otherwise(2)
    duration = number(F.col("flow_duration"))
    return graph.edges(rows.withColumn("split", F.lower(F.trim("split"))), part, "flow_timestamp", F.when(duration >= 0, duration), "row_id")


def targets(spark, d):
    return sequences.slot_targets(flow_edges(spark, d), ["part"], "second", "row", F.when(F.col("part") == 0, 4).otherwise(2), SLOT, OFFSET)


def strided_targets_slot(spark, d):
    return targets(spark, d).select("part", "slot", "second", "row")


def slot_target_counts(spark, d):
    return graph.slot_counts(targets(spark, d))


def _positioned(spark, d):
    return sequences.day_positions(base(spark, d).where("to_date(flow_timestamp) = file_date"), "file_date", "flow_timestamp", "row_id")


def strided_targets_daily(spark, d):
    stride = F.when(F.lower(F.trim("split")) == "train", 128).otherwise(8)
    return sequences.day_targets(_positioned(spark, d), stride).select("file_date", "position", "row_id")


def trailing_sequence_l16(spark, d):
    made = sequences.trailing(_positioned(spark, d), "file_date", ["row_id"], 16, (F.col("position") >= 63) & ((F.col("position") - 63) % 8 == 0), block_rows=500)
    return made.select("file_date", "position", F.concat_ws(",", F.transform("sequence", lambda s: s["row_id"].cast("string"))).alias("sequence"))


def cohort_violations(spark, d):
    """Planted: rows of other days stay in, and targets begin before a whole sequence stands behind them."""
    rows = sequences.day_positions(base(spark, d), "file_date", "flow_timestamp", "row_id")
    return sequences.cohort_violations(rows, sequences.day_targets(rows, F.lit(8), 32), "file_date", "flow_timestamp", 64)


def endpoint_join(spark, d):
    flows = table(spark, d, "flows")
    records = flows.select("source_file", "source_row", "label", "flow_iat_mean")
    ends = flows.select("source_file", "source_row", "src_ip", "dst_ip", F.col("label").alias("raw_label"))
    return rounded(graph.joined_endpoints(records, ends, ["source_file", "source_row"], ["src_ip", "dst_ip"], {"label": "raw_label"}))


def _prefix(spark, d, window=6):
    t = targets(spark, d)
    return graph.prefixes(flow_edges(spark, d), graph.cutoffs(t, SLOT, OFFSET), window, SLOT), t


def causal_prefix_edges(spark, d):
    prefix, _ = _prefix(spark, d)
    return graph.latest_edges(prefix).select("part", "cutoff", "row", "second", "completion_us")


def node_features(spark, d):
    return rounded(graph.node_features(_prefix(spark, d)[0]))


def kept_nodes(spark, d):
    prefix, t = _prefix(spark, d)
    return rounded(graph.kept_nodes(graph.node_features(prefix), graph.latest_edges(prefix), t, SLOT, OFFSET).select("part", "cutoff", "node", "in_count", "out_bytes"))


def snapshot_summary(spark, d):
    prefix, t = _prefix(spark, d)
    return graph.snapshot_summary(prefix, graph.latest_edges(prefix), t, SLOT, OFFSET)


def graph_topology(spark, d):
    return rounded(graph.topology(flow_edges(spark, d), 3600), 9)


def _event_pairs(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), F.col("user_id").alias("src"), k.alias("dst")).where("src is not null and dst is not null")


def weak_components(spark, d):
    return graph.weak_components(_event_pairs(spark, d), "day")


def component_counts(spark, d):
    return graph.component_counts(_event_pairs(spark, d), "day")


def attention_weights():
    """Fixed weights, in place of trained ones."""
    rng = np.random.default_rng(7)
    return {"source": rng.normal(size=(4, 2)).round(3), "target": rng.normal(size=(4, 2)).round(3), "edge": rng.normal(size=(4, 1)).round(3), "attention": rng.normal(size=(2, 2)).round(3), "bias": rng.normal(size=4).round(3)}


def gat_attention_forward(spark, d):
    rows = base(spark, d).where("src is not null and dst is not null")
    pairs = rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("k").alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.col("k").alias("into")))).alias("n")).select("n.*")
    nodes = ends.groupBy("node").agg(F.array(F.log1p(F.sum("out")), F.log1p(F.sum("into"))).alias("x"))
    made = graph.attention_layer(nodes, pairs.select("src", "dst", F.array(F.log1p("k")).alias("e")), attention_weights(), 2)
    return rounded(made.select("node", *[F.col("h")[i].alias(f"h{i}") for i in range(4)]))


def completion_overlap(spark, d):
    e = flow_edges(spark, d)
    bounds = e.groupBy("part").agg((F.max("second") * 1_000_000).alias("end_us"))
    return graph.completion_overlap(e, bounds)


def _observed(spark, d):
    return flow_edges(spark, d).withColumn("id", F.col("row"))


def history_slots(spark, d):
    return history.history_slots(_observed(spark, d), 8, SLOT, OFFSET)


def history_counts(spark, d):
    return history.history_counts(_observed(spark, d), SLOT, OFFSET)


def history_coverage(spark, d):
    rows = _observed(spark, d).join(base(spark, d).select(F.col("row_id").alias("id"), (F.col("status") == "malicious").cast("int").alias("y")), "id")
    return rounded(history.history_coverage(rows, history.history_slots(rows, 8, SLOT, OFFSET), history.history_counts(rows, SLOT, OFFSET), "y"))


def history_violations(spark, d):
    """Planted: some lags, kinds and records of the history are changed before the check."""
    rows = _observed(spark, d)
    slots = history.history_slots(rows, 8, SLOT, OFFSET)
    wrong = slots.withColumns({"lag": F.when(F.col("id") % 50 == 0, F.col("lag") + 1).otherwise(F.col("lag")), "kind": F.when(F.col("id") % 70 == 1, 1).otherwise(F.col("kind")), "history_id": F.when(F.col("id") % 110 == 2, F.col("id")).otherwise(F.col("history_id"))})
    return history.history_violations(rows, wrong, SLOT, OFFSET)


def history_sequence(spark, d):
    rows = _observed(spark, d)
    made = history.sequence_tensor(history.history_slots(rows, 8, SLOT, OFFSET), rows.select("id", F.array("bytes").alias("x")), rows)
    return made.select("id", F.size(F.filter("mask", lambda m: m)).alias("filled"), F.round(F.aggregate("sequence", F.lit(0.0), lambda a, s: a + F.coalesce(F.get(s, F.lit(0)), F.lit(0.0))), 4).alias("total"))


CATEGORIES = {
    "RF_TP_BOT": "y = 1 and family = 'beacon bot' and rf_decision = 1",
    "RF_FN_BOT": "y = 1 and family = 'beacon bot' and rf_decision = 0",
    "RF_FP_BENIGN": "y = 0 and rf_decision = 1",
    "RF_ONLY_ATTACK": "y = 1 and rf_decision = 1 and ae_decision = 0",
    "AE_ONLY_ATTACK": "y = 1 and rf_decision = 0 and ae_decision = 1",
    "RF_AND_AE_ATTACK": "y = 1 and rf_decision = 1 and ae_decision = 1",
    "NEVER": "y = 2",
}


def quantile_cases(spark, d):
    s = scored(spark, d)
    side = {n: s.select("row_id", F.col(n).alias("score")) for n in ("rf", "ae")}
    joined = cases.joined_scores(s.select("row_id", "family", "y"), side, "row_id", {"rf": 0.6, "ae": 60000.0})
    tests = {n: (F.expr(t), "ae_score" if n.startswith("AE") else "rf_score") for n, t in CATEGORIES.items()}
    return cases.selected_cases(cases.categorised(joined, tests, ["row_id"]), list(CATEGORIES), ["row_id"])


def quota_sample(spark, d):
    return cases.quota_sample(scored(spark, d).where("y = 1"), "family", "row_id", 500, 42, portable=True).select("family", "row_id")


def topology_summary(spark, d):
    windows = graph.topology(flow_edges(spark, d), 3600).withColumn("day_part", F.floor((F.col("window") % 24) / 12))
    return rounded(graph.metric_summary(windows, ["day_part"], ["nodes", "edges", "unique_pairs", "density"]))


def thinned_scores(spark, d):
    return rounded(picks.thinned(scored(spark, d), ["split"], "ae", 50))


def sampled_flows(spark, d):
    """Seeded samples: 1,000 rows of all and at most 40 of each family."""
    s = scored(spark, d)
    whole = picks.uniform_sample(s, "row_id", 1_000, 42, portable=True).select(F.lit("all").alias("sample"), "row_id")
    return whole.unionByName(picks.group_sample(s, ["family"], "row_id", 40, 42, portable=True).select(F.col("family").alias("sample"), "row_id"))


QUERIES = {f.__name__: f for f in (strided_targets_slot, slot_target_counts, strided_targets_daily, trailing_sequence_l16, cohort_violations, endpoint_join, causal_prefix_edges, node_features, kept_nodes, snapshot_summary, graph_topology, weak_components, component_counts, gat_attention_forward, completion_overlap, history_slots, history_counts, history_coverage, history_violations, history_sequence, quantile_cases, quota_sample, topology_summary, thinned_scores, sampled_flows)}

_T = TOKEN_SQL.format("flow_duration")
_DUR = f"case when regexp_full_match({_T}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') and ({_T})::double >= 0 then trunc(({_T})::double)::bigint else 0 end"
EDGES_SQL = f"""{BASE_SQL}, e as (select case lower(trim(split)) when 'train' then 0 when 'validation' then 1 else 2 end part, epoch_us(flow_timestamp) // 1000000 AS second, epoch_us(flow_timestamp) + {_DUR} completion_us, src, dst,
  try_cast(protocol as int) protocol, src_port, dst_port, coalesce(totlen_fwd_pkts, 0) + coalesce(totlen_bwd_pkts, 0) bytes, row_id "row", status from b
  where flow_timestamp::date = file_date and split is not null and src is not null and dst is not null),
t as (select part, second // {SLOT} slot, second, "row", src, dst from (select *, row_number() over (partition by part, second // {SLOT} order by second, "row") - 1 k from e where second % {SLOT} >= {OFFSET}) where k % (case part when 0 then 4 else 2 end) = 0)"""
PREFIX_SQL = f"""{EDGES_SQL}, cut as (select distinct part, slot * {SLOT} + {OFFSET} cutoff from t),
p as (select e.*, cutoff from e join cut on e.part = cut.part and e.second // {6 * SLOT} = cutoff // {6 * SLOT} and e.second < cutoff and completion_us < cutoff * 1000000),
m as (select * from p qualify row_number() over (partition by part, cutoff order by completion_us desc, "row" desc) <= {graph.EDGE_CAP})"""
_NODES = """n as (select part, cutoff, src node, 'src' role, * exclude (part, cutoff) from p union all select part, cutoff, dst, 'dst', * exclude (part, cutoff) from p),
f as (select part, cutoff, node, ln(1 + count(*) filter (role = 'dst')) in_count, ln(1 + count(*) filter (role = 'src')) out_count, ln(1 + coalesce(sum(greatest(bytes, 0)) filter (role = 'dst'), 0)) in_bytes,
  ln(1 + coalesce(sum(greatest(bytes, 0)) filter (role = 'src'), 0)) out_bytes, ln(1 + count(*) filter (protocol = 6)) tcp, ln(1 + count(*) filter (protocol = 17)) udp,
  ln(1 + count(*) filter (role = 'src' and src_port < 1024)) low_src_port, ln(1 + count(*) filter (role = 'dst' and dst_port < 1024)) low_dst_port from n group by all)"""
_POSITIONED = f"{BASE_SQL}, q as (select *, row_number() over (partition by file_date order by flow_timestamp, row_id) - 1 position from b where flow_timestamp::date = file_date)"
_PAIRS = "p as (select distinct strftime(ts, '%Y-%m-%d') AS \"day\", user_id src, regexp_extract(props, '([0-9]+)', 1)::bigint dst from events where user_id is not null and regexp_extract(props, '([0-9]+)', 1) != '')"
_HIST = f"""h as (select o.*, o.second // {SLOT} slot from e o), l as (select h.*, k.lag, slot + k.lag for_slot from h cross join (select unnest(range(1, 9)) lag) k where completion_us < ((slot + k.lag) * {SLOT} + {OFFSET}) * 1000000),
a1 as (select part, for_slot, lag, src, dst, arg_max("row", (completion_us, "row")) id from l group by all), a2 as (select part, for_slot, lag, src, arg_max("row", (completion_us, "row")) id from l group by all), a3 as (select part, for_slot, lag, dst, arg_max("row", (completion_us, "row")) id from l group by all),
s as (select h."row" id, k.lag, coalesce(a1.id, a2.id, a3.id) history_id, case when a1.id is not null then 1 when a2.id is not null then 2 when a3.id is not null then 3 end kind from h cross join (select unnest(range(1, 9)) lag) k
  left join a1 on a1.part = h.part and a1.for_slot = h.slot and a1.lag = k.lag and a1.src = h.src and a1.dst = h.dst left join a2 on a2.part = h.part and a2.for_slot = h.slot and a2.lag = k.lag and a2.src = h.src
  left join a3 on a3.part = h.part and a3.for_slot = h.slot and a3.lag = k.lag and a3.dst = h.dst)"""


def _count_sql(key):
    on = " and ".join(f"o.{k} = h.{k}" for k in key)
    return f"(select count(*) from (select o.part, {', '.join('o.' + k for k in key)}, o.second // {SLOT} slot, min(o.completion_us) done from e o group by all) o where o.part = h.part and {on} and o.slot < h.slot and o.done < (h.slot * {SLOT} + {OFFSET}) * 1000000)"


_COUNTS = f"k as (select h.\"row\" id, {_count_sql(['src', 'dst'])} pair_count, {_count_sql(['src'])} source_count, {_count_sql(['dst'])} destination_count from (select *, second // {SLOT} slot from e) h)"
_COV = ", ".join([f"count(*) filter ({n}_count >= {k}) {n}_ge{k}" for n in history.KINDS for k in (1, 4, 8)] + [f"max({n}_count) {n}_max, round(quantile_cont({n}_count, 0.5), 6) {n}_median, round(quantile_cont({n}_count, 0.9), 6) {n}_p90" for n in history.KINDS] + [f"count(*) filter (first_{k} = {k}) all_{k}, count(*) filter (first_{k} > 0) any_{k}" for k in (3, 7, 8)] + [f"sum(kind_{i})::bigint {n}_tokens" for i, n in enumerate(history.KINDS, 1)])


def _gat_sql():
    w = attention_weights()
    dot = lambda m, names, i: " + ".join(f"({float(v)}::double) * {n}" for v, n in zip(m[i], names))
    src = ", ".join(f"{dot(w['source'], ['x0', 'x1'], i)} s{i}" for i in range(4))
    dst = ", ".join(f"{dot(w['target'], ['x0', 'x1'], i)} t{i}" for i in range(4))
    leak = lambda i: f"(case when s{i} + t{i} + ({float(w['edge'][i][0])}::double) * e >= 0 then 1 else 0.2::double end) * (s{i} + t{i} + ({float(w['edge'][i][0])}::double) * e)"
    logits = ", ".join(" + ".join(f"({float(w['attention'][h][c])}::double) * {leak(h * 2 + c)}" for c in range(2)) + f" l{h}" for h in range(2))
    out = ", ".join(f"round(sum(exp(l{i // 2} - m{i // 2}) * s{i}) / sum(exp(l{i // 2} - m{i // 2})) + ({float(w['bias'][i])}::double), 6) h{i}" for i in range(4))
    return f"""with {BASE_SQL}, p as (select src, dst, count(*) k from b where src is not null and dst is not null group by all),
n as (select node, ln(1 + sum(o)) x0, ln(1 + sum(i)) x1 from (select src node, k o, 0 i from p union all select dst, 0, k from p) group by 1),
v as (select node, {src}, {dst} from n), l as (select src, dst, ln(1 + k) e from p union all select node, node, 0 from n),
g as (select l.dst, e, a.s0, a.s1, a.s2, a.s3, z.t0, z.t1, z.t2, z.t3 from l join v a on a.node = l.src join v z on z.node = l.dst), q as (select *, {logits} from g), r as (select *, max(l0) over (partition by dst) m0, max(l1) over (partition by dst) m1 from q)
select dst node, {out} from r group by dst"""


_CASES = " union all ".join(f"select row_id, '{n}' category, {'ae' if n.startswith('AE') else 'rf'} score from z where {t}" for n, t in CATEGORIES.items())

SQL = {
    "topology_summary": f"""with {EDGES_SQL}, g as (select second // 3600 w, src, dst, count(*) k from e group by all), n as (select w, count(distinct node) nodes from (select w, unnest([src, dst]) node from g) group by 1),
t2 as (select w % 24 // 12 day_part, sum(k) edges, count(*) unique_pairs, any_value(nodes) nodes, case when any_value(nodes) > 1 then count(*) filter (src != dst) / (any_value(nodes) * (any_value(nodes) - 1))::double else 0 end density from g join n using (w) group by w),
v as ({' union all '.join(f"select day_part, '{m}' metric, {m}::double v from t2" for m in ('nodes', 'edges', 'unique_pairs', 'density'))})
select day_part, metric, count(*) n, round(avg(v), 6) mean, round(quantile_cont(v, 0.5), 6) median, round(quantile_cont(v, 0.9), 6) p90, round(max(v), 6) maximum from v group by all""",
    "thinned_scores": f"""with {SCORED_SQL}, r as (select split, ae, row_number() over (partition by split order by ae) - 1 k, count(*) over (partition by split) n from s)
select distinct split, k AS "rank", ae AS "value", round((k + 1) / n::double, 6) AS share from r join range(50) i(i) on k = floor((n - 1) * i / greatest(least(50, n) - 1, 1)) and i < n""",
    "sampled_flows": f"with {SCORED_SQL}, h as (select row_id, family, md5('42-' || row_id) chance from s) select 'all' AS sample, row_id from (from h order by chance, row_id limit 1000) union all select family, row_id from h qualify row_number() over (partition by family order by chance, row_id) <= 40",
    "strided_targets_slot": f"with {EDGES_SQL} select part, slot, second AS \"second\", \"row\" from t",
    "slot_target_counts": f"with {EDGES_SQL} select part, slot, count(*) n, min(second) first_second, max(second) last_second from t group by 1, 2",
    "strided_targets_daily": f"with {_POSITIONED} select file_date, position AS \"position\", row_id from q where position >= 63 and (position - 63) % (case when lower(trim(split)) = 'train' then 128 else 8 end) = 0",
    "trailing_sequence_l16": f"with {_POSITIONED}, r as (select file_date, position, string_agg(row_id::varchar, ',') over (partition by file_date order by position rows between 15 preceding and current row) sequence from q) select file_date, position AS \"position\", sequence from r where position >= 63 and (position - 63) % 8 = 0",
    "cohort_violations": f"""with {BASE_SQL}, q as (select *, row_number() over (partition by file_date order by flow_timestamp, row_id) - 1 position from b where flow_timestamp is not null),
v as (select file_date, position, case when year(flow_timestamp) = 1970 then 'year_1970' when flow_timestamp::date != file_date then 'day_mismatch' when position < 63 then 'before_day_start' end problem from q where position >= 32 and (position - 32) % 8 = 0)
select file_date, position AS "position", problem from v where problem is not null""",
    "endpoint_join": "select a.source_file, a.source_row, a.label, round(a.flow_iat_mean, 6) flow_iat_mean, z.src_ip, z.dst_ip from flows a join flows z using (source_file, source_row)",
    "causal_prefix_edges": f"with {PREFIX_SQL} select part, cutoff, \"row\", second AS \"second\", completion_us from m",
    "node_features": f"with {PREFIX_SQL}, {_NODES} select part, cutoff, node, {', '.join(f'round({c}, 6) {c}' for c in ('in_count', 'out_count', 'in_bytes', 'out_bytes', 'tcp', 'udp', 'low_src_port', 'low_dst_port'))} from f",
    "kept_nodes": f"""with {PREFIX_SQL}, {_NODES}, u as (select part, cutoff, src node from m union select part, cutoff, dst from m union select part, slot * {SLOT} + {OFFSET}, src from t union select part, slot * {SLOT} + {OFFSET}, dst from t)
select u.part, u.cutoff, u.node, round(coalesce(in_count, 0), 6) in_count, round(coalesce(out_bytes, 0), 6) out_bytes from u left join f using (part, cutoff, node)""",
    "snapshot_summary": f"""with {PREFIX_SQL}, x as (select part, slot * {SLOT} + {OFFSET} cutoff, unnest([src, dst]) node from t), h as (select distinct part, cutoff, unnest([src, dst]) node from p)
select x.part, x.cutoff, count(*) // 2 target_edges, count(*) filter (h.node is null) cold_endpoints, coalesce((select count(*) from p where p.part = x.part and p.cutoff = x.cutoff), 0) history_edges, coalesce((select count(*) from m where m.part = x.part and m.cutoff = x.cutoff), 0) message_edges
from x left join h on h.part = x.part and h.cutoff = x.cutoff and h.node = x.node group by x.part, x.cutoff""",
    "graph_topology": f"""with {EDGES_SQL}, g as (select second // 3600 w, src, dst, count(*) k from e group by all), n as (select w, count(distinct node) nodes from (select w, unnest([src, dst]) node from g) group by 1)
select w AS "window", sum(k)::bigint edges, count(*) unique_pairs, count(*) filter (k > 1) repeated_pairs, sum(k - 1)::bigint parallel_edges, any_value(nodes) nodes, round(case when any_value(nodes) > 1 then count(*) filter (src != dst) / (any_value(nodes) * (any_value(nodes) - 1))::double else 0 end, 9) density from g join n using (w) group by w""",
    "weak_components": f"""with recursive {_PAIRS}, u as (select "day", src a, dst z from p union select "day", dst, src from p), r as (select "day", a node, a reach from u union select r."day", r.node, u.z from r join u on u."day" = r."day" and u.a = r.reach)
select "day", node, min(reach) component from r group by 1, 2""",
    "component_counts": f"""with recursive {_PAIRS}, n as (select "day", src node from p union select "day", dst from p), u as (select "day", src a, dst z from p union select "day", dst, src from p), r as (select "day", node, node reach from n union select r."day", r.node, u.z from r join u on u."day" = r."day" and u.a = r.reach),
f as (select "day", node, node reach from n union select f."day", f.node, p.dst from f join p on p."day" = f."day" and p.src = f.reach),
w as (select "day", count(distinct c) weak_components from (select "day", node, min(reach) c from r group by 1, 2) group by 1),
s as (select "day", count(distinct c) strong_components from (select x."day", x.node, min(x.reach) c from f x join f y on y."day" = x."day" and y.node = x.reach and y.reach = x.node group by 1, 2) group by 1)
select "day", weak_components, strong_components from w join s using ("day")""",
    "gat_attention_forward": _gat_sql(),
    "completion_overlap": f"with {EDGES_SQL}, x as (select part, max(second) * 1000000 en from e group by 1) select part, count(*) n, count(*) filter (completion_us >= en) n_overlapping from e join x using (part) group by 1",
    "history_slots": f"with {EDGES_SQL}, {_HIST} select id, lag::int AS \"lag\", history_id, kind from s where history_id is not null",
    "history_counts": f"with {EDGES_SQL}, {_COUNTS} select * from k",
    "history_coverage": f"""with {EDGES_SQL}, {_HIST}, {_COUNTS}, j as (select id, {', '.join(f'count(*) filter (history_id is not null and lag <= {k}) first_{k}' for k in (3, 7, 8))}, {', '.join(f'count(*) filter (kind = {i} and lag <= 7) kind_{i}' for i in (1, 2, 3))} from s group by 1),
x as (select part, (status = 'malicious')::int y, k.*, j.* exclude (id) from e join k on k.id = e."row" join j on j.id = e."row")
select part, y, count(*) n, {_COV} from x group by grouping sets ((part, y), (part))""",
    "history_violations": f"""with {EDGES_SQL}, {_HIST}, w as (select id, (lag + (id % 50 = 0)::int)::int AS "lag", case when id % 70 = 1 then 1 else kind end kind, case when id % 110 = 2 then id else history_id end history_id from s where history_id is not null),
v as (select w.id, w."lag", case when t1.part != t2.part then 'part' when t2.second // {SLOT} != t1.second // {SLOT} - w."lag" then 'slot' when t2.completion_us >= (t1.second // {SLOT} * {SLOT} + {OFFSET}) * 1000000 then 'completion'
  when w.kind = 1 and (t1.src != t2.src or t1.dst != t2.dst) or w.kind = 2 and t1.src != t2.src or w.kind = 3 and t1.dst != t2.dst then 'entity' end problem from w join e t1 on t1."row" = w.id join e t2 on t2."row" = w.history_id)
select id, "lag", problem from v where problem is not null""",
    "history_sequence": f"""with {EDGES_SQL}, {_HIST} select e."row" id, (1 + count(z."row"))::int filled, round(any_value(e.bytes) + coalesce(sum(z.bytes), 0), 4) total from e left join s on s.id = e."row" left join e z on z."row" = s.history_id group by e."row" """,
    "quantile_cases": f"""with {SCORED_SQL}, z as (select *, (rf >= 0.6)::int rf_decision, (ae >= 60000)::int ae_decision from s), x as ({_CASES}), r as (select *, row_number() over (partition by category order by score, row_id) - 1 k, count(*) over (partition by category) n from x),
c as (select *, abs(k - 0.1::double * (n - 1)) d1, abs(k - 0.5::double * (n - 1)) d5, abs(k - 0.9::double * (n - 1)) d9 from r),
p1 as (select * from c qualify row_number() over (partition by category order by d1, k) = 1), p5 as (select c.* from c anti join p1 on p1.category = c.category and p1.k = c.k qualify row_number() over (partition by category order by d5, k) = 1),
p9 as (select c.* from c anti join (select * from p1 union all select * from p5) u on u.category = c.category and u.k = c.k qualify row_number() over (partition by category order by d9, k) = 1)
select category, 'SELECTED' status, n available, q AS quantile, score, row_id from (select *, 0.1::double q from p1 union all select *, 0.5 from p5 union all select *, 0.9 from p9)
union all select v.category, 'EMPTY', 0, null, null, null from (values {', '.join(f"('{n}')" for n in CATEGORIES)}) v(category) where v.category not in (select category from x)""",
    "quota_sample": f"""with {SCORED_SQL}, c as (select family, count(*) n from s where y = 1 group by 1), t as (select sum(n) a from c), q as (select family, (least(500, a) * n) // a q, (least(500, a) * n) % a r from c cross join t),
k as (select *, row_number() over (order by r desc, family) i, (select least(500, a) from t) - (select sum(q) from q) rest from q) select family, row_id from (select s.family, s.row_id, row_number() over (partition by s.family order by md5('42-' || s.row_id), s.row_id) j, q + (i <= rest)::int most from s join k using (family) where s.y = 1) where j <= most""",
}
