"""Queries of the audit and window operators over flows and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstream.functions.text import category, trimmed
from siltstream.operators import audit, windows
from siltstream.queries.general import BLANK_SQL, CATEGORY_SQL, TOKEN_SQL, rounded
from siltstream.session import table
from siltstream.streaming import windows as live

PROFILED = ["flow_duration", "flow_byts_s", "flow_pkts_s", "src_ip", "label", "protocol"]
RECORD = ["file_date", "split", "flow_timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_byts_s", "flow_pkts_s", "flow_iat_mean", "init_fwd_win_byts", "label"]


def base(spark, d):
    """flows with trimmed addresses, the label as compared and its status."""
    flows = table(spark, d, "flows")
    return flows.withColumns({"src": trimmed(F.col("src_ip")), "dst": trimmed(F.col("dst_ip")), "label_key": category(F.col("label")), "status": audit.label_status(F.col("label"))})



def quality_profile(spark, d):
    return audit.content_types(audit.value_profile(table(spark, d, "flows"), ["source_file"], PROFILED))


def special_values(spark, d):
    return audit.special_values(base(spark, d), ["source_file", "label_key"], ["flow_duration", "flow_byts_s", "flow_pkts_s"])


def label_status_rules(spark, d):
    flows = table(spark, d, "flows")
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), audit.label_status(F.col("label"), r).alias("status")) for r in ("folded", "exact", "header_as_attack")])
    return flows.select(F.inline(rules)).groupBy("rule", "status").agg(F.count(F.lit(1)).alias("n"))


def later_copies(spark, d):
    return audit.later_copies(table(spark, d, "flows"), "source_file", RECORD, "source_row")


def duplicate_summary(spark, d):
    return audit.duplicate_summary(table(spark, d, "flows"), "source_file", RECORD, "label")


def document_duplicates(spark, d):
    texts = audit.repeated(table(spark, d, "documents").select("doc_id", "text", "source"), ["text"]).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return texts.where("n > 1").select("first_doc", "n")


def scoped_counts(spark, d):
    return rounded(audit.scoped_counts(base(spark, d), "source_file", "label_key", "status"))


def backward_transitions(spark, d):
    return audit.backward_transitions(base(spark, d), "source_file", "source_row", "flow_timestamp", "label_key")


def anomaly_context(spark, d):
    return audit.anomaly_context(base(spark, d), "source_file", "source_row", "flow_timestamp", "file_date", "label_key")


def file_times(spark, d):
    return audit.file_times(table(spark, d, "flows"), "source_file", "flow_timestamp", "file_date")


def cardinalities(spark, d):
    return audit.cardinalities(base(spark, d), "source_file", ["src", "dst", "src_port", "dst_port"])


def protocol_shares(spark, d):
    return rounded(audit.shares(table(spark, d, "flows"), "source_file", "protocol"))


def _events(spark, d):
    return table(spark, d, "events")


def window_counts_gapfill_5m(spark, d):
    counts = windows.window_counts(_events(spark, d), [], "ts", 5, F.col("event_type") == "error")
    return windows.filled(counts, [], 5)


def window_counts_10m_rollup(spark, d):
    counts = windows.window_counts(base(spark, d), ["source_file"], "flow_timestamp", 1, F.col("status") == "malicious")
    return windows.filled(windows.rolled_up(counts, ["source_file"], 10), ["source_file"], 10)


def window_pair_recurrence(spark, d):
    return rounded(windows.pair_recurrence(base(spark, d), "flow_timestamp", "src", "dst", 10))


def describe_windows(spark, d):
    counts = windows.window_counts(base(spark, d), ["source_file"], "flow_timestamp", 5, F.col("status") == "malicious")
    return rounded(windows.described(windows.filled(counts, ["source_file"], 5), ["source_file"], "n"))


def attack_timeline(spark, d):
    return windows.timeline(base(spark, d), "flow_timestamp", 5, F.col("status") == "malicious", "src", "dst")


def attack_episodes(spark, d):
    counts = windows.window_counts(_events(spark, d), [], "ts", 10, F.col("event_type") == "error")
    return windows.episodes(counts, 10, F.col("n_malicious") > 0)


def sliding_counts(spark, d):
    return windows.sliding_counts(_events(spark, d), "ts", 60, 15)


def user_sessions(spark, d):
    return windows.session_counts(_events(spark, d), "user_id", "ts", 30)


def live_window_counts(spark, d):
    stream = live.stream_of(spark, d, "events")
    return live.written_once(live.live_counts(stream, "ts", 60, F.col("event_type") == "error"))


QUERIES = {f.__name__: f for f in (quality_profile, special_values, label_status_rules, later_copies, duplicate_summary, document_duplicates, scoped_counts, backward_transitions, anomaly_context, file_times, cardinalities, protocol_shares, window_counts_gapfill_5m, window_counts_10m_rollup, window_pair_recurrence, describe_windows, attack_timeline, attack_episodes, sliding_counts, user_sessions, live_window_counts)}

_K = CATEGORY_SQL.format("label")
_NULLS = "'nan', '+nan', '-nan', 'null', 'none', 'na', 'n/a', '#n/a', '<na>'"
STATUS_SQL = f"case when label is null or {_K} in ('', 'label', {_NULLS}) then 'unclassified' when {_K} = 'benign' then 'benign' else 'malicious' end"
BASE_SQL = f"b as (select *, trim(src_ip, {BLANK_SQL}) src, trim(dst_ip, {BLANK_SQL}) dst, {_K} label_key, {STATUS_SQL} status from flows)"
_TOK = TOKEN_SQL.format("raw")
_RAW = " union all ".join(f"select source_file, '{c}' column_name, {c}::varchar raw from flows" for c in PROFILED)
_KIND = f"""case when raw is null or {_TOK} = '' then 'missing' when {_TOK} in ('nan', '+nan', '-nan') then 'nan' when {_TOK} in ('null', 'none', 'na', 'n/a', '#n/a', '<na>') then 'null_marker'
  when regexp_full_match({_TOK}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') then 'number' when regexp_full_match({_TOK}, '[+-]?inf(inity)?') then 'infinite' else 'other' end"""
_REC = ", ".join(RECORD)


def _window(minutes, time="flow_timestamp"):
    return f"time_bucket(interval '{minutes} minutes', {time})"


def filled_sql(counts, keys, minutes, values):
    k = "".join(f"{x}, " for x in keys)
    on = " and ".join([f"e.{x} = c.{x}" for x in keys] + ["e.window_start = c.window_start"])
    return f"""select {''.join(f'e.{x}, ' for x in keys)}e.window_start, {', '.join(f'coalesce({v}, 0)::bigint {v}' for v in values)} from
  (select {k}unnest(generate_series(min(window_start), max(window_start), interval '{minutes} minutes')) window_start from {counts} group by {k}window_start::date) e
  left join {counts} c on {on}"""


SQL = {
    "quality_profile": f"""with r as ({_RAW}), k as (select *, {_KIND} kind, {_TOK} tok from r),
p as (select source_file, column_name, count(*) n_rows, {', '.join(f"count(*) filter (kind = '{k}') n_{k}" for k in audit.COUNTED)},
  coalesce(bool_or(case when kind = 'number' then tok::double % 1 != 0 end), false) has_fraction,
  (count(distinct raw) = 1 and count(raw) = count(*)) or count(raw) = 0 is_constant,
  count(distinct case when kind not in ('missing', 'nan', 'null_marker') and raw != column_name then raw end) = 1 is_constant_value from k group by all)
select *, case when n_other > 0 and n_number + n_infinite > 0 then 'mixed numeric/string' when n_other > 0 then 'string'
  when n_number + n_infinite > 0 and (has_fraction or n_infinite > 0 or n_nan > 0) then 'float64' when n_number + n_infinite > 0 then 'integer' else 'missing-only' end content_type from p""",
    "special_values": f"""with {BASE_SQL}, r as ({' union all '.join(f"select source_file, label_key, '{c}' column_name, {TOKEN_SQL.format(c)} t from b" for c in ('flow_duration', 'flow_byts_s', 'flow_pkts_s'))}),
k as (select *, case when t in ('nan', '+nan', '-nan') then 'nan' when regexp_full_match(t, '-inf(inity)?') then 'negative_infinity' when regexp_full_match(t, '[+]?inf(inity)?') then 'positive_infinity' end kind from r)
select source_file, label_key, column_name, kind, count(*) n from k where kind is not null group by all""",
    "label_status_rules": f"""with r as (select 'folded' rule, {STATUS_SQL} status from flows union all
select 'exact', case when label = 'Benign' then 'benign' when label is null or trim(label, {BLANK_SQL}) = '' or label = 'Label' then 'unclassified' else 'malicious' end from flows union all
select 'header_as_attack', case when label = 'Benign' then 'benign' else 'malicious' end from flows) select rule, status, count(*) n from r group by all""",
    "later_copies": f"select source_file, source_row, retained from (select source_file, source_row, min(source_row) over (partition by source_file, {_REC}) retained from flows) where source_row > retained",
    "duplicate_summary": f"""with g as (select source_file, {_REC}, count(*) n from flows group by all)
select source_file, label, sum(n)::bigint n_rows, sum(n - 1)::bigint extra_occurrences, count(*) filter (n > 1) duplicate_groups, coalesce(sum(n) filter (n > 1), 0)::bigint all_occurrences from g group by all""",
    "document_duplicates": "select min(doc_id) first_doc, count(*) n from documents group by text having count(*) > 1",
    "scoped_counts": f"""with {BASE_SQL}, g as (select source_file, label_key, status, count(*) n, grouping(source_file, label_key, status) g from b
  group by grouping sets ((source_file, label_key, status), (source_file), (label_key, status), (status), ())),
f as (select source_file, count(*) fn from b group by 1), a as (select count(*) an from b)
select case g when 0 then 'file_class' when 3 then 'file_total' when 4 then 'dataset_class' when 6 then 'dataset_status' else 'dataset_total' end scope, g.source_file, label_key, status, n,
  case when g in (0, 3) then fn else an end denominator, round(100 * n / (case when g in (0, 3) then fn else an end)::double, 6) percentage from g left join f using (source_file) cross join a""",
    "backward_transitions": f"""with {BASE_SQL}, s as (select source_file, flow_timestamp, label_key, last_value(flow_timestamp ignore nulls) over (partition by source_file order by source_row rows between unbounded preceding and 1 preceding) previous_time from b)
select source_file, previous_time, flow_timestamp, label_key, count(*) n, (epoch(previous_time) - epoch(flow_timestamp))::bigint backward_seconds from s where flow_timestamp < previous_time group by all""",
    "anomaly_context": f"""with {BASE_SQL}, s as (select source_file, source_row, label_key, case when flow_timestamp is null then 'unparseable_timestamp' when year(flow_timestamp) = 1970 then 'year_1970' when flow_timestamp::date != file_date then 'date_mismatch' end anomaly_type,
  coalesce(string_agg(source_row::varchar, ',') over (partition by source_file order by source_row rows between 3 preceding and 1 preceding), '') preceding,
  coalesce(string_agg(source_row::varchar, ',') over (partition by source_file order by source_row rows between 1 following and 3 following), '') following,
  min(flow_timestamp) over (partition by source_file order by source_row rows between 3 preceding and 1 preceding) preceding_min,
  max(flow_timestamp) over (partition by source_file order by source_row rows between 1 following and 3 following) following_max from b)
select * from s where anomaly_type is not null""",
    "file_times": """select source_file, count(*) n_rows, count(flow_timestamp) n_timed, min(flow_timestamp) first_time, max(flow_timestamp) last_time, count(distinct flow_timestamp) n_times,
  count(flow_timestamp) - count(distinct flow_timestamp) same_time_extra, count(*) filter (flow_timestamp is null) n_unparseable_timestamp, count(*) filter (year(flow_timestamp) = 1970) n_year_1970,
  count(*) filter (year(flow_timestamp) != 1970 and flow_timestamp::date != file_date) n_date_mismatch from flows group by 1""",
    "cardinalities": f"""with {BASE_SQL} {' union all '.join(f"select source_file, '{c}' column_name, count(distinct {c}) n_distinct from b group by 1 having count({c}) > 0" for c in ('src', 'dst', 'src_port', 'dst_port'))}""",
    "protocol_shares": "select source_file, protocol, count(*) n, round(100 * count(*) / sum(count(*)) over (partition by source_file)::double, 6) percentage from flows group by 1, 2",
    "window_counts_gapfill_5m": f"with c as (select {_window(5, 'ts')} window_start, count(*) n, count(*) filter (event_type = 'error') n_malicious from events group by 1) {filled_sql('c', [], 5, ['n', 'n_malicious'])}",
    "window_counts_10m_rollup": f"with {BASE_SQL}, c as (select source_file, {_window(10)} window_start, count(*) n, count(*) filter (status = 'malicious') n_malicious from b where flow_timestamp is not null group by 1, 2) {filled_sql('c', ['source_file'], 10, ['n', 'n_malicious'])}",
    "window_pair_recurrence": f"""with {BASE_SQL}, p as (select {_window(10)} window_start, src, dst, count(*) n from b where flow_timestamp is not null and src is not null and dst is not null group by all)
select window_start, sum(n)::bigint flows, count(*) unique_pairs, count(*) filter (n > 1) repeated_pairs, coalesce(sum(n) filter (n > 1), 0)::bigint flows_in_repeated, sum(n - 1)::bigint extra_flows, max(n) max_flows_per_pair,
  round(100 * coalesce(sum(n) filter (n > 1), 0) / sum(n)::double, 6) repeated_percentage from p group by 1""",
    "describe_windows": f"""with {BASE_SQL}, c as (select source_file, {_window(5)} window_start, count(*) n from b where flow_timestamp is not null group by 1, 2), f as ({filled_sql('c', ['source_file'], 5, ['n'])})
select source_file, count(*) n, min(n) minimum, round(quantile_cont(n, 0.5), 6) median, round(avg(n), 6) mean, round(quantile_cont(n, 0.95), 6) p95, max(n) maximum from f group by 1""",
    "attack_timeline": f"""with {BASE_SQL}, c as (select {_window(5)} window_start, count(*) filter (status != 'malicious') n_benign, count(*) filter (status = 'malicious') n_malicious, count(*) n, count(distinct src) n_sources, count(distinct dst) n_targets from b where flow_timestamp is not null group by 1)
{filled_sql('c', [], 5, ['n_benign', 'n_malicious', 'n', 'n_sources', 'n_targets'])}""",
    "attack_episodes": f"""with c as (select {_window(10, 'ts')} w, count(*) n from events group by 1 having count(*) filter (event_type = 'error') > 0),
i as (select *, epoch(w)::bigint // 600 - row_number() over (order by w) g from c)
select min(w) episode_start, max(w) + interval '10 minutes' episode_end, count(*) n_windows, sum(n)::bigint n from i group by g""",
    "live_window_counts": f"select {_window(60, 'ts')} window_start, count(*) n, count(*) filter (event_type = 'error') n_malicious from events group by 1",
    "sliding_counts": "select window_start, count(*) n from (select unnest([time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' for k in range(4)]) window_start from events) group by 1",
    "user_sessions": """with s as (select user_id, ts, coalesce(ts >= lag(ts) over w + interval '30 minutes', true)::int new from events window w as (partition by user_id order by ts)),
g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from s)
select user_id, min(ts) session_start, max(ts) + interval '30 minutes' session_end, count(*) n from g group by user_id, k""",
}
