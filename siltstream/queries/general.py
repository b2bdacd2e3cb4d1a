"""Queries of the general record operators, p1 and p4 to p6, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstream.operators import keyed_chunks, quality_profile, schema_drift
from siltstream.session import table
from siltstream.sources import csv_rejects

def rounded(df, places=6):
    """Doubles rounded, as results of sums and quantiles may differ in the last digits."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


BLANK_SQL = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)"


def p1_found(spark, d):
    return keyed_chunks.heavy_endpoints(table(spark, d, "flows"))


def p1_endpoint_states(spark, d):
    return rounded(keyed_chunks.endpoint_states(table(spark, d, "flows")))


def p4_found(spark, d):
    return schema_drift.schema_changes(table(spark, d, "raw_lines"), table(spark, d, "class_by_file"))


def p4_versions(spark, d):
    return schema_drift.schema_versions(table(spark, d, "raw_lines"), table(spark, d, "class_by_file"))


def p4_consistent_table(spark, d):
    return schema_drift.consistent_table(table(spark, d, "raw_lines"), table(spark, d, "class_by_file"))


def p4_routes(spark, d):
    return schema_drift.migration_routes(table(spark, d, "raw_lines"), table(spark, d, "class_by_file"))


def p5_found(spark, d):
    return csv_rejects.rejected_lines(table(spark, d, "raw_lines"), table(spark, d, "class_by_file"))


def p5_loaded(spark, d):
    return csv_rejects.loaded_lines(table(spark, d, "raw_lines"), table(spark, d, "class_by_file"))


def p6_found(spark, d):
    return quality_profile.doubtful(table(spark, d, "flows"), table(spark, d, "data_quality_report"))


def p6_column_profile(spark, d):
    """Least, greatest and quartiles of numbers and times as numbers, of text as text."""
    made = quality_profile.column_profile(table(spark, d, "flows"))
    text = F.col("column_name").isin("split", "src_ip", "dst_ip", "protocol", "label")
    ranks = ["least", "q25", "q50", "q75", "greatest"]
    # times in seconds
    unit = F.when(F.col("column_name").isin("flow_timestamp", "loaded_at"), 1e-6).otherwise(1.0)
    as_number, as_text = [F.when(~text, F.round(F.col(c).try_cast("double") * unit, 6)).alias(c) for c in ranks], [F.when(text, F.col(c)).alias(f"{c}_text") for c in ranks]
    return rounded(made.select("source_file", "column_name", "n_rows", "n_null", *quality_profile.TOKENS, "n_distinct", *as_number, *as_text))


def p6_load_distances(spark, d):
    return rounded(quality_profile.load_distances(table(spark, d, "flows")))


def p6_measure_profile(spark, d):
    return rounded(quality_profile.measure_profile(table(spark, d, "flows")))


ENDPOINTS_SQL = f"""e as (
  select 'src_ip' endpoint_role, trim(src_ip, {BLANK_SQL}) ip, row_id, flow_timestamp ts,
         coalesce(tot_fwd_pkts, 0) + coalesce(tot_bwd_pkts, 0) pk from flows where src_ip is not null
  union all
  select 'dst_ip', trim(dst_ip, {BLANK_SQL}), row_id, flow_timestamp,
         coalesce(tot_fwd_pkts, 0) + coalesce(tot_bwd_pkts, 0) from flows where dst_ip is not null)"""

CATEGORY_SQL = "lower(regexp_replace(trim({0}, " + BLANK_SQL + r"), '[\s\x{{00A0}}]+', ' ', 'g'))"
TOKEN_SQL = "lower(trim({0}, " + BLANK_SQL + "))"
FIELDS_SQL = """list_transform(regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1),
  lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end)"""
_STAMP = f"trim(ts, {BLANK_SQL})"
LINES_SQL = f"""h as (select source_file, {FIELDS_SQL} hf from raw_lines where source_line = 1),
l as (select line_id, feed, source_file, file_seq, source_line, coalesce(raw_line, '') raw_line from raw_lines where source_line > 1),
f as (select *, regexp_full_match(raw_line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') formed, {FIELDS_SQL} fields from l),
j as (select f.*, hf, case when not formed then 'quoting' when len(fields) != len(hf) then 'column_count' when fields = hf then 'repeated_header' end problem
      from f left join h using (source_file)),
k as (select distinct {CATEGORY_SQL.format("label")} label_key from class_by_file where class_group in ('benign', 'malicious')),
v as (select *, fields[list_position(hf, 'Timestamp')] ts, {CATEGORY_SQL.format("fields[list_position(hf, 'Label')]")} label_key from j where problem is null),
w as (select v.*, not (regexp_full_match({_STAMP}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')
        and try_strptime({_STAMP}, '%d/%m/%Y %H:%M:%S') is not null) bad_ts, k.label_key is null bad_label
      from v left join k using (label_key))"""
# The field that a header name, in lower case and with marks as _, stands for. Kept apart from the operator's list.
_NAMES = {
    "timestamp": "timestamp",
    "src_ip": "(src|source|origin)_(ip|addr|address|ip_address)",
    "dst_ip": "(dst|destination|dest|target)_(ip|addr|address|ip_address)",
    "src_port": "s_?port|(src|source|origin)_port",
    "dst_port": "d_?port|(dst|destination|dest|target)_port",
    "protocol": "proto|protocol|ip_protocol",
    "flow_duration": "flow_dur(ation)?|duration_of_flow",
    "tot_fwd_pkts": "tot(al)?_fwd_(pkts|packets)",
    "tot_bwd_pkts": "tot(al)?_bwd_(pkts|packets)",
    "totlen_fwd_pkts": "tot_?len_fwd_pkts|total_length_fwd_packets",
    "totlen_bwd_pkts": "tot_?len_bwd_pkts|total_length_bwd_packets",
    "flow_byts_s": "flow_byte?s_s",
    "flow_pkts_s": "flow_(pkts|packets)_s",
    "label": "label",
}
_WORDS = f"trim(lower(regexp_replace(regexp_replace(trim(name, {BLANK_SQL}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_')"
_FIELD = "case " + " ".join(f"when regexp_full_match({_WORDS}, '{p}') then '{f}'" for f, p in _NAMES.items()) + f" else {_WORDS} end"
_VALUE = TOKEN_SQL.format("u.value")
_ABSENT = "'', 'nan', '+nan', '-nan', 'null', 'none', 'na', 'n/a', '#n/a', '<na>'"
_RULE = " + ".join(
    f"case when max(({test})::int) = 1 then {bit} else 0 end"
    for bit, test in [
        (1, f"field in ('src_ip', 'dst_ip') and regexp_full_match({_VALUE}, '[0-9]{{1,10}}')"),
        (2, f"field in ('src_port', 'dst_port') and regexp_full_match({_VALUE}, '0x[0-9a-f]+')"),
        (4, f"field in ('src_port', 'dst_port') and regexp_full_match({_VALUE}, '(p|[a-z]+/)[0-9]+')"),
        (8, f"field in ('src_port', 'dst_port', 'protocol', 'tot_fwd_pkts', 'tot_bwd_pkts') and regexp_full_match({_VALUE}, '[+-]?[0-9]+\\.0*')"),
        (16, f"field = 'protocol' and regexp_matches({_VALUE}, '^[a-z]')"),
        (32, f"field = 'flow_duration' and regexp_full_match({_VALUE}, '[+-]?[0-9]*\\.[0-9]*[1-9][0-9]*')"),
    ]
)
DRIFT_SQL = f"""{LINES_SQL},
hh as (select feed, source_file, file_seq, unnest(hf) name, unnest(range(1, len(hf) + 1)) pos from h join (select distinct feed, source_file, file_seq from raw_lines) using (source_file)),
hc as (select *, {_FIELD} field from hh),
u0 as (select source_file, unnest(fields) as value, unnest(range(1, len(fields) + 1)) pos from w where not bad_ts and not bad_label),
u as (select u0.*, field from u0 join hc using (source_file, pos)),
t as (select source_file, pos, max(case when {_VALUE} in ({_ABSENT}) or regexp_full_match({_VALUE}, '[+-]?inf(inity)?') then null when regexp_full_match({_VALUE}, '[+-]?[0-9]+') then 0
        when regexp_full_match({_VALUE}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') then 1 else 2 end) kind, {_RULE} rules
      from u group by all),
n as (select feed, source_file, file_seq, lag(source_file) over (partition by feed order by file_seq) earlier,
        lead(source_file) over (partition by feed order by file_seq) later from (select distinct feed, source_file, file_seq from hh)),
c as (select hc.feed, hc.source_file, hc.file_seq, pos, name, field, kind, coalesce(rules, 0) rules, earlier, later from hc left join t using (source_file, pos) join n on n.source_file = hc.source_file),
b as (select coalesce(x.source_file, y.later) source_file, coalesce(x.field, y.field) field, x.name, y.name old_name, x.kind, y.kind old_kind
      from (select * from c where earlier is not null) x full join (select * from c where later is not null) y on x.source_file = y.later and x.field = y.field)"""
_KIND = "(['integer', 'decimal', 'text'])[{} + 1]"
VERSIONS_SQL = f"""{DRIFT_SQL},
fp as (select feed, source_file, file_seq, sha256(string_agg(part, '|' order by part)) fingerprint from (select *, concat_ws(':', field, name, coalesce({_KIND.format("kind")}, '-'), rules::varchar) part from c) group by all),
vn as (select *, fingerprint is distinct from lag(fingerprint) over (partition by feed order by file_seq) is_new from fp),
vs as (select *, sum(is_new::bigint) over (partition by feed order by file_seq)::bigint as version from vn)"""
_AT = lambda f: f"trim(fields[list_position(canon, '{f}')], {BLANK_SQL})"
_WRITTEN = lambda f: f"case when lower({_AT(f)}) not in ({_ABSENT}) then {_AT(f)} end"
_WHOLE = r"""case when regexp_full_match({0}, '0[xX][0-9a-fA-F]+') then try_cast(lower({0}) as bigint) when regexp_full_match(lower({0}), '(p|[a-z]+/)[0-9]+') then regexp_replace({0}, '^[^0-9]+', '')::bigint
  when regexp_full_match({0}, '[+-]?[0-9]+(\.0*)?') then try_cast(regexp_replace({0}, '\..*', '') as bigint) end""".replace("\\", "\\")
_DOTTED = "case when regexp_full_match({0}, '[0-9]{{1,10}}') then concat_ws('.', ({0}::bigint >> 24) & 255, ({0}::bigint >> 16) & 255, ({0}::bigint >> 8) & 255, {0}::bigint & 255) else {0} end"
_TABLE = {
    "flow_timestamp": "try_strptime(w_timestamp, '%d/%m/%Y %H:%M:%S')",
    "src_ip": _DOTTED.format("w_src_ip"),
    "src_port": _WHOLE.format("w_src_port"),
    "dst_ip": _DOTTED.format("w_dst_ip"),
    "dst_port": _WHOLE.format("w_dst_port"),
    "protocol": "coalesce((map {'hopopt': 0, 'icmp': 1, 'tcp': 6, 'udp': 17})[lower(w_protocol)]::bigint, " + _WHOLE.format("w_protocol") + ")",
    "flow_duration": "round(try_cast(w_flow_duration as double) * case when is_ms then 1000.0::double else 1.0::double end, 3)",
    "tot_fwd_pkts": _WHOLE.format("w_tot_fwd_pkts"),
    "tot_bwd_pkts": _WHOLE.format("w_tot_bwd_pkts"),
    **{f: f"case when isfinite(try_cast(w_{f} as double)) then try_cast(w_{f} as double) end" for f in ("totlen_fwd_pkts", "totlen_bwd_pkts", "flow_byts_s", "flow_pkts_s")},
    "label": r"regexp_replace(w_label, '\s+', ' ', 'g')",
}
_LOST = ", ".join(f"case when w_{'timestamp' if f == 'flow_timestamp' else f} is not null and {f} is null then '\"{f}\":' || to_json(w_{'timestamp' if f == 'flow_timestamp' else f})::varchar end" for f in _TABLE)
_EXTRA = "list_filter(list_transform(canon, lambda x, i: case when x not in (" + ", ".join(f"'{f}'" for f in _NAMES) + ") then '\"' || x || '\":' || to_json(fields[i])::varchar end), lambda x: x is not null)"

_T = TOKEN_SQL.format("x")
_MEASURE_ROWS = " union all ".join(f"select source_file, file_date, '{c}' column_name, {c} x from flows" for c in quality_profile.MEASURES)
MEASURES_SQL = rf"""r as ({_MEASURE_ROWS}),
k as (select source_file, column_name, case when x is null or {_T} = '' then 'missing' when {_T} in ('nan', '+nan', '-nan') then 'nan'
        when {_T} in ('null', 'none', 'na', 'n/a', '#n/a', '<na>') then 'null_marker'
        when regexp_full_match({_T}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') then 'number'
        when regexp_full_match({_T}, '[+-]?inf(inity)?') then 'infinite' else 'other' end kind, {_T} tok from r),
m as (select *, case when kind = 'number' then tok::double end v from k),
s as (select source_file, column_name, count(*) n_rows, count(*) filter (kind = 'missing') n_missing, count(*) filter (kind = 'null_marker') n_null_marker,
        count(*) filter (kind = 'nan') n_nan, count(*) filter (kind = 'infinite') n_infinite, count(*) filter (kind = 'other') n_other, count(v) n_number,
        count(*) filter (v < 0) n_negative, count(*) filter (v > 120000000) n_above_limit, min(v) least, max(v) greatest, count(distinct v) n_distinct,
        quantile_cont(v, 0.01) q01, quantile_cont(v, 0.25) q25, quantile_cont(v, 0.5) q50, quantile_cont(v, 0.75) q75, quantile_cont(v, 0.99) q99 from m group by all),
d as (select source_file, regexp_extract(source_file, '(site[0-9]+)', 1) site, min(file_date) dt from flows group by all),
e as (select a.source_file, b.source_file earlier from d a join d b on a.site = b.site and a.dt = b.dt + 1)""".replace("\\\\", "\\")

_REALS = ["row_id", "source_row", "src_port", "dst_port", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_iat_mean", "init_fwd_win_byts"]
_CURVES = " union all ".join(
    [f"select source_file, '{c}' column_name, case when isfinite({c}::double) then {c}::double + 0.0 end x, null::varchar t from flows" for c in _REALS]
    + [f"select source_file, '{c}', epoch_us({c}::timestamp)::double, null from flows" for c in ("file_date", "flow_timestamp", "loaded_at")]
    + ["select source_file, column_name, v, null from m"]
    + [f"select source_file, '{c}', null, {CATEGORY_SQL.format(c)} from flows" for c in ("split", "src_ip", "dst_ip", "protocol", "label")]
)
_RANK = "dense_rank() over (partition by column_name order by x, t)"

_FLOATS = ["totlen_fwd_pkts", "totlen_bwd_pkts", "flow_iat_mean"]
_PROFILED = " union all ".join(
    [f"select source_file, '{c}' column_name, {c} is null gone, {_T.replace('x', f'{c}::varchar') if c in _FLOATS else 'null'} tok, {c}::double + 0.0 x, null::varchar t, false measured from flows" for c in _REALS]
    + [f"select source_file, '{c}', {c} is null, null, {'({0} - date ' + chr(39) + '1970-01-01' + chr(39) + ')' if c == 'file_date' else 'epoch_us({0}) * 1e-6::double'}::double, null, false from flows".replace("{0}", c) for c in ("file_date", "flow_timestamp", "loaded_at")]
    + [f"select source_file, '{c}', {c} is null, {TOKEN_SQL.format(c)}, case when {TOKEN_SQL.format(c)} similar to '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?' then ({TOKEN_SQL.format(c)})::double + 0.0 end, null, true from flows" for c in quality_profile.MEASURES]
    + [f"select source_file, '{c}', {c} is null, {TOKEN_SQL.format(c)}, null, {CATEGORY_SQL.format(c)}, false from flows" for c in ("split", "src_ip", "dst_ip", "protocol", "label")]
)
_QUARTILES = ", ".join(f"round(quantile_cont(x, {q}), 6) {c}, list_sort(list(t) filter (t is not null))[floor({q} * (count(t) - 1))::int + 1] {c}_text" for c, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))

SQL = {
    "p6_column_profile": f"""with r as ({_PROFILED}) select source_file, column_name, count(*) n_rows, count(*) filter (gone) n_null, count(*) filter (not gone and tok = '') n_blank,
  count(*) filter (tok in ('nan', '+nan', '-nan')) n_nan, count(*) filter (tok in ('null', 'none', 'na', 'n/a', '#n/a', '<na>')) n_null_marker, count(*) filter (regexp_full_match(tok, '[+-]?inf(inity)?')) n_infinite,
  count(*) filter (measured and not gone and x is null and tok not in ('', 'nan', '+nan', '-nan', 'null', 'none', 'na', 'n/a', '#n/a', '<na>') and not regexp_full_match(tok, '[+-]?inf(inity)?')) n_other,
  count(distinct x) + count(distinct t) n_distinct, round(min(x), 6) least, min(t) least_text, {_QUARTILES}, round(max(x), 6) greatest, max(t) greatest_text from r group by all""",
    "p6_measure_profile": f"with {MEASURES_SQL} select * replace ({', '.join(f'round({c}, 6) as {c}' for c in ('least', 'greatest', 'q01', 'q25', 'q50', 'q75', 'q99'))}) from s",
    "p6_found": f"""with {MEASURES_SQL},
j as (select s.*, b.n_rows b_rows, b.n_missing + b.n_null_marker b_absent, b.q50 b_median, s.n_missing + s.n_null_marker n_absent
      from s left join e using (source_file) left join s b on b.source_file = e.earlier and b.column_name = s.column_name),
q as (select distinct filename source_file, column_name, nan_values, infinite_values from data_quality_report where report_scope = 'column')
select source_file, column_name, 'nan_values' finding from s semi join (select * from q) z on z.source_file = s.source_file and z.column_name = s.column_name and z.nan_values is distinct from n_nan
union all select source_file, column_name, 'infinite_values' from s semi join (select * from q) z on z.source_file = s.source_file and z.column_name = s.column_name and z.infinite_values is distinct from n_infinite
union all select source_file, column_name, 'pattern' from j where n_other > 0
union all select source_file, column_name, 'value_range' from j where n_negative > 0 or column_name = 'flow_duration' and n_above_limit > 0
union all select source_file, column_name, 'null_rate' from j where n_absent / n_rows::double - b_absent / b_rows::double >= 0.05 - 1e-12
union all select source_file, column_name, 'shift' from j where q50 >= 4 * b_median or q50 <= b_median / 4""",
    "p6_load_distances": f"""with {MEASURES_SQL},
c0 as ({_CURVES}),
c1 as (select c0.*, {_RANK} v from c0 where t is not null or x is not null),
p as (select e.source_file, c.column_name, e.earlier, v, 1 w from e join c1 c on c.source_file = e.source_file
      union all select e.source_file, c.column_name, e.earlier, v, 0 from e join c1 c on c.source_file = e.earlier),
g as (select source_file, column_name, earlier, v, sum(w) c, count(*) - sum(w) p from p group by all),
tt as (select e.source_file, e.earlier, column_name from e cross join (select distinct column_name from c0)),
t as (select tt.source_file, tt.column_name, tt.earlier, coalesce(sum(c), 0) n, coalesce(sum(p), 0) n_earlier from tt left join g using (source_file, column_name, earlier) group by all),
x as (select t.source_file, t.column_name, t.earlier, n, n_earlier, case when n > 0 and n_earlier > 0 then sum(c) over (partition by t.source_file, t.column_name order by v) / n::double - sum(p) over (partition by t.source_file, t.column_name order by v) / n_earlier::double end gap
      from t left join g using (source_file, column_name, earlier))
select source_file, column_name, earlier, n::bigint n, n_earlier::bigint n_earlier, round(max(abs(gap)), 6) ks from x group by all""",
    "p5_found": f"""with {LINES_SQL} select line_id, problem reason from j where problem is not null
union all select line_id, 'invalid_timestamp' from w where bad_ts union all select line_id, 'invalid_label' from w where bad_label""",
    "p5_loaded": f"""with {LINES_SQL} select line_id, feed, source_file, source_line, strptime({_STAMP}, '%d/%m/%Y %H:%M:%S') flow_timestamp, label_key as label,
  len(fields)::int n_fields, array_to_string(list_transform(fields, lambda x, i: case when i = list_position(hf, 'Timestamp') then {_STAMP.replace("ts", "x")} else x end), chr(31)) field_values
from w where not bad_ts and not bad_label""",
    "p4_found": f"""with {DRIFT_SQL}
select source_file, 'added' change_kind, name field_name from b where old_name is null
union all select source_file, 'removed', old_name from b where name is null
union all select source_file, 'renamed', name from b where name != old_name
union all select source_file, 'type_changed', name from b where kind != old_kind""",
    "p4_versions": f"""with {VERSIONS_SQL},
st as (select source_file, unnest([case when old_name is null then 'default ' || field end, case when name is null then 'drop ' || field end,
  case when name != old_name then 'rename ' || old_name || ' to ' || name end, case when kind != old_kind then 'cast ' || field || ' ' || {_KIND.format("old_kind")} || ' to ' || {_KIND.format("kind")} end]) step from b)
select feed, vs.source_file, file_seq, fingerprint, version, coalesce(steps, '') steps from vs left join (select source_file, string_agg(step, '; ' order by step) steps from st where step is not null group by 1) using (source_file)""",
    "p4_routes": f"""with {VERSIONS_SQL},
kf as (select vs.feed, version, field, name, pos, rules from vs join c using (source_file) where is_new),
tv as (select feed, version, max(version) over (partition by feed) target_version from vs where is_new),
ln as (select feed, field, arg_max(name, version) last_name from kf group by all)
select tv.feed, tv.version, target_version, field, (pos - 1)::int "position", name, last_name target_name,
  concat_ws('; ', case when pos is null then 'default' end, case when name != last_name then 'rename' end, case when rules > 0 then 'cast ' || concat_ws('+', case when rules & 1 > 0 then 'dotted' end,
    case when rules & 2 > 0 then 'hexadecimal' end, case when rules & 4 > 0 then 'prefixed' end, case when rules & 8 > 0 then 'decimal' end, case when rules & 16 > 0 then 'named' end, case when rules & 32 > 0 then 'milliseconds' end) end) rules
from tv join ln using (feed) left join kf using (feed, version, field)""",
    "p4_consistent_table": f"""with {DRIFT_SQL},
cn as (select source_file, list(field order by pos) canon, bool_or(rules & 32 > 0) is_ms from c group by 1),
z as (select line_id, feed, source_file, source_line, fields, canon, is_ms, {', '.join(f'{_WRITTEN(f)} w_{f}' for f in _NAMES)} from w join cn using (source_file) where not bad_ts and not bad_label),
y as (select *, {', '.join(f'{x} as {f}' for f, x in _TABLE.items())} from z)
select line_id, feed, source_file, source_line, {', '.join(_TABLE)}, case when is_ms then 'ms' else 'us' end duration_unit,
  '{{' || array_to_string({_EXTRA}, ',') || '}}' extra, '{{' || concat_ws(',', {_LOST}) || '}}' uncast from y""",
    "p1_found": f"""with {ENDPOINTS_SQL}, t as (select endpoint_role, count(*) n from e group by 1)
select endpoint_role, ip from e join t using (endpoint_role) group by endpoint_role, ip, n having count(*) * 100 >= n""",
    "p1_endpoint_states": f"""with {ENDPOINTS_SQL}, t as (select endpoint_role, count(*) n from e group by 1),
s as (select *, epoch(ts)::bigint - epoch(last_value(ts ignore nulls) over (partition by endpoint_role, ip order by row_id
        rows between unbounded preceding and 1 preceding))::bigint step from e)
select endpoint_role, ip, count(*)::bigint n_rows, min(row_id) first_row, max(row_id) last_row, count(ts)::bigint timed_rows,
       arg_min(ts, row_id) filter (ts is not null) first_time, arg_max(ts, row_id) filter (ts is not null) last_time,
       count(*) filter (step < 0)::bigint backward_steps, max(step) filter (step > 0)::bigint max_forward_gap_s,
       sum(pk)::bigint total, round(count(*) / any_value(n)::double, 6) share
from s join t using (endpoint_role) group by endpoint_role, ip""",
}

QUERIES = {k: v for k, v in globals().items() if k.startswith("p") and callable(v)}
