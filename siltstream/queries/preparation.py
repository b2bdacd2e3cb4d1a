"""Queries of cleaning, splitting and preprocessing over flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstream.functions.text import category, number, trimmed
from siltstream.operators import cleaning, preprocess, splitting, verify
from siltstream.queries.audit import BASE_SQL, RECORD, base
from siltstream.queries.general import BLANK_SQL, TOKEN_SQL, rounded
from siltstream.session import table

SPEC = splitting.SplitSpec((3, 1, 2), 20, 5)
NUMERIC = ["totlen_fwd_pkts", "totlen_bwd_pkts", "flow_iat_mean", "flow_byts_s"]


def classified(spark, d):
    flows = table(spark, d, "flows")
    return cleaning.classify(flows, trimmed(F.col("label")) == "Label", RECORD, F.col("flow_timestamp"), F.col("file_date"))


def cleaning_events(spark, d):
    return cleaning.audit_events(classified(spark, d), ["label"])


def cleaned_rows(spark, d):
    spec = cleaning.CleaningSpec(["totlen_fwd_pkts", "flow_iat_mean"], ["protocol"], label="label")
    return rounded(cleaning.cleaned(classified(spark, d), spec, F.col("flow_timestamp"), F.col("file_date")))


def quarantined_rows(spark, d):
    spec = cleaning.CleaningSpec(["totlen_fwd_pkts"], ["protocol"], label="label")
    return cleaning.cleaned(classified(spark, d), spec, F.col("flow_timestamp"), F.col("file_date"), quarantine=True)


def stage_counts(spark, d):
    return cleaning.stage_counts(classified(spark, d), "label")


def cleaning_reconciliation(spark, d):
    return cleaning.reconciliation(classified(spark, d))


def account_for_every_row(spark, d):
    rows = classified(spark, d)
    audit = table(spark, d, "cleaning_audit")
    parts = {"clean": rows.where("reason is null"), "quarantine": audit.where("disposition != 'remove'"), "removed": audit.where("disposition = 'remove'")}
    return cleaning.unaccounted(rows, parts, ["source_file", "source_row"])


def _distribution(spark, d):
    rows = base(spark, d).where("status != 'unclassified' and flow_timestamp is not null")
    return rows.groupBy("file_date", F.col("label_key").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def date_split_candidates(spark, d):
    return rounded(splitting.split_candidates(_distribution(spark, d), SPEC))


def chronological_partition(spark, d):
    rows = splitting.elapsed_split(table(spark, d, "events"), "ts", (0.8, 0.9))
    return rounded(splitting.split_summary(rows, "part", "ts", F.col("event_type") == "error", ["event_id"]).drop("digest"))


def partition_coverage(spark, d):
    return rounded(splitting.coverage(base(spark, d).where("status != 'unclassified'"), "split", "label_key"))


def unseen_labels(spark, d):
    return splitting.unseen_labels(base(spark, d), "split", "label_key")


def split_membership(spark, d):
    rows = table(spark, d, "flows")
    part = splitting.part_of(F.col("file_date"), F.lit("2029-06-11").cast("date"), F.lit("2029-06-13").cast("date"))
    return splitting.membership(rows, part, ["source_file", "source_row", "file_date"])


def _train(spark, d):
    rows = base(spark, d).withColumn("flow_byts_s", number(F.col("flow_byts_s"))).withColumn("protocol", trimmed(F.col("protocol")))
    return rows.where("status != 'unclassified'")


def train_fit_stats(spark, d):
    return rounded(preprocess.numeric_fit(_train(spark, d).where("split = 'train'"), NUMERIC), 4)


def mode_and_vocab(spark, d):
    fitted = preprocess.category_fit(_train(spark, d).where("split = 'train'").withColumn("label_text", category(F.col("label"))), ["protocol", "init_fwd_win_byts", "label_text"])
    return fitted.select("column_name", F.concat_ws("|", "levels").alias("levels"), "mode")


def target_encoding_check(spark, d):
    rows = _train(spark, d).withColumns({"copied": F.col("label_key"), "code": (F.col("status") == "malicious").cast("int")})
    return preprocess.target_encodings(rows.where("split = 'train'"), ["copied", "code", "protocol", "init_fwd_win_byts", "flow_iat_mean"], "label_key")


def transform_apply(spark, d):
    rows = _train(spark, d)
    state = preprocess.fit(rows.where("split = 'train'"), [*NUMERIC, "protocol"], ["protocol"], "label_key")
    return rounded(state.transform(rows, ["row_id"]), 4)


def imputation_counts(spark, d):
    rows = _train(spark, d)
    state = preprocess.fit(rows.where("split = 'train'"), [*NUMERIC, "protocol"], ["protocol"], "label_key")
    return preprocess.imputation_counts(rows, "split", state)


def elapsed_candidates(spark, d):
    return splitting.elapsed_candidates(table(spark, d, "events"), "ts", F.col("event_type") == "error", [(0.8, 0.9), (0.7, 0.85), (0.6, 0.8)])


def duplicate_links(spark, d):
    """Planted: some duplicates name themselves, or a row that was removed, as the one retained."""
    rows = classified(spark, d)
    kept = F.when(F.col("source_row") % 3 == 0, F.col("source_row")).when(F.col("source_row") % 3 == 1, F.col("retained_source_row") - 1).otherwise(F.col("retained_source_row"))
    events = cleaning.audit_events(rows, []).withColumn("retained_source_row", kept)
    return verify.duplicate_links(events, rows.where("reason is null or reason not in ('repeated_header', 'exact_duplicate')"))


def cleaned_rule_violations(spark, d):
    """Planted: some dates, times and targets are changed before the check."""
    spec = cleaning.CleaningSpec([], ["protocol"], label="label")
    clean = cleaning.cleaned(classified(spark, d), spec, F.col("flow_timestamp"), F.col("file_date"))
    row = F.col("source_row")
    wrong = clean.withColumns({"file_date": F.when(row % 90 == 0, F.date_add("file_date", 1)).otherwise(F.col("file_date")), "timestamp": F.when(row % 120 != 1, F.col("timestamp")), "target_binary": F.when(row % 150 == 2, (1 - F.col("target_binary")).cast("tinyint")).otherwise(F.col("target_binary"))})
    return verify.cleaned_rules(wrong)


QUERIES = {f.__name__: f for f in (cleaning_events, cleaned_rows, quarantined_rows, stage_counts, cleaning_reconciliation, account_for_every_row, date_split_candidates, chronological_partition, partition_coverage, unseen_labels, split_membership, train_fit_stats, mode_and_vocab, target_encoding_check, transform_apply, imputation_counts, elapsed_candidates, duplicate_links, cleaned_rule_violations)}

_REC = ", ".join(RECORD)
CLASSIFIED_SQL = f"""h as (select *, coalesce(trim(label, {BLANK_SQL}) = 'Label', false) is_header from flows),
d as (select source_file sf, source_row sr, min(source_row) over (partition by source_file, {_REC}) first_row from h where not is_header),
c as (select h.*, case when first_row < source_row then first_row end retained_source_row,
  case when is_header then 'repeated_header' when first_row < source_row then 'exact_duplicate' when flow_timestamp is null then 'invalid_timestamp' when year(flow_timestamp) = 1970 then 'year_1970' when flow_timestamp::date != file_date then 'date_mismatch' end reason
  from h left join d on sf = source_file and sr = source_row)"""
_QUARANTINE = "reason in ('invalid_timestamp', 'year_1970', 'date_mismatch')"
_DAYS = """x as (select file_date, label_key label, count(*) n from b where status != 'unclassified' and flow_timestamp is not null group by all),
t as (select file_date, sum(n) n, sum(n) filter (label = 'benign') b from x group by 1), o as (select *, row_number() over (order by file_date) i, sum(n) over (order by file_date) cn, sum(b) over (order by file_date) cb, sum(n) over () an, sum(b) over () ab, count(*) over () ndays, lead(file_date) over (order by file_date) nxt from t),
f as (select label, min(file_date) fd from x where label != 'benign' group by 1), k as (select i, (select count(*) from f where fd <= file_date) classes from o),
p as (select a.file_date train_end, a.nxt validation_start, z.file_date validation_end, z.nxt test_start, classes training_attack_classes,
  round(abs(a.cn / a.an::double - 0.8) + abs((z.cn - a.cn) / a.an::double - 0.1) + abs((a.an - z.cn) / a.an::double - 0.1), 12) fraction_absolute_error,
  a.cn train_rows, z.cn - a.cn validation_rows, a.an - z.cn test_rows, a.cb train_benign, z.cb - a.cb validation_benign, a.ab - z.cb test_benign, a.i i1, z.i - a.i i2, a.ndays - z.i i3 from o a join o z on a.i < z.i join k on k.i = a.i)"""
_TOKB = TOKEN_SQL.format("flow_byts_s")
_BYTS = f"case when regexp_full_match({_TOKB}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') then ({_TOKB})::double end"
_TRAIN = f"r as (select * replace ({_BYTS} as flow_byts_s, trim(protocol, {BLANK_SQL}) as protocol) from b where status != 'unclassified')"
_FIT = f"s as ({' union all '.join(f'''select '{c}' column_name, count({c}) observed, coalesce(avg({c}), 0.0) mean, coalesce(stddev_pop(coalesce({c}, (select avg({c}) from r where split = 'train'))), 0.0) sd from r where split = 'train' ''' for c in NUMERIC)})"

SQL = {
    "elapsed_candidates": " union all ".join(
        f"""select {a}::double train_share, {z}::double validation_end, part, count(*) n, count(*) filter (event_type = 'error') malicious from (select event_type, case when ts < f then 0 when ts < s then 1 else 2 end part
  from events cross join (select make_timestamp((floor((a + (b - a) * {a}::double) / 600000000 + 0.5) * 600000000)::bigint) f, make_timestamp((floor((a + (b - a) * {z}::double) / 600000000 + 0.5) * 600000000)::bigint) s
  from (select epoch_us(min(ts)) a, epoch_us(max(ts)) b from events))) group by part"""
        for a, z in ((0.8, 0.9), (0.7, 0.85), (0.6, 0.8))
    ),
    "duplicate_links": f"""with {CLASSIFIED_SQL}, l as (select source_file, source_row, case source_row % 3 when 0 then source_row when 1 then retained_source_row - 1 else retained_source_row end kept from c where reason = 'exact_duplicate')
select source_file, source_row, kept retained_source_row from l where kept >= source_row or not exists (select 1 from c k where k.source_file = l.source_file and k.source_row = l.kept and (k.reason is null or k.reason not in ('repeated_header', 'exact_duplicate')))""",
    "cleaned_rule_violations": f"""with {CLASSIFIED_SQL}, k as (select source_file, source_row, label, (case when source_row % 90 = 0 then file_date + 1 else file_date end)::date fd, case when source_row % 120 != 1 then flow_timestamp end ts,
  case when source_row % 150 = 2 then 1 - (coalesce(label, '') != 'Benign')::int else (coalesce(label, '') != 'Benign')::int end y from c where reason is null)
select source_file, source_row, 'target' AS "rule" from k where y != (coalesce(label, '') != 'Benign')::int union all select source_file, source_row, 'time' from k where ts is null or year(ts) = 1970 union all select source_file, source_row, 'date' from k where ts::date is distinct from fd""",
    "cleaning_events": f"with {CLASSIFIED_SQL} select source_file, source_row, label, reason, case when {_QUARANTINE} then 'retain_in_non_temporal_quarantine' else 'remove' end disposition, retained_source_row from c where reason is not null",
    "cleaned_rows": f"with {CLASSIFIED_SQL} select round(totlen_fwd_pkts, 6) totlen_fwd_pkts, round(flow_iat_mean, 6) flow_iat_mean, protocol, source_file, source_row, flow_timestamp \"timestamp\", file_date, label attack_label, (coalesce(label, '') != 'Benign')::tinyint target_binary from c where reason is null",
    "quarantined_rows": f"with {CLASSIFIED_SQL} select totlen_fwd_pkts, protocol, source_file, source_row, flow_timestamp \"timestamp\", file_date, label attack_label, (coalesce(label, '') != 'Benign')::tinyint target_binary from c where {_QUARANTINE}",
    "stage_counts": f"""with {CLASSIFIED_SQL} select source_file, label, 'raw' stage, count(*) n from c group by all union all select source_file, label, 'deduplicated', count(*) from c where reason is null or {_QUARANTINE} group by all
union all select source_file, label, 'eligible', count(*) from c where reason is null group by all""",
    "cleaning_reconciliation": f"""with {CLASSIFIED_SQL} select source_file, count(*) raw_rows, count(*) filter (reason = 'repeated_header') headers, count(*) filter (reason = 'exact_duplicate') duplicates, count(*) filter ({_QUARANTINE}) quarantined,
  count(*) filter (reason is null) eligible_rows, true adds_up from c group by 1""",
    "account_for_every_row": f"""with {CLASSIFIED_SQL}, p as (select source_file, source_row, '' part from c union all select source_file, source_row, 'clean' from c where reason is null
  union all select source_file, source_row, case when disposition = 'remove' then 'removed' else 'quarantine' end from cleaning_audit)
select source_file, source_row, count(*) filter (part != '') n, coalesce(string_agg(distinct part, ',' order by part) filter (part != ''), '') parts from p group by all having count(*) filter (part = '') != 1 or count(*) filter (part != '') != 1""",
    "date_split_candidates": f"""with {BASE_SQL}, {_DAYS} select train_end, validation_start, validation_end, test_start, training_attack_classes, round(fraction_absolute_error, 6) fraction_absolute_error, train_rows::bigint train_rows, validation_rows::bigint validation_rows, test_rows::bigint test_rows,
  train_benign::bigint train_benign, validation_benign::bigint validation_benign, test_benign::bigint test_benign, (row_number() over (order by training_attack_classes desc, p.fraction_absolute_error, train_end, validation_end))::int "rank" from p
where i1 >= 3 and i2 >= 1 and i3 >= 2 and least(train_benign, validation_benign, test_benign) >= 20 and least(train_rows - train_benign, validation_rows - validation_benign, test_rows - test_benign) >= 5""",
    "chronological_partition": """with e as (select epoch_us(min(ts)) a, epoch_us(max(ts)) b from events), c as (select make_timestamp((floor((a + (b - a) * 0.8::double) / 600000000 + 0.5) * 600000000)::bigint) f, make_timestamp((floor((a + (b - a) * 0.9::double) / 600000000 + 0.5) * 600000000)::bigint) s from e),
p as (select *, case when ts < f then 0 when ts < s then 1 else 2 end part from events cross join c)
select part, count(*) n, count(*) filter (event_type != 'error') benign, count(*) filter (event_type = 'error') malicious, min(ts) first_time, max(ts) last_time, round(count(*) / sum(count(*)) over ()::double, 6) fraction from p group by part""",
    "partition_coverage": f"""with {BASE_SQL}, r as (select * from b where status != 'unclassified'), c as (select split, label_key, count(*) n from r group by all)
select p.split, l.label_key, coalesce(c.n, 0) n, c.n is not null present, l.label_key in (select label_key from c where split = 'train') seen_in_training, round(coalesce(c.n, 0) / (select count(*) from r where r.split = p.split)::double, 6) fraction
from (select distinct split from c) p cross join (select distinct label_key from c) l left join c on c.split = p.split and c.label_key = l.label_key""",
    "unseen_labels": f"with {BASE_SQL} select distinct split, label_key from b where split != 'train' and not exists (select 1 from b t where t.split = 'train' and t.label_key = b.label_key)",
    "split_membership": "select source_file, source_row, file_date, case when file_date <= date '2029-06-11' then 'train' when file_date <= date '2029-06-13' then 'validation' else 'test' end part from flows",
    "train_fit_stats": f"with {BASE_SQL}, {_TRAIN}, {_FIT} select column_name, observed, round(mean, 4) mean, round(sd, 4) sd, round(case when sd = 0 then 1 else sd end, 4) \"scale\" from s",
    "mode_and_vocab": f"""with {BASE_SQL}, {_TRAIN}, v as (select 'protocol' column_name, protocol v from r where split = 'train' union all select 'init_fwd_win_byts', init_fwd_win_byts::varchar from r where split = 'train' union all select 'label_text', label_key from r where split = 'train'),
c as (select column_name, v, count(*) n from v where v is not null group by all) select column_name, string_agg(v, '|' order by v) levels, arg_max(v, n) "mode" from c group by 1""",
    "target_encoding_check": "select * from (values ('copied', 'one_to_one_attack_class_encoding'), ('code', 'one_to_one_binary_target_encoding')) t(column_name, reason)",
    "transform_apply": f"""with {BASE_SQL}, {_TRAIN}, {_FIT}, w as (select {', '.join(f"any_value(mean) filter (column_name = '{c}') m_{c}, any_value(case when sd = 0 then 1 else sd end) filter (column_name = '{c}') s_{c}" for c in NUMERIC)} from s),
q as (select protocol from r where split = 'train' and protocol is not null group by 1 order by count(*) desc, protocol limit 1)
select row_id, {', '.join(f'round((coalesce({c}, m_{c}) - m_{c}) / s_{c}, 4) {c}' for c in NUMERIC)}, {', '.join(f'''(coalesce(protocol, (select protocol from q)) = '{p}')::int::double "protocol={p}"''' for p in ('0', '17', '6'))} from r cross join w""",
    "imputation_counts": f"""with {BASE_SQL}, {_TRAIN} select split, count(*) n, sum({' + '.join(f'({c} is null)::int' for c in NUMERIC)})::bigint imputed_cells,
  count(*) filter (protocol is not null and protocol not in (select protocol from r where split = 'train' and protocol is not null)) unknown_protocol from r group by 1""",
}
