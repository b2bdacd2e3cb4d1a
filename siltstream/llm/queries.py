"""Queries of the operators for training data, with their SQL."""

from __future__ import annotations

from siltstream.llm import abuse, leakage, overlap, packing, sampling
from siltstream.queries.general import BLANK_SQL, CATEGORY_SQL, TOKEN_SQL
from siltstream.session import table


def p2_found(spark, d):
    return overlap.overlap_pairs(table(spark, d, "flows"), table(spark, d, "cleaning_audit"))


def p2_overlap_report(spark, d):
    return overlap.overlap_report(table(spark, d, "flows"), table(spark, d, "cleaning_audit"))


def _sampling(spark, d):
    return [table(spark, d, t) for t in ("flows", "cleaning_audit", "class_by_file", "sampling_targets")]


def p3_found(spark, d):
    return sampling.unmet_targets(*_sampling(spark, d))


def p3_sample_report(spark, d):
    return sampling.sample_report(*_sampling(spark, d))


def p3_target_report(spark, d):
    """The columns of the report that no draw changes."""
    return sampling.sample_report(*_sampling(spark, d)).select("plan_id", "category_kind", "category", "required", "available", "is_possible", "is_met")


def p3_sample(spark, d):
    return sampling.draw_samples(*_sampling(spark, d))


def p7_found(spark, d):
    return packing.oversized(table(spark, d, "documents"))


def p7_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


def p7_fill_report(spark, d):
    return packing.fill_report(table(spark, d, "documents"))


def p8_found(spark, d):
    return leakage.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_leak_report(spark, d):
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean_documents(spark, d):
    return leakage.clean_documents(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "source", "n_chars")


def p9_found(spark, d):
    return abuse.abusive_documents(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p9_scores(spark, d):
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p9_source_rates(spark, d):
    return abuse.source_rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


_LABEL = CATEGORY_SQL.format("coalesce(label, '')")
POOL_SQL = f"""pool as (select {_LABEL} k from flows f where lower(trim(split)) = 'train' and not exists (select 1 from cleaning_audit a
  where a.source_file = f.source_file and a.source_row = f.source_row)),
g as (select {_LABEL} k, any_value({CATEGORY_SQL.format("class_group")}) grp from class_by_file group by 1),
c as (select 'label' kind, k, count(*) n from pool group by all union all select 'class_group', grp, count(*) from pool join g using (k) group by all),
e as (select count(*) n from pool),
t as (select s.*, coalesce(c.n, 0) have, greatest(min_rows::double, target_share * sample_fraction * e.n) need from sampling_targets s cross join e
  left join c on c.kind = lower(trim(category_kind)) and c.k = {CATEGORY_SQL.format("category")})"""

_NUMBER = "case when regexp_full_match({0}, '[+-]?([0-9]+\\\\.?[0-9]*|\\\\.[0-9]+)(e[+-]?[0-9]+)?') then ({0})::double + 0.0 end".replace("\\\\", "\\")


def _canonical(name):
    if name in ("src_ip", "dst_ip"):
        return f"trim({name}, {BLANK_SQL})"
    if name in ("protocol", "label"):
        return CATEGORY_SQL.format(name)
    if name in ("flow_duration", "flow_byts_s", "flow_pkts_s"):
        return _NUMBER.format(TOKEN_SQL.format(name))
    if name in ("totlen_fwd_pkts", "totlen_bwd_pkts", "flow_iat_mean"):
        return f"case when not isnan({name}) then {name} + 0.0 end"
    return name


# Four blocks of the fields, of which two records that differ in three share one; others than the operator's.
_OTHER_BLOCKS = [
    ["src_ip", "src_port", "tot_fwd_pkts", "flow_pkts_s"],
    ["dst_ip", "dst_port", "flow_duration", "init_fwd_win_byts"],
    ["protocol", "totlen_fwd_pkts", "flow_byts_s", "label"],
    ["tot_bwd_pkts", "totlen_bwd_pkts", "flow_iat_mean"],
]
OVERLAP_SQL = f"""r as (select row_id, source_file, lower(trim(split, {BLANK_SQL})) split, {', '.join(f'{_canonical(f)} {f}' for f in overlap.FIELDS)} from flows f
  where not exists (select 1 from cleaning_audit a where a.source_file = f.source_file and a.source_row = f.source_row)),
t as (select * from r where split = 'train'), e as (select * from r where split in ('validation', 'test')),
c as ({' union '.join(f"select e.row_id e, t.row_id t from e join t on {' and '.join(f'e.{x} = t.{x}' for x in b)}" for b in _OTHER_BLOCKS)}),
p as (select e.row_id e, t.row_id t, e.split, e.source_file, {' + '.join(f'coalesce((e.{x} = t.{x})::int, 0)' for x in overlap.FIELDS)} agree from c join e on e.row_id = c.e join t on t.row_id = c.t),
found as (select * from p where agree >= {overlap.AGREE})"""

SQL = {
    "p2_found": f"with {OVERLAP_SQL} select least(e, t) row_id_a, greatest(e, t) row_id_b from found",
    "p2_overlap_report": f"with {OVERLAP_SQL} select split, source_file, count(*) n_pairs, count(*) filter (agree = 15) n_exact_pairs, count(distinct e) n_eval_records, count(distinct t) n_train_records from found group by all",
    "p3_target_report": f"""with {POOL_SQL} select plan_id::bigint plan_id, lower(trim(category_kind)) category_kind, category, need required, have::bigint available, have >= need is_possible, have >= need is_met from t""",
    "p3_found": f"with {POOL_SQL} select distinct plan_id::bigint plan_id, category from t where have < need",
}

QUERIES = {k: v for k, v in globals().items() if k.startswith("p") and callable(v)}
