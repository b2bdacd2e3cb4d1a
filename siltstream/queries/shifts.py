"""Queries of the drift and fusion operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstream.functions.text import number
from siltstream.operators import drift, evaluate, fusion
from siltstream.queries.general import TOKEN_SQL, rounded
from siltstream.queries.scores import SCORED_SQL, _confusion, rates_sql, scored
from siltstream.session import table

FEATURES = ["flow_iat_mean", "totlen_fwd_pkts", "totlen_bwd_pkts", "tot_fwd_pkts", "init_fwd_win_byts", "flow_byts_s"]


def _values(spark, d):
    flows = table(spark, d, "flows").withColumn("flow_byts_s", number(F.col("flow_byts_s"))).withColumn("split", F.lower(F.trim("split")))
    return drift.unpivoted(flows, ["split"], FEATURES)


def feature_summary(spark, d):
    return rounded(drift.feature_summary(_values(spark, d), ["split", "feature"]))


def feature_shift(spark, d):
    return rounded(drift.shift(_values(spark, d), "split", "train", ["validation", "test"]))


def topk_shift(spark, d):
    return rounded(drift.top_shifts(drift.shift(_values(spark, d), "split", "train", ["validation", "test"]), "split", 3))


def nearest_reference(spark, d):
    return rounded(drift.nearest_reference(_values(spark, d), "split", "test", ["train", "validation"]))


def lineitem_shift(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    values = drift.unpivoted(rows, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(drift.shift(values, "l_returnflag", "N", ["A", "R"]))


def family_score_shift(spark, d):
    s = scored(spark, d).where("split != 'train'").select("split", F.col("family").alias("feature"), F.col("ae").alias("value"))
    return rounded(drift.ks_distance(s, ["feature"], F.col("split") == "validation"))


def _normalised(spark, d):
    s = scored(spark, d)
    a = fusion.ecdf(s, "ae", (F.col("split") == "validation") & (F.col("y") == 0), "ae_n")
    return fusion.ecdf(a, "rf", (F.col("split") == "validation") & (F.col("y") == 0), "rf_n")


def ecdf_percentile(spark, d):
    return rounded(_normalised(spark, d).select("row_id", "ae_n", "rf_n"))


def fusion_scores(spark, d):
    return rounded(fusion.fused(_normalised(spark, d), "rf_n", "ae_n").select("row_id", "maximum", "weighted_25", "weighted_50", "weighted_75"))


def fusion_or_decision(spark, d):
    s = scored(spark, d).withColumn("hit", fusion.either(F.col("rf"), F.lit(0.6), F.col("ae"), F.lit(60000.0)).cast("double"))
    return rounded(evaluate.confusion(s, ["split"], "y", "hit", F.lit(0.5)))


def fusion_compared(spark, d):
    s = scored(spark, d).withColumn("hit", fusion.either(F.col("rf"), F.lit(0.6), F.col("ae"), F.lit(60000.0)).cast("double"))
    one = evaluate.confusion(s, ["split"], "y", "hit", F.lit(0.5)).withColumn("model", F.lit("or"))
    both = one.unionByName(evaluate.confusion(s, ["split"], "y", "rf", F.lit(0.6)).withColumn("model", F.lit("rf")))
    return rounded(fusion.compared_to(both.select("split", "model", "f1", "recall", "false_positive_rate"), ["split"], "model", "rf", ["f1", "recall"]))


def detector_overlap(spark, d):
    return rounded(fusion.overlap(scored(spark, d), ["split", "family"], F.col("rf") >= 0.6, F.col("ae") >= 60000))


def detector_correlation(spark, d):
    return rounded(fusion.correlations(scored(spark, d), ["split"], "rf", "ae"))


QUERIES = {f.__name__: f for f in (feature_summary, feature_shift, topk_shift, nearest_reference, lineitem_shift, family_score_shift, ecdf_percentile, fusion_scores, fusion_or_decision, fusion_compared, detector_overlap, detector_correlation)}

_T = TOKEN_SQL.format("flow_byts_s")
_B = f"case when regexp_full_match({_T}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') then ({_T})::double end"
_UNPIVOT = " union all ".join(f"select lower(trim(split)) part, '{c}' feature, {_B if c == 'flow_byts_s' else f'{c}::double'} v from flows" for c in FEATURES)


def shift_sql(others):
    """KS and PSI of v (part, feature, v) for the other parts against the part 'ref'."""
    return f"""k as (select * from (select distinct feature from v) cross join (values {', '.join(f"('{o}')" for o in others)}) o(part)),
x as (select k.feature, k.part, v.v, (v.part = 'ref')::int a from k join v on v.feature = k.feature and v.part in ('ref', k.part)),
c as (select feature, part, v, sum(a) a, sum(1 - a) b from x where v is not null group by all),
u as (select feature, part, sum(a) over o / sum(a) over (partition by feature, part)::double - sum(b) over o / sum(b) over (partition by feature, part)::double gap from c window o as (partition by feature, part order by v)),
ks as (select feature, part, max(abs(gap)) ks from u group by all),
e as (select feature, part, min(v) lo, max(v) hi, list_distinct(quantile_cont(v, [{', '.join(str(q) for q in drift.DECILES)}])) edges from x where a = 1 group by all),
n as (select x.*, case when v is null then -1 when lo = hi then (case when v < lo then 0 when v = lo then 1 else 2 end) else len(list_filter(edges, lambda q: q <= v)) end bin from x join e using (feature, part)),
m as (select feature, part, unnest(range(-1, case when lo = hi then 3 else len(edges) + 1 end)) bin from e),
t as (select feature, part, count(*) filter (a = 1) na, count(*) filter (a = 0) nb from x group by all),
q as (select m.feature, m.part, m.bin, count(*) filter (a = 1) ca, count(*) filter (a = 0) cb from m left join n using (feature, part, bin) group by all),
h as (select q.*, greatest(ca / na::double, 1e-6) pa, greatest(cb / nb::double, 1e-6) pb from q join t using (feature, part)),
g as (select feature, part, pa / sum(pa) over (partition by feature, part) pa, pb / sum(pb) over (partition by feature, part) pb from h),
ps as (select feature, part, sum((pb - pa) * ln(pb / pa)) psi from g group by all),
shift as (select feature, part, ks, psi from ks full join ps using (feature, part))"""


_FLOWV = f"v as (select case when part = 'train' then 'ref' else part end part, feature, v from ({_UNPIVOT}))"
_NORM = """n as (select row_id, (select count(*) from s r where r.split = 'validation' and r.y = 0 and r.ae <= s.ae) / (select count(*) from s where split = 'validation' and y = 0)::double ae_n,
  (select count(*) from s r where r.split = 'validation' and r.y = 0 and r.rf <= s.rf) / (select count(*) from s where split = 'validation' and y = 0)::double rf_n from s)"""
_OR = "s2 as (select *, (rf >= 0.6 or ae >= 60000)::int::double hit from s)"
_QS = ", ".join(f"round(quantile_cont(v, {q}), 6) {n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"), (0.99, "p99")))

SQL = {
    "feature_summary": f"with v as ({_UNPIVOT}) select part split, feature, count(*) n, count(v) observed, round(1 - count(v) / count(*)::double, 6) missing_rate, round(avg(v), 6) mean, round(stddev_pop(v), 6) sd, {_QS} from v group by all",
    "feature_shift": f"with {_FLOWV}, {shift_sql(['validation', 'test'])} select feature, part split, round(ks, 6) ks, round(psi, 6) psi from shift",
    "topk_shift": f"with {_FLOWV}, {shift_sql(['validation', 'test'])} select feature, part split, round(ks, 6) ks, round(psi, 6) psi, (row_number() over (partition by part order by coalesce(ks, 0) desc, psi desc, feature))::int \"rank\" from shift qualify \"rank\" <= 3",
    "nearest_reference": f"""with r as ({_UNPIVOT}), p as (select f.feature, o.part, v.v, (v.part = o.part)::int a from (select distinct feature from r) f cross join (values ('train'), ('validation')) o(part) join r v on v.feature = f.feature and v.part in ('test', o.part) where v.v is not null),
c as (select feature, part, v, sum(a) a, sum(1 - a) b from p group by all), u as (select feature, part, sum(a) over o / sum(a) over (partition by feature, part)::double - sum(b) over o / sum(b) over (partition by feature, part)::double gap from c window o as (partition by feature, part order by v)),
k as (select feature, max(abs(gap)) filter (part = 'train') a, max(abs(gap)) filter (part = 'validation') b from u group by 1)
select feature, round(a, 6) ks_train, round(b, 6) ks_validation, round(least(a, b), 6) least, (row_number() over (order by least(a, b) desc, feature))::int "rank" from k""",
    "lineitem_shift": f"""with v as ({' union all '.join(f"select case when l_returnflag = 'N' then 'ref' else l_returnflag end part, '{c}' feature, {c} v from lineitem" for c in ('l_quantity', 'l_extendedprice', 'l_discount'))}), {shift_sql(['A', 'R'])}
select feature, part l_returnflag, round(ks, 6) ks, round(psi, 6) psi from shift""",
    "family_score_shift": f"""with {SCORED_SQL}, c as (select family, ae v, count(*) filter (split = 'validation') a, count(*) filter (split = 'test') b from s where split != 'train' group by all),
u as (select family, sum(a) over (partition by family) na, sum(b) over (partition by family) nb, sum(a) over (partition by family order by v) ca, sum(b) over (partition by family order by v) cb from c)
select family feature, na::bigint n_reference, nb::bigint n_other, round(max(case when na > 0 and nb > 0 then abs(ca / na::double - cb / nb::double) end), 6) ks from u group by all""",
    "ecdf_percentile": f"with {SCORED_SQL}, {_NORM} select row_id, round(ae_n, 6) ae_n, round(rf_n, 6) rf_n from n",
    "fusion_scores": f"with {SCORED_SQL}, {_NORM} select row_id, round(greatest(rf_n, ae_n), 6) maximum, round(0.25::double * rf_n + 0.75::double * ae_n, 6) weighted_25, round(0.5::double * rf_n + 0.5::double * ae_n, 6) weighted_50, round(0.75::double * rf_n + 0.25::double * ae_n, 6) weighted_75 from n",
    "fusion_or_decision": f"with {SCORED_SQL}, {_OR}, c as ({_confusion('hit', 0.5, 'split').replace('from s ', 'from s2 ')}) select *, {rates_sql()} from c",
    "fusion_compared": f"""with {SCORED_SQL}, {_OR}, c as (select 'or' model, x.* from ({_confusion('hit', 0.5, 'split').replace('from s ', 'from s2 ')}) x union all select 'rf', y.* from ({_confusion('rf', 0.6, 'split')}) y),
m as (select split, model, {rates_sql(18)} from c) select a.split, a.model, round(a.f1, 6) f1, round(a.recall, 6) recall, round(a.false_positive_rate, 6) false_positive_rate, round(a.f1 - b.f1, 6) f1_delta, round(a.recall - b.recall, 6) recall_delta from m a join m b on a.split = b.split and b.model = 'rf'""",
    "detector_overlap": f"""with {SCORED_SQL}, c as (select split, family, count(*) n, count(*) filter (rf >= 0.6 and ae >= 60000) "both", count(*) filter (rf >= 0.6 and ae < 60000) only_a, count(*) filter (rf < 0.6 and ae >= 60000) only_b, count(*) filter (rf < 0.6 and ae < 60000) neither from s group by all)
select *, case when "both" + only_a + only_b > 0 then round("both" / ("both" + only_a + only_b)::double, 6) end jaccard from c""",
    "detector_correlation": f"""with {SCORED_SQL}, r as (select split, rf, ae, rank() over (partition by split order by rf) + (count(*) over (partition by split, rf) - 1) / 2.0 ra, rank() over (partition by split order by ae) + (count(*) over (partition by split, ae) - 1) / 2.0 rb from s)
select split, count(*) n, round(corr(rf, ae), 6) pearson, round(corr(ra, rb), 6) spearman from r group by 1""",
}
