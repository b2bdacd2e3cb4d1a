"""Queries of the score operators over flows, with their SQL.

The driver's tables hold no detector scores; two simple ones stand in: rf, in [0, 1) and with many ties, and ae,
unbounded. Unclassified records are left out, as in evaluation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstream.operators import evaluate
from siltstream.queries.audit import BASE_SQL, base
from siltstream.queries.general import rounded


def scored(spark, d):
    """(row_id, split, family, y, rf, ae, second) of the classified flows."""
    rows = base(spark, d).where("status != 'unclassified'")
    rf = F.round(F.col("tot_bwd_pkts") / (F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts") + 1.0), 3)
    return rows.select("row_id", F.lower(F.trim("split")).alias("split"), F.col("label_key").alias("family"), (F.col("status") == "malicious").cast("int").alias("y"), F.coalesce(rf, F.lit(0.0)).alias("rf"), F.coalesce(F.round("flow_iat_mean", 0), F.lit(0.0)).alias("ae"))


def confusion_metrics(spark, d):
    return rounded(evaluate.confusion(scored(spark, d), ["split"], "y", "rf", F.lit(0.5)))


def threshold_sweep(spark, d):
    return rounded(evaluate.threshold_sweep(scored(spark, d).where("split = 'validation'"), [], "y", "rf").drop("threshold"))


def select_thresholds(spark, d):
    return evaluate.select_thresholds(scored(spark, d), ["split"], "y", "ae")


def ranking_metrics(spark, d):
    return rounded(evaluate.ranking(scored(spark, d), ["split"], "y", "ae"))


def roc_pr_points(spark, d):
    return rounded(evaluate.curve_points(scored(spark, d), ["split"], "y", "rf"))


def threshold_grid(spark, d):
    return rounded(evaluate.threshold_grid(scored(spark, d), ["split"], "y", "rf"))


def benign_thresholds(spark, d):
    return rounded(evaluate.benign_thresholds(scored(spark, d).where("y = 0"), ["split"], "ae"))


def family_recall(spark, d):
    s = scored(spark, d)
    train = s.where("split = 'train'").select("family")
    return rounded(evaluate.family_recall(s.where("split != 'train'"), ["split"], "family", "rf", F.lit(0.5), train, s))


def family_recall_pivot(spark, d):
    return evaluate.family_pivot(family_recall(spark, d), ["split"], "family", ["beacon bot", "port sweep"])


def family_ranking(spark, d):
    return rounded(evaluate.family_ranking(scored(spark, d), ["split"], "family", "ae"))


def calibration_bins(spark, d):
    return rounded(evaluate.calibration_bins(scored(spark, d), ["split"], "y", "rf"))


def calibration(spark, d):
    return rounded(evaluate.calibration(scored(spark, d), ["split"], "y", "rf"))


def score_summary(spark, d):
    return rounded(evaluate.score_summary(scored(spark, d), ["split", "family"], "rf"))


def _runs(spark, d):
    """Metrics of two detectors on five folds of the rows, which stand in for seeds."""
    s = scored(spark, d).withColumn("seed", F.pmod("row_id", F.lit(5)))
    a = evaluate.confusion(s, ["split", "seed"], "y", "rf", F.lit(0.5)).withColumn("model", F.lit("rf"))
    b = evaluate.confusion(s, ["split", "seed"], "y", "ae", F.lit(30000.0)).withColumn("model", F.lit("ae"))
    return a.unionByName(b)


def seed_mean_sd(spark, d):
    return rounded(evaluate.seed_summary(_runs(spark, d), ["model", "split"], "seed", ["f1", "recall"]))


def paired_difference(spark, d):
    return rounded(evaluate.paired_difference(_runs(spark, d), ["split", "seed"], "model", "rf", "ae", ["f1", "recall", "false_positive_rate"]))


def class_weights(spark, d):
    return rounded(evaluate.class_weights(scored(spark, d), "y"))


def cost_summary(spark, d):
    runs = _runs(spark, d).withColumn("cost", F.col("fp") + 10 * F.col("fn"))
    return rounded(evaluate.cost_summary(runs.where("split = 'test'"), "seed", "model", ["cost", "f1"]))


QUERIES = {f.__name__: f for f in (confusion_metrics, threshold_sweep, select_thresholds, ranking_metrics, roc_pr_points, threshold_grid, benign_thresholds, family_recall, family_recall_pivot, family_ranking, calibration_bins, calibration, score_summary, seed_mean_sd, paired_difference, class_weights, cost_summary)}

SCORED_SQL = f"""{BASE_SQL}, s as (select row_id, lower(trim(split)) split, label_key family, (status = 'malicious')::int y,
  coalesce(round(tot_bwd_pkts / (tot_fwd_pkts + tot_bwd_pkts + 1.0)::double, 3), 0) rf, coalesce(round(flow_iat_mean, 0), 0) ae from b where status != 'unclassified')"""


def _div(a, b):
    return f"case when ({b}) = 0 then 0.0 else ({a}) / ({b})::double end"


def rates_sql(places=6):
    f1, benign = _div("2 * tp", "2 * tp + fp + fn"), _div("2 * tn", "2 * tn + fp + fn")
    made = {"accuracy": _div("tp + tn", "tp + fp + fn + tn"), "precision": _div("tp", "tp + fp"), "recall": _div("tp", "tp + fn"), "specificity": _div("tn", "tn + fp"), "f1": f1, "macro_f1": f"(({f1}) + ({benign})) / 2", "false_positive_rate": _div("fp", "fp + tn"), "false_negative_rate": _div("fn", "fn + tp")}
    return ", ".join(f'round({v}, {places}) "{k}"' for k, v in made.items())


def _confusion(score, threshold, keys):
    return f"""select {keys}, count(*) n, count(*) filter (y = 1 and {score} >= {threshold}) tp, count(*) filter (y = 0 and {score} >= {threshold}) fp,
  count(*) filter (y = 1 and {score} < {threshold}) fn, count(*) filter (y = 0 and {score} < {threshold}) tn from s group by {keys}"""


def _sweep(score, where="true"):
    return f"""g as (select split, {score} threshold, sum(y)::bigint pos, sum(1 - y)::bigint neg from s where {where} group by all),
w as (select *, sum(pos) over (partition by split order by threshold desc)::bigint tp, sum(neg) over (partition by split order by threshold desc)::bigint fp,
  sum(pos) over (partition by split)::bigint n_pos, sum(neg) over (partition by split)::bigint n_neg from g)"""


_RUNS = f"""r as (select 'rf' model, x.* from ({_confusion('rf', 0.5, 'split, row_id % 5')}) x union all select 'ae', y.* from ({_confusion('ae', 30000.0, 'split, row_id % 5')}) y),
m as (select model, split, "(row_id % 5)" seed, fp + 10 * fn AS cost, {_div('2 * tp', '2 * tp + fp + fn')} f1, {_div('tp', 'tp + fn')} recall, {_div('fp', 'fp + tn')} false_positive_rate from r)"""
_FAMILY = """k as (select distinct family from s where split = 'train'), e as (select distinct family from s where family != 'benign'),
h as (select split, family, count(*) n, count(*) filter (rf >= 0.5) hits from s where split != 'train' group by all),
f as (select p.split, e.family, case when k.family is null then 'UNSEEN' else 'KNOWN' end status, coalesce(n, 0) n, coalesce(hits, 0) hits, coalesce(n, 0) - coalesce(hits, 0) missed, round(hits / n::double, 6) recall
  from (select distinct split from s where split != 'train') p cross join e left join h on h.split = p.split and h.family = e.family left join k on k.family = e.family)"""

SQL = {
    "confusion_metrics": f"with {SCORED_SQL}, c as ({_confusion('rf', 0.5, 'split')}) select *, {rates_sql()} from c",
    "threshold_sweep": f"""with {SCORED_SQL}, {_sweep('rf', "split = 'validation'")},
c as (select pos, neg, tp, fp, n_pos, n_neg, false all_negative, n_pos - tp fn, n_neg - fp tn from w union all (select 0, 0, 0, 0, n_pos, n_neg, true, n_pos, n_neg from w limit 1)) select *, {rates_sql()} from c""",
    "select_thresholds": f"""with {SCORED_SQL}, {_sweep('ae')}, p as (select split, threshold, tp, fp, n_pos, n_neg from w union all select split, nextafter(max(threshold), 'inf'::double), 0, 0, any_value(n_pos), any_value(n_neg) from w group by split),
c as (select *, n_pos - tp fn, n_neg - fp tn from p), x as (select *, {rates_sql(18)} from c),
u as (select *, 'maximum_binary_f1' criterion, f1 v from x union all select *, 'maximum_macro_f1', macro_f1 from x
  union all select *, 'fpr_at_most_0.01', tp from x where false_positive_rate <= 0.01 union all select *, 'fpr_at_most_0.005', tp from x where false_positive_rate <= 0.005 union all select *, 'fpr_at_most_0.001', tp from x where false_positive_rate <= 0.001)
select split, criterion, threshold, tp, fp, fn, tn from u qualify row_number() over (partition by split, criterion order by v desc, threshold desc) = 1""",
    "ranking_metrics": f"""with {SCORED_SQL}, {_sweep('ae')}
select split, n_pos, n_neg, round(sum(pos / n_pos::double * (n_neg - fp + neg / 2.0) / n_neg), 6) roc_auc, round(sum(pos / n_pos::double * tp / (tp + fp)), 6) average_precision,
  round(sum(pos / n_pos::double * (tp / (tp + fp)::double + case when tp - pos + fp - neg = 0 then 1.0 else (tp - pos) / (tp - pos + fp - neg)::double end) / 2), 6) pr_auc from w group by all""",
    "roc_pr_points": f"with {SCORED_SQL}, {_sweep('rf')} select split, threshold, round(tp / n_pos::double, 6) tpr, round(fp / n_neg::double, 6) fpr, round(tp / (tp + fp)::double, 6) \"precision\" from w",
    "threshold_grid": f"""with {SCORED_SQL}, t as (select k / 200.0::double threshold from range(201) r(k)), c as (select split, threshold, count(*) filter (y = 1 and rf >= threshold) tp, count(*) filter (y = 0 and rf >= threshold) fp,
  count(*) filter (y = 1) p, count(*) filter (y = 0) n from s cross join t group by all)
select split, round(threshold, 6) threshold, round({_div('tp', 'p')}, 6) recall, round({_div('fp', 'n')}, 6) false_positive_rate, round({_div('tp', 'tp + fp')}, 6) "precision" from c""",
    "benign_thresholds": f"""with {SCORED_SQL}, o as (select split, ae, row_number() over (partition by split order by ae desc) r, count(*) over (partition by split) n from s where y = 0),
t as (select split, cap, n, floor(cap * n)::bigint allowed, ae from o cross join (values (0.05::double), (0.01), (0.005), (0.001)) c(cap) where r = floor(cap * n)::bigint + 1)
select t.split, cap::double cap, t.n, allowed, count(*) filter (s.ae > t.ae) observed, round(nextafter(t.ae, 'inf'::double), 6) threshold from t join s on s.split = t.split and s.y = 0 group by t.split, cap, t.n, allowed, t.ae""",
    "family_recall": f"with {SCORED_SQL}, {_FAMILY} select * from f",
    "family_recall_pivot": f"with {SCORED_SQL}, {_FAMILY} select split, any_value(recall) filter (family = 'beacon bot') \"beacon bot\", any_value(recall) filter (family = 'port sweep') \"port sweep\" from f group by split",
    "family_ranking": f"""with {SCORED_SQL}, e as (select distinct split, family from s where family != 'benign'),
x as (select e.split, e.family, s.ae threshold, s.y from e join s on s.split = e.split and s.family in (e.family, 'benign')),
g as (select split, family, threshold, sum(y)::bigint pos, sum(1 - y)::bigint neg from x group by all),
w as (select *, sum(pos) over o::bigint tp, sum(neg) over o::bigint fp, sum(pos) over (partition by split, family)::bigint n_pos, sum(neg) over (partition by split, family)::bigint n_neg from g window o as (partition by split, family order by threshold desc))
select split, family, n_pos, n_neg, round(sum(pos / n_pos::double * (n_neg - fp + neg / 2.0) / n_neg), 6) roc_auc, round(sum(pos / n_pos::double * tp / (tp + fp)), 6) average_precision from w group by all""",
    "calibration_bins": f"with {SCORED_SQL} select split, least(floor(rf * 20), 19)::bigint bin, count(*) n, round(avg(rf), 6) mean_score, round(avg(y::double), 6) observed from s group by 1, 2",
    "calibration": f"""with {SCORED_SQL}, c as (select split, least(floor(rf * 20), 19) bin, count(*) n, avg(rf) m, avg(y) o from s group by 1, 2), e as (select split, sum(n * abs(m - o)) / sum(n) ece from c group by 1),
z as (select split, count(*) n, avg((rf - y) ** 2) brier, avg(y) * (1 - avg(y)) reference from s group by 1) select split, n, round(brier, 6) brier, round(reference, 6) reference, round(ece, 6) ece, round(1 - brier / reference, 6) skill from z join e using (split)""",
    "score_summary": f"with {SCORED_SQL} select split, family, count(*) n, round(avg(rf), 6) mean, round(quantile_cont(rf, 0.5), 6) median, {', '.join(f'round(quantile_cont(rf, {p / 100}), 6) p{p}' for p in (75, 90, 95, 99))}, max(rf) maximum, round(avg((rf >= 0.5)::int), 6) recall from s group by all",
    "seed_mean_sd": f"with {SCORED_SQL}, {_RUNS} select model, split, count(distinct seed) n_seeds, round(avg(f1), 6) f1_mean, round(stddev_samp(f1), 6) f1_sd, round(avg(recall), 6) recall_mean, round(stddev_samp(recall), 6) recall_sd from m group by all",
    "paired_difference": f"with {SCORED_SQL}, {_RUNS} select split, seed, {', '.join(f'round(a.{x} - b.{x}, 6) {x}_delta' for x in ('f1', 'recall', 'false_positive_rate'))} from m a join m b using (split, seed) where a.model = 'rf' and b.model = 'ae'",
    "cost_summary": f"with {SCORED_SQL}, {_RUNS} select model, count(distinct seed) n_seeds, round(avg(cost), 6) cost_mean, max(cost) cost_max, round(avg(f1), 6) f1_mean, round(max(f1), 6) f1_max from m where split = 'test' group by 1",
    "class_weights": f"with {SCORED_SQL}, c as (select y, count(*) n from s group by 1) select y, n, round((select sum(n) from c) / (2 * n)::double, 6) weight, round((select n from c where y = 0) / (select n from c where y = 1)::double, 6) pos_weight from c",
}
