"""Evaluation, curve, dataset, tracking, review, store and model queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from sonarlake.operators import curves as cv
from sonarlake.operators import datasets as ds
from sonarlake.operators import evaluation as ev
from sonarlake.operators import models as md
from sonarlake.operators import review as rv
from sonarlake.operators import tracking as tr
from sonarlake.plans.durable import durable
from sonarlake.plans.ordered import dense_index
from sonarlake.sources import export as ex
from sonarlake.sources import files as fl
from sonarlake.sources import telemetry as tl

from . import tables as t
from .detections_q import NAMED, iou_sql, named, r
from .registry import query
from .waterfall_q import PROBS, class_probs

# ---- matching and detection metrics ---------------------------------------------------------------------------------------


def greedy_sql(thresholds, low="0.5e0", least="0e0"):
    """A walk over the predictions of an image and class, one after the other: ``m`` holds image_id, class_id, thr, pred_id, gt_id, iou.

    ``walk`` also tells per prediction the best IoU (``low`` or more) with a label that is free at its turn.
    """
    return f"""cand as (select a.image_id, a.class_id, a.pred_id, a.conf, list({{'g': b.gt_id, 'v': {iou_sql('a', 'b')}}} order by {iou_sql('a', 'b')} desc, b.gt_id) as c
  from fx_pred a join fx_gt b using (image_id, class_id) where {iou_sql('a', 'b')} >= {low} and a.conf >= {least} group by all),
turn as (select *, row_number() over (partition by image_id, class_id order by conf desc, pred_id) as n from cand),
walk(image_id, class_id, thr, n, taken, pred_id, b, free) as (
 select distinct image_id, class_id, thr, cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), c[99999], cast(null as double) from turn, (select unnest([{', '.join(thresholds)}]) as thr)
 union all select image_id, class_id, thr, n, case when b is null then taken else list_append(taken, b.g) end, pred_id, b, free from (
  select image_id, class_id, thr, n, taken, pred_id, list_filter(o, lambda x: x.v >= thr)[1] as b, o[1].v as free from (
   select t.image_id, t.class_id, w.thr, t.n, w.taken, t.pred_id, list_filter(t.c, lambda x: not list_contains(w.taken, x.g)) as o
   from walk w join turn t on t.image_id = w.image_id and t.class_id = w.class_id and t.n = w.n + 1) k) q),
m as (select image_id, class_id, thr, pred_id, b.g as gt_id, b.v as iou from walk where b is not null)"""


def curve_sql(thresholds):
    return f"""{greedy_sql(thresholds)},
rk as (select pred_id, class_id, conf, row_number() over (partition by class_id order by conf desc, pred_id) as rank from fx_pred),
ng as (select class_id, count(*) as n_gt from fx_gt group by 1),
tp as (select m.class_id, m.thr, rk.rank, rk.conf, ng.n_gt, row_number() over (partition by m.class_id, m.thr order by rk.rank) as tps from m join rk using (pred_id) join ng on ng.class_id = m.class_id)"""


THRESHOLDS = [f"{0.5 + 0.05 * i:.2f}e0" for i in range(10)]
AP_SQL = f"""with recursive {curve_sql(THRESHOLDS)},
st as (select class_id, thr, cast(floor(tps * 100e0 / n_gt) as bigint) as step, max(tps / cast(rank as double)) as p from tp group by all),
gr as (select class_id, thr, step from ng, (select unnest([{', '.join(THRESHOLDS)}]) as thr), (select unnest(range(101)) as step)),
en as (select class_id, thr, step, coalesce(max(p) over (partition by class_id, thr order by step rows between current row and unbounded following), 0) as p from gr left join st using (class_id, thr, step)),
ap as (select class_id, thr, avg(p) as ap from en group by all)"""


@query("v01_greedy_match", "fx_pred", "fx_gt", sql=f"with recursive {greedy_sql(['0.5e0'])} select image_id, pred_id, gt_id, round(iou, 6) as iou from m")
def _(spark, sf):
    return ev.greedy_match(t.pred(spark, sf), t.gt(spark, sf)).select("image_id", "pred_id", "gt_id", r("iou"))


JUDGED = f"""with recursive {greedy_sql(['0.5e0'], '0.1e0', '0.25e0')},
j as (select p.pred_id, m.gt_id, case when p.conf < 0.25e0 then 'LOW_CONF' when m.gt_id is not null then 'TP' when w.free is not null then 'POOR_LOCALISATION' else 'FP' end as verdict, m.iou as match_iou,
 case when m.gt_id is null then w.free end as best_iou from fx_pred p left join m using (pred_id) left join walk w on w.pred_id = p.pred_id where p.conf >= 0.1e0),
lb as (select g.*, m.gt_id is not null as matched from fx_gt g left join m using (gt_id))"""


@query("v02_error_analysis", "fx_pred", "fx_gt", sql=JUDGED + " select pred_id, gt_id, verdict, round(match_iou, 6) as match_iou, round(best_iou, 6) as best_iou from j")
def _(spark, sf):
    return ev.error_analysis(t.pred(spark, sf), t.gt(spark, sf))["predictions"].select("pred_id", "gt_id", "verdict", r("match_iou"), r("best_iou"))


@query("v02_error_summary", "fx_pred", "fx_gt", sql=JUDGED + """, p as (select count(*) filter (verdict = 'TP') as true_positives, count(*) filter (verdict in ('FP', 'POOR_LOCALISATION')) as false_positives,
 count(*) filter (verdict = 'POOR_LOCALISATION') as poor_localization, count(*) filter (verdict = 'LOW_CONF') as low_confidence from j), l as (select count(*) as labels, count(*) filter (not matched) as false_negatives from lb)
select p.*, l.*, round(true_positives / cast(true_positives + false_positives as double), 6) as precision, round(true_positives / cast(labels as double), 6) as recall from p, l""")
def _(spark, sf):
    return ev.error_summary(ev.error_analysis(t.pred(spark, sf), t.gt(spark, sf))).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("v03_miss_rates", "fx_pred", "fx_gt", sql=JUDGED + """, z as (select *, (x2 - x1) * (y2 - y1) / 120000e0 as a from lb), s as (select *, case when a < 0.002e0 then 'very_small' when a < 0.01e0 then 'small' when a < 0.05e0 then 'medium' else 'large' end as size_cat from z)
select class_id, size_cat, count(*) as labels, count(*) filter (not matched) as missed, round(count(*) filter (not matched) / cast(count(*) as double), 6) as miss_rate from s group by grouping sets ((class_id), (size_cat))""")
def _(spark, sf):
    return ev.miss_rates(ev.error_analysis(t.pred(spark, sf), t.gt(spark, sf))["labels"], 400.0 * 300.0).withColumn("miss_rate", F.round("miss_rate", 6))


@query("v04_mean_iou", "fx_pred", "fx_gt", sql=f"""
with m as (select a.pred_id, a.class_id, b.class_id as gc, {iou_sql('a', 'b')} as iou, row_number() over (partition by a.pred_id order by {iou_sql('a', 'b')} desc, b.gt_id) as rn from fx_pred a join fx_gt b using (image_id) where {iou_sql('a', 'b')} > 0),
k as (select class_id, iou from m where rn = 1 and iou >= 0.5e0 and class_id = gc)
select class_id, round(avg(iou), 6) as mean_iou, count(*) as n from k group by rollup(class_id)""")
def _(spark, sf):
    return ev.mean_iou(t.pred(spark, sf), t.gt(spark, sf)).select("class_id", r("mean_iou"), "n")


@query("v05_average_precision", "fx_pred", "fx_gt", sql=AP_SQL + " select class_id, round(thr, 2) as thr, round(ap, 6) as ap from ap")
def _(spark, sf):
    return ev.average_precision(t.pred(spark, sf), t.gt(spark, sf)).select("class_id", r("thr", 2), r("ap"))


@query("v05_map_summary", "fx_pred", "fx_gt", sql=AP_SQL + """, c as (select class_id, max(case when thr = 0.5e0 then ap end) as a, avg(ap) as b from ap group by 1)
select class_id, round(avg(a), 6) as ap50, round(avg(b), 6) as ap50_95 from c group by rollup(class_id)""")
def _(spark, sf):
    return ev.map_summary(ev.average_precision(t.pred(spark, sf), t.gt(spark, sf))).select("class_id", r("ap50"), r("ap50_95"))


@query("v05_class_scores", "fx_pred", "fx_gt", sql=f"""with recursive {curve_sql(['0.5e0'])}, b as (select *, row_number() over (partition by class_id order by 2e0 * tps / (rank + n_gt) desc, rank) as no from tp)
select ng.class_id, ng.n_gt, round(coalesce(tps / cast(rank as double), 0), 6) as precision, round(coalesce(tps / cast(b.n_gt as double), 0), 6) as recall, round(coalesce(2e0 * tps / (rank + b.n_gt), 0), 6) as f1, b.conf as cut
from ng left join b on b.class_id = ng.class_id and no = 1""")
def _(spark, sf):
    return ev.class_scores(t.pred(spark, sf), t.gt(spark, sf)).select("class_id", "n_gt", r("precision"), r("recall"), r("f1"), "cut")


def region_det(spark, sf):
    return t.pred(spark, sf).withColumns({"detection_type": F.expr("case when conf >= 0.9D then 'known' else 'unknown' end"),
                                          "anomaly_score": F.expr("case when pred_id % 7 = 0 then anomaly_score end")})


REG = """dd as (select *, case when conf >= 0.9e0 or coalesce(case when pred_id % 7 = 0 then anomaly_score end, 0) >= 0.5e0 then 9e0 else conf end as gate from fx_pred),
gg as (select g.gt_id, max(gate) as fb from fx_gt g left join dd d on d.image_id = g.image_id and {c} group by 1),
di as (select d.pred_id, d.gate, count(g.gt_id) > 0 as inside from dd d left join fx_gt g on d.image_id = g.image_id and {c} group by 1, 2),
th(threshold) as (values (0.3e0), (0.45e0), (0.6e0), (0.75e0)),
a as (select threshold, count(*) as n_gt, count(*) filter (fb >= threshold) as objects_found from gg, th group by 1),
b as (select threshold, count(*) as detections, count(*) filter (not inside) as false_alarms from di, th where gate >= threshold group by 1),
sw as (select threshold, n_gt, objects_found, detections, false_alarms, n_gt - objects_found as objects_missed, (detections - false_alarms) * 1e0 / greatest(1, detections) as precision, objects_found * 1e0 / n_gt as recall from a join b using (threshold)),
sf as (select *, 2 * precision * recall / (precision + recall) as f1 from sw)"""
CENTRE = "(d.x1 + d.x2) / 2 between g.x1 and g.x2 and (d.y1 + d.y2) / 2 between g.y1 and g.y2"
STRICT = f"{iou_sql('d', 'g')} >= 0.3e0"
THS = [0.3, 0.45, 0.6, 0.75]
SWEEP_COLS = "threshold, n_gt, objects_found, objects_missed, detections, false_alarms, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1"


def sweep_of(spark, sf, mode):
    labels, dets = ev.region_hits(t.gt(spark, sf), region_det(spark, sf), mode)
    return ev.sweep(labels, dets, THS)


def rounded(df):
    return df.select("threshold", "n_gt", "objects_found", "objects_missed", "detections", "false_alarms", r("precision"), r("recall"), r("f1"))


@query("v06_region_score", "fx_pred", "fx_gt", sql="with " + REG.format(c=CENTRE) + f" select {SWEEP_COLS} from sf")
def _(spark, sf):
    return rounded(sweep_of(spark, sf, "region"))


@query("v07_iou_score", "fx_pred", "fx_gt", sql="with " + REG.format(c=STRICT) + f" select {SWEEP_COLS} from sf")
def _(spark, sf):
    return rounded(sweep_of(spark, sf, "iou"))


@query("v08_best_threshold", "fx_pred", "fx_gt", sql="with " + REG.format(c=CENTRE) + f" select {SWEEP_COLS} from sf order by f1 desc, threshold limit 1")
def _(spark, sf):
    return rounded(ev.best_threshold(sweep_of(spark, sf, "region")))


@query("c14_region_hits", "fx_pred", "fx_gt", sql="with " + REG.format(c=CENTRE) + " select pred_id, cast(inside as int) as inside from di")
def _(spark, sf):
    return ev.region_hits(t.gt(spark, sf), region_det(spark, sf))[1].select("pred_id", F.col("inside").cast("int").alias("inside"))


def flagged(spark, sf):
    """Predictions with a correctness flag derived from the box they were made from."""
    return t.pred(spark, sf).withColumn("is_tp", F.expr("(pred_id * 7 + source_gt) % 10 < 6"))


def n_gt(spark, sf):
    return t.gt(spark, sf).agg(F.count(F.lit(1)).alias("n_gt"))


TP = "tp as (select conf, seg_quality, (pred_id * 7 + source_gt) % 10 < 6 as is_tp from fx_pred), ng as (select count(*) as n_gt from fx_gt)"


@query("v09_confidence_sweep", "fx_pred", "fx_gt", sql=f"""with {TP}, c(cut) as (values (0.15e0), (0.2e0), (0.25e0), (0.3e0), (0.4e0), (0.5e0), (0.6e0)),
s as (select cut, count(*) as n, count(*) filter (is_tp) as tp from tp, c where conf >= cut group by 1)
select cut, tp, n, round(tp * 1e0 / n, 6) as precision, round(tp * 1e0 / n_gt, 6) as recall, round(2 * (tp * 1e0 / n) * (tp * 1e0 / n_gt) / (tp * 1e0 / n + tp * 1e0 / n_gt), 6) as f1 from s, ng""")
def _(spark, sf):
    return ev.confidence_sweep(flagged(spark, sf), n_gt(spark, sf)).select("cut", "tp", "n", r("precision"), r("recall"), r("f1"))


@query("v10_ablation", "fx_pred", "fx_gt", sql=f"""with {TP}, o(alpha, beta) as (values (1e0, 0e0), (0.7e0, 0.3e0), (0.6e0, 0.4e0), (0.5e0, 0.5e0), (0.4e0, 0.6e0)),
x as (select alpha, beta, is_tp, beta = 0 or round(least(1e0, greatest(0e0, alpha * conf + beta * seg_quality)), 4) >= 0.3e0 as k from tp, o),
s as (select alpha, beta, count(*) filter (k) as kept, count(*) filter (k and is_tp) as tp, count(*) filter (not k and not is_tp) as fp_rejected, count(*) filter (not is_tp) as fp from x group by 1, 2)
select alpha, beta, kept, tp, fp_rejected, round(tp * 1e0 / kept, 6) as precision, round(tp * 1e0 / n_gt, 6) as recall, round(fp_rejected * 1e0 / fp, 6) as fp_rejection from s, ng""")
def _(spark, sf):
    return ev.ablation(flagged(spark, sf), n_gt(spark, sf)).select("alpha", "beta", "kept", "tp", "fp_rejected", r("precision"), r("recall"), r("fp_rejection"))


@query("v11_e2e_rates", "fx_pred", "fx_gt", sql=f"""
with d as (select *, case when conf >= 0.6e0 then 'known' else 'unknown' end as dt from fx_pred),
k as (select d.image_id, d.pred_id, coalesce(max({iou_sql('d', 'g')}) >= 0.5e0, false) as good from d left join fx_gt g on g.image_id = d.image_id and g.class_id = d.class_id where dt = 'known' group by 1, 2),
i as (select g.image_id, (select count(*) from k where k.image_id = g.image_id) as known, (select count(*) from k where k.image_id = g.image_id and good) as good,
 (select count(*) from d where d.image_id = g.image_id) as n, (select count(*) from d where d.image_id = g.image_id and dt = 'unknown') as unk from (select distinct image_id from fx_gt) g)
select count(*) as images, round(avg(cast(good > 0 as int)), 6) as correct_rate, round(avg(cast(good = 0 and known > 0 as int)), 6) as wrong_known_only_rate, round(avg(cast(known = 0 and unk > 0 as int)), 6) as unknown_only_rate,
 round(avg(cast(n = 0 as int)), 6) as nothing_rate, round(sum(good) * 1e0 / sum(known), 6) as known_precision, round(sum(known - good) * 1e0 / count(*), 6) as false_known_per_image from i""")
def _(spark, sf):
    d = t.pred(spark, sf).withColumn("det_id", F.col("pred_id")).withColumn("detection_type", F.expr("case when conf >= 0.6D then 'known' else 'unknown' end"))
    e = ev.e2e_rates(t.gt(spark, sf), d)
    return e.select("images", *[r(c) for c in e.columns if c != "images"])


CLS = "cl as (select p.class_id as y_pred, g.class_id as y_true from fx_pred p join fx_gt g on p.source_gt = g.gt_id)"


def classified(spark, sf):
    return t.pred(spark, sf).select(F.col("class_id").alias("y_pred"), F.col("source_gt").alias("gt_id")).join(
        t.gt(spark, sf).select("gt_id", F.col("class_id").alias("y_true")), "gt_id")


@query("v12_confusion", "fx_pred", "fx_gt", sql=f"with {CLS} select y_true, y_pred, count(*) as n, round(count(*) * 1e0 / sum(count(*)) over (partition by y_true), 6) as row_share from cl group by 1, 2")
def _(spark, sf):
    return ev.confusion(classified(spark, sf)).select("y_true", "y_pred", "n", r("row_share"))


@query("v12_confusion_wide", "fx_pred", "fx_gt", sql=f"with {CLS} select y_true, " + ", ".join(f"count(*) filter (y_pred = {k}) as p{k}" for k in range(5)) + " from cl group by 1")
def _(spark, sf):
    return ev.confusion_wide(classified(spark, sf), list(range(5))).withColumnsRenamed({str(k): f"p{k}" for k in range(5)})


REPORT = f"""with {CLS}, c as (select y_true, y_pred, count(*) as n from cl group by 1, 2),
p as (select k.cls, (select sum(n) from c where y_true = cls) as support, (select sum(n) from c where y_true = cls and y_pred = cls) as tp, (select sum(n) from c where y_pred = cls) as predicted from (select distinct y_true as cls from c) k),
f as (select cls, support, tp * 1e0 / predicted as precision, tp * 1e0 / support as recall, tp from p), ff as (select *, 2 * precision * recall / (precision + recall) as f1 from f)"""


@query("v13_classification_report", "fx_pred", "fx_gt", sql=REPORT + " select cls, cast(support as bigint) as support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from ff")
def _(spark, sf):
    return ev.classification_report(classified(spark, sf)).select("cls", "support", r("precision"), r("recall"), r("f1"))


@query("v13_report_averages", "fx_pred", "fx_gt", sql=REPORT + """ select round(sum(tp) / sum(support), 6) as accuracy, round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1,
 round(sum(precision * support) / sum(support), 6) as weighted_precision, round(sum(recall * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from ff""")
def _(spark, sf):
    a = ev.report_averages(ev.classification_report(classified(spark, sf)))
    return a.select(*[r(c) for c in a.columns])


@query("v14_topk_accuracy", "fx_pred", sql=f"with {PROBS}, k as (select pred_id, class_id, k, row_number() over (partition by pred_id order by p desc, k) as rn from pb) select round(avg(cast(rn <= 2 as int)), 6) as accuracy, count(*) as n from k where k = class_id")
def _(spark, sf):
    return ev.topk_accuracy(class_probs(spark, sf), 2, "class_id").select(r("accuracy"), "n")


# ---- curves ---------------------------------------------------------------------------------------------------------------

AUC = "(sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * 1e0 * sum(1 - y))"
RANK = "rank() over ({p} order by score) + (count(*) over (partition by {q} score) - 1) / 2e0 as rk"


@query("v15_roc_auc", "fx_scores", sql=f"select round({AUC}, 8) as roc_auc, sum(y) as n_pos, sum(1 - y) as n_neg from (select y, {RANK.format(p='', q='')} from fx_scores) q")
def _(spark, sf):
    return cv.roc_auc(t.scores(spark, sf)).select(r("roc_auc", 8), "n_pos", "n_neg")


OVR = f"""with {PROBS}, l as (select k as cls, cast(class_id = k as int) as y, p as score from pb), rr as (select cls, y, {RANK.format(p='partition by cls', q='cls,')} from l),
oa as (select cls, {AUC} as a, sum(y) as n from rr group by 1)"""


@query("v15_ovr_auc", "fx_pred", sql=OVR + " select cls, round(a, 6) as roc_auc, n as n_pos from oa")
def _(spark, sf):
    return cv.ovr_auc(class_probs(spark, sf), "class_id").select("cls", r("roc_auc", 6), "n_pos")


@query("v15_ovr_summary", "fx_pred", sql=OVR + " select round(avg(a), 6) as macro_auc, round(sum(a * n) / sum(n), 6) as weighted_auc from oa")
def _(spark, sf):
    return cv.ovr_summary(cv.ovr_auc(class_probs(spark, sf), "class_id")).select(r("macro_auc"), r("weighted_auc"))


@query("v16_pr_auc", "fx_scores", sql="""with g as (select score, sum(y) as p, count(*) as n from fx_scores group by 1), c as (select p, sum(p) over (order by score desc) as cp, sum(n) over (order by score desc) as cn from g)
select round(sum(p * cp * 1e0 / cn) / sum(p), 8) as pr_auc from c""")
def _(spark, sf):
    return cv.pr_auc(t.scores(spark, sf)).select(r("pr_auc", 8))


@query("v17_detection_metrics", "fx_scores", sql="""with c as (select count(*) filter (score > 0.6e0 and y = 1) as tp, count(*) filter (score > 0.6e0 and y = 0) as fp, count(*) filter (score <= 0.6e0 and y = 1) as fn, count(*) filter (score <= 0.6e0 and y = 0) as tn from fx_scores)
select tp, fp, fn, tn, round(tp * 1e0 / greatest(1, tp + fp), 6) as precision, round(tp * 1e0 / greatest(1, tp + fn), 6) as recall, round(fp * 1e0 / greatest(1, fp + tn), 6) as fpr, round(fn * 1e0 / greatest(1, fn + tp), 6) as fnr from c""")
def _(spark, sf):
    return cv.detection_metrics(t.scores(spark, sf), 0.6).select("tp", "fp", "fn", "tn", r("precision"), r("recall"), r("fpr"), r("fnr"))


LIN = lambda lo, hi, k=200: "[" + ", ".join(repr((lo + (hi - lo) * i / (k - 1)) / 100.0) + "e0" for i in range(k)) + "]"


@query("v18_select_threshold", "fx_scores", sql=f"""with c as (select distinct unnest(quantile_cont(score, {LIN(50.0, 99.9)}) filter (y = 0)) as t from fx_scores union select distinct unnest(quantile_cont(score, {LIN(1.0, 99.0)}) filter (y = 1)) from fx_scores),
m as (select t, count(*) filter (score > t and y = 1) as tp, count(*) filter (score > t and y = 0) as fp, count(*) filter (score <= t and y = 1) as fn, count(*) filter (score <= t and y = 0) as tn from fx_scores, c group by 1),
f as (select *, case when tp = 0 then 0e0 else 2e0 * tp / (2 * tp + fp + fn) end as f1 from m where fp * 1e0 / (fp + tn) <= 0.1e0)
select round(t, 8) as threshold, tp, fp, fn, tn from f order by f1 desc, t limit 1""")
def _(spark, sf):
    return cv.select_threshold(t.scores(spark, sf)).select(r("threshold", 8), "tp", "fp", "fn", "tn")


CAL = """b as (select greatest(1, ceil(score * 10)) as bin, score, y from fx_scores), a as (select bin, count(*) as n, avg(score) as conf, avg(y) as acc from b group by 1),
cb as (select k.bin, coalesce(n, 0) as n, coalesce(conf, (k.bin - 0.5e0) / 10) as conf, coalesce(acc, 0) as acc from range(1, 11) k(bin) left join a on a.bin = k.bin)"""


@query("v19_calibration_bins", "fx_scores", sql=f"with {CAL} select bin, n, round(conf, 6) as conf, round(acc, 6) as acc from cb")
def _(spark, sf):
    return cv.calibration_bins(t.scores(spark, sf)).select("bin", "n", r("conf"), r("acc"))


@query("v19_calibration", "fx_scores", sql=f"with {CAL} select round(sum(n * abs(acc - conf)) / sum(n), 6) as ece, round(max(case when n > 0 then abs(acc - conf) else 0 end), 6) as mce from cb")
def _(spark, sf):
    return cv.calibration(t.scores(spark, sf)).select(r("ece"), r("mce"))


@query("v20_reliability_comparison", "fx_scores", sql="""with s as (select y, least(0.999e0, greatest(0.001e0, score)) as score from fx_scores),
x as (select 'raw' as curve, y, score from s union all select 'scaled', y, 1 / (1 + exp(-(ln(score / (1 - score)) / 1.35e0))) from s),
a as (select curve, greatest(1, ceil(score * 10)) as bin, count(*) as n, avg(score) as conf, avg(y) as acc from x group by 1, 2)
select c.curve, k.bin, coalesce(n, 0) as n, round(coalesce(conf, (k.bin - 0.5e0) / 10), 6) as conf, round(coalesce(acc, 0), 6) as acc from (values ('raw'), ('scaled')) c(curve) cross join range(1, 11) k(bin) left join a on a.bin = k.bin and a.curve = c.curve""")
def _(spark, sf):
    from sonarlake.functions.scores import temperature_scale
    s = t.scores(spark, sf).withColumn("score", F.expr("least(0.999D, greatest(0.001D, score))"))
    return cv.reliability_comparison(s, temperature_scale(F.col("score"))).select("curve", "bin", "n", r("conf"), r("acc"))


@query("v21_verification_auc")
def _(spark, sf):
    return cv.verification_auc(class_probs(spark, sf), 5, "class_id")


POLICY = f"""with {PROBS}, q as (select pred_id, max(p) as top, max(case when k = class_id then p end) as p from pb group by 1), rk as (select pb.pred_id, count(*) filter (pb.p > q.p) as rank from pb join q using (pred_id) group by 1),
w as (select q.p, rank, q.p / top as ratio, (pred_id * 13) % 10 < 7 as ok from q join rk using (pred_id)),
r(i, v) as (values (0, 0.02e0), (1, 0.05e0), (2, 0.1e0), (3, 0.2e0), (4, 0.3e0), (5, 0.5e0), (6, 0.75e0), (7, 1e0)),
j as (select i, v, avg(cast(ratio >= v as int)) filter (ok) - avg(cast(ratio >= v as int)) filter (not ok) as j from w, r group by 1, 2),
kk(a, k) as (values (0, 1), (1, 2), (2, 3), (3, 4)), tt(b, tau) as (values (0, 0.01e0), (1, 0.03e0), (2, 0.05e0), (3, 0.07e0)),
m as (select a * 4 + b as i, k, tau, avg(cast(rank >= k and p < tau as int)) filter (ok) as fp, avg(cast(rank >= k and p < tau as int)) filter (not ok) as tp from w, kk, tt group by 1, 2, 3)
select (select v from j order by j desc, i limit 1) as confirm_ratio, k as mismatch_rank, tau as mismatch_p, round(tp, 6) as errors_flagged, round(fp, 6) as correct_flagged from m where fp <= 0.1e0 order by tp desc, i limit 1"""


@query("v22_select_policy", "fx_pred", sql=POLICY)
def _(spark, sf):
    w = class_probs(spark, sf).withColumn("p", F.get("probs", F.col("class_id").cast("int"))).withColumns(
        {"rank": F.size(F.filter("probs", lambda x: x > F.col("p"))), "ratio": F.col("p") / F.array_max("probs"), "ok": F.expr("(pred_id * 13) % 10 < 7")})
    return cv.select_policy(w, ranks=(1, 2, 3, 4), taus=(0.01, 0.03, 0.05, 0.07)).select(
        "confirm_ratio", "mismatch_rank", "mismatch_p", r("errors_flagged"), r("correct_flagged"))


FEATS = ["conf", "contrast_ratio", "snr_db", "shadow_contrast"]


def split_by_id(df):
    return df.withColumn("y_true", F.col("class_id").cast("double")), df


@query("v23_signature_ablation")
def _(spark, sf):
    df = t.pred(spark, sf).withColumn("y_true", F.expr("cast(floor(contrast_ratio) as double)"))
    parts = ds.ratio_split(df, "pred_id", (("train", 0.7), ("test", 0.3)))
    return md.signature_ablation(parts.filter("split = 'train'"), parts.filter("split = 'test'"), {"all": FEATS, "acoustic": ["contrast_ratio", "snr_db"], "geometry": ["conf", "shadow_contrast"]})


@query("v24_fit_signature")
def _(spark, sf):
    df = t.pred(spark, sf).withColumn("y_true", F.expr("cast(floor(contrast_ratio) as double)"))
    return md.score(md.fit_signature(df, FEATS), df).select("pred_id", "y_pred")


@query("v25_fit_fusion")
def _(spark, sf):
    rows = t.pred(spark, sf).withColumn("y", F.expr("cast(contrast_ratio * 20 + snr_db + pred_id % 17 > 62 as double)"))
    feats = ["contrast_ratio", "snr_db", "shadow_contrast", "seg_quality"]
    _, oof = md.fit_fusion(rows.select("pred_id", "image_id", "y", *feats, "x1", "y1", "x2", "y2"), feats, "image_id")
    return md.fusion_threshold(oof, t.gt(spark, sf))


def masks(spark, sf):
    c = t.cells(spark, sf)
    return c.filter("v > 120"), c.filter("v > 127 and (ping + col) % 7 <> 0")


@query("v26_mask_metrics", "fx_cells", sql="""with j as (select survey_id, cast(v > 120 as int) as p, cast(v > 127 and (ping + col) % 7 <> 0 as int) as g from fx_cells), s as (select survey_id, sum(p * g) as tp, sum(p) as p, sum(g) as g from j group by 1)
select survey_id, tp, round(tp * 1e0 / p, 6) as precision, round(tp * 1e0 / g, 6) as recall, round(tp * 1e0 / (p + g - tp), 6) as iou, round(2e0 * tp / (p + g), 6) as dice from s""")
def _(spark, sf):
    p, g = masks(spark, sf)
    return ev.mask_metrics(p, g, ["ping", "col"], ["survey_id"]).select("survey_id", "tp", r("precision"), r("recall"), r("iou"), r("dice"))


def small_masks(boxes, ident):
    """Mask cells of boxes at a quarter of the resolution."""
    return boxes.selectExpr(ident, "explode(sequence(cast(floor(y1 / 4) as bigint), cast(floor(y2 / 4) as bigint))) as row", "x1", "x2").selectExpr(
        ident, "row", "explode(sequence(cast(floor(x1 / 4) as bigint), cast(floor(x2 / 4) as bigint))) as col").filter("(row * 5 + col * 3) % 11 <> 0")


@query("v27_instance_mask_iou")
def _(spark, sf):
    p, g = t.pred(spark, sf), t.gt(spark, sf)
    matches = durable(ev.greedy_match(p, g).select("pred_id", "gt_id"), "matches")
    # boxes are drawn once they are matched, since only the masks of matched boxes are compared
    drawn = lambda boxes, ident: small_masks(boxes.join(matches.select(ident).hint("merge"), ident), ident)
    return ev.mask_iou_summary(ev.instance_mask_iou(matches, drawn(p, "pred_id"), drawn(g, "gt_id")))


@query("c17_parity", "fx_pred", sql="""with a as (select pred_id, conf from fx_pred where pred_id % 50 <> 0), b as (select pred_id, conf * 1.0001e0 as c2 from fx_pred where pred_id % 51 <> 0)
select count(conf + c2) as compared, count(*) filter (conf is null or c2 is null) as one_sided, round(max(abs(conf - c2)), 9) as max_abs_diff, round(max(abs(conf - c2) / conf), 9) as max_rel_diff from a full join b using (pred_id)""")
def _(spark, sf):
    p = t.pred(spark, sf)
    a, b = p.filter("pred_id % 50 <> 0"), p.filter("pred_id % 51 <> 0").withColumn("conf", F.col("conf") * 1.0001)
    return ev.parity(a, b, ["pred_id"], "conf").select("compared", "one_sided", r("max_abs_diff", 9), r("max_rel_diff", 9))


# ---- datasets ---------------------------------------------------------------------------------------------------------------

LAB = """sp as (select *, string_split(line, ' ') as p from fx_labels),
lb as (select image_id, line_no, line, len(p) as n_fields, try_cast(p[1] as bigint) as class_id, try_cast(p[2] as double) as cx, try_cast(p[3] as double) as cy, try_cast(p[4] as double) as w, try_cast(p[5] as double) as h from sp),
lk as (select *, n_fields = 5 and class_id is not null and cx is not null and cy is not null and w is not null and h is not null as ok from lb),
le as (select *, cast(n_fields <> 5 as int) + cast(n_fields = 5 and not ok as int) + cast(ok and not class_id between 0 and 4 as int) + cast(ok and (w <= 0 or h <= 0) as int) + cast(ok and not (cx between 0 and 1 and cy between 0 and 1) as int)
 + cast(ok and (cx - w / 2 < -0.05e0 or cx + w / 2 > 1.05e0 or cy - h / 2 < -0.05e0 or cy + h / 2 > 1.05e0) as int) as n_errors from lk)"""


@query("k01_validate_labels", "fx_labels", sql=f"with {LAB} select line_no, n_errors, cast(coalesce(ok, false) as int) as is_box from le")
def _(spark, sf):
    return ds.validate_labels(t.labels(spark, sf), 5).select("line_no", F.size("errors").alias("n_errors"), F.col("is_box").cast("int").alias("is_box"))


def boxes(spark, sf):
    return ds.validate_labels(t.labels(spark, sf), 5).filter("is_box")


@query("a13_class_dim", "fx_pred", sql=f"select class_id, {NAMED} as class_name, count(*) as n from fx_pred group by 1, 2")
def _(spark, sf):
    dim = ds.class_dim(spark, ["tire", "bottle", "valve", "can", "Shipwrecks"])
    return t.pred(spark, sf).groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).join(dim, "class_id")


@query("d07_class_counts", "fx_labels", sql=f"with {LAB} select k.c as class_id, count(le.line_no) as n from range(0, 7) k(c) left join le on le.class_id = k.c and ok group by 1")
def _(spark, sf):
    return ds.class_counts(boxes(spark, sf), ds.class_dim(spark, [f"c{i}" for i in range(7)])).select("class_id", "n")


@query("d08_size_distribution", "fx_labels", sql=f"with {LAB} select case when w * h < 0.002e0 then 'very_small' when w * h < 0.01e0 then 'small' when w * h < 0.05e0 then 'medium' else 'large' end as size_cat, count(*) as n from le where ok group by 1")
def _(spark, sf):
    return ds.size_distribution(boxes(spark, sf))


@query("d09_aspect_distribution", "fx_labels", sql=f"""with {LAB} select case when w / (h + 1e-6) > 3 then 'extreme_wide' when w / (h + 1e-6) > 1.5e0 then 'wide' when w / (h + 1e-6) >= 0.67e0 then 'square_ish' when w / (h + 1e-6) >= 0.33e0 then 'tall' else 'extreme_tall' end as aspect, count(*) as n from le where ok group by 1""")
def _(spark, sf):
    return ds.aspect_distribution(boxes(spark, sf))


def images(spark, sf):
    return t.images(spark, sf).withColumn("readable", F.expr("size_bytes % 23 <> 0"))


SUMMARY = LAB + """, im as (select *, size_bytes % 23 <> 0 as readable from fx_images), lf as (select image_id, count(*) filter (ok) as boxes, max(cast(n_errors > 0 as int)) as bad from le group by 1),
jj as (select im.split, readable, lf.image_id is not null as has, coalesce(boxes, 0) as boxes, coalesce(bad, 0) as bad from im left join lf using (image_id)),
sm as (select split, count(*) as images, count(*) filter (not readable) as corrupt, count(*) filter (readable and has) as labels, count(*) filter (readable and not has) as missing, count(*) filter (readable and has and bad = 1) as invalid,
 count(*) filter (readable and has and boxes = 0) as background, cast(sum(case when readable and has then boxes else 0 end) as bigint) as boxes from jj group by rollup(split))"""


@query("d06_dataset_summary", "fx_images", "fx_labels", sql=f"with {SUMMARY} select * from sm")
def _(spark, sf):
    return ds.dataset_summary(images(spark, sf), t.labels(spark, sf), 5)


@query("k02_dataset_health", "fx_images", "fx_labels", sql=f"with {SUMMARY} select split, cast(corrupt = 0 and invalid = 0 and missing = 0 as int) as is_healthy from sm")
def _(spark, sf):
    return ds.dataset_health(ds.dataset_summary(images(spark, sf), t.labels(spark, sf), 5)).select("split", F.col("is_healthy").cast("int").alias("is_healthy"))


@query("c10_missing_labels", "fx_images", "fx_labels", sql="select image_id from fx_images where image_id not in (select image_id * 3 from fx_labels)")
def _(spark, sf):
    return ds.missing_labels(t.images(spark, sf), t.labels(spark, sf).withColumn("image_id", F.col("image_id") * 3)).select("image_id")


@query("d20_duplicate_images", "fx_images", sql="""select content_hash, min(image_id) as first_id, arg_min(name, image_id) as first_name, count(*) - 1 as copies from fx_images group by 1 having count(*) > 1""")
def _(spark, sf):
    return ds.duplicate_images(t.images(spark, sf))


@query("d19_leakage_report", "fx_images", sql="""with g as (select split_part(name, '_', 2) as survey_group, split from fx_images)
select survey_group, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from g group by 1 having count(distinct split) > 1""")
def _(spark, sf):
    g = t.images(spark, sf).withColumn("survey_group", F.get(F.split("name", "_"), F.lit(1)))
    return ds.leakage_report(g)


@query("s21_name_groups", "fx_images", sql="""select image_id, 'Shipwrecks_' || regexp_replace(name, '_[0-9]+\\.png$', '') as survey_group, regexp_replace(name, '\\.png$', '') as frame_group from fx_images""")
def _(spark, sf):
    stem = F.concat(F.lit("Shipwrecks_"), F.regexp_replace("name", r"\.png$", ""))
    augmented = F.concat(F.regexp_replace("name", r"\.png$", ""), F.lit("_png.rf."), F.col("content_hash"), F.lit(".jpg"))
    return t.images(spark, sf).select("image_id", ds.survey_group(stem).alias("survey_group"), ds.frame_group(augmented).alias("frame_group"))


MIX = "(({c} % 1000003) * 48271 + {s} * 7919) % 1000003"


@query("k03_stratified_split", "fx_pred", sql=f"""with n as (select pred_id, class_id, row_number() over (partition by class_id order by {MIX.format(c='pred_id', s=42)}, pred_id) - 1 as pos, count(*) over (partition by class_id) as n from fx_pred)
select pred_id, case when pos < floor(n * 0.8e0) then 'train' when pos < floor(n * 0.8e0) + floor(n * 0.1e0) then 'val' else 'test' end as split from n""")
def _(spark, sf):
    return ds.stratified_split(t.pred(spark, sf), "class_id", "pred_id").select("pred_id", "split")


@query("k04_ratio_split", "fx_pred", sql=f"""with n as (select pred_id, row_number() over (order by {MIX.format(c='pred_id', s=42)}, pred_id) - 1 as pos, count(*) over () as n from fx_pred)
select pred_id, case when pos < floor(n * 0.7e0) then 'train' when pos < floor(n * 0.7e0) + floor(n * 0.15e0) then 'val' else 'test' end as split from n""")
def _(spark, sf):
    return ds.ratio_split(t.pred(spark, sf), "pred_id").select("pred_id", "split")


@query("k05_group_split", "fx_pred", sql=f"""with g as (select image_id, row_number() over (order by {MIX.format(c='image_id', s=0)}, image_id) - 1 as pos, count(*) over () as n from (select distinct image_id from fx_pred) q)
select pred_id, case when pos < floor(n * 0.5e0) then 'a' else 'b' end as split from fx_pred join g using (image_id)""")
def _(spark, sf):
    return ds.group_split(t.pred(spark, sf), "image_id").select("pred_id", "split")


@query("k06_assign_survey_splits")
def _(spark, sf):
    g = t.pred(spark, sf).groupBy(F.expr("image_id % 61").alias("survey_group")).agg(F.count(F.lit(1)).alias("n"))
    return ds.assign_survey_splits(g)


MAT = f"case {NAMED} when 'valve' then 'metal' when 'can' then 'metal' else 'plastic' end"


@query("k07_to_material", "fx_pred", sql=f"select pred_id, {MAT} as material, case {MAT} when 'metal' then 2 else 0 end as material_id from fx_pred")
def _(spark, sf):
    return ds.to_material(named(t.pred(spark, sf))).select("pred_id", "material", "material_id")


@query("k08_centered_labels", "fx_pred", sql="select pred_id, 0.5e0 as cx, 0.5e0 as cy, 0.92e0 as w, 0.92e0 as h from fx_pred")
def _(spark, sf):
    return ds.centered_labels(t.pred(spark, sf)).select("pred_id", "cx", "cy", "w", "h")


def catalogue(spark, sf):
    lab = named(boxes(spark, sf)).withColumns({
        "class_name": F.coalesce("class_name", F.lit("unknown")),
        "image_name": F.concat(F.lit("img"), F.col("image_id").cast("string"), F.lit(".png")), "box_no": F.col("line_no") % 10,
        "split": F.expr("case when image_id % 10 < 8 then 'train' else 'val' end")})
    return ds.roi_catalogue(lab, 0.25, 640, 480)


CATQ = LAB + f""", rc as (select line_no, image_id, case when class_id > 4 then 'unknown' else {NAMED} end as class_name, case when image_id % 10 < 8 then 'train' else 'val' end as split, (cx - w / 2) * 640 as x1, (cy - h / 2) * 480 as y1, (cx + w / 2) * 640 as x2, (cy + h / 2) * 480 as y2 from le where ok),
rx as (select *, greatest(0, floor(x1 - greatest(1, x2 - x1) * 0.25e0)) as rx1, greatest(0, floor(y1 - greatest(1, y2 - y1) * 0.25e0)) as ry1, least(640, ceil(x2 + greatest(1, x2 - x1) * 0.25e0)) as rx2, least(480, ceil(y2 + greatest(1, y2 - y1) * 0.25e0)) as ry2 from rc)"""


@query("k09_roi_catalogue", "fx_labels", sql=f"with {CATQ} select line_no, 'img' || image_id || '_roi0' || (line_no % 10) || '_' || class_name as sample_id from rx")
def _(spark, sf):
    return catalogue(spark, sf).select("line_no", "sample_id")


@query("k09_roi_counts", "fx_labels", sql=f"with {CATQ} select class_name, null as split, count(*) as n from rx group by 1 union all select null, split, count(*) from rx group by split")
def _(spark, sf):
    return ds.roi_counts(catalogue(spark, sf))


@query("k10_background_patches")
def _(spark, sf):
    frames = t.gt(spark, sf).select("image_id").distinct().withColumns({"width": F.lit(400), "height": F.lit(300)})
    return ds.background_patches(frames, t.gt(spark, sf), 3, [24, 32, 48])


@query("c11_remap_classes", "fx_pred", sql="select pred_id, case class_id when 0 then 10 when 1 then 12 when 2 then 11 else 7 end as class_id from fx_pred")
def _(spark, sf):
    m = spark.createDataFrame([(0, 10), (1, 12), (2, 11)], "class_id bigint, new_id bigint")
    return ds.remap_classes(t.pred(spark, sf), m, 7).select("pred_id", "class_id")


@query("g01_union_datasets", "fx_pred", sql="""select 'sonar' as source, 'sonar_' || pred_id as name, case class_id when 0 then 3 when 1 then 4 else 0 end as class_id from fx_pred where class_id < 3
union all select 'debris', 'debris_' || pred_id, case class_id when 3 then 9 else 7 end from fx_pred where class_id >= 3""")
def _(spark, sf):
    p = t.pred(spark, sf).select(F.col("pred_id").cast("string").alias("name"), "class_id")
    return ds.union_datasets([("sonar", p.filter("class_id < 3"), {0: 3, 1: 4}, 0), ("debris", p.filter("class_id >= 3"), {3: 9}, 7)])


# ---- tracking ---------------------------------------------------------------------------------------------------------------

def observations(spark, sf):
    o = t.pred(spark, sf).selectExpr("source_gt % 20 as survey_id", "source_gt % 997 as track_id", "pred_id", "pred_id / 8D as t", "x1 as x", "y1 as y", "x2 - x1 as w", "y2 - y1 as h", "conf")
    return tr.number_observations(o, ["t", "pred_id"])


OBS = """ob as (select source_gt % 20 as survey_id, source_gt % 997 as track_id, pred_id, pred_id / 8e0 as t, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, conf from fx_pred),
oo as (select *, row_number() over (partition by survey_id, track_id order by pred_id) - 1 as obs_no from ob)"""


@query("e09_track_features", "fx_pred", sql=f"""with {OBS}, k as (select a.survey_id, a.track_id, a.obs_no, i, greatest(0, a.obs_no - 7 + i) as j, greatest(greatest(0, a.obs_no - 7), greatest(0, a.obs_no - 7 + i) - case when i = 0 then 0 else 1 end) as pj, a.x as lx, a.y as ly from oo a, range(0, 8) q(i)),
f as (select k.survey_id, k.track_id, k.obs_no, k.i, (b.x - lx) / 100 as dx, b.w / 100 as w, b.t - p.t as dt, case when b.t - p.t > 0 then (b.x - p.x) / (b.t - p.t) else 0 end as vx, case when b.t - p.t > 0 then (b.y - p.y) / (b.t - p.t) else 0 end as vy
 from k join oo b on b.survey_id = k.survey_id and b.track_id = k.track_id and b.obs_no = k.j join oo p on p.survey_id = k.survey_id and p.track_id = k.track_id and p.obs_no = case when k.obs_no - 7 + k.i <= 0 then k.j else k.pj end)
select survey_id, track_id, obs_no, i, round(dx, 6) as dx, round(w, 6) as w, round(dt, 6) as dt, round(vx / 100, 6) as vx, round(case when vx <> 0 or vy <> 0 then atan2(vy, vx) / pi() else 0 end, 6) as heading from f""")
def _(spark, sf):
    f = tr.track_features(observations(spark, sf)).select("survey_id", "track_id", "obs_no", F.posexplode("features").alias("i", "f"))
    pick = lambda k, n: F.round(F.col("f")[k], 6).alias(n)
    return f.select("survey_id", "track_id", "obs_no", "i", pick(0, "dx"), pick(2, "w"), pick(5, "dt"), pick(6, "vx"), pick(8, "heading"))


CVF = OBS + """, l as (select *, first_value(t) over w4 as ft, first_value(x) over w4 as fx, first_value(y) over w4 as fy, lag(t) over w as pt from oo window w as (partition by survey_id, track_id order by obs_no), w4 as (partition by survey_id, track_id order by obs_no rows between 3 preceding and current row)),
fc as (select survey_id, track_id, obs_no, t, k as step, x + case when pt is not null and t - ft > 0 then (x - fx) / (t - ft) * (t - pt) * k else 0 end as px, y + case when pt is not null and t - ft > 0 then (y - fy) / (t - ft) * (t - pt) * k else 0 end as py from l, range(1, 6) q(k))"""


@query("e10_cv_forecast", "fx_pred", sql=f"with {CVF} select survey_id, track_id, obs_no, step, round(px, 6) as px, round(py, 6) as py from fc")
def _(spark, sf):
    return tr.cv_forecast(observations(spark, sf)).select("survey_id", "track_id", "obs_no", "step", r("px"), r("py"))


@query("e11_track_snapshot", "fx_pred", sql=f"""with {OBS}, s as (select *, lag(t) over w as pt, lag(x) over w as px, lag(y) over w as py, count(*) over (partition by survey_id, track_id) as hits from oo window w as (partition by survey_id, track_id order by obs_no))
select survey_id, track_id, x, y, confidence, vx, vy, hits, case when hits >= 3 then 'confirmed' else 'tentative' end as state from (select survey_id, track_id, x, y, conf as confidence, round(coalesce((x - px) / (t - pt), 0), 6) as vx, round(coalesce((y - py) / (t - pt), 0), 6) as vy, hits, obs_no from s) q where obs_no = hits - 1""")
def _(spark, sf):
    return tr.track_snapshot(observations(spark, sf)).select("survey_id", "track_id", "x", "y", "confidence", r("vx"), r("vy"), "hits", "state")


def assignments(spark, sf):
    return t.pred(spark, sf).selectExpr("case when pred_id % 9 = 0 then -1 else source_gt % 499 end as gt_id", "image_id as frame_id", "case when pred_id % 13 = 0 then source_gt % 499 + 1 else source_gt % 499 end as track_id", "pred_id as det_id")


@query("e12_tracking_metrics", "fx_pred", sql="""
with a as (select case when pred_id % 9 = 0 then -1 else source_gt % 499 end as gt_id, image_id as frame_id, case when pred_id % 13 = 0 then source_gt % 499 + 1 else source_gt % 499 end as track_id, pred_id as det_id from fx_pred),
s as (select gt_id, count(*) filter (p <> track_id) as sw from (select gt_id, track_id, lag(track_id) over (partition by gt_id order by frame_id, det_id) as p from a where gt_id >= 0) q group by 1),
v as (select gt_id, max(n) * 1e0 / sum(n) as dom, count(*) - 1 as frag from (select gt_id, track_id, count(*) as n from a where gt_id >= 0 group by 1, 2) q group by 1),
t as (select track_id, gt_id, count(*) as n, min(frame_id * 1000000000 + det_id) as met from a group by 1, 2), b as (select track_id, sum(n) as hits, arg_max(gt_id, (n, -met)) as g from t group by 1)
select count(*) as n_gt_tracks, cast(sum(sw) as bigint) as id_switches, round(avg(dom), 6) as track_continuity, cast(sum(frag) as bigint) as fragmentations, round(avg(cast(dom >= 0.8e0 and sw = 0 as int)), 6) as success_rate,
 (select count(*) from b where hits >= 3) as total_tracks, (select round(avg(cast(g = -1 as int)), 6) from b where hits >= 3) as false_track_rate from s join v using (gt_id)""")
def _(spark, sf):
    return tr.tracking_metrics(assignments(spark, sf)).select("n_gt_tracks", "id_switches", r("track_continuity"), "fragmentations", r("success_rate"), "total_tracks", r("false_track_rate"))


@query("e12_tracking_per_survey", "fx_pred", sql="""
with a as (select pred_id % 3 as survey_id, case when pred_id % 9 = 0 then -1 else source_gt % 97 end as gt_id, image_id as frame_id, case when pred_id % 13 = 0 then source_gt % 97 + 1 else source_gt % 97 end as track_id, pred_id as det_id from fx_pred),
s as (select survey_id, gt_id, count(*) filter (p <> track_id) as sw from (select survey_id, gt_id, track_id, lag(track_id) over (partition by survey_id, gt_id order by frame_id, det_id) as p from a where gt_id >= 0) q group by 1, 2),
v as (select survey_id, gt_id, max(n) * 1e0 / sum(n) as dom, count(*) - 1 as frag from (select survey_id, gt_id, track_id, count(*) as n from a where gt_id >= 0 group by 1, 2, 3) q group by 1, 2),
t as (select survey_id, track_id, gt_id, count(*) as n, min(frame_id * 1000000000 + det_id) as met from a group by 1, 2, 3), b as (select survey_id, track_id, sum(n) as hits, arg_max(gt_id, (n, -met)) as g from t group by 1, 2)
select count(*) as n_gt_tracks, cast(sum(sw) as bigint) as id_switches, round(avg(dom), 6) as track_continuity, cast(sum(frag) as bigint) as fragmentations, round(avg(cast(dom >= 0.8e0 and sw = 0 as int)), 6) as success_rate,
 (select count(*) from b where hits >= 3) as total_tracks, (select round(avg(cast(g = -1 as int)), 6) from b where hits >= 3) as false_track_rate from s join v using (survey_id, gt_id)""")
def _(spark, sf):
    a = t.pred(spark, sf).selectExpr("pred_id % 3 as survey_id", "case when pred_id % 9 = 0 then -1 else source_gt % 97 end as gt_id", "image_id as frame_id",
                                     "case when pred_id % 13 = 0 then source_gt % 97 + 1 else source_gt % 97 end as track_id", "pred_id as det_id")
    return tr.tracking_metrics(a, keys=["survey_id"]).select("n_gt_tracks", "id_switches", r("track_continuity"), "fragmentations", r("success_rate"), "total_tracks", r("false_track_rate"))


@query("e13_overfit_check", sql="""with l as (select event_type as run_id, event_id as epoch, value / 100e0 as tl, (value + event_id % 40) / 90e0 as vl, row_number() over (partition by event_type order by event_id) - 1 as i, count(*) over (partition by event_type) as n from events)
select run_id, round(regr_slope(vl, i), 8) as val_slope, round(regr_slope(tl, i), 8) as train_slope, cast(regr_slope(vl, i) > 0.005e0 and regr_slope(tl, i) < -0.002e0 as int) as overfit from l where i >= n - greatest(3, floor(n * 0.25e0)) group by 1""")
def _(spark, sf):
    log = t.base(spark, sf, "events").selectExpr("event_type as run_id", "event_id as epoch", "value / 100D as train_box_loss", "(value + event_id % 40) / 90D as val_box_loss")
    return tr.overfit_check(log).select("run_id", r("val_slope", 8), r("train_slope", 8), F.col("overfit").cast("int").alias("overfit"))


def frame_obs(spark, sf):
    o = observations(spark, sf).withColumn("t", F.col("obs_no").cast("double"))
    return o, o.filter("pred_id % 17 <> 0").select("survey_id", "track_id", F.col("obs_no").alias("frame"), F.col("x").alias("tx"), F.col("y").alias("ty"))


@query("e14_training_windows", "fx_pred", sql=f"""with {OBS}, j as (select o.survey_id, o.track_id, o.obs_no, k, r.x - o.x as dx, r.y - o.y as dy from oo o, range(1, 6) q(k), oo r where o.obs_no >= 2 and r.survey_id = o.survey_id and r.track_id = o.track_id and r.obs_no = o.obs_no + k and r.pred_id % 17 <> 0)
select survey_id, track_id, obs_no, sum(dx) as sx, sum(dy * k) as sy from j group by 1, 2, 3 having count(*) = 5""")
def _(spark, sf):
    o, truth = frame_obs(spark, sf)
    w = tr.training_windows(o, truth)
    return w.select("survey_id", "track_id", "obs_no", F.aggregate("dx", F.lit(0.0), lambda a, v: a + v).alias("sx"),
                    F.aggregate(F.transform("dy", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v).alias("sy"))


@query("d22_forecast_errors", "fx_pred", sql=f"""with {CVF}, tr as (select survey_id, track_id, obs_no, x as tx, y as ty from oo), e as (select f.step, px - tx as dx, py - ty as dy from fc f join tr on tr.survey_id = f.survey_id and tr.track_id = f.track_id and tr.obs_no = f.obs_no + f.step)
select round(avg((abs(dx) + abs(dy)) / 2) filter (step = 1), 6) as mae_step1, round(sqrt(avg((dx * dx + dy * dy) / 2) filter (step = 1)), 6) as rmse_step1, round(avg((abs(dx) + abs(dy)) / 2), 6) as mae_horizon,
 round(sqrt(avg((dx * dx + dy * dy) / 2)), 6) as rmse_horizon, round(avg(sqrt(dx * dx + dy * dy)), 6) as ade, round(avg(sqrt(dx * dx + dy * dy)) filter (step = 5), 6) as fde from e""")
def _(spark, sf):
    o = observations(spark, sf)
    fc = tr.cv_forecast(o)
    truth = o.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("survey_id", "track_id", (F.col("obs_no") - F.col("step")).alias("obs_no"), "step", F.col("x").alias("tx"), F.col("y").alias("ty"))
    e = tr.forecast_errors(fc, truth, ["survey_id", "track_id", "obs_no"])
    return e.select(*[r(c) for c in e.columns])


@query("t01_track")
def _(spark, sf):
    d = named(t.det(spark, sf)).withColumns({"x": F.expr("(x1 + x2) / 2"), "y": F.expr("(y1 + y2) / 2")})
    return tr.track(d.select("survey_id", "frame_id", "det_id", "x", "y", "class_name")).select("survey_id", "frame_id", "det_id", "track_id", "hits")


# ---- review -----------------------------------------------------------------------------------------------------------------

def queue(spark, sf):
    return rv.enqueue(named(t.det(spark, sf)))


def actions(spark, sf):
    return t.det(spark, sf).filter("det_id % 2 = 0").selectExpr(
        "concat('sample_', cast(det_id as string)) as id", "case when det_id % 3 = 0 then 'RELABEL' when det_id % 3 = 1 then 'CONFIRM' else 'REJECT' end as action", "'can' as corrected_class", "'' as operator_notes")


ACT = f"""q as (select det_id, 'sample_' || det_id as id, {NAMED} as class_name, conf, latitude from fx_det),
ac as (select id, class_name, case when det_id % 3 = 0 then 'RELABEL' when det_id % 3 = 1 then 'CONFIRM' else 'REJECT' end as action from q where det_id % 2 = 0),
ar as (select id, action, case when action = 'RELABEL' then 'can' else class_name end as final_class from ac)"""


@query("r01_enqueue", "fx_det", sql=f"with {ACT} select id, class_name, conf as confidence, 'MODERATE' as uncertainty_flag, round(coalesce(latitude, 13.0827e0), 6) as latitude, 'PENDING' as status from q")
def _(spark, sf):
    return queue(spark, sf).select("id", "class_name", "confidence", "uncertainty_flag", r("latitude"), "status")


@query("f04_pending_queue", "fx_det", sql=f"with {ACT} select id, status from (select id, case when det_id % 5 = 0 then 'REVIEWED' else 'PENDING' end as status from q) z where status = 'PENDING'")
def _(spark, sf):
    q = queue(spark, sf).withColumn("status", F.expr("case when cast(substring(id, 8) as bigint) % 5 = 0 then 'REVIEWED' else status end"))
    return rv.pending_queue(q).select("id", "status")


@query("r02_apply_reviews", "fx_det", sql=f"with {ACT} select id, action, final_class, 'REVIEWED' as status from ar union all select id, null, null, 'PENDING' from q where det_id % 2 <> 0")
def _(spark, sf):
    left, done = rv.apply_reviews(queue(spark, sf), actions(spark, sf))
    return done.select("id", "action", "final_class", "status").unionByName(left.select("id", "status"), allowMissingColumns=True)


@query("d04_archive_stats", "fx_det", sql=f"with {ACT} select count(*) as total_reviewed, count(*) filter (action = 'CONFIRM') as confirmed, count(*) filter (action = 'RELABEL') as relabeled, count(*) filter (action = 'REJECT') as rejected from ar")
def _(spark, sf):
    return rv.archive_stats(rv.apply_reviews(queue(spark, sf), actions(spark, sf))[1])


@query("r03_update_review", "fx_det", sql=f"""select det_id, case when det_id % 4 = 0 then 'CONFIRMED' else 'UNREVIEWED' end as reviewed_status, case when det_id % 8 = 0 then 'can' else {NAMED} end as class_name from fx_det""")
def _(spark, sf):
    d = named(t.det(spark, sf))
    u = d.filter("det_id % 4 = 0").selectExpr("det_id", "'CONFIRMED' as status", "case when det_id % 8 = 0 then 'can' else '' end as corrected_class")
    return rv.update_review(d, u).select("det_id", "reviewed_status", "class_name")


@query("r04_training_set", "fx_det", sql=f"with {ACT} select id, case final_class when 'bottle' then 1 when 'can' then 2 else 0 end as label_idx from ar where action <> 'REJECT'")
def _(spark, sf):
    return rv.training_set(rv.apply_reviews(queue(spark, sf), actions(spark, sf))[1], ["tire", "bottle", "can"]).select("id", "label_idx")


@query("r05_uncertainty_flag", "fx_det", sql="select det_id, case when mc_variance < 0.02e0 then 'LOW' when mc_variance < 0.045e0 then 'MODERATE' else 'HIGH' end as uncertainty_flag from fx_det where mc_variance >= 0.045e0")
def _(spark, sf):
    from sonarlake.operators.detections import uncertainty_flag
    return uncertainty_flag(t.det(spark, sf)).filter("uncertainty_flag = 'HIGH'").select("det_id", "uncertainty_flag")


# ---- exports and stores -----------------------------------------------------------------------------------------------------

def export_rows(spark, sf):
    return named(t.det(spark, sf)).withColumns({
        "run_id": F.lit("run1"), "bbox": F.array("x1", "y1", "x2", "y2"), "model_version": F.create_map(F.lit("tracker"), F.lit("t@1"), F.lit("detector"), F.lit("d@2")), "confidence": F.col("conf")})


@query("a17_export_csv", "fx_det", sql=f"""select survey_id, 'run1' as run_id, frame_id, null as timestamp, {NAMED} as class_name, detection_type, conf as confidence, x1, y1, x2, y2, null as mask_area_px, null as anomaly_score, null as reconstruction_error, track_id,
 round(latitude, 6) as latitude, round(longitude, 6) as longitude, null as positional_uncertainty_m, null as snr_db, null as scqi, '{{"detector":"d@2","tracker":"t@1"}}' as model_version, null as config_hash from fx_det""")
def _(spark, sf):
    path, rows = scratch(spark, "csv"), export_rows(spark, sf)
    ex.export_csv(rows, path)
    c = spark.read.schema(ex.csv_rows(rows).schema).option("header", True).option("escape", "\\").csv(path)
    return c.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


@query("a18_export_json", "fx_det", sql="""select det_id, '{"det_id":' || det_id || ',"detection_type":"' || detection_type || '","track_id":' || coalesce(cast(track_id as varchar), 'null') || '}' as value from fx_det""")
def _(spark, sf):
    path = scratch(spark, "json")
    n = ex.export_json(t.det(spark, sf).select("det_id", "detection_type", "track_id"), path)
    rows = spark.read.text(path)
    assert spark.read.text(path + "_summary").first().value == f'{{"count":{n}}}'
    return rows.select(F.get_json_object("value", "$.det_id").cast("bigint").alias("det_id"), "value")


@query("a19_export_geojson", "fx_det", sql="""select '{"det_id":' || det_id || ',"detection_type":"' || detection_type || '"}' as props, cast(round(longitude * 100000) as bigint) as lon5, cast(round(latitude * 100000) as bigint) as lat5, 'Feature' as type from fx_det where latitude is not null""")
def _(spark, sf):
    path = scratch(spark, "geojson")
    ex.export_geojson(t.det(spark, sf).select("det_id", "detection_type", "latitude", "longitude"), path)
    f = spark.read.text(path)
    num = lambda p: F.round(F.get_json_object("value", p).cast("double") * 100000).cast("bigint")
    return f.select(F.get_json_object("value", "$.properties").alias("props"), num("$.geometry.coordinates[0]").alias("lon5"), num("$.geometry.coordinates[1]").alias("lat5"),
                    F.get_json_object("value", "$.type").alias("type"))


@query("a20_survey_csv", "fx_det", sql=f"""with n as (select *, row_number() over (order by det_id) as id from fx_det)
select id, id || ',"' || {NAMED} || '",' || printf('%.3f', conf) || ',LOW,' || printf('%.6f', latitude) || ',' || printf('%.6f', longitude) || ',0.00,Port,0.00,0.00,"survey"' as value from n where latitude is not null""")
def _(spark, sf):
    path = scratch(spark, "survey-csv")
    ex.export_survey(named(t.det(spark, sf)), path, ["det_id"], form="csv")
    return spark.read.text(path).select(F.regexp_extract("value", "^[0-9]+", 0).cast("bigint").alias("id"), "value")


@query("a20_survey_geojson", "fx_det", sql=f"with n as (select *, row_number() over (order by det_id) as id from fx_det) select id, {NAMED} as class_name, 'LOW' as flag, cast(id as varchar) as pid from n where latitude is not null")
def _(spark, sf):
    path = scratch(spark, "survey-geojson")
    ex.export_survey(named(t.det(spark, sf)), path, ["det_id"])
    f = spark.read.text(path)
    g = lambda p: F.get_json_object("value", p)
    return f.select(g("$.properties.id").cast("bigint").alias("id"), g("$.properties.class_name").alias("class_name"), g("$.properties.uncertainty_flag").alias("flag"), g("$.properties.id").alias("pid"))


@query("a21_sql_dump", "fx_det", sql="""select 'INSERT INTO marine_debris_detections (mission_id, class_name, confidence, fused_confidence, uncertainty_flag, uncertainty_variance, ground_range_m, channel, error_ellipse_a, error_ellipse_b, error_ellipse_phi, geom) VALUES (''mission_default'', ''diver''''s '
 || class_id || ''', ' || printf('%.3f', conf) || ', ' || printf('%.3f', conf) || ', ''LOW'', 0.0000, 0.00, ''Port'', 5.00, 5.00, 0.0, ST_SetSRID(ST_MakePoint(' || printf('%.6f', longitude) || ', ' || printf('%.6f', latitude) || '), 4326));' as value from fx_det where latitude is not null""")
def _(spark, sf):
    path = scratch(spark, "dump")
    ex.export_sql_dump(t.det(spark, sf).withColumn("class_name", F.concat(F.lit("diver's "), F.col("class_id").cast("string"))), path)
    return spark.read.text(path)


def scratch(spark, name):
    import uuid

    from sonarlake.plans.durable import shared_dir
    return f"{shared_dir(spark)}/sonarlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("a22_save_run", "fx_det", sql="select det_id, survey_id, frame_id, case when survey_id = 3 then 'again' else 'first' end as run_id from fx_det")
def _(spark, sf):
    path = scratch(spark, "store")
    d = t.det(spark, sf).select("det_id", "survey_id", "frame_id", "detection_type", F.lit("first").alias("run_id"))
    ex.save_surveys(d, path)
    ex.save_run(d.filter("survey_id = 3"), 3, "again", path)
    ex.save_run(d.filter("survey_id = 3"), 3, "again", path)
    return ex.load_detections(spark, path, ordered=False).select("det_id", F.col("survey_id").cast("bigint").alias("survey_id"), "frame_id", "run_id")


@query("a23_load_detections", "fx_det", sql="select det_id, frame_id from fx_det where survey_id = 5 and detection_type = 'known'")
def _(spark, sf):
    path = scratch(spark, "store")
    ex.save_surveys(t.det(spark, sf), path)
    return ex.load_detections(spark, path, survey_id=5, detection_type="known").select("det_id", "frame_id")


@query("a24_upsert_missions", sql="""select c_custkey as mission_id, case when c_custkey % 3 = 0 then 'new' else 'old' end as mission_name from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""")
def _(spark, sf):
    c = t.base(spark, sf, "customer").select(F.col("c_custkey").alias("mission_id"))
    return ex.upsert_missions(c.filter("mission_id % 2 = 0").withColumn("mission_name", F.lit("old")), c.filter("mission_id % 3 = 0").withColumn("mission_name", F.lit("new")))


@query("a24_insert_missions", sql="""select c_custkey as mission_id, case when c_custkey % 2 = 0 then 'old' else 'new' end as mission_name from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""")
def _(spark, sf):
    c = t.base(spark, sf, "customer").select(F.col("c_custkey").alias("mission_id"))
    return ex.upsert_missions(c.filter("mission_id % 2 = 0").withColumn("mission_name", F.lit("old")), c.filter("mission_id % 3 = 0").withColumn("mission_name", F.lit("new")), "ignore")


@query("a25_mission_detections", "fx_det", sql="""select 'm' || c_custkey as mission_id, coalesce(n, 0) as total_detections, coalesce(z, 0) as zeros from customer left join (select survey_id, count(*) as n, count(*) filter (latitude is null) as z from fx_det group by 1) q on survey_id = c_custkey""")
def _(spark, sf):
    path = scratch(spark, "missions")
    ex.save_mission_detections(t.det(spark, sf), path, F.concat(F.lit("m"), F.col("survey_id").cast("string")))
    rows = spark.read.parquet(path)
    missions = t.base(spark, sf, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("mission_id"))
    z = rows.groupBy("mission_id").agg(F.count_if(F.col("latitude") == 0).alias("zeros"))
    return ex.recount_missions(missions, rows).join(z, "mission_id", "left").na.fill(0, ["zeros"])


@query("a14_run_logs", sql="select event_type as stage, user_id % 7 as run_id, count(*) as n, round(sum(value), 4) as seconds from events group by 1, 2")
def _(spark, sf):
    path = scratch(spark, "runs")
    ex.write_run_log(t.base(spark, sf, "events").selectExpr("event_type as stage", "cast(event_id as double) as started", "value as seconds", "true as ok", "map('k', props) as summary", "user_id % 7 as run_id"), path)
    return ex.read_run_logs(spark, path).groupBy("stage", F.col("run_id").cast("bigint").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"))


@query("a10_check_inputs", "fx_images", sql="""with f as (select image_id, case when image_id % 3 = 0 then name when image_id % 3 = 1 then replace(name, '.png', '.xtf') else replace(name, '.png', '.doc') end as path, case when image_id % 11 = 0 then 0 when image_id % 13 = 0 then 2000000000 else size_bytes end as length from fx_images)
select image_id, case when path like '%.png' then 'image' when path like '%.xtf' then 'sonar_log' end as kind, case when path like '%.doc' then 'unsupported extension' when length = 0 then 'empty file' when length > 1073741824 then 'file too large' end as problem from f""")
def _(spark, sf):
    f = t.images(spark, sf).selectExpr("image_id", "case when image_id % 3 = 0 then name when image_id % 3 = 1 then replace(name, '.png', '.xtf') else replace(name, '.png', '.doc') end as path",
                                       "case when image_id % 11 = 0 then 0 when image_id % 13 = 0 then 2000000000 else size_bytes end as length")
    return fl.check_inputs(f).select("image_id", "kind", "problem")


@query("d18_compare_experiments", sql="""with e as (select 'run' || user_id % 9 as experiment, event_type as c, max(value) / 200e0 as v from events group by 1, 2)
select experiment, round(max(v) filter (c = 'click'), 6) as click, round(max(v) filter (c = 'view'), 6) as view from e group by 1""")
def _(spark, sf):
    e = t.base(spark, sf, "events").groupBy(F.expr("concat('run', cast(user_id % 9 as string))").alias("experiment"), F.col("event_type").alias("class_name")).agg((F.max("value") / 200).alias("map50"))
    return tl.pivot_class_metrics(e, ["click", "view"]).select("experiment", r("click"), r("view"))


@query("s24_content_version", sql="select doc_id, 'doc@' || substring(sha256(text), 1, 10) as version from documents")
def _(spark, sf):
    d = t.base(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"), F.length("text").alias("length"))
    return ex.file_versions(d, "doc").withColumnRenamed("path", "doc_id")


@query("s26_header_epoch", sql="""with h as (select event_id, 2000 + event_id % 40 as y, 1 + event_id % 13 as mo, 1 + event_id % 31 as d, event_id % 25 as hh, event_id % 60 as mi, event_id % 61 as s, event_id % 100 as hs from events)
select event_id, case when try_cast(printf('%04d-%02d-%02d', y, mo, d) as date) is not null and hh < 24 and mi < 60 and s < 60 then cast(epoch(cast(try_cast(printf('%04d-%02d-%02d', y, mo, d) as date) as timestamp)) + hh * 3600 + mi * 60 + s as double) + hs / 100e0 end as epoch_s from h""")
def _(spark, sf):
    from sonarlake.sources.logs import header_epoch
    h = t.base(spark, sf, "events").selectExpr("event_id", "2000 + event_id % 40 as year", "1 + event_id % 13 as month", "1 + event_id % 31 as day", "event_id % 25 as hour", "event_id % 60 as minute", "event_id % 61 as second", "event_id % 100 as hsecond")
    return header_epoch(h).select("event_id", "epoch_s")
