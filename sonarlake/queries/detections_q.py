"""Detection filters, boxes, summaries, ranking and fusion queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from sonarlake.functions import scores as sc
from sonarlake.operators import detections as d
from sonarlake.operators import frames as fr
from sonarlake.operators import fusion as fu

from . import tables as t
from .registry import query

IOU = ("(case when (({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1) - "
       "greatest(0e0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0e0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))) > 0 then "
       "greatest(0e0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0e0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) / "
       "(({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1) - "
       "greatest(0e0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0e0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))) else 0e0 end)")


def iou_sql(a: str, b: str) -> str:
    return IOU.format(a=a, b=b)


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@query("b03_filter_detections", "fx_det", sql="select det_id from fx_det where conf * 100e0 >= 40 and class_id in (1, 3)")
def _(spark, sf):
    return d.filter_detections(t.det(spark, sf), 40, [1, 3], "class_id").select("det_id")


@query("b04_filter_view", "fx_det", sql="""
select det_id, class_name from (select *, case class_id when 0 then 'tire' when 1 then 'bottle' when 2 then 'valve' when 3 then 'can' else 'Shipwrecks' end as class_name from fx_det) q
where class_name in ('bottle', 'can') and conf >= 0.35e0""")
def _(spark, sf):
    return d.filter_view(named(t.det(spark, sf)), "debris and containers").select("det_id", "class_name")


def named(df):
    """Class names for the five numeric classes of the derived tables."""
    names = F.create_map(*[F.lit(x) for k, v in enumerate(["tire", "bottle", "valve", "can", "Shipwrecks"]) for x in (k, v)])
    return df.withColumn("class_name", F.element_at(names, F.col("class_id").cast("int")))


NAMED = "case class_id when 0 then 'tire' when 1 then 'bottle' when 2 then 'valve' when 3 then 'can' else 'Shipwrecks' end"


@query("b05_select_records", "fx_det", sql="select det_id from fx_det where survey_id = 3 and detection_type = 'unknown'")
def _(spark, sf):
    return d.select_records(t.det(spark, sf), survey_id=3, detection_type="unknown").select("det_id")


@query("b07_result_view_summary", "fx_det", sql="""
select count(*) as detections, count(*) filter (detection_type = 'known') as known, count(*) filter (detection_type = 'unknown') as unknown from fx_det""")
def _(spark, sf):
    return d.result_view(t.det(spark, sf), "summary")


@query("b07_result_view_slim", "fx_det", sql="select det_id, survey_id, conf from fx_det")
def _(spark, sf):
    full = t.det(spark, sf).select("det_id", "survey_id", "conf", F.array(F.array("x1", "y1")).alias("segmentation_mask"))
    return d.result_view(full, "slim")


@query("b08_flatten_bbox", "fx_det", sql="select det_id, x1, y1, x2, y2 from fx_det")
def _(spark, sf):
    return d.flatten_bbox(t.det(spark, sf).select("det_id", F.array("x1", "y1", "x2", "y2").alias("bbox")))


@query("b09_to_global", "fx_det", sql="""
select det_id, y1 + (frame_id % 40) * 192 as y1, y2 + (frame_id % 40) * 192 as y2, (y1 + y2) / 2 + (frame_id % 40) * 192 as cy, y2 + (frame_id % 40) * 192 as py from fx_det""")
def _(spark, sf):
    det = t.det(spark, sf).withColumn("cy", F.expr("(y1 + y2) / 2")).withColumn("polygon", F.expr("array(array(x1, y1), array(x2, y2))"))
    fl = det.select("survey_id", "frame_id").distinct().withColumn("y0", F.expr("(frame_id % 40) * 192"))
    return fr.to_global(det, fl).select("det_id", "y1", "y2", "cy", F.col("polygon")[1][1].alias("py"))


@query("b10_keep_at", "fx_pred", sql="""
select pred_id from fx_pred where conf >= 0.8e0 or coalesce(anomaly_score, 0) >= 0.5e0 or conf >= 0.45e0""")
def _(spark, sf):
    p = t.pred(spark, sf).withColumn("detection_type", F.when(F.col("conf") >= 0.8, "known").otherwise("unknown"))
    return d.keep_at(p, 0.45).select("pred_id")


@query("b11_confirmed_tracks", "fx_det", sql="""
with s as (select survey_id, track_id, count(*) as hits from fx_det where track_id is not null group by 1, 2),
f as (select survey_id, count(distinct frame_id) = 1 as single from fx_det group by 1)
select s.survey_id, s.track_id, s.hits from s join f using (survey_id) where s.hits >= 3 or f.single""")
def _(spark, sf):
    det = t.det(spark, sf)
    snap = det.filter("track_id is not null").groupBy("survey_id", "track_id").agg(F.count(F.lit(1)).alias("hits")).withColumn(
        "state", F.expr("case when hits >= 3 then 'confirmed' else 'tentative' end"))
    return d.confirmed_tracks(snap, det.select("survey_id", "frame_id").distinct()).drop("state")


@query("b12_pad_bbox", "fx_pred", sql="select pred_id, greatest(0e0, x1 - 8) as px1, greatest(0e0, y1 - 8) as py1, least(400e0, x2 + 8) as px2, least(300e0, y2 + 8) as py2 from fx_pred")
def _(spark, sf):
    return d.pad_bbox(t.pred(spark, sf), 8, 400, 300).select("pred_id", "px1", "py1", "px2", "py2")


@query("b13_expand_bbox", "fx_pred", sql="""
with a as (select pred_id, greatest(0e0, floor(x1 - greatest(1e0, x2 - x1) * 0.25e0)) as rx1, greatest(0e0, floor(y1 - greatest(1e0, y2 - y1) * 0.25e0)) as ry1,
 least(200e0, ceil(x2 + greatest(1e0, x2 - x1) * 0.25e0)) as rx2, least(150e0, ceil(y2 + greatest(1e0, y2 - y1) * 0.25e0)) as ry2 from fx_pred)
select pred_id, rx1, ry1, case when rx2 <= rx1 then least(200e0, rx1 + 1) else rx2 end as rx2, case when ry2 <= ry1 then least(150e0, ry1 + 1) else ry2 end as ry2 from a""")
def _(spark, sf):
    return d.expand_bbox(t.pred(spark, sf), 0.25, 200, 150).select("pred_id", "rx1", "ry1", "rx2", "ry2")


@query("b14_adaptive_padding", "fx_pred", sql="""
select pred_id, case when mc_variance >= 0.045e0 or snr_db < 8 or conf < 0.35e0 then 0.5e0 when conf >= 0.7e0 and mc_variance < 0.02e0 and snr_db >= 12 then 0.1e0 else 0.25e0 end as padding from fx_pred""")
def _(spark, sf):
    p = d.uncertainty_flag(t.pred(spark, sf)).withColumnRenamed("uncertainty_flag", "uncertainty")
    return d.adaptive_padding(p).select("pred_id", "padding")


@query("b15_context_window", "fx_pred", sql="""
with a as (select pred_id, trunc(x1) as a1, trunc(y1) as b1, trunc(x2) as a2, trunc(y2) as b2 from fx_pred),
s as (select *, least(greatest(96, greatest(a2 - a1, b2 - b1) + 16), 300) as side from a),
w as (select *, least(400 - side, greatest(0, floor((a1 + a2) / 2) - floor(side / 2))) as wx1, least(300 - side, greatest(0, floor((b1 + b2) / 2) - floor(side / 2))) as wy1 from s)
select pred_id, cast(wx1 as bigint) as wx1, cast(wy1 as bigint) as wy1, cast(wx1 + side as bigint) as wx2, cast(wy1 + side as bigint) as wy2 from w""")
def _(spark, sf):
    return d.context_window(t.pred(spark, sf), 96, 8, 400, 300).select("pred_id", *[F.col(c).cast("bigint").alias(c) for c in ("wx1", "wy1", "wx2", "wy2")])


@query("b16_roi_quality", "fx_pred", "fx_cells", sql="""
with roi as (select pred_id as roi_id, source_gt % 2 as survey_id, cast(least(60, greatest(0, x1 - 60)) as bigint) as x1, cast(greatest(0, y1) as bigint) as y1,
 cast(least(64, x2 - 60) as bigint) as x2, cast(least(250, y2) as bigint) as y2 from fx_pred),
big as (select * from roi where x2 > x1 and y2 > y1),
st as (select roi_id, stddev_pop(v) as sd from big b join fx_cells c on c.survey_id = b.survey_id and c.ping >= b.y1 and c.ping < b.y2 and c.col >= b.x1 and c.col < b.x2 group by roi_id)
select r.roi_id, case when x2 <= x1 or y2 <= y1 then 0e0 when x2 - x1 < 10 or y2 - y1 < 10 then 0.2e0 when coalesce(sd, 0) < 3 then 0.3e0
 else round(greatest(0.4e0, 1 - 0.15e0 * (cast(x1 = 0 as int) + cast(y1 = 0 as int) + cast(x2 = 64 as int) + cast(y2 = 250 as int))), 4) end as quality from roi r left join st using (roi_id)""")
def _(spark, sf):
    p = t.pred(spark, sf)
    rois = p.selectExpr("pred_id as roi_id", "source_gt % 2 as survey_id", "cast(least(60, greatest(0, x1 - 60)) as int) as x1", "cast(greatest(0, y1) as int) as y1",
                        "cast(least(64, x2 - 60) as int) as x2", "cast(least(250, y2) as int) as y2")
    return d.roi_quality(rois, t.waterfall(spark, sf), 64, 250).select("roi_id", r("quality", 4))


@query("b17_to_pixels", "fx_pred", sql="""
with l as (select pred_id, (pred_id % 90) / 100e0 as cx, (source_gt % 90) / 100e0 as cy, (pred_id % 40) / 100e0 as w, (source_gt % 30) / 100e0 as h from fx_pred)
select pred_id, round((cx - w / 2) * 640, 6) as x1, round((cy - h / 2) * 480, 6) as y1, round((cx + w / 2) * 640, 6) as x2, round((cy + h / 2) * 480, 6) as y2 from l""")
def _(spark, sf):
    lab = t.pred(spark, sf).selectExpr("pred_id", "(pred_id % 90) / 100D as cx", "(source_gt % 90) / 100D as cy", "(pred_id % 40) / 100D as w", "(source_gt % 30) / 100D as h")
    return d.to_pixels(lab, 640, 480).select("pred_id", r("x1"), r("y1"), r("x2"), r("y2"))


@query("s22_polygon_ratio", "fx_pred", sql="""
select pred_id, round(((x2 - x1) * (y2 - y1) - (x2 - x1) * (y2 - y1) / 8) / ((x2 - x1) * (y2 - y1)), 6) as area_ratio from fx_pred""")
def _(spark, sf):
    p = t.pred(spark, sf).withColumn("polygon", F.expr("array(array(x1, y1), array((x1 + x2) / 2, y1), array(x2, (y1 + y2) / 2), array(x2, y2), array(x1, y2))"))
    return d.polygon_ratio(p).select("pred_id", r("area_ratio"))


# ---- summaries ----------------------------------------------------------------------------------------------------------

@query("d01_run_summary", "fx_det", "fx_frames", sql="""
with f as (select survey_id, count(*) as frames from fx_frames group by 1),
d as (select survey_id, count(*) as detections, count(*) filter (detection_type = 'known') as known, count(*) filter (detection_type = 'unknown') as unknown, count(distinct track_id) as tracks from fx_det group by 1)
select f.survey_id, frames, coalesce(detections, 0) as detections, coalesce(known, 0) as known, coalesce(unknown, 0) as unknown, coalesce(tracks, 0) as tracks from f left join d using (survey_id)""")
def _(spark, sf):
    det = t.det(spark, sf)
    return d.run_summary(det, det, t.frames(spark, sf))


@query("d05_tier_counts", "fx_pred", sql="""
select count(*) as total, count(*) filter (conf >= 0.75e0) as confirmed, count(*) filter (conf >= 0.45e0 and conf < 0.75e0) as probable, count(*) filter (conf < 0.45e0) as uncertain from fx_pred""")
def _(spark, sf):
    p = t.pred(spark, sf).withColumn("tier", F.expr("case when conf >= 0.75D then 'confirmed' when conf >= 0.45D then 'PROBABLE' else 'Uncertain' end"))
    return d.tier_counts(p)


@query("d10_mission_counts", "fx_det", sql="select survey_id, count(*) as total_detections from fx_det group by survey_id")
def _(spark, sf):
    return d.mission_counts(t.det(spark, sf), "survey_id")


@query("d11_unique_objects", "fx_det", sql="""
select det_id, conf from (select *, row_number() over (partition by survey_id, track_id order by conf desc, det_id) as rn from fx_det) q where track_id is null or rn = 1""")
def _(spark, sf):
    return d.unique_objects(t.det(spark, sf)).select("det_id", "conf")


@query("d12_track_lines", "fx_det", sql="""
with p as (select *, row_number() over (partition by survey_id, track_id order by frame_id, det_id) - 1 as i from fx_det where track_id is not null and latitude is not null),
q as (select survey_id, track_id, i // 3 as part, i, longitude, latitude from p union all select survey_id, track_id, i // 3 - 1, i, longitude, latitude from p where i > 0 and i % 3 = 0)
select survey_id, track_id, part, string_agg(cast(round(longitude * 100000) as bigint) || ' ' || cast(round(latitude * 100000) as bigint), ',' order by i) as line from q group by 1, 2, 3 having count(*) > 1""")
def _(spark, sf):
    lines = d.track_lines(t.det(spark, sf), ["frame_id", "det_id"], part_points=3)
    text = F.array_join(F.transform("line", lambda p: F.concat_ws(" ", F.round(p[0] * 100000).cast("bigint"), F.round(p[1] * 100000).cast("bigint"))), ",")
    return lines.select("survey_id", "track_id", "part", text.alias("line"))


def stage_logs(spark, sf):
    return t.base(spark, sf, "events").selectExpr("event_type as stage", "value / 100D as seconds")


@query("d13_stage_profile", sql="""
select event_type as stage, count(*) as calls, round(sum(value / 100e0), 6) as total_s, round(avg(value / 100e0), 6) as mean_s, round(sum(value) / (select sum(value) from events), 6) as share from events group by 1""")
def _(spark, sf):
    return d.stage_profile(stage_logs(spark, sf)).select("stage", "calls", r("total_s"), r("mean_s"), r("share"))


@query("d14_latency_profile", sql="""
select event_type as stage, count(*) as n, round(avg(value), 5) as mean_ms, round(stddev_pop(value), 5) as std_ms, min(value) as min_ms, max(value) as max_ms,
 round(quantile_cont(value, 0.5), 5) as p50_ms, round(quantile_cont(value, 0.95), 5) as p95_ms, round(1000 / avg(value), 5) as fps from events group by 1""")
def _(spark, sf):
    logs = t.base(spark, sf, "events").selectExpr("event_type as stage", "value as latency_ms")
    return d.latency_profile(logs, ["stage"]).select("stage", "n", r("mean_ms", 5), r("std_ms", 5), "min_ms", "max_ms", r("p50_ms", 5), r("p95_ms", 5), r("fps", 5))


@query("d15_map_view", "fx_det", sql="""
select survey_id, round(avg(latitude), 6) as center_lat, round(avg(longitude), 6) as center_lon, round(greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)), 6) as spread, 12e0 as zoom
from fx_det where latitude is not null group by 1""")
def _(spark, sf):
    return d.map_view(t.det(spark, sf), ["survey_id"]).select("survey_id", r("center_lat"), r("center_lon"), r("spread"), "zoom")


def tile_reports(spark, sf):
    return t.pings(spark, sf).selectExpr(
        "survey_id", "ping_id", "altitude_m as raw_snr_db", "slant_range_m as final_snr_db",
        "filter(array(case when event_id % 33 = 0 then 'low range' end, case when event_id % 50 = 0 then 'jump' end), x -> x is not null) as warnings")


@query("d16_merge_tile_reports", "fx_pings", sql="""
select survey_id, round(avg(altitude_m), 6) as raw_snr_db, round(avg(slant_range_m), 6) as final_snr_db, count(*) as tiles,
 concat_ws(',', max(case when event_id % 50 = 0 then 'jump' end), max(case when event_id % 33 = 0 then 'low range' end)) as warnings from fx_pings group by 1""")
def _(spark, sf):
    return d.merge_tile_reports(tile_reports(spark, sf)).select(
        "survey_id", r("raw_snr_db"), r("final_snr_db"), "tiles", F.array_join("warnings", ",").alias("warnings"))


@query("g03_distinct_sets", "fx_pings", sql="""
with x as (select survey_id, 'jump' as s from fx_pings where event_id % 50 = 0 union select survey_id, 'low range' from fx_pings where event_id % 33 = 0)
select survey_id, string_agg(s, ',' order by s) as warnings from x group by 1""")
def _(spark, sf):
    return d.distinct_sets(tile_reports(spark, sf), ["survey_id"], "warnings").withColumn("warnings", F.array_join("warnings", ","))


@query("d17_mc_uncertainty", "fx_passes", sql="""
with p as (select *, w / sum(w) over (partition by object_id, pass) as p from fx_passes),
c as (select object_id, class_idx, avg(p) as m, var_pop(p) as v from p group by 1, 2),
o as (select object_id, avg(v) as mv, sum(-m * ln(m + 1e-9)) as en from c group by 1),
b as (select *, row_number() over (partition by object_id order by m desc, class_idx) as rn from c)
select b.object_id, b.class_idx as pred_class, round(b.m, 6) as confidence, round(b.v, 8) as variance, round(mv, 8) as mean_variance, round(en, 6) as entropy,
 case when b.v < 0.015e0 and en < 1 then 'LOW' when b.v < 0.045e0 and en < 2 then 'MODERATE' else 'HIGH' end as uncertainty_flag from b join o using (object_id) where rn = 1""")
def _(spark, sf):
    return d.mc_uncertainty(t.passes(spark, sf)).select("object_id", "pred_class", r("confidence"), r("variance", 8), r("mean_variance", 8), r("entropy"), "uncertainty_flag")


@query("f01_top_anomalies", "fx_det", sql="""
select survey_id, frame_id, det_id, rank from (select *, row_number() over (partition by survey_id, frame_id order by conf desc, det_id) as rank from fx_det where detection_type = 'unknown') q where rank <= 4""")
def _(spark, sf):
    return d.top_k(t.det(spark, sf).filter("detection_type = 'unknown'"), ["survey_id", "frame_id"], 4).select("survey_id", "frame_id", "det_id", "rank")


@query("f05_nms", "fx_pred", sql=f"""with recursive o as (select *, row_number() over (partition by image_id order by conf desc, pred_id) as n from fx_pred),
k as (select b.image_id, b.pred_id, b.conf, b.n, coalesce(list(a.pred_id) filter (where a.pred_id is not null), []) as better
  from o b left join o a on a.image_id = b.image_id and a.n < b.n and {iou_sql('a', 'b')} > 0.35e0 group by all),
w(image_id, n, kept, pred_id, conf, ok) as (
 select distinct image_id, cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), cast(null as double), false from k
 union all select image_id, n, case when ok then list_append(kept, pred_id) else kept end, pred_id, conf, ok from (
  select k.image_id, k.n, w.kept, k.pred_id, k.conf, not list_has_any(k.better, w.kept) as ok from w join k on k.image_id = w.image_id and k.n = w.n + 1) q)
select image_id, pred_id, conf from w where ok""")
def _(spark, sf):
    boxes = t.pred(spark, sf).select("image_id", "pred_id", "conf", "x1", "y1", "x2", "y2")
    return d.nms(boxes, ["image_id"], "pred_id").select("image_id", "pred_id", "conf")


@query("g02_merge_tiles", "fx_det", sql="""
select det_id, y1 + (frame_id % 5) * 1024 as y1, y2 + (frame_id % 5) * 1024 as y2, (frame_id % 5) * 1024 as tile_start_row from fx_det""")
def _(spark, sf):
    det = t.det(spark, sf).withColumn("tile_id", F.expr("frame_id % 5"))
    tiles = det.select("survey_id", "tile_id").distinct().withColumn("y0", F.col("tile_id") * 1024)
    return fr.merge_tiles(det, tiles).select("det_id", "y1", "y2", "tile_start_row")


@query("a26_hazard_register", "fx_det", sql=f"""
with n as (select *, row_number() over (partition by survey_id order by det_id) as no, {NAMED} as cname from fx_det)
select survey_id, case when no < 10 then '#0' || no else '#' || no end as no, cname as class_name, case when conf >= 0.75e0 then 'CONFIRMED' else 'PROBABLE' end as tier, '1.8m x 0.7m' as size, '±1.2m x ±0.8m' as error from n""")
def _(spark, sf):
    det = named(t.det(spark, sf)).withColumn("confidence", F.col("conf")).withColumn("tier", F.expr("case when conf >= 0.75D then 'confirmed' end"))
    return d.hazard_register(det, ["det_id"]).select("survey_id", "no", "class_name", "tier", "size", "error")


@query("a26_hazard_kpis", "fx_det", "fx_frames", sql="""with q as (select survey_id, avg(scqi) as scqi from fx_frames where survey_id <> 3 group by survey_id)
select survey_id, count(*) as total, sum(cast(conf >= 0.75e0 as int)) as confirmed, sum(cast(conf >= 0.4e0 and conf < 0.75e0 as int)) as probable, sum(cast(conf < 0.4e0 and det_id % 2 = 0 as int)) as uncertain,
 round(coalesce(any_value(q.scqi), 82.5e0), 6) as scqi, case when any_value(q.scqi) < 49 then 'POOR' else 'GOOD' end as grade, cast(coalesce(any_value(q.scqi) < 49, false) as int) as again
from fx_det left join q using (survey_id) group by survey_id""")
def _(spark, sf):
    tier = F.expr("case when conf >= 0.75D then 'confirmed' when conf >= 0.4D then 'Probable' when det_id % 2 = 0 then 'UNCERTAIN' end")
    q = t.frames(spark, sf).filter("survey_id <> 3").groupBy("survey_id").agg(F.avg("scqi").alias("scqi"))
    q = q.withColumns({"grade": F.expr("case when scqi < 49 then 'POOR' else 'GOOD' end"), "resurvey_recommended": F.col("scqi") < 49})
    k = d.hazard_kpis(t.det(spark, sf).withColumn("tier", tier), q)
    return k.select("survey_id", "total", "confirmed", "probable", "uncertain", r("scqi"), "grade", F.col("resurvey_recommended").cast("int").alias("again"))


# ---- fusion -------------------------------------------------------------------------------------------------------------

def candidates(spark, sf):
    """Threshold candidates: the labelled boxes shifted a little, two per label."""
    return t.gt(spark, sf).selectExpr(
        "*", "explode(array(0, 1)) as k").selectExpr(
        "image_id", "gt_id * 2 + k as cand_id", "x1 + 3 * k + gt_id % 11 as x1", "y1 + gt_id % 7 as y1", "x2 + 3 * k + gt_id % 11 as x2",
        "y2 + gt_id % 7 - 5 * k as y2", "(gt_id % 45) / 10D as contrast_ratio", "gt_id % 3 <> 0 as has_shadow")


CAND = """cand as (select image_id, gt_id * 2 + k as cand_id, x1 + 3 * k + gt_id % 11 as x1, y1 + gt_id % 7 as y1, x2 + 3 * k + gt_id % 11 as x2, y2 + gt_id % 7 - 5 * k as y2,
 (gt_id % 45) / 10e0 as contrast_ratio, gt_id % 3 <> 0 as has_shadow from fx_gt, range(0, 2) q(k))"""


def anomalies(spark, sf):
    return t.gt(spark, sf).selectExpr(
        "image_id", "gt_id as anom_id", "x1 + 12 as x1", "y1 + 9 as y1", "x2 + 12 as x2", "y2 + 9 as y2", "(gt_id * 7 % 100) / 100D as anomaly_score",
        "gt_id % 5 = 0 as has_shadow")


ANOM = """anom as (select image_id, gt_id as anom_id, x1 + 12 as x1, y1 + 9 as y1, x2 + 12 as x2, y2 + 9 as y2, (gt_id * 7 % 100) / 100e0 as anomaly_score, gt_id % 5 = 0 as has_shadow
 from fx_gt)"""


def spots(tbl: str, ident: str, cnt: str) -> str:
    return f"(select image_id, x1, y1, x2, y2, min({ident}) as {ident}, count(*) as {cnt} from {tbl} group by 1, 2, 3, 4, 5)"


@query("c02_iou_join", "fx_pred", "fx_gt", sql=f"""
select a.image_id, a.pred_id, n_left, b.gt_id, n_right, round({iou_sql('a', 'b')}, 6) as iou
from {spots('fx_pred', 'pred_id', 'n_left')} a join {spots('fx_gt', 'gt_id', 'n_right')} b on a.image_id = b.image_id where {iou_sql('a', 'b')} > 0.1e0""")
def _(spark, sf):
    return fu.iou_join(t.pred(spark, sf), t.gt(spark, sf), "image_id", "pred_id", "gt_id", 0.1).withColumn("iou", F.round("iou", 6))


MATCH = (f"({iou_sql('a', 'b')} >= 0.05e0 or ((a.x1+a.x2)/2 between b.x1 and b.x2 and (a.y1+a.y2)/2 between b.y1 and b.y2) "
         "or ((b.x1+b.x2)/2 between a.x1 and a.x2 and (b.y1+b.y2)/2 between a.y1 and a.y2))")


@query("c03_match_join", "fx_pred", "fx_gt", sql=f"""with {CAND}
select a.image_id, a.pred_id, n_left, b.cand_id, n_right, round({iou_sql('a', 'b')}, 6) as iou
from {spots('fx_pred', 'pred_id', 'n_left')} a join {spots('cand', 'cand_id', 'n_right')} b on a.image_id = b.image_id where {MATCH}""")
def _(spark, sf):
    return fu.match_join(t.pred(spark, sf), candidates(spark, sf), "image_id", "pred_id", "cand_id").withColumn("iou", F.round("iou", 6))


@query("c04_fuse_objects", "fx_pred", "fx_gt", sql=f"""with {CAND},
pr as (select * from fx_pred),
m as (select a.image_id, a.pred_id, b.cand_id, row_number() over (partition by a.pred_id order by {iou_sql('a', 'b')} desc, b.cand_id) as rn from pr a join cand b on a.image_id = b.image_id where {MATCH}),
b as (select p.image_id, p.pred_id, m.cand_id from pr p left join m on m.pred_id = p.pred_id and rn = 1)
select * from b union all select image_id, null, cand_id from cand c where not exists (select 1 from b where b.image_id = c.image_id and b.cand_id = c.cand_id)""")
def _(spark, sf):
    return fu.fuse_objects(t.pred(spark, sf), candidates(spark, sf), "image_id", "pred_id", "cand_id").select("image_id", "pred_id", "cand_id")


GATE = f"""with {CAND}, {ANOM},
bx as (select image_id, pred_id as box_id, x1, y1, x2, y2, conf, shadow_contrast <= 0.3e0 as has_shadow from fx_pred),
ba as (select a.box_id, b.anom_id, b.anomaly_score from bx a join anom b on a.image_id = b.image_id where {iou_sql('a', 'b')} > 0.15e0),
bc as (select a.box_id, min(b.cand_id) as cand_id from bx a join cand b on a.image_id = b.image_id where {iou_sql('a', 'b')} > 0.15e0 group by 1),
la as (select * from anom where anom_id not in (select anom_id from ba)),
lc as (select a.anom_id, min(b.cand_id) as cand_id from la a join cand b on a.image_id = b.image_id where {iou_sql('a', 'b')} > 0.15e0 group by 1),
used as (select cand_id from bc union select cand_id from lc),
ae as (select box_id, max(anomaly_score) as s from ba group by 1),
x as (select bx.*, bc.cand_id, greatest(0e0, coalesce(ae.s, 0e0)) as ae from bx left join bc using (box_id) left join ae using (box_id)),
g as (select image_id, 'box' as stream, box_id as item_id, case when conf >= 0.25e0 and (has_shadow or cand_id is not null or conf >= 0.55e0) then 'KNOWN_DEBRIS'
  when conf < 0.25e0 and (ae >= 0.4e0 or cand_id is not null) then 'UNKNOWN_ANOMALY' else 'REJECT' end as category,
  case when conf < 0.25e0 and (ae >= 0.4e0 or cand_id is not null) then greatest(ae, 0.5e0) else conf end as confidence, ae as anomaly_score, cand_id is not null as hit from x
 union all select image_id, 'anomaly', anom_id, 'UNKNOWN_ANOMALY', anomaly_score, anomaly_score, lc.cand_id is not null from la left join lc using (anom_id) where anomaly_score >= 0.4e0
 union all select image_id, 'candidate', cand_id, 'UNKNOWN_ANOMALY', least(0.85e0, contrast_ratio / 3), 0.35e0, true from cand where cand_id not in (select cand_id from used) and contrast_ratio >= 2.2e0 and has_shadow)"""


def gate_inputs(spark, sf):
    boxes = t.pred(spark, sf).selectExpr("image_id", "pred_id as box_id", "x1", "y1", "x2", "y2", "conf", "shadow_contrast <= 0.3D as has_shadow")
    return boxes, candidates(spark, sf), anomalies(spark, sf)


@query("c05_gate_overlap", "fx_pred", "fx_gt", sql=GATE + " select box_id, cand_id, round(ae, 6) as ae_score from x")
def _(spark, sf):
    return fu.gate_overlap(*gate_inputs(spark, sf))["boxes"].select("box_id", "cand_id", r("ae_score"))


@query("g04_unmatched_remainder", "fx_pred", "fx_gt", sql=GATE + " select 'candidate' as kind, cand_id as id from cand where cand_id not in (select cand_id from used) union all select 'anomaly', anom_id from la")
def _(spark, sf):
    parts = fu.gate_overlap(*gate_inputs(spark, sf))
    return parts["candidates"].select(F.lit("candidate").alias("kind"), F.col("cand_id").alias("id")).unionByName(
        parts["anomalies"].select(F.lit("anomaly").alias("kind"), F.col("anom_id").alias("id")))


@query("s10_decision_gate", "fx_pred", "fx_gt", sql=GATE + """ select image_id, stream, item_id, category, round(confidence, 6) as confidence, round(anomaly_score, 6) as anomaly_score,
 cast(hit and category <> 'REJECT' as int) as cfar_confirmed from g""")
def _(spark, sf):
    return fu.decision_gate(*gate_inputs(spark, sf)).select(
        "image_id", "stream", "item_id", "category", r("confidence"), r("anomaly_score"), F.col("cfar_confirmed").cast("int").alias("cfar_confirmed"))


@query("d02_triage_summary", "fx_pred", "fx_gt", sql=GATE + """ select count(*) filter (category = 'KNOWN_DEBRIS') as known_debris_count,
 count(*) filter (category = 'UNKNOWN_ANOMALY') as unknown_anomaly_count, count(*) filter (category = 'REJECT') as rejected_count from g""")
def _(spark, sf):
    return fu.triage_summary(fu.decision_gate(*gate_inputs(spark, sf)))


def evidence_rows(spark, sf):
    p = t.pred(spark, sf).withColumns({"has_shadow": F.expr("shadow_contrast <= 0.7D"), "conf": F.expr("case when pred_id % 5 = 0 then null else conf end")})
    return fu.fuse_evidence(fu.evidence(p))


EVID = """ev as (select pred_id, anomaly_score, contrast_ratio, case when pred_id % 5 = 0 then null else conf end as yolo, least(1e0, greatest(0e0, (contrast_ratio - 1) / 3)) as cfar,
 least(1e0, greatest(0e0, (snr_db - 3) / 17)) as snr, case when shadow_contrast <= 0.7e0 then least(1e0, greatest(0e0, 1 - shadow_contrast)) else 0e0 end as shadow from fx_pred),
fz as (select *, (0.25e0 * cfar + coalesce(0.4e0 * yolo, 0) + coalesce(0.25e0 * anomaly_score, 0) + 0.1e0 * snr + 0.2e0 * shadow) /
 (0.25e0 + case when yolo is null then 0e0 else 0.4e0 end + case when anomaly_score is null then 0e0 else 0.25e0 end + 0.1e0 + 0.2e0) as fused from ev)"""


@query("s07_evidence", "fx_pred", sql=f"with {EVID} select pred_id, round(cfar, 6) as e_cfar, round(snr, 6) as e_snr, round(shadow, 6) as e_shadow from fz")
def _(spark, sf):
    return evidence_rows(spark, sf).select("pred_id", r("e_cfar"), r("e_snr"), r("e_shadow"))


@query("s08_fuse_evidence", "fx_pred", sql=f"with {EVID} select pred_id, round(fused, 6) as fused, 3 + cast(yolo is not null as int) + cast(anomaly_score is not null as int) as n_evidence from fz")
def _(spark, sf):
    return evidence_rows(spark, sf).select("pred_id", r("fused"), F.size("evidence").alias("n_evidence"))


@query("s09_triage", "fx_pred", sql=f"""with {EVID}, k as (select *, case when yolo >= 0.35e0 then 'known' when anomaly_score >= 0.5e0 or round(fused, 12) >= 0.45e0 then 'unknown' else 'noise' end as detection_type from fz)
select pred_id, detection_type, case detection_type when 'known' then 'KNOWN_DEBRIS' when 'unknown' then 'UNKNOWN_ANOMALY' else 'NOISE' end as category,
 2 + cast(anomaly_score < 0.5e0 and detection_type <> 'noise' as int) as n_reasons
from (select pred_id, detection_type, coalesce(anomaly_score, 1) as anomaly_score from k) z""")
def _(spark, sf):
    return fu.triage(evidence_rows(spark, sf).withColumn("fused", F.round("fused", 12))).select("pred_id", "detection_type", "category", F.size("reasons").alias("n_reasons"))


@query("s11_reliability", "fx_pred", sql="""
with c as (select pred_id, mc_variance, 1 / (1 + exp(-(ln(least(1 - 1e-6, greatest(1e-6, conf)) / (1 - least(1 - 1e-6, greatest(1e-6, conf)))) / 1.35e0))) as pc,
 least(1e0, greatest(0e0, (contrast_ratio - 1) / 2)) as cf, least(1e0, greatest(0e0, 1 - coalesce(anomaly_score, 0.2e0))) as ae,
 case when shadow_contrast <= 0.7e0 then least(1e0, greatest(0.2e0, 1 - shadow_contrast)) else 0.1e0 end as sh, least(1e0, greatest(0e0, snr_db / 20)) as sn from fx_pred),
f as (select pred_id, least(1e0, greatest(0e0, 0.35e0 * pc + 0.15e0 * cf + 0.15e0 * ae + 0.15e0 * sh + 0.1e0 * sn + 0.1e0 - 1.25e0 * mc_variance)) * 100 as pct from c)
select pred_id, round(pct / 100, 7) as reliability_raw, case when round(pct, 1) >= 75 then 'CONFIRMED' when round(pct, 1) >= 45 then 'PROBABLE' else 'UNCERTAIN' end as tier, 7 as n_parts from f""")
def _(spark, sf):
    p = t.pred(spark, sf).withColumn("has_shadow", F.expr("shadow_contrast <= 0.7D"))
    return fu.reliability(p).select("pred_id", r("reliability_raw", 7), "tier", F.size("breakdown").alias("n_parts"))


@query("s12_temperature_scale", "fx_pred", sql="""
select pred_id, round(1 / (1 + exp(-(ln(conf / (1 - conf)) / 1.35e0))), 8) as p from fx_pred""")
def _(spark, sf):
    return t.pred(spark, sf).select("pred_id", F.round(sc.temperature_scale(F.col("conf")), 8).alias("p"))


@query("s13_error_to_score", "fx_pred", sql="""
select pred_id, round(case when mc_variance > 0 then 1 / (1 + pow(0.02e0 / mc_variance, 3)) else 0e0 end, 8) as s from fx_pred""")
def _(spark, sf):
    return t.pred(spark, sf).select("pred_id", F.round(sc.error_to_score(F.col("mc_variance"), 0.02), 8).alias("s"))


@query("s14_fuse_detection", "fx_pred", sql="""
with f as (select pred_id, least(1e0, greatest(0e0, 0.6e0 * conf + 0.4e0 * seg_quality)) as s from fx_pred)
select pred_id, round(s, 4) as fusion_score, case when round(s, 4) >= 0.55e0 then 'VERIFIED' when round(s, 4) >= 0.35e0 then 'REVIEW' else 'REJECT' end as decision from f""")
def _(spark, sf):
    return fu.fuse_detection(t.pred(spark, sf)).select("pred_id", "fusion_score", "decision")


@query("s15_retriage", "fx_pred", sql="""
select pred_id, cast(mc_variance >= 0.045e0 or conf * 100 < 35 as int) as triaged, case when mc_variance >= 0.045e0 or conf * 100 < 35 then 'UNKNOWN_ANOMALY' else 'KNOWN_DEBRIS' end as category from fx_pred""")
def _(spark, sf):
    p = d.uncertainty_flag(t.pred(spark, sf)).withColumn("fused_pct", F.lit(None).cast("double"))
    return fu.retriage(p).select("pred_id", F.col("triaged").cast("int").alias("triaged"), "category")


MEAN, STD, COEF = [0.3, 0.2, 0.4, 10.0, 0.5], [0.25, 0.3, 0.0, 6.0, 0.3], [0.8, 1.1, -0.4, 0.5, -0.9]


@query("s17_learned_fusion", "fx_pred", sql="""
select pred_id, round(1 / (1 + exp(-(-0.2e0 + (conf - 0.3e0) / 0.25e0 * 0.8e0 + (coalesce(anomaly_score, 0) - 0.2e0) / 0.3e0 * 1.1e0 + (contrast_ratio - 0.4e0) * -0.4e0
 + (snr_db - 10) / 6 * 0.5e0 + (shadow_contrast - 0.5e0) / 0.3e0 * -0.9e0))), 8) as learned from fx_pred""")
def _(spark, sf):
    feats = ["conf", "anomaly_score", "contrast_ratio", "snr_db", "shadow_contrast"]
    return fu.learned_fusion(t.pred(spark, sf), feats, MEAN, STD, COEF, -0.2).select("pred_id", r("learned", 8))


@query("s25_seg_quality", "fx_gt", sql="""
with roi as (select gt_id as roi_id, 20 as h, 20 as w, 0.5e0 + (gt_id % 50) / 100e0 as p, 1 + gt_id % 20 as a, 1 + gt_id % 13 as b from fx_gt),
m as (select roi_id, count(*) as fg, count(*) filter (i between 3 and 16 and j between 3 and 16) as cf from roi, range(0, 20) r(i), range(0, 20) c(j) where i < a and j < b group by 1),
x as (select roi_id, p, m.fg, m.cf, m.fg / 400e0 as ratio from roi join m using (roi_id))
select roi_id, fg, cf as centre_fg, round(least(1e0, greatest(0e0, p * case when ratio < 0.01e0 then ratio * 10 when ratio > 0.9e0 then greatest(0.1e0, 1 - ratio) else least(1e0, greatest(0.3e0, 1 - abs(ratio - 0.35e0) / 0.35e0)) end * least(1e0, cf / fg))), 6) as seg_quality from x""")
def _(spark, sf):
    roi = t.gt(spark, sf).selectExpr("gt_id as roi_id", "20 as h", "20 as w", "0.5D + (gt_id % 50) / 100D as fg_prob", "1 + gt_id % 20 as a", "1 + gt_id % 13 as b")
    mask = roi.selectExpr("roi_id", "b", "explode(sequence(0L, a - 1)) as r").selectExpr("roi_id", "r", "explode(sequence(0L, b - 1)) as c")
    return fu.seg_quality(fu.seg_counts(mask, roi.drop("a", "b"))).select("roi_id", "fg", "centre_fg", r("seg_quality"))
