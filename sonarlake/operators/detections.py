"""Detection records: filters, reshaping, summaries, ranking, and the boxes around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.operators.cfar import box_totals
from sonarlake.plans.groups import first_come, iou_of_rows, map_groups, numbers, pairs_within, split_by_size
from sonarlake.plans.iterate import first_come_set
from sonarlake.plans.ordered import dense_index, exact_quantiles
from sonarlake.plans.spatial import BOX, box_pairs, pair_iou

# Named class groups with their default confidence (no classes = all classes).
MODEL_VIEWS: dict[str, tuple[float, list[str]]] = {
    "all classes": (0.30, []),
    "debris and containers": (0.35, [
        "bottle", "brown-glass-bottle", "can", "drink-carton", "drink-sachet", "glass-bottle", "glass-jar", "metal-bottle",
        "metal-box", "plastic-bidon", "plastic-bottle", "potion-glass-bottle", "shampoo-bottle", "standing-bottle"]),
    "hardware and tools": (0.30, [
        "chain", "hook", "pipeline or cable", "plastic-pipe", "plastic-propeller", "propeller", "rotating-platform", "valve", "wrench"]),
    "tires and rubber": (0.35, ["tire", "small-tire", "large-tire"]),
    "shipwrecks": (0.25, ["Shipwrecks"]),
    "sonar anomalies": (0.25, []),
}


# ---- filters ----------------------------------------------------------------------------------------------------------

def filter_detections(df: DataFrame, min_pct: float = 0.0, classes: Sequence | None = None, class_col: str = "class_name") -> DataFrame:
    out = df.filter(F.col("conf") * 100.0 >= min_pct)
    return out if classes is None else out.filter(F.col(class_col).isin(list(classes)))


def filter_view(df: DataFrame, view: str, class_col: str = "class_name", views: Mapping[str, tuple[float, Sequence]] = MODEL_VIEWS) -> DataFrame:
    conf, classes = views[view]
    out = df.filter(F.col("conf") >= conf)
    return out.filter(F.col(class_col).isin(list(classes))) if classes else out


def select_records(df: DataFrame, survey_id=None, run_id=None, detection_type=None) -> DataFrame:
    """Optional equality filters; as plain predicates they prune partitions and reach the Parquet scan."""
    for name, value in (("survey_id", survey_id), ("run_id", run_id), ("detection_type", detection_type)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def keep_at(df: DataFrame, threshold: float, confidence: str = "conf") -> DataFrame:
    return df.filter((F.col("detection_type") == "known") | (F.coalesce("anomaly_score", F.lit(0.0)) >= 0.5)
                     | (F.col(confidence) >= threshold))


def confirmed_tracks(snapshots: DataFrame, frames: DataFrame) -> DataFrame:
    """Confirmed tracks, or every track of a survey that has a single frame."""
    single = frames.groupBy("survey_id").agg((F.count(F.lit(1)) == 1).alias("_single"))
    joined = snapshots.join(single, "survey_id", "left")
    return joined.filter((F.col("state") == "confirmed") | F.coalesce("_single", F.lit(False))).drop("_single")


def result_view(df: DataFrame, view: str) -> DataFrame:
    """``detections``: all columns; ``slim``: without mask columns; ``summary``: counts."""
    if view == "detections":
        return df
    if view == "slim":
        return df.drop("segmentation_mask", "mask_polygon_global", "polygon")
    if view == "summary":
        return df.agg(F.count(F.lit(1)).alias("detections"), F.count_if(F.col("detection_type") == "known").alias("known"),
                      F.count_if(F.col("detection_type") == "unknown").alias("unknown"))
    raise ValueError("view is 'detections', 'slim' or 'summary'")


# ---- boxes ------------------------------------------------------------------------------------------------------------

def flatten_bbox(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.get("bbox", F.lit(i)) for i, n in enumerate(BOX)}).drop("bbox")


def pad_bbox(df: DataFrame, pad: float, width: Column | float, height: Column | float) -> DataFrame:
    w, h = _num(width), _num(height)
    return df.withColumns({
        "px1": F.greatest(F.lit(0.0), F.col("x1") - pad), "py1": F.greatest(F.lit(0.0), F.col("y1") - pad),
        "px2": F.least(w, F.col("x2") + pad), "py2": F.least(h, F.col("y2") + pad)})


def expand_bbox(df: DataFrame, ratio: Column | float, width: Column | float, height: Column | float) -> DataFrame:
    """Grow a box by a share of its size, to whole pixels, clamped, and never empty."""
    w, h, r = _num(width), _num(height), _num(ratio)
    px = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")) * r
    py = F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")) * r
    out = df.withColumns({
        "rx1": F.greatest(F.lit(0.0), F.floor(F.col("x1") - px).cast("double")),
        "ry1": F.greatest(F.lit(0.0), F.floor(F.col("y1") - py).cast("double")),
        "rx2": F.least(w, F.ceil(F.col("x2") + px).cast("double")), "ry2": F.least(h, F.ceil(F.col("y2") + py).cast("double"))})
    return out.withColumns({
        "rx2": F.when(F.col("rx2") <= F.col("rx1"), F.least(w, F.col("rx1") + 1)).otherwise(F.col("rx2")),
        "ry2": F.when(F.col("ry2") <= F.col("ry1"), F.least(h, F.col("ry1") + 1)).otherwise(F.col("ry2"))})


def adaptive_padding(df: DataFrame) -> DataFrame:
    loose = (F.col("uncertainty") == "HIGH") | (F.col("snr_db") < 8.0) | (F.col("conf") < 0.35)
    tight = (F.col("conf") >= 0.70) & (F.col("uncertainty") == "LOW") & (F.col("snr_db") >= 12.0)
    return df.withColumn("padding", F.when(loose, 0.50).when(tight, 0.10).otherwise(0.25))


def context_window(df: DataFrame, context: int, pad: int, width: int, height: int) -> DataFrame:
    """Square window around the object, slid to stay inside the image; ``context`` 0 means the padded box."""
    if context <= 0:
        out = pad_bbox(df, pad, width, height)
        return out.withColumnsRenamed({"px1": "wx1", "py1": "wy1", "px2": "wx2", "py2": "wy2"})
    i = {c: F.col(c).cast("int") for c in BOX}
    side = F.least(F.greatest(F.lit(context), F.greatest(i["x2"] - i["x1"], i["y2"] - i["y1"]) + 2 * pad), F.lit(min(width, height)))
    out = df.withColumn("_side", side)
    half = F.floor(F.col("_side") / 2.0)
    place = lambda a, b, size: F.least(F.lit(size) - F.col("_side"), F.greatest(F.lit(0), F.floor((a + b) / 2.0) - half)).cast("int")
    out = out.withColumns({"wx1": place(i["x1"], i["x2"], width), "wy1": place(i["y1"], i["y2"], height)})
    return out.withColumns({"wx2": F.col("wx1") + F.col("_side"), "wy2": F.col("wy1") + F.col("_side")}).drop("_side")


def to_pixels(labels: DataFrame, width: Column | float, height: Column | float) -> DataFrame:
    """Normalised centre form (cx, cy, w, h) to pixel corners."""
    w, h = _num(width), _num(height)
    return labels.withColumns({
        "x1": (F.col("cx") - F.col("w") / 2.0) * w, "y1": (F.col("cy") - F.col("h") / 2.0) * h,
        "x2": (F.col("cx") + F.col("w") / 2.0) * w, "y2": (F.col("cy") + F.col("h") / 2.0) * h})


def polygon_ratio(df: DataFrame) -> DataFrame:
    """Shoelace area of the polygon over the area of its box."""
    nxt = F.concat(F.slice("polygon", 2, F.size("polygon")), F.slice("polygon", 1, 1))
    cross = F.zip_with("polygon", nxt, lambda p, q: p[0] * q[1] - q[0] * p[1])
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2.0
    box = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return df.withColumn("polygon_area", area).withColumn("area_ratio", F.when(box > 0, F.col("polygon_area") / box).otherwise(F.lit(0.0)))


def _num(v: Column | float) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else v


# ---- summaries --------------------------------------------------------------------------------------------------------

def run_summary(detections: DataFrame, tracks: DataFrame, frames: DataFrame) -> DataFrame:
    d = detections.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("detections"), F.count_if(F.col("detection_type") == "known").alias("known"),
        F.count_if(F.col("detection_type") == "unknown").alias("unknown"))
    t = tracks.filter(F.col("track_id").isNotNull()).groupBy("survey_id").agg(F.countDistinct("track_id").alias("tracks"))
    f = frames.groupBy("survey_id").agg(F.count(F.lit(1)).alias("frames"))
    return f.join(d, "survey_id", "left").join(t, "survey_id", "left").na.fill(0, ["detections", "known", "unknown", "tracks"])


def tier_counts(df: DataFrame) -> DataFrame:
    up = F.upper("tier")
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(up == t).alias(t.lower()) for t in ("CONFIRMED", "PROBABLE", "UNCERTAIN")])


def mission_counts(df: DataFrame, mission: str = "mission_id") -> DataFrame:
    return df.groupBy(mission).agg(F.count(F.lit(1)).alias("total_detections"))


def unique_objects(df: DataFrame, row_id: str = "det_id") -> DataFrame:
    """Best record per track (first wins ties); untracked records are all kept.

    Per track a single aggregate with map-side combining, so a track that holds most of the table stays cheap.
    """
    tracked = df.filter(F.col("track_id").isNotNull())
    best = tracked.groupBy("survey_id", "track_id").agg(
        F.max(F.struct(F.col("conf").alias("c"), (-F.col(row_id)).alias("o"), F.struct(*df.columns).alias("r"))).alias("_m"))
    return best.select("_m.r.*").unionByName(df.filter(F.col("track_id").isNull()))


def track_lines(df: DataFrame, order: Sequence[str], part_points: int = 10_000) -> DataFrame:
    """Polyline per track with at least two located points, as parts of at most ``part_points`` points.

    A normal track is one part. Each further part starts with the last point of the one before, so drawn together they
    are the same line and no row grows without bound.
    """
    located = df.filter("track_id is not null and latitude is not null and longitude is not null")
    idx = dense_index(located.select("survey_id", "track_id", *order, "latitude", "longitude"), ["survey_id", "track_id"], order, "seq")
    part = F.floor(F.col("seq") / F.lit(float(part_points)))
    spread = idx.withColumn("part", F.explode(F.when(
        (F.col("seq") > 0) & (F.col("seq") % part_points == 0), F.array(part - 1, part)).otherwise(F.array(part))))
    lines = spread.groupBy("survey_id", "track_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("seq", "longitude", "latitude"))).alias("_p"))
    return lines.filter(F.size("_p") > 1).select(
        "survey_id", "track_id", "part", F.transform("_p", lambda p: F.array(p["longitude"], p["latitude"])).alias("line"))


def stage_profile(logs: DataFrame) -> DataFrame:
    """Seconds per stage: calls, total, mean, share of everything."""
    per = logs.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("total_s"), F.avg("seconds").alias("mean_s"))
    return per.withColumn("share", F.col("total_s") / F.sum("total_s").over(Window.partitionBy(F.lit(1))))


def latency_profile(df: DataFrame, keys: Sequence[str], latency: str = "latency_ms") -> DataFrame:
    """Exact percentiles by range-partitioned running counts, so no task holds a group's distinct values."""
    ranks = exact_quantiles(df, keys, latency, (0.5, 0.95), "p").groupBy(*keys).agg(
        F.max(F.when(F.col("p_no") == 0, F.col("p"))).alias("p50_ms"), F.max(F.when(F.col("p_no") == 1, F.col("p"))).alias("p95_ms"))
    counts = df.groupBy(*keys, latency).agg(F.count(F.lit(1)).alias("n"))
    v = F.col(latency)
    agg = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(v * F.col("n")) / F.sum("n")).alias("mean_ms"),
        (F.sum(v * v * F.col("n")) / F.sum("n")).alias("_sq"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"))
    return agg.join(ranks, list(keys), "left").withColumns({
        "std_ms": F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("mean_ms") * F.col("mean_ms"))),
        "fps": F.when(F.col("mean_ms") > 0, 1000.0 / F.col("mean_ms")).otherwise(F.lit(0.0))}).drop("_sq")


def map_view(points: DataFrame, keys: Sequence[str], default_zoom: float = 12.0) -> DataFrame:
    """Centre, spread and zoom step of a set of points."""
    a = points.filter("latitude is not null and longitude is not null").groupBy(*keys).agg(
        F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"),
        F.greatest(F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude")).alias("spread"))
    s = F.col("spread")
    return a.withColumn("zoom", F.when(s > 50, 1.5).when(s > 20, 2.5).when(s > 10, 3.5).when(s > 5, 4.5).when(s > 1, 6.0).otherwise(default_zoom))


def merge_tile_reports(reports: DataFrame) -> DataFrame:
    """Per survey: mean SNR, number of tiles, sorted distinct warnings."""
    base = reports.groupBy("survey_id").agg(F.avg("raw_snr_db").alias("raw_snr_db"), F.avg("final_snr_db").alias("final_snr_db"),
                                            F.count(F.lit(1)).alias("tiles"))
    return base.join(distinct_sets(reports, ["survey_id"], "warnings"), "survey_id", "left").withColumn(
        "warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def distinct_sets(df: DataFrame, keys: Sequence[str], texts: str) -> DataFrame:
    """Sorted distinct values of an array column per key; values are de-duplicated before they are gathered."""
    flat = df.select(*keys, F.explode(texts).alias("_t")).distinct()
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_list("_t")).alias(texts))


def mc_uncertainty(passes: DataFrame, weight: str = "w") -> DataFrame:
    """Stochastic passes (object, pass, class, unnormalised weight) to class, confidence, variance, entropy and advice."""
    totals = Window.partitionBy("object_id", "pass")
    probs = passes.withColumn("p", F.col(weight) / F.sum(weight).over(totals))
    per_class = probs.groupBy("object_id", "class_idx").agg(F.avg("p").alias("m"), F.var_pop("p").alias("v"))
    obj = per_class.groupBy("object_id").agg(
        F.max(F.struct(F.col("m"), (-F.col("class_idx")).alias("c"), F.col("v"))).alias("_b"), F.avg("v").alias("mean_variance"),
        F.sum(-F.col("m") * F.log(F.col("m") + 1e-9)).alias("entropy"))
    out = obj.select("object_id", (-F.col("_b.c")).alias("pred_class"), F.col("_b.m").alias("confidence"), F.col("_b.v").alias("variance"),
                     "mean_variance", "entropy")
    low = (F.col("variance") < 0.015) & (F.col("entropy") < 1.0)
    mid = (F.col("variance") < 0.045) & (F.col("entropy") < 2.0)
    return out.withColumns({
        "uncertainty_flag": F.when(low, "LOW").when(mid, "MODERATE").otherwise("HIGH"),
        "action": F.when(low, "Accept").when(mid, "Accept with Caution").otherwise("Flag for Expert Review")})


def uncertainty_flag(df: DataFrame, variance: str = "mc_variance") -> DataFrame:
    v = F.col(variance)
    return df.withColumn("uncertainty_flag", F.when(v < 0.02, "LOW").when(v < 0.045, "MODERATE").otherwise("HIGH"))


# ---- ranking ----------------------------------------------------------------------------------------------------------

def top_k(df: DataFrame, keys: Sequence[str], k: int, score: str = "conf", tie: str = "det_id") -> DataFrame:
    """The k best rows per key. Rank filters on row_number prune inside each map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def newest_first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order])


def nms(df: DataFrame, keys: Sequence[str], row_id: str, threshold: float = 0.35, score: str = "conf") -> DataFrame:
    """Keep a box unless it overlaps a better kept box (IoU above ``threshold``); score first, then ``row_id``.

    Rows of small keys are shuffled once with all their columns, so select those that are wanted before.
    """
    (small,), large = split_by_size([df], keys)
    worse = [F.col(score).isNull(), -F.col(score), F.col(row_id)]
    kept = map_groups(small, keys, worse, _suppress(threshold), small.schema)
    return kept if large is None else kept.unionByName(_joined_nms(large[0], keys, row_id, threshold, score))


def _suppress(threshold: float):
    """The kept rows of whole keys, whose rows come best first."""
    def work(t: pa.Table, sizes: np.ndarray) -> pa.Table:
        box = [numbers(t, c) for c in BOX]
        a, b = pairs_within(sizes)
        clash = iou_of_rows(box, a, b) > threshold
        return t.filter(pa.array(first_come(t.num_rows, a[clash], b[clash])))

    return work


def _joined_nms(df: DataFrame, keys: Sequence[str], row_id: str, threshold: float, score: str) -> DataFrame:
    """The same for keys of any size.

    An exact copy always conflicts with its first copy and shares all other conflicts, so piles of copies are reduced to
    their first member before boxes are paired. Boxes without an area conflict with nothing, not even with a copy.
    """
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & F.lit(threshold < 1)
    empty = F.when(solid, F.lit(None)).otherwise(F.col(row_id)).alias("_e")
    best = F.min(F.struct(F.col(score).isNull().alias("u"), (-F.col(score)).alias("s"), F.col(row_id).alias("i"))).alias("_k")
    firsts = df.groupBy(*keys, *BOX, empty).agg(best)
    pairs = box_pairs(firsts, firsts.withColumnRenamed("_k", "_k2"), keys, "_k", "_k2")
    clash = pairs.filter((F.col("_k") < F.col("_k2")) & (pair_iou() > threshold)).select(
        F.col("_k.i").alias("earlier"), F.col("_k2.i").alias("later"))
    kept = first_come_set(firsts.select(F.col("_k.i").alias("id")), clash)
    return df.join(kept.withColumnRenamed("id", row_id), row_id, "left_semi")


def hazard_register(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Report table rows: running number, class, tier, confidence text, position, size and error texts."""
    numbered = dense_index(df, ["survey_id"], order, "_no", start=1)

    def or_lit(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    conf = or_lit("confidence", 0.0)
    return numbered.select(
        "survey_id", F.format_string("#%02d", "_no").alias("no"), or_lit("class_name", "Unknown Debris").alias("class_name"),
        F.upper(or_lit("tier", "PROBABLE")).alias("tier"),
        F.when(conf <= 1.0, F.format_string("%.1f%%", conf * 100)).otherwise(F.format_string("%.1f%%", conf)).alias("confidence"),
        F.format_string("%.5f° N, %.5f° E", or_lit("latitude", 12.8342), or_lit("longitude", 80.2415)).alias("position"),
        F.format_string("%.1fm x %.1fm", or_lit("length_m", 1.8), or_lit("width_m", 0.7)).alias("size"),
        F.format_string("±%.1fm x ±%.1fm", or_lit("error_ellipse_a_m", 1.2), or_lit("error_ellipse_b_m", 0.8)).alias("error"))


def hazard_kpis(df: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Report totals per survey: detections by tier (of the given tiers only) and the survey's quality.

    ``quality`` has survey_id, scqi, grade, resurvey_recommended; a survey without a row there counts as 82.5, GOOD, not to
    be surveyed again. A survey without detections has no row.
    """
    # Tier names and the defaults of a report without quality data.
    tier = F.upper(F.col("tier")) if "tier" in df.columns else F.lit("")
    totals = df.groupBy("survey_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(tier == t).alias(t.lower()) for t in ("CONFIRMED", "PROBABLE", "UNCERTAIN")])
    found = quality.select("survey_id", "scqi", "grade", "resurvey_recommended") if quality is not None else (
        totals.select("survey_id", F.lit(None).cast("double").alias("scqi"), F.lit(None).cast("string").alias("grade"), F.lit(None).cast("boolean").alias("resurvey_recommended")))
    return totals.join(found, "survey_id", "left").na.fill({"scqi": 82.5, "grade": "GOOD", "resurvey_recommended": False})


def roi_quality(rois: DataFrame, cells: DataFrame, width: int, height: int) -> DataFrame:
    """Gate on crop size, contrast and border contact. ``rois``: roi_id, survey_id, whole-pixel x1, y1, x2, y2.

    The deviation comes from running totals of the image, two short rows per ROI. ``cells`` is the wide form (survey_id,
    ping, samples).
    """
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("n") * F.col("q") - F.col("s") * F.col("s"))) / F.col("n")
    stats = box_totals(rois, cells, ["roi_id"], ["survey_id"]).select("roi_id", spread.alias("intensity_std"))
    small = (F.col("x2") - F.col("x1") < 10) | (F.col("y2") - F.col("y1") < 10)
    empty = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    flat = F.coalesce(F.col("intensity_std"), F.lit(0.0)) < 3.0
    edges = ((F.col("x1") == 0).cast("int") + (F.col("y1") == 0).cast("int") + (F.col("x2") == width).cast("int")
             + (F.col("y2") == height).cast("int"))
    return rois.join(stats.hint("merge"), "roi_id", "left").withColumns({
        "quality": F.when(empty, 0.0).when(small, 0.2).when(flat, 0.3).otherwise(F.greatest(F.lit(0.4), 1.0 - edges * 0.15)),
        "roi_ok": ~(empty | small | flat),
        "status": F.when(empty, "Empty crop").when(small, "Crop too small (< 10px)")
        .when(flat, "Uniform intensity / zero contrast residual").otherwise("Good ROI")})


