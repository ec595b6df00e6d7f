"""Evidence fusion, triage and the decision gate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from sonarlake.config import FusionSettings
from sonarlake.functions.boxes import centre_inside, clip
from sonarlake.functions.scores import cfar_evidence, snr_evidence, temperature_scale, weighted_mean
from sonarlake.plans.durable import durable
from sonarlake.plans.groups import iou_of_rows, map_groups, pairs_within, split_by_size
from sonarlake.plans.spatial import BOX, WIDE_TILE, best_overlap, box_pairs, pair_iou

MATCH_IOU = 0.05
GATE_IOU = 0.15


# ---- joins --------------------------------------------------------------------------------------------------------

def _spots(df: DataFrame, key: str, ident: str, count: str) -> DataFrame:
    """Distinct boxes of an image with their first id and number of copies."""
    return df.groupBy(key, *BOX).agg(F.min(ident).alias(ident), F.count(F.lit(1)).alias(count))


def _pairs_with_counts(left: DataFrame, right: DataFrame, key: str, l_id: str, r_id: str, keep: Column) -> DataFrame:
    ls = _spots(left, key, l_id, "n_left").withColumn("_l", F.struct(l_id, "n_left"))
    rs = _spots(right, key, r_id, "n_right").withColumn("_r", F.struct(r_id, "n_right"))
    pairs = box_pairs(ls, rs, [key], "_l", "_r", tile=WIDE_TILE).withColumn("iou", pair_iou()).filter(keep)
    return pairs.select(key, f"_l.{l_id}", "_l.n_left", f"_r.{r_id}", "_r.n_right", "iou")


def iou_join(left: DataFrame, right: DataFrame, key: str, l_id: str, r_id: str, min_iou: float = 0.0) -> DataFrame:
    """Overlapping boxes of one image with their IoU above ``min_iou``.

    Identical boxes are paired once: the row carries the first id of each pile and the pile sizes.
    """
    return _pairs_with_counts(left, right, key, l_id, r_id, F.col("iou") > min_iou)


def _match_condition() -> Column:
    lb, rb = [F.col(f"l_{c}") for c in BOX], [F.col(f"r_{c}") for c in BOX]
    return (pair_iou() >= MATCH_IOU) | centre_inside(*lb, *rb) | centre_inside(*rb, *lb)


def match_join(left: DataFrame, right: DataFrame, key: str, l_id: str, r_id: str) -> DataFrame:
    """Boxes that overlap enough, or where the centre of either lies inside the other (piles as in ``iou_join``)."""
    return _pairs_with_counts(left, right, key, l_id, r_id, _match_condition())


def fuse_objects(boxes: DataFrame, candidates: DataFrame, key: str, box_id: str, cand_id: str) -> DataFrame:
    """Object list: every detector box with its best matching candidate, then the candidates nobody claimed.

    Two boxes may claim the same candidate. Ties in IoU go to the lower candidate id.
    """
    matched = best_overlap(boxes, candidates, [key], cand_id, accept=_match_condition(), match=cand_id, score="iou")
    matched = matched.select(key, box_id, cand_id, *BOX)
    used = matched.filter(F.col(cand_id).isNotNull()).select(key, cand_id).distinct()
    free = candidates.join(used.hint("merge"), [key, cand_id], "left_anti").select(
        key, F.lit(None).cast(boxes.schema[box_id].dataType).alias(box_id), cand_id, *BOX)
    return matched.unionByName(free)


# ---- evidence -----------------------------------------------------------------------------------------------------

def evidence(df: DataFrame, cfg: FusionSettings = FusionSettings()) -> DataFrame:
    """Evidence columns e_cfar, e_yolo, e_anomaly, e_snr, e_shadow; null where the source is absent."""
    shadow = F.when(F.col("has_shadow"), clip(1.0 - F.col("shadow_contrast"), 0.0, 1.0)).otherwise(F.lit(0.0))
    return df.withColumns({
        "e_cfar": F.when(F.col("contrast_ratio").isNotNull(), cfar_evidence(F.col("contrast_ratio"))),
        "e_yolo": F.col("conf"),
        "e_anomaly": F.col("anomaly_score"),
        "e_snr": snr_evidence(F.col("snr_db"), cfg.min_tile_snr_db, cfg.max_tile_snr_db),
        "e_shadow": shadow if cfg.w_shadow > 0 else F.lit(None).cast("double"),
    })


def fuse_evidence(df: DataFrame, cfg: FusionSettings = FusionSettings()) -> DataFrame:
    cols = {k: F.col(f"e_{k}") for k in ("cfar", "yolo", "anomaly", "snr", "shadow")}
    weights = {"cfar": cfg.w_cfar, "yolo": cfg.w_yolo, "anomaly": cfg.w_anomaly, "snr": cfg.w_snr, "shadow": cfg.w_shadow}
    present = F.map_filter(F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())
    return df.withColumn("fused", weighted_mean(cols, weights)).withColumn("evidence", present)


def learned_fusion(df: DataFrame, features: Sequence[str], mean: Sequence[float], std: Sequence[float],
                   coef: Sequence[float], intercept: float) -> DataFrame:
    """Logistic score over standardised features; a missing feature counts as 0, a zero deviation as 1."""
    z = sum(((F.coalesce(F.col(f), F.lit(0.0)) - m) / (s if s > 0 else 1.0) * c
             for f, m, s, c in zip(features, mean, std, coef)), F.lit(float(intercept)))
    return df.withColumn("learned", 1.0 / (1.0 + F.exp(-z)))


def triage(df: DataFrame, cfg: FusionSettings = FusionSettings()) -> DataFrame:
    """KNOWN / UNKNOWN / NOISE from conf, anomaly_score and fused, first rule wins; a low anomaly never vetoes."""
    known = F.coalesce(F.col("conf") >= cfg.known_min_conf, F.lit(False))
    flagged = F.coalesce(F.col("anomaly_score") >= cfg.unknown_min_anomaly, F.lit(False))
    strong = F.col("fused") >= cfg.noise_max_fused
    kind = F.when(known, "known").when(flagged | strong, "unknown").otherwise("noise")
    why = F.when(known, F.format_string("detector confidence %.2f", "conf")).when(
        flagged, F.lit("reconstruction error above the validated threshold")).when(
        strong, F.format_string(f"combined evidence %.2f >= {cfg.noise_max_fused:.2f}", "fused")).otherwise(
        F.format_string(f"combined evidence %.2f < {cfg.noise_max_fused:.2f}", "fused"))
    reasons = F.array_compact(F.array(
        why,
        F.when(F.col("contrast_ratio").isNotNull(), F.lit("adaptive-threshold candidate")),
        F.when(F.col("anomaly_score").isNotNull() & ~flagged & (kind != "noise"),
               F.lit("low anomaly score did not veto the object"))))
    category = F.when(kind == "known", "KNOWN_DEBRIS").when(kind == "unknown", "UNKNOWN_ANOMALY").otherwise("NOISE")
    return df.withColumns({"detection_type": kind, "category": category, "reasons": reasons})


def reliability(df: DataFrame, temperature: float = 1.35, uncertainty_lambda: float = 1.25) -> DataFrame:
    """Six-evidence reliability in percent with tier and breakdown."""
    def or_lit(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    has = F.coalesce(F.col("has_shadow"), F.lit(True)) if "has_shadow" in df.columns else F.lit(True)
    parts = {  # fixed values: weights in percent and neutral inputs
        "detector": (0.35, temperature_scale(F.col("conf"), temperature)),
        "cfar": (0.15, clip((or_lit("contrast_ratio", 1.5) - 1.0) / 2.0, 0.0, 1.0)),
        "reconstruction": (0.15, clip(1.0 - or_lit("anomaly_score", 0.20), 0.0, 1.0)),
        "shadow": (0.15, F.when(has, clip(1.0 - or_lit("shadow_contrast", 0.45), 0.2, 1.0)).otherwise(F.lit(0.10))),
        "snr": (0.10, clip(or_lit("snr_db", 12.0) / 20.0, 0.0, 1.0)),
        "motion": (0.10, clip(or_lit("motion_quality", 1.0), 0.0, 1.0)),
    }
    penalty = uncertainty_lambda * F.greatest(F.lit(0.0), or_lit("mc_variance", 0.010))
    total = sum((w * c for w, c in parts.values()), F.lit(0.0))
    breakdown = F.map_from_arrays(
        F.array(*[F.lit(k) for k in parts], F.lit("uncertainty")),
        F.array(*[F.round(w * c * 100.0, 1) for w, c in parts.values()], F.round(penalty * 100.0, 1)))
    out = df.withColumn("reliability_raw", clip(total - penalty, 0.0, 1.0)).withColumn(
        "reliability_pct", F.round(F.col("reliability_raw") * 100.0, 1))
    tier = F.when(F.col("reliability_pct") >= 75.0, "CONFIRMED").when(F.col("reliability_pct") >= 45.0, "PROBABLE").otherwise("UNCERTAIN")
    return out.withColumn("tier", tier).withColumn("breakdown", breakdown)


def fuse_detection(df: DataFrame, alpha: float = 0.6, beta: float = 0.4, verified: float = 0.55, reject: float = 0.35) -> DataFrame:
    """Detector confidence and segmentation quality into VERIFIED / REVIEW / REJECT."""
    score = F.round(clip(alpha * F.col("conf") + beta * F.coalesce("seg_quality", F.lit(0.0)), 0.0, 1.0), 4)
    return df.withColumn("fusion_score", score).withColumn("decision", F.when(F.col("fusion_score") >= verified, "VERIFIED").when(
        F.col("fusion_score") >= reject, "REVIEW").otherwise("REJECT"))


def seg_quality(df: DataFrame) -> DataFrame:
    """Segmentation quality from counts: fg_prob, fg (mask pixels), centre_fg (in the middle 70 %), total (ROI pixels)."""
    ratio = F.col("fg") / F.greatest(F.lit(1), F.col("total"))
    factor = F.when(ratio < 0.01, ratio * 10.0).when(ratio > 0.90, F.greatest(F.lit(0.1), 1.0 - ratio)).otherwise(
        clip(1.0 - F.abs(ratio - 0.35) / 0.35, 0.3, 1.0))
    centred = F.when(F.col("fg") > 0, F.least(F.lit(1.0), F.col("centre_fg") / F.greatest(F.lit(1), F.col("fg")))).otherwise(F.lit(0.0))
    return df.withColumn("seg_quality", clip(F.col("fg_prob") * factor * centred, 0.0, 1.0))


def seg_counts(mask_cells: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixel counts per ROI from mask cells (roi_id, r, c) and ROI sizes (roi_id, h, w, fg_prob)."""
    my, mx = F.floor(F.col("h") * 0.15), F.floor(F.col("w") * 0.15)
    inner = F.col("r").between(my, F.col("h") - my - 1) & F.col("c").between(mx, F.col("w") - mx - 1)
    counts = mask_cells.join(rois, "roi_id").groupBy("roi_id").agg(
        F.count(F.lit(1)).alias("fg"), F.count_if(inner).alias("centre_fg"))
    return rois.join(counts, "roi_id", "left").na.fill(0, ["fg", "centre_fg"]).withColumn("total", F.col("h") * F.col("w"))


def retriage(df: DataFrame, stream_is_anomaly: Column | None = None) -> DataFrame:
    """Send uncertain or weakly fused detections to the anomaly branch (``triaged`` says which rows moved)."""
    stream = stream_is_anomaly if stream_is_anomaly is not None else F.lit(False)
    pct = F.coalesce(F.col("fused_pct"), F.col("conf") * 100.0)
    moved = stream | F.coalesce(F.col("uncertainty_flag") == "HIGH", F.lit(False)) | (pct < 35.0)
    return df.withColumn("triaged", moved).withColumns({
        "category": F.when(moved, "UNKNOWN_ANOMALY").otherwise("KNOWN_DEBRIS"),
        "triage_anomaly_score": F.when(moved, F.round(1.0 - pct / 100.0, 3))})


# ---- decision gate ------------------------------------------------------------------------------------------------

def gate_overlap(boxes: DataFrame, candidates: DataFrame, anomalies: DataFrame, key: str = "image_id") -> dict[str, DataFrame]:
    """Overlap facts (IoU > 0.15) the gate needs.

    ``boxes``: key, box_id, BOX. ``candidates``: key, cand_id, BOX. ``anomalies``: key, anom_id, anomaly_score, BOX.
    The first overlapping candidate in id order is the only one a box or a leftover anomaly uses up; every overlapping
    anomaly is used up by a box. Images with few rows are shuffled once and worked on by the task that holds them.
    """
    given = {"boxes": boxes, "candidates": candidates, "anomalies": anomalies}
    small, large = split_by_size(list(given.values()), [key])
    fields = {name: [f for f in df.schema.fields if f.name != key] for name, df in given.items()}

    def tagged(kind: int) -> DataFrame:
        own = lambda name: F.struct(*[f.name for f in fields[name]]) if name == list(given)[kind] else F.lit(None).cast(StructType(fields[name]))
        return small[kind].select(key, F.lit(kind).alias("_kind"), *[own(name).alias(name) for name in given])

    rows = tagged(0).unionAll(tagged(1)).unionAll(tagged(2))
    facts = [StructField("_cand", candidates.schema["cand_id"].dataType), StructField("_score", DoubleType()), StructField("_used", BooleanType())]
    facing = map_groups(rows, [key], ["_kind", F.col("candidates.cand_id")], _meet, StructType([*rows.schema.fields, *facts]))
    facing = durable(facing.filter("not _used").drop("_used"), "overlaps")
    cand, score = F.col("_cand").alias("cand_id"), F.col("_score").alias("ae_score")
    parts = {name: facing.filter(F.col("_kind") == kind).select(key, f"{name}.*", *more) for kind, (name, more) in enumerate(
        {"boxes": [cand, score], "candidates": [], "anomalies": [cand]}.items())}
    if large is None:
        return parts
    rest = _joined_overlap(*large, key)
    return {name: df.unionByName(rest[name]) for name, df in parts.items()}


def _meet(t: pa.Table, sizes: np.ndarray) -> pa.Table:
    """Rows of whole images (boxes, candidates by id, anomalies) with the first candidate, the highest score and what is used up."""
    kind = t.column("_kind").to_numpy()
    streams = [t.column(c).combine_chunks() for c in ("boxes", "candidates", "anomalies")]
    of = lambda c: [pc.struct_field(s, c) for s in streams]
    box = [np.choose(kind, [f.cast(pa.float64()).to_numpy(zero_copy_only=False) for f in of(c)]) for c in BOX]
    a, b = pairs_within(sizes)
    near = (kind[a] != kind[b]) & (iou_of_rows(box, a, b) > GATE_IOU)
    a, b = a[near], b[near]
    ids = pc.struct_field(streams[1], "cand_id")
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    # boxes come before candidates, candidates before anomalies: a box or an anomaly meets its lowest candidate first
    score = np.full(len(kind), 0.0)
    met = (kind[a] == 0) & (kind[b] == 2)
    scores = pc.struct_field(streams[2], "anomaly_score").cast(pa.float64())
    known = scores.is_valid().to_numpy(zero_copy_only=False)[b[met]]
    np.maximum.at(score, a[met][known], scores.to_numpy(zero_copy_only=False)[b[met]][known])
    used = np.zeros(len(kind), dtype=bool)
    used[b[met]] = True
    first = np.full(len(kind), len(kind))
    for mine, other, here in ((a, b, 0), (b, a, 2)):
        hit = (kind[mine] == here) & (kind[other] == 1) & named[other]
        np.minimum.at(first, mine[hit], other[hit])
    has = (first < len(kind)) & ~used
    # a candidate is used up wherever its id is
    image = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.arange(len(kind)) if pa.types.is_nested(ids.type) else pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy().astype(np.int64)
    spot = image * (len(kind) + 1) + codes
    used |= (kind == 1) & named & np.isin(spot, spot[first[has]])
    cand = ids.take(pa.array(first, pa.int64(), mask=~has))
    return t.append_column("_cand", cand).append_column("_score", pa.array(score)).append_column("_used", pa.array(used))


def _joined_overlap(boxes: DataFrame, candidates: DataFrame, anomalies: DataFrame, key: str) -> dict[str, DataFrame]:
    """The same for images of any size; candidate order and best scores are taken over collapsed identical boxes."""
    def first_candidate(left: DataFrame) -> DataFrame:
        lefts = left.select(key, *BOX).distinct().withColumn("_lk", F.struct(*BOX))
        rights = candidates.groupBy(key, *BOX).agg(F.min("cand_id").alias("_rid"))
        hits = box_pairs(lefts, rights, [key], "_lk", "_rid", tile=WIDE_TILE).filter(pair_iou() > GATE_IOU)
        first = hits.groupBy(key, *[F.col(f"l_{c}").alias(c) for c in BOX]).agg(F.min("_rid").alias("cand_id"))
        return left.join(first.hint("merge"), [key, *BOX], "left")

    lefts = boxes.select(key, *BOX).distinct().withColumn("_lk", F.struct(*BOX))
    rights = anomalies.groupBy(key, *BOX).agg(F.max("anomaly_score").alias("_score")).withColumn(
        "_rk", F.struct(F.col("_score").alias("s"), *BOX))
    over = box_pairs(lefts, rights, [key], "_lk", "_rk", tile=WIDE_TILE).filter(pair_iou() > GATE_IOU)
    over = durable(over.select(key, "_rk", *[f"{s}_{c}" for s in "lr" for c in BOX]), "overlaps")
    best = over.groupBy(key, *[F.col(f"l_{c}").alias(c) for c in BOX]).agg(F.max("_rk.s").alias("ae_score"))
    used_anomaly = over.select(key, *[F.col(f"r_{c}").alias(c) for c in BOX]).distinct()
    out_boxes = first_candidate(boxes).join(best.hint("merge"), [key, *BOX], "left").withColumn(
        "ae_score", F.greatest(F.lit(0.0), F.coalesce("ae_score", F.lit(0.0))))
    left_anomalies = first_candidate(anomalies.join(used_anomaly.hint("merge"), [key, *BOX], "left_anti"))
    used = (out_boxes.select(key, "cand_id").unionByName(left_anomalies.select(key, "cand_id"))
            .filter(F.col("cand_id").isNotNull()).distinct())
    return {"boxes": out_boxes, "anomalies": left_anomalies, "candidates": candidates.join(used.hint("merge"), [key, "cand_id"], "left_anti")}


def decision_gate(boxes: DataFrame, candidates: DataFrame, anomalies: DataFrame, key: str = "image_id",
                  conf_threshold: float = 0.25, anomaly_threshold: float = 0.40) -> DataFrame:
    """KNOWN / UNKNOWN / REJECT over three candidate streams. Each input carries has_shadow for its boxes."""
    parts = gate_overlap(boxes, candidates, anomalies, key)
    hit = F.col("cand_id").isNotNull()
    b = parts["boxes"]
    strong = F.col("conf") >= conf_threshold
    known = strong & (F.col("has_shadow") | hit | (F.col("conf") >= 0.55))
    odd = ~strong & ((F.col("ae_score") >= anomaly_threshold) | hit)
    from_boxes = b.select(
        key, F.lit("box").alias("stream"), F.col("box_id").alias("item_id"),
        F.when(known, "KNOWN_DEBRIS").when(odd, "UNKNOWN_ANOMALY").otherwise("REJECT").alias("category"),
        F.when(odd, F.greatest("ae_score", F.lit(0.5))).otherwise(F.col("conf")).alias("confidence"),
        F.col("ae_score").alias("anomaly_score"), (hit & (known | odd)).alias("cfar_confirmed"),
        F.when(known, "High YOLO confidence with confirmed acoustic signature")
        .when(odd, "Low YOLO class match but elevated anomaly score & CFAR highlight")
        .when(strong, "Rejected: Lacks acoustic shadow and CFAR confirmation (spurious clutter)")
        .otherwise("Rejected: Below confidence threshold").alias("reason"))
    from_anomalies = parts["anomalies"].filter(F.col("anomaly_score") >= anomaly_threshold).select(
        key, F.lit("anomaly").alias("stream"), F.col("anom_id").alias("item_id"), F.lit("UNKNOWN_ANOMALY").alias("category"),
        F.col("anomaly_score").alias("confidence"), "anomaly_score", hit.alias("cfar_confirmed"),
        F.lit("Significant autoencoder reconstruction error (novel acoustic structure)").alias("reason"))
    from_candidates = parts["candidates"].filter((F.col("contrast_ratio") >= 2.2) & F.col("has_shadow")).select(
        key, F.lit("candidate").alias("stream"), F.col("cand_id").alias("item_id"), F.lit("UNKNOWN_ANOMALY").alias("category"),
        F.least(F.lit(0.85), F.col("contrast_ratio") / 3.0).alias("confidence"), F.lit(0.35).alias("anomaly_score"),
        F.lit(True).alias("cfar_confirmed"), F.lit("Strong OS-CFAR highlight with verified acoustic shadow").alias("reason"))
    return from_boxes.unionByName(from_anomalies).unionByName(from_candidates)


def triage_summary(decisions: DataFrame) -> DataFrame:
    c = F.col("category")
    return decisions.agg(F.count_if(c == "KNOWN_DEBRIS").alias("known_debris_count"),
                         F.count_if(c == "UNKNOWN_ANOMALY").alias("unknown_anomaly_count"),
                         F.count_if(c == "REJECT").alias("rejected_count"))
