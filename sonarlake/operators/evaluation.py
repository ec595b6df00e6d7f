"""Labels against predictions: matching, error analysis, average precision, region scoring, sweeps, classification.

``pred``: image_id, class_id, pred id, conf, x1..y2. ``gt``: image_id, class_id, gt id, x1..y2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.plans.durable import discard, save_table
from sonarlake.plans.ordered import dense_index, running_sums
from sonarlake.plans.spatial import BOX, WIDE_TILE, best_overlap, box_pairs, pair_iou
from sonarlake.plans.totals import with_totals

P_ID, G_ID, KEY = "pred_id", "gt_id", "image_id"


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


# ---- greedy one-to-one matching -----------------------------------------------------------------------------------------

def _edges(pred: DataFrame, gt: DataFrame, min_iou: float, keys: Sequence[str]) -> DataFrame:
    """(prediction, pile of identical labels) with IoU at least ``min_iou``; ``cap`` is the size of the pile."""
    piles = gt.groupBy(*keys, *BOX).agg(F.min(G_ID).alias("pile"), F.count(F.lit(1)).alias("cap"))
    asked = pred.select(*keys, *BOX, F.struct(P_ID, "conf").alias("_p"))
    tagged = piles.withColumn("_r", F.struct("pile", "cap"))
    pairs = box_pairs(asked, tagged, keys, "_p", "_r", tile=WIDE_TILE).withColumn("iou", pair_iou()).filter(F.col("iou") >= min_iou)
    turn = F.struct((-F.col("_p.conf")).alias("c"), F.col(f"_p.{P_ID}").alias("i")).alias("turn")
    return pairs.select(*keys, f"_p.{P_ID}", turn, "_r.pile", "_r.cap", "iou")


SMALL_GROUP = 20_000  # edges of a key (image, class) that one task may walk


def _walk(keys: Sequence[str], thresholds: Sequence[float]):
    """The sequential loop over edges sorted by key, turn, IoU descending and label; yields what each prediction takes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = pred = None
        used: list[dict[int, int]] = []
        open_: list[int] = []
        for b in batches:
            out = []
            for *k, p, c, pile, cap, iou in zip(*[b[x].tolist() for x in (*keys, P_ID, "_c", "pile", "cap", "iou")]):
                if k != key:
                    key, pred, used = k, None, [{} for _ in thresholds]
                if p != pred:
                    pred, open_ = p, list(range(len(thresholds)))
                if not open_:
                    continue
                rest = []
                for t in open_:
                    taken = used[t].get(pile, 0)
                    if iou >= thresholds[t] and taken < cap:
                        used[t][pile] = taken + 1
                        out.append((thresholds[t], p, c, pile, cap, iou))
                    else:
                        rest.append(t)
                open_ = rest
            yield pd.DataFrame(out, columns=["thr", P_ID, "_c", "pile", "cap", "iou"])

    return run


def _assign(edges: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Each prediction in turn takes the best free label, per threshold: highest IoU, then lowest label id.

    Predictions and labels of different keys never meet, so keys with few edges are shuffled once and walked by the task
    that holds them; keys with more than ``SMALL_GROUP`` edges are solved in rounds.
    """
    edges = save_table(edges, "edges")[0]
    big = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL_GROUP).select(*keys)
    big = save_table(big, "big")[0]  # at most one row per SMALL_GROUP edges
    types = dict(edges.dtypes)
    small = edges.join(F.broadcast(big), list(keys), "left_anti").select(*keys, P_ID, F.col("turn.c").alias("_c"), "pile", "cap", "iou")
    small = small.repartition(*keys).sortWithinPartitions(*keys, "_c", P_ID, F.col("iou").desc(), "pile")
    shape = f"thr double, {P_ID} {types[P_ID]}, _c double, pile {types['pile']}, cap bigint, iou double"
    took = small.mapInPandas(_walk(keys, thresholds), shape).select(
        "thr", P_ID, F.struct(F.col("_c").alias("c"), F.col(P_ID).alias("i")).alias("turn"), "pile", "cap", "iou")
    if big.isEmpty():
        return took
    reach = F.filter(F.array(*[F.lit(x) for x in thresholds]), lambda x: F.col("iou") >= x)
    many = edges.join(F.broadcast(big), list(keys), "left_semi").select(P_ID, "turn", "pile", "cap", "iou", F.explode(reach).alias("thr"))
    return took.unionByName(_rounds(many, ["thr"]))


def _rounds(edges: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The same for groups of any size.

    Solved in rounds: every prediction asks for its best remaining label, a label holds the earliest askers up to its
    capacity, and what a label can no longer give is withdrawn. A label only ever improves what it holds, so the result
    is the sequential one. Labels that share an exact box form a pile; if two different boxes tie in IoU for a
    prediction, the pile with the lower first id is used up first.
    """
    spark = edges.sparkSession
    ex = list(extra)
    left, path = save_table(edges, "edges")
    shared = not left.filter("cap > 1").isEmpty()
    while True:
        wish = left.groupBy(*ex, P_ID, "turn").agg(F.max(F.struct(F.col("iou"), (-F.col("pile")).alias("n"), F.col("cap"))).alias("_b"))
        wish = wish.select(*ex, P_ID, "turn", (-F.col("_b.n")).alias("pile"), F.col("_b.cap").alias("cap"), F.col("_b.iou").alias("iou"))
        limit = wish.filter("cap = 1").groupBy(*ex, "pile").agg(F.min("turn").alias("_last"))
        if shared:
            many = dense_index(wish.filter("cap > 1"), [*ex, "pile"], ["turn"], "_no")
            limit = limit.unionByName(many.filter(F.col("_no") == F.col("cap") - 1).select(*ex, "pile", F.col("turn").alias("_last")))
        kept = left.join(limit, [*ex, "pile"], "left").filter(F.col("_last").isNull() | (F.col("turn") <= F.col("_last"))).drop("_last")
        nxt, nxt_path = save_table(kept, "edges")
        if nxt.count() == left.count():
            discard(spark, nxt_path)
            break
        discard(spark, path)
        left, path = nxt, nxt_path
    return wish


def greedy_match(pred: DataFrame, gt: DataFrame, min_iou: float = 0.5, same_class: bool = True) -> DataFrame:
    """One-to-one matches (image_id, pred_id, gt_id, iou) in prediction order (conf descending, then id)."""
    keys = [KEY, "class_id"] if same_class else [KEY]
    return _matches(_edges(pred, gt, min_iou, keys), pred, gt, min_iou, keys)


def _matches(edges: DataFrame, pred: DataFrame, gt: DataFrame, min_iou: float, keys: Sequence[str]) -> DataFrame:
    wish = save_table(_assign(edges, keys, [min_iou]).drop("thr"), "wish")[0]
    return _with_label_ids(wish, gt, keys).join(pred.select(P_ID, KEY), P_ID).select(KEY, P_ID, G_ID, "iou", "turn")


def _with_label_ids(wish: DataFrame, gt: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Name the label of a pile: the n-th holder gets the n-th label id."""
    ex = list(extra)
    single = wish.filter("cap = 1").withColumn(G_ID, F.col("pile"))
    if wish.filter("cap > 1").isEmpty():
        return single
    holders = dense_index(wish.filter("cap > 1"), [*ex, "pile"], ["turn"], "_no")
    piles = gt.groupBy(*keys, *BOX).agg(F.min(G_ID).alias("pile"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    ids = dense_index(gt.join(piles, [*keys, *BOX]).select("pile", G_ID), ["pile"], [G_ID], "_no")
    return single.unionByName(holders.join(ids, ["pile", "_no"]).drop("_no").select(*single.columns))


def error_analysis(pred: DataFrame, gt: DataFrame, conf: float = 0.25, min_iou: float = 0.5, low: float = 0.10, poor: float = 0.1) -> dict[str, DataFrame]:
    """``predictions`` with verdict TP / POOR_LOCALISATION / FP / LOW_CONF, and ``labels`` with a matched flag.

    Poor localisation looks at the labels still free at the prediction's turn.
    """
    used = pred.filter(F.col("conf") >= conf)
    edges, _ = save_table(_edges(used, gt, min(poor, min_iou), [KEY, "class_id"]), "edges")
    matches, _ = save_table(_matches(edges.filter(F.col("iou") >= min_iou), used, gt, min_iou, [KEY, "class_id"]), "matches")
    near = edges.filter(F.col("iou") >= poor).join(matches.select(P_ID), P_ID, "left_anti")
    # a pile still has a free label at a turn if fewer of its labels were taken before than it holds
    taken = gt.join(matches.select(G_ID, F.col("turn").alias("_t")), G_ID, "left").groupBy(KEY, "class_id", *BOX).agg(
        F.min(G_ID).alias("pile"), F.count(F.lit(1)).alias("_c"), F.count("_t").alias("_used"), F.max("_t").alias("_lastturn"))
    free = near.join(taken.select("pile", "_c", "_used", "_lastturn"), "pile").filter(
        (F.col("_used") < F.col("_c")) | (F.col("_lastturn") > F.col("turn")))
    poorly = free.groupBy(P_ID).agg(F.max("iou").alias("best_iou"))
    judged = (used.join(matches.select(P_ID, G_ID, F.col("iou").alias("match_iou")), P_ID, "left").join(poorly, P_ID, "left")
              .withColumn("verdict", F.when(F.col(G_ID).isNotNull(), "TP").when(F.col("best_iou").isNotNull(), "POOR_LOCALISATION").otherwise("FP")))
    weak = pred.filter((F.col("conf") >= low) & (F.col("conf") < conf)).withColumns(
        {G_ID: F.lit(None).cast(gt.schema[G_ID].dataType), "match_iou": F.lit(None).cast("double"), "best_iou": F.lit(None).cast("double"),
         "verdict": F.lit("LOW_CONF")})
    labels = gt.join(matches.select(G_ID, F.lit(True).alias("matched")), G_ID, "left").na.fill(False, ["matched"])
    return {"predictions": judged.unionByName(weak.select(*judged.columns)), "labels": labels}


def error_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """Totals: every unmatched prediction is a false positive, poorly localised ones included."""
    v = F.col("verdict")
    p = parts["predictions"].agg(
        F.count_if(v == "TP").alias("true_positives"), F.count_if(v.isin("FP", "POOR_LOCALISATION")).alias("false_positives"),
        F.count_if(v == "POOR_LOCALISATION").alias("poor_localization"), F.count_if(v == "LOW_CONF").alias("low_confidence"))
    g = parts["labels"].agg(F.count(F.lit(1)).alias("labels"), F.count_if(~F.col("matched")).alias("false_negatives"))
    out = with_totals(p, g)
    return out.withColumns({"precision": ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives")),
                            "recall": ratio(F.col("true_positives"), F.col("labels"))})


def size_category(area_share: Column) -> Column:
    return F.when(area_share < 0.002, "very_small").when(area_share < 0.01, "small").when(area_share < 0.05, "medium").otherwise("large")


def miss_rates(labels: DataFrame, image_area: float) -> DataFrame:
    """Missed share by class and by size in one pass (grouping sets)."""
    sized = labels.withColumn("size_cat", size_category((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / image_area))
    g = sized.groupingSets([[F.col("class_id")], [F.col("size_cat")]], F.col("class_id"), F.col("size_cat")).agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(~F.col("matched")).alias("missed"))
    return g.withColumn("miss_rate", F.col("missed") / F.col("labels"))


def true_positive_ranks(pred: DataFrame, gt: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per class and IoU threshold the true positives in order: ``tps`` counts them, ``rank`` all predictions up to each; with n_gt.

    Predictions are ranked once per class; only matched ones are listed per threshold, all thresholds matched in one run.
    """
    ths = [round(float(x), 4) for x in thresholds]
    edges = _edges(pred, gt, min(ths), [KEY, "class_id"])
    hits = _assign(edges, [KEY, "class_id"], ths).select(P_ID, "thr")
    ranks = dense_index(pred.select("class_id", P_ID, "conf"), ["class_id"], [F.col("conf").desc(), F.col(P_ID)], "rank", start=1)
    found = dense_index(hits.join(ranks, P_ID).select("class_id", "thr", "rank", P_ID, "conf"), ["class_id", "thr"], ["rank"], "tps", start=1)
    return found.join(gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt")), "class_id")


def average_precision(pred: DataFrame, gt: DataFrame, thresholds: Sequence[float] = tuple(0.5 + 0.05 * i for i in range(10))) -> DataFrame:
    """AP per class and IoU threshold with 101-point interpolation.

    Precision falls between true positives, so its envelope over 101 recall steps needs the true positives only.
    """
    ths = [round(float(x), 4) for x in thresholds]
    steps = (true_positive_ranks(pred, gt, ths).groupBy("class_id", "thr", F.floor(F.col("tps") * 100 / F.col("n_gt")).alias("step"))
             .agg(F.max(F.col("tps") / F.col("rank")).alias("p")))
    grid = gt.select("class_id").distinct().select("class_id", F.explode(F.array(*[F.lit(x) for x in ths])).alias("thr"))
    grid = grid.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(100)).cast("array<bigint>")))
    ahead = Window.partitionBy("class_id", "thr").orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    envelope = grid.join(steps, ["class_id", "thr", "step"], "left").withColumn("p", F.coalesce(F.max("p").over(ahead), F.lit(0.0)))
    return envelope.groupBy("class_id", "thr").agg(F.avg("p").alias("ap"))


def class_scores(pred: DataFrame, gt: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and confidence per class at the cut of highest F1 (ties: the higher confidence).

    A class with labels but no true positive scores zero, its cut is null.
    """
    ranks = true_positive_ranks(pred, gt, [min_iou])
    p, rec = F.col("tps") / F.col("rank"), F.col("tps") / F.col("n_gt")
    scored = ranks.withColumns({"precision": p, "recall": rec, "f1": 2 * F.col("tps") / (F.col("rank") + F.col("n_gt"))})
    top = F.max(F.struct("f1", (-F.col("rank")).alias("_r"), "precision", "recall", F.col("conf").alias("cut"))).alias("_b")
    best = scored.groupBy("class_id").agg(top).select("class_id", "_b.precision", "_b.recall", "_b.f1", "_b.cut")
    return gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt")).join(best, "class_id", "left").na.fill(0.0, ["precision", "recall", "f1"])


def map_summary(ap: DataFrame) -> DataFrame:
    """Per class AP@50 and AP@50-95; class_id null is the mean over classes."""
    per = ap.groupBy("class_id").agg(F.max(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    return per.unionByName(per.agg(F.lit(None).cast(per.schema["class_id"].dataType).alias("class_id"), F.avg("ap50").alias("ap50"), F.avg("ap50_95").alias("ap50_95")))


def mean_iou(pred: DataFrame, gt: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Mean IoU of predictions whose best label over all classes has their own class; null class = overall."""
    best = best_overlap(pred.select(KEY, P_ID, "class_id", *BOX), gt, [KEY], G_ID, match=G_ID)
    ok = best.filter(F.col("best_iou") >= min_iou).join(gt.select(G_ID, F.col("class_id").alias("gt_class")), G_ID).filter("class_id = gt_class")
    return ok.rollup("class_id").agg(F.avg("best_iou").alias("mean_iou"), F.count(F.lit(1)).alias("n"))


# ---- region scoring -------------------------------------------------------------------------------------------------------

def gate_score(det: DataFrame) -> Column:
    """Lowest threshold that still drops the record is just above this value; records that are always kept get infinity."""
    always = (F.col("detection_type") == "known") | (F.coalesce("anomaly_score", F.lit(0.0)) >= 0.5)
    return F.when(always, F.lit(float("inf"))).otherwise(F.col("conf"))


def region_hits(gt: DataFrame, det: DataFrame, mode: str = "region", min_iou: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Labels with the best gate score that finds them, and detections with an ``inside`` flag.

    ``region``: the detection's centre lies in the label's box. ``iou``: overlap of at least ``min_iou``. Identical
    positions and identical boxes are compared once.
    """
    scored = det.withColumn("_g", gate_score(det))
    if mode == "region":
        spot = scored.withColumns({"_cx": F.expr("(x1 + x2) / 2"), "_cy": F.expr("(y1 + y2) / 2")})
        shapes = spot.groupBy(KEY, "_cx", "_cy").agg(F.max("_g").alias("_g")).select(
            KEY, "_g", F.col("_cx").alias("x1"), F.col("_cy").alias("y1"), F.col("_cx").alias("x2"), F.col("_cy").alias("y2"))
        back = [F.col("l_x1").alias("_cx"), F.col("l_y1").alias("_cy")]
        on = [KEY, "_cx", "_cy"]
    else:
        spot = scored
        shapes = spot.groupBy(KEY, *BOX).agg(F.max("_g").alias("_g"))
        back = [F.col(f"l_{c}").alias(c) for c in BOX]
        on = [KEY, *BOX]
    boxes = gt.select(KEY, *BOX).distinct().withColumn("_r", F.lit(0))
    pairs = box_pairs(shapes, boxes, [KEY], "_g", "_r", tile=WIDE_TILE)
    if mode != "region":
        pairs = pairs.filter(pair_iou() >= min_iou)
    found = pairs.groupBy(KEY, *[F.col(f"r_{c}").alias(c) for c in BOX]).agg(F.max("_g").alias("found_by"))
    good = pairs.select(KEY, *back).distinct().withColumn("inside", F.lit(True))
    labels = gt.join(found, [KEY, *BOX], "left")
    dets = spot.join(good, on, "left").na.fill(False, ["inside"]).withColumnRenamed("_g", "gate")
    return labels, dets


def sweep(labels: DataFrame, dets: DataFrame, thresholds: Sequence[float], n_frames: int | None = None) -> DataFrame:
    """Scores at every threshold from one matching run: each row lists the thresholds it passes, then one aggregate."""
    ths = F.array(*[F.lit(float(x)) for x in thresholds])
    d = dets.select("inside", F.explode(F.filter(ths, lambda x: F.col("gate") >= x)).alias("threshold")).groupBy("threshold").agg(
        F.count(F.lit(1)).alias("detections"), F.count_if(~F.col("inside")).alias("false_alarms"))
    g = labels.select(F.explode(F.transform(ths, lambda x: F.struct(x.alias("t"), F.coalesce(F.col("found_by") >= x, F.lit(False)).alias("f")))).alias("_x")).groupBy(
        F.col("_x.t").alias("threshold")).agg(F.count(F.lit(1)).alias("n_gt"), F.count_if(F.col("_x.f")).alias("objects_found"))
    out = g.join(d, "threshold", "left").na.fill(0, ["detections", "false_alarms"]).withColumn("objects_missed", F.col("n_gt") - F.col("objects_found"))
    out = out.withColumns({"precision": ratio(F.col("detections") - F.col("false_alarms"), F.col("detections")), "recall": ratio(F.col("objects_found"), F.col("n_gt"))})
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out if n_frames is None else out.withColumn("false_alarms_per_frame", F.col("false_alarms") / max(1, n_frames))


def best_threshold(scores: DataFrame, prefer_high: bool = False) -> DataFrame:
    """Row with the best F1; the lowest (or highest) threshold wins ties. One row per threshold comes in."""
    tie = F.col("threshold") if prefer_high else -F.col("threshold")
    return scores.agg(F.max(F.struct(F.col("f1"), tie.alias("t"), F.struct(*scores.columns).alias("r"))).alias("_m")).select("_m.r.*")


def confidence_sweep(matches: DataFrame, n_gt: DataFrame, cuts: Sequence[float] = (0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60)) -> DataFrame:
    """P / R / F1 per cut-off from (conf, is_tp) rows; ``n_gt`` is a one-row table with column n_gt."""
    c = F.array(*[F.lit(float(x)) for x in cuts])
    hit = matches.select("is_tp", F.explode(F.filter(c, lambda x: F.col("conf") >= x)).alias("cut")).groupBy("cut").agg(
        F.count_if("is_tp").alias("tp"), F.count(F.lit(1)).alias("n"))
    out = with_totals(hit, n_gt.select("n_gt"))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("n")), "recall": ratio(F.col("tp"), F.col("n_gt"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def ablation(df: DataFrame, n_gt: DataFrame, pairs: Sequence[tuple[float, float]] = ((0.7, 0.3), (0.6, 0.4), (0.5, 0.5), (0.4, 0.6)),
             reject: float = 0.30) -> DataFrame:
    """Fusion weights compared: rows with conf, seg_quality, is_tp are scored under every (alpha, beta) at once.

    The unfused detector is included as alpha 1, beta 0 with nothing rejected.
    """
    options = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta")) for a, b in ((1.0, 0.0), *pairs)])
    x = df.select("conf", "seg_quality", "is_tp", F.explode(options).alias("o")).select("*", "o.*")
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("alpha") * F.col("conf") + F.col("beta") * F.col("seg_quality"))), 4)
    keep = (F.col("beta") == 0) | (score >= reject)
    g = x.withColumn("_k", keep).groupBy("alpha", "beta").agg(
        F.count_if("_k").alias("kept"), F.count_if(F.col("_k") & F.col("is_tp")).alias("tp"),
        F.count_if(~F.col("_k") & ~F.col("is_tp")).alias("fp_rejected"), F.count_if(~F.col("is_tp")).alias("_fp"))
    out = with_totals(g, n_gt.select("n_gt"))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("kept")), "recall": ratio(F.col("tp"), F.col("n_gt")),
                           "fp_rejection": F.col("fp_rejected") / F.greatest(F.lit(1), F.col("_fp"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).drop("_j", "_fp", "n_gt")


def e2e_rates(gt: DataFrame, det: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Per-image outcome shares for images with labels: correct, wrong class only, unknown only, nothing; precision."""
    known = det.filter(F.col("detection_type") == "known")
    good = best_overlap(known.select(KEY, "det_id", "class_id", *BOX), gt, [KEY, "class_id"], G_ID).withColumn(
        "good", F.coalesce(F.col("best_iou") >= min_iou, F.lit(False)))
    k = good.groupBy(KEY).agg(F.count(F.lit(1)).alias("known"), F.count_if("good").alias("good"))
    a = det.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("detection_type") == "unknown").alias("unknown"))
    img = gt.select(KEY).distinct().join(k, KEY, "left").join(a, KEY, "left").na.fill(0, ["known", "good", "n", "unknown"])
    share = lambda c: F.avg(c.cast("int"))
    return img.agg(
        F.count(F.lit(1)).alias("images"), share(F.col("good") > 0).alias("correct_rate"),
        share((F.col("good") == 0) & (F.col("known") > 0)).alias("wrong_known_only_rate"),
        share((F.col("known") == 0) & (F.col("unknown") > 0)).alias("unknown_only_rate"), share(F.col("n") == 0).alias("nothing_rate"),
        (F.sum("good") / F.greatest(F.lit(1), F.sum("known"))).alias("known_precision"),
        (F.sum(F.col("known") - F.col("good")) / F.count(F.lit(1))).alias("false_known_per_image"))


# ---- classification ---------------------------------------------------------------------------------------------------------

def confusion(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Long confusion matrix with row shares."""
    c = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def confusion_wide(df: DataFrame, classes: Sequence, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    return df.groupBy(truth).pivot(guess, list(classes)).count().na.fill(0)


def classification_report(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Per class precision / recall / F1 / support from a confusion table."""
    c = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(F.col(truth).alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col(guess).alias("cls")).agg(F.sum("n").alias("predicted"))
    out = t.join(p, "cls", "full").na.fill(0, ["support", "tp", "predicted"])
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def report_averages(report: DataFrame) -> DataFrame:
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.greatest(F.lit(1), F.sum("support"))
    names = ("precision", "recall", "f1")
    return report.agg((F.sum("tp") / F.greatest(F.lit(1), F.sum("support"))).alias("accuracy"), *[F.avg(n).alias(f"macro_{n}") for n in names],
                      *[w(n).alias(f"weighted_{n}") for n in names])


def topk_accuracy(df: DataFrame, k: int, truth: str = "y_true") -> DataFrame:
    """Share of rows whose true class is among the k most probable (array ``probs``; ties to the lower class)."""
    tp = F.get("probs", F.col(truth).cast("int"))
    ahead = F.size(F.filter(F.transform("probs", lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                            lambda s: (s["p"] > tp) | ((s["p"] == tp) & (s["i"] < F.col(truth)))))
    return df.agg(F.avg((ahead < k).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# ---- masks ------------------------------------------------------------------------------------------------------------------

def mask_metrics(pred: DataFrame, gt: DataFrame, cell: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pixel precision / recall / IoU / Dice of two sparse masks (keys + cell columns)."""
    on = [*keys, *cell]
    j = pred.select(*on).distinct().withColumn("p", F.lit(1)).join(gt.select(*on).distinct().withColumn("g", F.lit(1)), on, "full").na.fill(0, ["p", "g"])
    s = j.groupBy(*keys).agg(F.sum(F.col("p") * F.col("g")).alias("tp"), F.sum("p").alias("_p"), F.sum("g").alias("_g"))
    return s.select(*keys, "tp", ratio(F.col("tp"), F.col("_p")).alias("precision"), ratio(F.col("tp"), F.col("_g")).alias("recall"),
                    ratio(F.col("tp"), F.col("_p") + F.col("_g") - F.col("tp")).alias("iou"), ratio(2 * F.col("tp"), F.col("_p") + F.col("_g")).alias("dice"))


def instance_mask_iou(matches: DataFrame, pred_masks: DataFrame, gt_masks: DataFrame, cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """Mask IoU of each matched pair. A mask is listed by its cells, in whole numbers; a block of 8 x 8 cells travels as the bits of one.

    A pair with a mask on neither side is left out.
    """
    pairs = matches.select(P_ID, G_ID)
    row, col = (F.col(c).cast("bigint") for c in cell)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.pmod(row, F.lit(8)) * 8 + F.pmod(col, F.lit(8))).cast("int"))
    block = [F.shiftright(row, 3).alias("_ty"), F.shiftright(col, 3).alias("_tx")]

    def blocks_of(masks: DataFrame, ident: str, name: str, other: str) -> DataFrame:
        blocks = masks.groupBy(ident, *block).agg(F.bit_or(bit).alias(name)).join(pairs.hint("merge"), ident)
        return blocks.select(P_ID, G_ID, "_ty", "_tx", name, F.lit(None).cast("bigint").alias(other))

    both = blocks_of(pred_masks, P_ID, "_p", "_g").unionByName(blocks_of(gt_masks, G_ID, "_g", "_p"))
    met = both.repartition(P_ID, G_ID).groupBy(P_ID, G_ID, "_ty", "_tx").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("_p", "_g")])
    s = met.groupBy(P_ID, G_ID).agg(F.sum(F.bit_count(F.col("_p").bitwiseAND(F.col("_g")))).alias("_tp"), F.sum(F.bit_count(F.col("_p").bitwiseOR(F.col("_g")))).alias("_all"))
    return s.select(P_ID, G_ID, ratio(F.col("_tp"), F.col("_all")).alias("iou"))


def mask_iou_summary(ious: DataFrame) -> DataFrame:
    return ious.agg(F.count(F.lit(1)).alias("n_matched"), F.avg("iou").alias("mean_mask_iou"), F.avg((F.col("iou") >= 0.5).cast("int")).alias("frac_ge_half"))


def parity(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Agreement of two scorers: rows in common, rows on one side only, largest absolute and relative difference."""
    j = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), list(key), "full")
    d = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(F.count_if(d.isNotNull()).alias("compared"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("one_sided"),
                 F.max(d).alias("max_abs_diff"), F.max(d / F.greatest(F.abs("_a"), F.lit(1e-12))).alias("max_rel_diff"))
