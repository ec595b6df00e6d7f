"""Human review of uncertain detections: queue, decisions, archive, retraining set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sonarlake.plans.totals import with_totals


def _or(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def enqueue(dets: DataFrame, reason: str = "High Uncertainty", ident: str = "det_id") -> DataFrame:
    """Queue rows with the fields a reviewer needs; absent fields take their defaults."""
    return dets.select(
        F.concat(F.lit("sample_"), F.col(ident).cast("string")).alias("id"), _or(dets, "class_name", "Target").alias("class_name"),
        _or(dets, "conf", 0.88).alias("confidence"), _or(dets, "uncertainty_flag", "MODERATE").alias("uncertainty_flag"),
        _or(dets, "uncertainty_variance", 0.012).alias("uncertainty_variance"), _or(dets, "latitude", 13.0827).alias("latitude"),
        _or(dets, "longitude", 80.2707).alias("longitude"), _or(dets, "error_ellipse_a", 3.2).alias("error_ellipse_a"),
        _or(dets, "crop_path", "").alias("crop_path"), F.lit(reason).alias("flag_reason"), F.lit("PENDING").alias("status"))


def pending_queue(queue: DataFrame, order: str | None = None) -> DataFrame:
    """Open items, newest first: by ``order`` (an arrival time or number), else by the number at the end of the id."""
    newest = F.col(order) if order else F.regexp_extract("id", r"(\d+)$", 1).try_cast("decimal(38,0)")
    return queue.filter(F.col("status") == "PENDING").orderBy(newest.desc_nulls_last(), F.col("id").desc())


def apply_reviews(queue: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move decided items to the archive: (remaining queue, archive rows).

    ``actions``: id, action, corrected_class, operator_notes. The corrected class counts only for RELABEL.
    """
    done = queue.drop("status").join(actions, "id").withColumns({
        "status": F.lit("REVIEWED"), "final_class": F.when(F.col("action") == "RELABEL", F.col("corrected_class")).otherwise(F.col("class_name"))})
    return queue.join(actions.select("id"), "id", "left_anti"), done.drop("corrected_class")


def archive_stats(archive: DataFrame) -> DataFrame:
    a = F.col("action")
    return archive.agg(F.count(F.lit(1)).alias("total_reviewed"), F.count_if(a == "CONFIRM").alias("confirmed"),
                       F.count_if(a == "RELABEL").alias("relabeled"), F.count_if(a == "REJECT").alias("rejected"))


def update_review(dets: DataFrame, updates: DataFrame, ident: str = "det_id") -> DataFrame:
    """New review status on stored detections, and a new class where one is given (empty text = none)."""
    u = updates.select(ident, F.col("status").alias("_s"), F.nullif(F.col("corrected_class"), F.lit("")).alias("_c"))
    return dets.join(u, ident, "left").withColumns({
        "reviewed_status": F.coalesce("_s", _or(dets, "reviewed_status", "UNREVIEWED")), "class_name": F.coalesce("_c", "class_name")}).drop("_s", "_c")


def training_set(archive: DataFrame, classes: Sequence[str], minimum: int = 2) -> DataFrame:
    """Confirmed and relabelled items with their class index (unknown names map to 0); empty below ``minimum`` items."""
    good = archive.filter(F.col("action").isin("CONFIRM", "RELABEL"))
    index = F.greatest(F.array_position(F.array(*[F.lit(c) for c in classes]), F.coalesce("final_class", "class_name")) - 1, F.lit(0))
    enough = with_totals(good, good.agg((F.count(F.lit(1)) >= minimum).alias("_enough"))).filter("_enough").drop("_enough")
    return enough.withColumn("label_idx", index)
