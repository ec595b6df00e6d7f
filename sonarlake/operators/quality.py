"""Survey coverage quality index and quality-control table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.config import QualityLimits
from sonarlake.functions.boxes import clip
from sonarlake.functions.scores import rounded

# Grades with their lower bounds and coverage texts.
GRADES = [
    (85.0, "EXCELLENT", "Nominal Hydrographic Survey Quality (100% Swath Overlap)"),
    (70.0, "GOOD", "Acceptable Survey Quality (<5% Edge Distortion)"),
    (55.0, "ACCEPTABLE", "Sub-Optimal Swath (Minor Motion Jitter)"),
    (40.0, "DEGRADED", "Severe Acoustic Degradation (Resurvey Advised)"),
    (None, "RESURVEY_REQUIRED", "Critical Data Dropout / Blind Zone (Resurvey Mandatory)"),
]


def _graded(score: Column, pick: int) -> Column:
    out = F.lit(GRADES[-1][pick])
    for row in reversed(GRADES[:-1]):
        out = F.when(score >= row[0], row[pick]).otherwise(out)
    return out


def _or_default(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def scqi(df: DataFrame, resurvey_threshold: float = 55.0) -> DataFrame:
    """Coverage quality per row from snr_db / snr_valid, p10 / p90 and telemetry; missing telemetry counts as ideal.

    Missing signal figures score 30 for SNR and 50 for shadow clarity.
    """
    snr_ok = F.coalesce(F.col("snr_valid"), F.lit(False)) & F.col("snr_db").isNotNull()
    alt, slant = _or_default(df, "altitude_m", 10.0), _or_default(df, "slant_range_m", 75.0)
    pitch, roll = F.abs(_or_default(df, "pitch_deg", 0.0)), F.abs(_or_default(df, "roll_deg", 0.0))
    heave, speed = F.abs(_or_default(df, "heave_m", 0.0)), _or_default(df, "speed_knots", 3.5)
    ratio = alt / F.greatest(F.lit(1.0), slant) * 100.0
    parts = df.withColumns({
        "_snr": F.when(snr_ok, clip((F.col("snr_db") - 2.0) / 14.0 * 100.0, 0.0, 100.0)).otherwise(F.lit(30.0)),
        "_alt": F.when(ratio.between(10.0, 20.0), F.lit(100.0))
        .when(ratio < 10.0, F.greatest(F.lit(10.0), 100.0 - (10.0 - ratio) * 12.0))
        .otherwise(F.greatest(F.lit(10.0), 100.0 - (ratio - 20.0) * 6.0)),
        "_motion": clip(100.0 - (pitch * 8.0 + roll * 6.0 + heave * 20.0), 0.0, 100.0),
        "_speed": F.when(speed.between(3.0, 4.5), F.lit(100.0))
        .when(speed > 4.5, F.greatest(F.lit(15.0), 100.0 - (speed - 4.5) * 22.0))
        .otherwise(F.greatest(F.lit(30.0), 100.0 - (3.0 - speed) * 25.0)),
        "_shadow": F.when(F.col("p90").isNotNull(), clip((F.col("p90") - F.col("p10")) / 140.0 * 100.0, 0.0, 100.0))
        .otherwise(F.lit(50.0)),
    })
    reasons = F.array_compact(F.array(
        F.when(~snr_ok, F.lit("Acoustic SNR could not be verified or is critically degraded."))
        .when(F.col("_snr") < 40.0,
              F.format_string("Degraded acoustic SNR (%.1f dB); high ambient seabed clutter / turbidity.", "snr_db")),
        F.when(ratio < 10.0, F.format_string(
            "Towfish altitude too low (%.1fm, %.1f%% of range); acoustic grazing angle suboptimal.", alt, ratio))
        .when(ratio > 20.0, F.format_string(
            "Towfish altitude too high (%.1fm, %.1f%% of range); acoustic shadow length compressed.", alt, ratio)),
        F.when(F.col("_motion") < 50.0, F.format_string(
            "High vehicle attitude disturbance (Pitch: %.1fdeg, Roll: %.1fdeg, Heave: %.2fm); causes cross-track beam distortion.",
            pitch, roll, heave)),
        F.when(speed > 5.5, F.format_string(
            "Survey speed excessive (%.1f knots > 4.5 knots); risk of along-track ping gaps.", speed))
        .when(speed < 2.0, F.format_string("Survey speed low (%.1f knots); potential towfish crabbing.", speed)),
        F.when(F.col("p90").isNotNull() & (F.col("_shadow") < 35.0),
               F.lit("Low acoustic shadow contrast; seabed highlights blend into backscatter.")),
    ))
    total = (0.30 * F.col("_snr") + 0.25 * F.col("_alt") + 0.20 * F.col("_motion") + 0.15 * F.col("_speed")
             + 0.10 * F.col("_shadow"))
    scored = parts.withColumn("resurvey_reasons", reasons).withColumn("scqi_raw", clip(total, 0.0, 100.0)).withColumn(
        "scqi", rounded(F.col("scqi_raw"), 1))
    return scored.withColumns({
        "grade": _graded(F.col("scqi"), 1),
        "coverage_status": _graded(F.col("scqi"), 2),
        "snr_score": F.round("_snr", 1), "altitude_score": F.round("_alt", 1), "motion_score": F.round("_motion", 1),
        "speed_score": F.round("_speed", 1), "shadow_score": F.round("_shadow", 1),
        "resurvey_recommended": (F.col("scqi") < resurvey_threshold) | (F.size("resurvey_reasons") >= 3),
        "recommended_speed_knots": F.lit(3.5), "recommended_altitude_m": F.round(slant * 0.15, 1),
    }).drop("_snr", "_alt", "_motion", "_speed", "_shadow")


def quality_control(stats: DataFrame, mid_pings: DataFrame, trajectory: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Named checks per survey as rows (survey_id, check_no, name, passed, value, limit).

    ``stats``: survey_id, n_cells, zero_ratio, saturation_ratio, dynamic_range_db, dropout. ``mid_pings``: the survey's
    middle telemetry record with ``is_valid``. ``trajectory``: survey_id, n_pings, is_valid. Telemetry checks are
    left out for surveys without telemetry, the trajectory check for those with a single ping.
    """
    q = limits
    m = mid_pings.select("survey_id", F.col("is_valid").alias("rec_ok"), "altitude_m",
                         F.greatest(F.abs("pitch_deg"), F.abs("roll_deg")).alias("tilt"), F.lit(True).alias("has_rec"))
    t = trajectory.select("survey_id", "n_pings", F.col("is_valid").alias("traj_ok"))
    wide = stats.join(m, "survey_id", "left").join(t, "survey_id", "left")

    def check(no: int, name: str, passed: Column, value: Column, limit: str, applies: Column | None = None) -> Column:
        row = F.struct(F.lit(no).alias("check_no"), F.lit(name).alias("name"), passed.alias("passed"),
                       value.cast("double").alias("value"), F.lit(limit).alias("limit"))
        return row if applies is None else F.when(applies, row)

    has = F.coalesce(F.col("has_rec"), F.lit(False))
    rows = F.array_compact(F.array(
        check(1, "image_not_empty", F.col("n_cells") > 0, F.col("n_cells"), "> 0"),
        check(2, "zero_ratio", F.col("zero_ratio") <= q.max_zero_ratio, F.col("zero_ratio"), f"<= {q.max_zero_ratio}"),
        check(3, "saturation_ratio", F.col("saturation_ratio") <= q.max_saturation_ratio, F.col("saturation_ratio"),
              f"<= {q.max_saturation_ratio}"),
        check(4, "dynamic_range_db", F.col("dynamic_range_db") >= q.min_dynamic_range_db, F.col("dynamic_range_db"),
              f">= {q.min_dynamic_range_db}"),
        check(5, "ping_dropout", F.col("dropout") <= q.max_zero_ratio, F.col("dropout"), f"<= {q.max_zero_ratio}"),
        check(6, "telemetry_record", F.col("rec_ok"), F.col("rec_ok").cast("int"), "valid", has),
        check(7, "altitude_m", F.col("altitude_m").between(q.min_altitude_m, q.max_altitude_m), F.col("altitude_m"),
              f"[{q.min_altitude_m}, {q.max_altitude_m}]", has),
        check(8, "pitch_roll_deg", F.col("tilt") <= q.max_pitch_roll_deg, F.col("tilt"), f"<= {q.max_pitch_roll_deg}", has),
        check(9, "trajectory_consistency", F.col("traj_ok"), F.col("traj_ok").cast("int"), "consistent",
              has & (F.col("n_pings") > 1)),
    ))
    return wide.select("survey_id", F.inline(rows))


def qc_verdict(checks: DataFrame) -> DataFrame:
    return checks.groupBy("survey_id").agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def middle_pings(pings: DataFrame) -> DataFrame:
    """The record at index floor(n / 2) of each survey."""
    mid = pings.groupBy("survey_id").agg(F.floor((F.max("ping_id") + 1) / F.lit(2.0)).cast("bigint").alias("ping_id"))
    return pings.join(mid, ["survey_id", "ping_id"])
