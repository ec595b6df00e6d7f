"""Telemetry checks. A ping table has (survey_id, ping_id, t_s, latitude, ...); ping_id counts up from 0 per survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions.geo import KNOTS_PER_MPS, haversine

MAX_SPEED_KNOTS = 15.0
CHUNK = 4096


def normalise_heading(df: DataFrame) -> DataFrame:
    """Heading into [0, 360); ``heading_changed`` tells where it was outside."""
    h = F.col("heading_deg")
    outside = ~((h >= 0) & (h < 360))
    return df.withColumn("heading_changed", outside).withColumn("heading_deg", F.when(outside, F.pmod(h, F.lit(360.0))).otherwise(h))


def ping_warnings() -> Column:
    """Ordered list of warning texts for one telemetry record."""
    lat, lon, h = F.col("latitude"), F.col("longitude"), F.col("heading_deg")
    alt, slant = F.col("altitude_m"), F.col("slant_range_m")
    return F.array_compact(F.array(
        F.when(~lat.between(-90, 90), F.concat(F.lit("Invalid latitude: "), lat.cast("string"))),
        F.when(~lon.between(-180, 180), F.concat(F.lit("Invalid longitude: "), lon.cast("string"))),
        F.when(~((h >= 0) & (h < 360)), F.format_string("Heading normalized to [0, 360): %.2f°", F.pmod(h, F.lit(360.0)))),
        F.when(alt <= 0.1, F.format_string("Towfish altitude too low (%.1fm); seabed collision risk or bad nadir.", alt)),
        F.when(alt >= slant, F.format_string("Altitude (%.1fm) exceeds slant range (%.1fm).", alt, slant)),
        F.when(slant <= 1.0, F.concat(F.lit("Invalid slant range: "), slant.cast("string"), F.lit("m"))),
    ))


def ping_is_valid() -> Column:
    return (F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
            & (F.col("altitude_m") < F.col("slant_range_m")) & (F.col("slant_range_m") > 1.0))


def validate_pings(df: DataFrame) -> DataFrame:
    return df.withColumn("warnings", ping_warnings()).withColumn("is_valid", ping_is_valid())


def trajectory_steps(pings: DataFrame, max_speed_knots: float = MAX_SPEED_KNOTS, chunk: int = CHUNK) -> DataFrame:
    """One row per step to the previous ping (the next lower number there is): time, distance, speed, and the two faults.

    A survey is cut into chunks of ping numbers. The step into a chunk's first ping starts at the last ping of the chunks
    before, found over one row per chunk, so lost numbers, whole chunks of them included, make no difference.
    """
    kept = ("t_s", "latitude", "longitude")
    chunks = pings.withColumn("_chunk", F.floor(F.col("ping_id") / F.lit(float(chunk))).cast("bigint"))
    ends = chunks.groupBy("survey_id", "_chunk").agg(F.max(F.struct("ping_id", *kept)).alias("_end"))
    by_survey = Window.partitionBy("survey_id").orderBy("_chunk")
    ends = ends.select("survey_id", "_chunk", F.lag("_end").over(by_survey).alias("_before"))
    w = Window.partitionBy("survey_id", "_chunk").orderBy("ping_id")
    prev = {f"_{c}": F.coalesce(F.lag(c).over(w), F.when(F.row_number().over(w) == 1, F.col(f"_before.{c}"))) for c in kept}
    steps = chunks.join(ends, ["survey_id", "_chunk"]).withColumns(prev).filter(F.col("_t_s").isNotNull())
    dt = F.col("t_s") - F.col("_t_s")
    dist = haversine(F.col("_latitude"), F.col("_longitude"), F.col("latitude"), F.col("longitude"))
    return (
        steps.withColumn("dt_s", dt)
        .withColumn("non_monotonic", F.col("dt_s") <= 0)
        .withColumn("distance_m", F.when(~F.col("non_monotonic"), dist))
        .withColumn("speed_knots", F.when(~F.col("non_monotonic"), dist / F.col("dt_s") * KNOTS_PER_MPS))
        .withColumn("teleport", F.coalesce(F.col("speed_knots") > max_speed_knots, F.lit(False)))
        .select("survey_id", "ping_id", "dt_s", "distance_m", "speed_knots", "non_monotonic", "teleport")
    )


def trajectory_warnings(pings: DataFrame, max_speed_knots: float = MAX_SPEED_KNOTS) -> DataFrame:
    """One row per fault with its text (a long survey may have any number of them, so they are not collected)."""
    i = F.col("ping_id").cast("string")
    before = (F.col("ping_id") - 1).cast("string")
    text = F.when(
        F.col("non_monotonic"),
        F.concat(F.lit("Non-monotonic timestamp at index "), i, F.format_string(": dt=%.3fs", "dt_s")),
    ).otherwise(F.concat(
        F.lit("GPS Teleport Jump detected between ping "), before, F.lit(" & "), i,
        F.format_string(": %.1f kts > max %.1f kts", F.col("speed_knots"), F.lit(float(max_speed_knots)))))
    faults = trajectory_steps(pings, max_speed_knots).filter("non_monotonic or teleport")
    return faults.select("survey_id", "ping_id", text.alias("warning"))


def validate_trajectory(pings: DataFrame, max_speed_knots: float = MAX_SPEED_KNOTS) -> DataFrame:
    """Verdict per survey; a survey of fewer than two pings is valid."""
    steps = trajectory_steps(pings, max_speed_knots)
    faults = steps.groupBy("survey_id").agg(
        F.count_if("non_monotonic").alias("n_non_monotonic"), F.count_if("teleport").alias("n_teleports"))
    surveys = pings.groupBy("survey_id").agg(F.count(F.lit(1)).alias("n_pings"))
    return (
        surveys.join(faults, "survey_id", "left").na.fill(0, ["n_non_monotonic", "n_teleports"])
        .withColumn("is_valid", (F.col("n_non_monotonic") + F.col("n_teleports")) == 0)
    )


def attach_ping(objects: DataFrame, pings: DataFrame, row: str = "row_px", n_rows: str = "n_rows") -> DataFrame:
    """Telemetry of the ping an image row belongs to: rounded proportional position, clamped to the survey."""
    totals = pings.groupBy("survey_id").agg((F.max("ping_id") + 1).alias("n_pings"))
    scaled = F.col(row) / (F.col(n_rows) - 1) * (F.col("n_pings") - 1)
    index = F.when((F.col("n_pings") == 1) | (F.col(n_rows) <= 1), F.lit(0)).otherwise(
        F.least(F.col("n_pings") - 1, F.greatest(F.lit(0), F.bround(scaled)))).cast("bigint")
    return (objects.join(totals, "survey_id").withColumn("ping_id", index).drop("n_pings")
            .join(pings, ["survey_id", "ping_id"]))
