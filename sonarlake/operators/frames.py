"""Along-track slices of a survey: overlapping frames, tiles, and frame-level bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.plans.ordered import with_chunks


def make_frames(surveys: DataFrame, height: int = 384, stride: int = 192, min_rows: int = 64) -> DataFrame:
    """Frames [y0, y1) of each survey (survey_id, n_rows). A survey no taller than a frame is one frame.

    Starts run until a frame reaches the end; a last frame shorter than ``min_rows`` is left out.
    """
    n = F.col("n_rows")
    last = F.ceil((n - height) / F.lit(float(stride))).cast("bigint")
    many = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0))), lambda k: k * stride)
    framed = surveys.select("survey_id", "n_rows", F.posexplode(F.when(n <= height, F.array(F.lit(0).cast("bigint"))).otherwise(many))
                            .alias("frame_id", "y0"))
    framed = framed.withColumn("y1", F.least(F.col("y0") + height, F.col("n_rows")))
    return framed.filter((F.col("y1") - F.col("y0") >= min_rows) | (F.col("frame_id") == 0)).drop("n_rows")


def assign_frames(rows: DataFrame, height: int = 384, stride: int = 192, min_rows: int = 64, row: str = "ping_id") -> DataFrame:
    """Each row once per frame that holds it, by arithmetic on the row number (no join with the frame list)."""
    totals = rows.groupBy("survey_id").agg((F.max(row) + 1).alias("_n"))
    r = F.col(row).cast("bigint")
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - height) / F.lit(float(stride)))).cast("bigint")
    first_k = F.greatest(F.lit(0), F.floor((r - height) / F.lit(float(stride))) + 1).cast("bigint")
    last_k = F.least(last, F.floor(r / F.lit(float(stride))).cast("bigint"))
    ks = F.when(first_k <= last_k, F.sequence(first_k, last_k)).otherwise(F.array().cast("array<bigint>"))
    out = rows.join(totals, "survey_id").withColumn("frame_id", F.explode(ks))
    size = F.least(F.lit(height), F.col("_n") - F.col("frame_id") * stride)
    return (out.filter((size >= min_rows) | (F.col("frame_id") == 0))
            .withColumn("frame_row", r - F.col("frame_id") * stride).drop("_n"))


def make_tiles(surveys: DataFrame, tile_rows: int = 1024, trigger: int = 2048) -> DataFrame:
    """Tiles of a tall survey; a final sliver below a quarter tile joins the tile before it."""
    n = F.col("n_rows")
    full = F.ceil(n / F.lit(float(tile_rows))).cast("bigint")
    sliver = (n - (full - 1) * tile_rows < tile_rows // 4) & (full > 1)
    count = F.when(n <= trigger, F.lit(1)).otherwise(full - sliver.cast("bigint")).cast("bigint")
    tiles = surveys.select("survey_id", "n_rows", count.alias("n_tiles")).withColumn(
        "tile_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tiles") - 1)))
    y0 = F.col("tile_id") * tile_rows
    return tiles.select("survey_id", "tile_id", y0.alias("y0"),
                        F.when(F.col("tile_id") == F.col("n_tiles") - 1, n).otherwise(y0 + tile_rows).alias("y1"))


def stalled_frames(cells: DataFrame, frame_rows: int, threshold: float = 2.0) -> DataFrame:
    """Mean squared difference to the previous, equally sized frame; below the threshold the sensor has stalled.

    Cells carry (survey_id, ping, col, v); frames are consecutive blocks of ``frame_rows`` pings.
    """
    placed = cells.select(
        "survey_id", F.floor(F.col("ping") / F.lit(float(frame_rows))).cast("bigint").alias("frame_id"),
        (F.col("ping") % frame_rows).alias("r"), "col", "v")
    sizes = placed.groupBy("survey_id", "frame_id").agg(F.count(F.lit(1)).alias("n"))
    earlier = placed.select("survey_id", (F.col("frame_id") + 1).alias("frame_id"), "r", "col", F.col("v").alias("pv"))
    diff = (placed.join(earlier, ["survey_id", "frame_id", "r", "col"])
            .groupBy("survey_id", "frame_id").agg(F.avg((F.col("v") - F.col("pv")) ** 2).alias("mse"),
                                                  F.count(F.lit(1)).alias("shared")))
    prev = sizes.select("survey_id", (F.col("frame_id") + 1).alias("frame_id"), F.col("n").alias("prev_n"))
    joined = sizes.join(prev, ["survey_id", "frame_id"], "left").join(diff, ["survey_id", "frame_id"], "left")
    same = (F.col("n") == F.col("prev_n")) & (F.col("shared") == F.col("n"))
    mse = F.when(same, F.col("mse")).otherwise(F.lit(999.0))
    return joined.select("survey_id", "frame_id", mse.alias("mse"), (same & (F.col("mse") < threshold)).alias("is_duplicate")).na.fill(
        False, ["is_duplicate"])


def resurvey_areas(frames: DataFrame, threshold: float = 55.0, chunk: int = 4096) -> DataFrame:
    """Maximal runs of consecutive low-quality located frames: bounds, mean score, distinct reasons, first/last frame.

    ``frame_id`` must be consecutive per survey. A run start is a low frame whose predecessor is not low; runs get the
    id of their first frame by carrying starts forward, chunk by chunk, then joining open ends across chunks.
    """
    located = (F.col("latitude").isNotNull() & (F.col("scqi") < threshold))
    base = frames.withColumn("_low", located)
    chunks = with_chunks(base, "frame_id", chunk, before=1)
    w = Window.partitionBy("survey_id", "_chunk").orderBy("frame_id")
    flagged = chunks.withColumn("_prev", F.coalesce(F.lag("_low").over(w), F.lit(False))).filter("_own and _low")
    flagged = flagged.withColumn("_start", F.when(~F.col("_prev"), F.col("frame_id")))
    # within a chunk: last start at or before the row; rows before the chunk's first start continue an earlier run
    carried = flagged.withColumn("_run", F.last("_start", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = carried.groupBy("survey_id", "_chunk").agg(F.max("_start").alias("_s"))
    back = Window.partitionBy("survey_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    opens = lasts.select("survey_id", "_chunk", F.last("_s", True).over(back).alias("_open"))
    runs = carried.join(opens, ["survey_id", "_chunk"]).withColumn("_run", F.coalesce("_run", "_open"))
    # distinct reason names per run: collected from a de-duplicated (run, reason) list
    groups = runs.groupBy("survey_id", F.col("_run").alias("first_frame")).agg(
        F.max("frame_id").alias("last_frame"), F.count(F.lit(1)).alias("n_frames"), F.avg("scqi").alias("mean_scqi"),
        F.min("longitude").alias("min_lon"), F.min("latitude").alias("min_lat"),
        F.max("longitude").alias("max_lon"), F.max("latitude").alias("max_lat"))
    if "reasons" not in frames.columns:
        return groups.withColumn("reasons", F.array().cast("array<string>"))
    reasons = (runs.select("survey_id", F.col("_run").alias("first_frame"), F.explode("reasons").alias("reason")).distinct()
               .groupBy("survey_id", "first_frame").agg(F.array_sort(F.collect_list("reason")).alias("reasons")))
    return groups.join(reasons, ["survey_id", "first_frame"], "left").withColumn(
        "reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def to_global(objects: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame-local boxes, polygons and centroids into survey rows (adds the frame's y0)."""
    out = objects.join(frames.select("survey_id", "frame_id", "y0"), ["survey_id", "frame_id"])
    y0 = F.col("y0")
    changes = {c: F.col(c) + y0 for c in ("y1", "y2", "cy") if c in objects.columns}
    if "polygon" in objects.columns:
        changes["polygon"] = F.transform("polygon", lambda p: F.array(p[0], p[1] + F.col("y0")))
    return out.withColumns(changes).drop("y0")


def merge_tiles(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """Union of per-tile results with the tile's first row added to the box."""
    shifted = objects.join(tiles.select("survey_id", "tile_id", F.col("y0").alias("tile_start_row")), ["survey_id", "tile_id"])
    return shifted.withColumns({c: F.col(c) + F.col("tile_start_row") for c in ("y1", "y2")})
