"""Radiometric and geometric work on waterfall cells (survey_id, ping, col, v) and on wide rows (samples array)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions.boxes import clip
from sonarlake.plans.ordered import exact_quantiles

SEPARATOR_COLUMNS = 6
SEPARATOR_VALUE = 15


# ---- images that break off ------------------------------------------------------------------------------------------

def complete_rows(rows: DataFrame, width: int, height: int, keys: Sequence[str] = ("survey_id",)) -> DataFrame:
    """Wide rows of images of a fixed size: a ping that is missing becomes a row of null samples, which count as nothing."""
    blank = rows.select(*keys).distinct().withColumn("ping", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("ping", F.col("ping").cast(rows.schema["ping"].dataType))
    none = F.array_repeat(F.lit(None).cast(rows.schema["samples"].dataType.elementType), width)
    return blank.join(rows, [*keys, "ping"], "left").withColumn("samples", F.coalesce("samples", none))


# ---- signal statistics ----------------------------------------------------------------------------------------------

def histogram(cells: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Count of each grey value per key: at most 256 rows per key, combined on the map side.

    Every order statistic of an 8-bit waterfall is exact on this table, whatever the number of cells behind it.
    """
    return cells.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def snr_index(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signal quality per key: percentiles, clutter level, SNR, dynamic range, black and saturated shares, warnings."""
    hist = histogram(cells, keys)
    base = hist.groupBy(*keys).agg(
        F.sum("n").alias("n_cells"),
        F.expr("percentile(v, array(0.05D, 0.70D, 0.98D), n)").alias("_p"),
        (F.sum(F.when(F.col("v") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("zero_ratio"),
        (F.sum(F.when(F.col("v") == 255, F.col("n")).otherwise(0)) / F.sum("n")).alias("saturation_ratio"),
        F.min("v").alias("_min"), F.max("v").alias("_max"),
        F.collect_list(F.struct(F.col("v").cast("double").alias("v"), F.col("n").alias("n"))).alias("_h"))
    clutter = F.filter("_h", lambda x: x["v"].between(F.col("_p")[0], F.col("_p")[1]))
    total = lambda f: F.aggregate("_c", F.lit(0.0), lambda a, x: a + f(x))
    stats = base.withColumn("_c", clutter).withColumn("_n", total(lambda x: x["n"].cast("double"))).withColumn(
        "clutter_mean", F.when(F.col("_n") > 0, total(lambda x: x["v"] * x["n"]) / F.col("_n")).otherwise(F.lit(1.0)))
    stats = stats.withColumn("clutter_std", F.when(F.col("_n") > 0, F.sqrt(
        F.aggregate("_c", F.lit(0.0), lambda a, x: a + x["n"] * (x["v"] - F.col("clutter_mean")) * (x["v"] - F.col("clutter_mean")))
        / F.col("_n"))).otherwise(F.lit(1.0)))
    snr = 20.0 * F.log10(F.greatest(F.lit(1.0), F.col("_p")[2] - F.col("clutter_mean")) / F.greatest(F.lit(1.0), F.col("clutter_std")))
    stats = stats.withColumn("snr_db", snr).withColumn("is_valid", F.col("snr_db") >= 3.0)
    warnings = F.array_compact(F.array(
        F.when(F.col("zero_ratio") > 0.40, F.format_string(
            "High black-level ratio (%.1f%%); wide water column or sensor dropout.", F.col("zero_ratio") * 100)),
        F.when(F.col("saturation_ratio") > 0.15, F.format_string(
            "High acoustic saturation ratio (%.1f%%); gain setting too high.", F.col("saturation_ratio") * 100)),
        F.when(~F.col("is_valid"), F.format_string(
            "Low Acoustic SNR (%.1f dB < 3.0 dB); low contrast or high turbidity.", "snr_db"))))
    return stats.withColumns({
        "warnings": warnings,
        "p5": F.col("_p")[0], "p70": F.col("_p")[1], "p98": F.col("_p")[2],
        "dynamic_range_db": 20.0 * F.log10(F.greatest(F.lit(1), F.col("_max") - F.col("_min"))),
    }).drop("_p", "_h", "_c", "_n", "_min", "_max")


def tile_snr(cells: DataFrame, tile: int = 64) -> DataFrame:
    placed = cells.withColumns({"tile_r": F.floor(F.col("ping") / F.lit(float(tile))), "tile_c": F.floor(F.col("col") / F.lit(float(tile)))})
    return snr_index(placed, ["survey_id", "tile_r", "tile_c"]).select("survey_id", "tile_r", "tile_c", "snr_db", "n_cells")


def snr_summary(tiles: DataFrame, overall: DataFrame) -> DataFrame:
    t = tiles.groupBy("survey_id").agg(F.min("snr_db").alias("tile_snr_min"), F.avg("snr_db").alias("tile_snr_mean"))
    return overall.select("survey_id", "snr_db", "dynamic_range_db").join(t, "survey_id")


def tile_at(objects: DataFrame, tiles: DataFrame, tile: int = 64, x: str = "cx", y: str = "cy") -> DataFrame:
    """Tile SNR at a pixel; positions outside the image take the border tile."""
    ext = tiles.groupBy("survey_id").agg(F.max("tile_r").alias("_r"), F.max("tile_c").alias("_c"))
    at = lambda c, hi: F.least(F.col(hi), F.greatest(F.lit(0), F.floor(F.col(c) / F.lit(float(tile)))))
    placed = objects.join(ext, "survey_id").withColumns({"tile_r": at(y, "_r"), "tile_c": at(x, "_c")}).drop("_r", "_c")
    return placed.join(tiles.select("survey_id", "tile_r", "tile_c", F.col("snr_db").alias("tile_snr_db")), ["survey_id", "tile_r", "tile_c"])


def ping_dropout(cells: DataFrame, dead_mean: float = 2.0) -> DataFrame:
    """Share of pings whose mean level is practically zero."""
    rows = cells.groupBy("survey_id", "ping").agg(F.avg("v").alias("m"))
    return rows.groupBy("survey_id").agg(F.avg((F.col("m") < dead_mean).cast("int")).alias("dropout"))


# ---- wide rows: gains, water column, slant correction ------------------------------------------------------------------

def _half_offset(i: Column, width: int, centre: float) -> Column:
    return (i - centre)


def tvg_gains(width: int, alpha: float = 1.2, beta: float = 0.04, range_m: float = 75.0) -> Column:
    """Gain per column as one array expression; depends on the width only, so it is evaluated from literals."""
    half = width / 2.0
    ref = range_m / 2.0
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.greatest(F.lit(1.0), F.abs(x - half) / half * range_m))
    gains = F.transform(raw, lambda r: F.pow(r / ref, F.lit(alpha)) * F.pow(F.lit(10.0), beta * (r - ref) / 20.0))
    mean = F.aggregate(gains, F.lit(0.0), lambda a, g: a + g) / width
    return F.transform(gains, lambda g: clip(g / mean, 0.4, 2.8))


def beam_gains(width: int, half_angle_deg: float = 25.0, scale: float = 2.4, floor: float = 0.25) -> Column:
    mid = width / 2.0

    def gain(x: Column) -> Column:
        a = scale * F.sin(F.radians((x - mid) / mid * half_angle_deg))
        sinc = F.when(F.abs(a) < 1e-6, F.lit(1.0)).otherwise(F.sin(a) / a)
        return 1.0 / clip(sinc * sinc, floor, 1.0)

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), gain)


def _apply_gains(rows: DataFrame, gains: Column) -> DataFrame:
    scaled = F.zip_with("samples", gains, lambda v, g: F.floor(clip(v * g, 0.0, 255.0)).cast("int"))
    return rows.withColumn("samples", scaled)


def apply_tvg(rows: DataFrame, width: int, alpha: float = 1.2, beta: float = 0.04, range_m: float = 75.0) -> DataFrame:
    return _apply_gains(rows, tvg_gains(width, alpha, beta, range_m))


def apply_beam(rows: DataFrame, width: int) -> DataFrame:
    return _apply_gains(rows, beam_gains(width))


def to_cells(rows: DataFrame) -> DataFrame:
    return rows.select("survey_id", "ping", F.posexplode("samples").alias("col", "v"))


def nadir_lines(cells: DataFrame, width: int, min_frac: float = 0.03, max_frac: float = 0.35) -> DataFrame:
    """First bottom return left and right of the centre, from the gradient of the column-mean profile.

    Ties go to the lower column. The profile has one row per column, so the gradient window is small.
    """
    mid, lo, hi = width // 2, int(width * min_frac), int(width * max_frac)
    profile = cells.groupBy("survey_id", "col").agg(F.avg("v").alias("m"))
    w = Window.partitionBy("survey_id").orderBy("col")
    prev, nxt = F.lag("m").over(w), F.lead("m").over(w)
    grad = F.when(prev.isNull(), nxt - F.col("m")).when(nxt.isNull(), F.col("m") - prev).otherwise((nxt - prev) / 2.0)
    g = profile.withColumn("g", grad)
    port = F.col("col").between(mid - hi, mid - lo - 1)
    stbd = F.col("col").between(mid + lo, mid + hi - 1)
    picked = g.groupBy("survey_id").agg(
        F.min(F.when(port, F.struct(F.col("g"), F.col("col")))).alias("p"),
        F.min(F.when(stbd, F.struct((-F.col("g")).alias("g"), F.col("col")))).alias("s"))
    return picked.select(
        "survey_id",
        F.greatest(F.lit(0), F.least(F.lit(mid - 5), F.coalesce("p.col", F.lit(mid - hi)))).alias("nadir_port"),
        F.greatest(F.lit(mid + 5), F.least(F.lit(width - 1), F.coalesce("s.col", F.lit(mid + lo)))).alias("nadir_stbd"))


def remove_water_column(rows: DataFrame, nadir: DataFrame, width: int, mode: str = "mask") -> DataFrame:
    """``mask`` blackens the columns between the nadir lines; ``crop`` drops them and stretches each side back.

    A side of n columns is stretched to half the width with linear interpolation (pixel centres aligned).
    """
    joined = rows.join(nadir, "survey_id")
    p, s = F.col("nadir_port"), F.col("nadir_stbd")
    if mode == "mask":
        out = F.transform("samples", lambda v, i: F.when((i >= p) & (i < s), F.lit(0)).otherwise(v))
    elif mode == "crop":
        half = width // 2
        left = resample(F.slice("samples", F.lit(1), F.greatest(F.lit(1), p)), half)
        right = resample(F.slice("samples", s + 1, F.greatest(F.lit(1), F.lit(width) - s)), width - half)
        out = F.transform(F.concat(left, right), lambda v: F.round(v).cast("int"))
    else:
        raise ValueError("mode is 'mask' or 'crop'")
    return joined.withColumn("samples", out).drop("nadir_port", "nadir_stbd")


def resample(samples: Column, width: int) -> Column:
    """Linear interpolation of an array to ``width`` values, pixel centres aligned, borders held."""
    n = F.size(samples)

    def at(i: Column) -> Column:
        pos = F.least(F.greatest((i + 0.5) * n / float(width) - 0.5, F.lit(0.0)), (n - 1).cast("double"))
        k = F.floor(pos).cast("int")
        a = F.get(samples, k).cast("double")
        b = F.get(samples, F.least(k + 1, n - 1)).cast("double")
        return a + (b - a) * (pos - k)

    return F.when(n == width, F.transform(samples, lambda v: v.cast("double"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at))


def slant_to_ground(rows: DataFrame, width: int, altitude: Column | float, range_m: Column | float) -> DataFrame:
    """Slant-range rows to ground range: each output column gathers two interpolated source samples."""
    h = F.lit(float(altitude)) if isinstance(altitude, (int, float)) else altitude
    r = F.lit(float(range_m)) if isinstance(range_m, (int, float)) else range_m
    mid = width / 2.0
    same = (h <= 0.5) | (h >= r)
    scale = F.sqrt(F.greatest(F.lit(1.0), r * r - h * h))

    def source(i: Column) -> Column:
        off = i - mid
        rs = F.abs(off) / mid * r
        reach = F.sqrt(F.greatest(F.lit(0.0), rs * rs - h * h)) / scale * mid
        return F.when(off < 0, mid - reach).otherwise(mid + reach)

    def reflect(k: Column) -> Column:
        k = F.when(k < 0, -k).otherwise(k)
        return F.when(k > width - 1, 2 * (width - 1) - k).otherwise(k).cast("int")

    def gather(i: Column) -> Column:
        pos = source(i)
        k = F.floor(pos)
        a = F.get("samples", reflect(k)).cast("double")
        b = F.get("samples", reflect(k + 1)).cast("double")
        return F.round(a + (b - a) * (pos - k)).cast("int")

    mapped = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), gather)
    return rows.withColumn("samples", F.when(same, F.col("samples")).otherwise(mapped))


def calibrate(rows: DataFrame, width: int, altitude: float = 10.0, range_m: float = 75.0, alpha: float = 1.2, beta: float = 0.04,
              water_column: str = "mask") -> tuple[DataFrame, DataFrame]:
    """TVG, beam pattern, nadir search, water-column removal, slant correction; with an SNR report before and after."""
    gained = apply_beam(apply_tvg(rows, width, alpha, beta, range_m), width)
    nadir = nadir_lines(to_cells(gained), width)
    done = slant_to_ground(remove_water_column(gained, nadir, width, water_column), width, altitude, range_m)
    before = snr_index(to_cells(rows), ["survey_id"]).select("survey_id", F.col("snr_db").alias("raw_snr_db"))
    after = snr_index(to_cells(done), ["survey_id"]).select("survey_id", F.col("snr_db").alias("final_snr_db"))
    report = before.join(after, "survey_id").join(nadir, "survey_id").withColumn("gain_db", F.col("final_snr_db") - F.col("raw_snr_db"))
    return done, report


# ---- assembly from traces -----------------------------------------------------------------------------------------------

def assemble_waterfall(traces: DataFrame, width: int) -> DataFrame:
    """Port reversed, separator, starboard. ``traces``: survey_id, ping, channel (0 port, 1 starboard), samples."""
    side = traces.groupBy("survey_id", "ping").agg(
        F.first(F.when(F.col("channel") == 0, F.col("samples")), True).alias("_p"),
        F.first(F.when(F.col("channel") != 0, F.col("samples")), True).alias("_s")).filter("_p is not null and _s is not null")
    fit = lambda c: F.transform(resample(F.col(c), width), lambda v: F.round(v).cast("int"))
    return side.select("survey_id", "ping", F.concat(
        F.reverse(fit("_p")), F.array_repeat(F.lit(SEPARATOR_VALUE), SEPARATOR_COLUMNS), fit("_s")).alias("samples"))


def log_compress(cells: DataFrame, value: str = "v") -> DataFrame:
    """log(1 + v) mapped from [1 %, 99.7 %] of the survey to 0..255.

    The two quantiles come from range-partitioned running counts of a (survey, value) table, not from the cells.
    """
    marks = exact_quantiles(cells.select("survey_id", F.log1p(value).alias("_l")), ["survey_id"], "_l", (0.01, 0.997), "_q")
    lim = marks.groupBy("survey_id").agg(F.max(F.when(F.col("_q_no") == 0, F.col("_q"))).alias("_lo"), F.max(F.when(F.col("_q_no") == 1, F.col("_q"))).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = clip((F.log1p(value) - lo) / F.greatest(hi - lo, F.lit(1e-6)), 0.0, 1.0) * 255.0
    return cells.join(lim, "survey_id").withColumn("grey", F.floor(scaled).cast("int")).drop("_lo", "_hi")
