"""From pixels to positions, and spatial joins on positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.functions.geo import K95, METRES_PER_DEGREE, ground_range, haversine, planar_move, wgs84_step

# Deep-ocean basins (name, lat and lon bounds, depth m, sound speed m/s, substrate).
OCEAN_BASINS = [
    ("Bay of Bengal (Central Abyssal Basin)", 11.5, 16.5, 83.5, 89.5, 2400, 3900, 1515, 1530, "Siliceous Pelagic Ooze & Silt"),
    ("Arabian Sea (Deep Subsea Trench)", 12.0, 18.0, 63.5, 70.5, 2900, 4400, 1520, 1535, "Fine Terrigenous Mud & Clay"),
    ("Central Indian Ocean (Pelagic Abyssal Plain)", -7.5, 2.5, 70.0, 88.0, 3800, 5200, 1505, 1525, "Polymetallic Nodule Bed / Red Clay"),
    ("North Atlantic (Sargasso Deep Basin)", 24.0, 31.0, -64.0, -48.0, 4100, 5600, 1498, 1518, "Calcareous Foraminiferal Ooze"),
    ("Mid-Atlantic Ridge (Abyssal Rift Valley)", -4.0, 8.0, -32.0, -18.0, 3100, 4700, 1502, 1522, "Basaltic Pillow Lava & Pelagic Sediment"),
    ("North Pacific (Pelagic Ocean Corridor)", 22.0, 32.0, 148.0, 172.0, 4300, 5900, 1492, 1512, "Abyssal Brown Clay & Manganese Crust"),
    ("South Pacific (Polynesian Deep Basin)", -18.0, -8.0, -138.0, -115.0, 3900, 5100, 1496, 1516, "Pelagic Red Clay & Zeolitic Silt"),
    ("South China Sea (Central Deep Basin)", 13.0, 17.0, 113.5, 117.5, 2200, 3900, 1518, 1532, "Hemipelagic Clay & Carbonate Silt"),
    ("Mediterranean Sea (Ionian Deep Abyssal Plain)", 34.5, 36.2, 16.8, 20.5, 2600, 4200, 1528, 1542, "Sapropelic Mud & Biogenic Carbonate"),
    ("Coral Sea (Queensland Abyssal Corridor)", -19.5, -14.5, 150.5, 156.0, 2500, 4600, 1510, 1528, "Coral-Derived Carbonate Ooze"),
    ("Gulf of Mexico (Sigsbee Abyssal Plain)", 23.8, 25.8, -92.5, -88.5, 3200, 3800, 1515, 1530, "Turbidite Sand & Hemipelagic Mud"),
    ("Norwegian Sea (Vøring Deep Basin)", 67.0, 71.0, 1.5, 7.0, 1800, 3200, 1475, 1495, "Glaciomarine Silty Clay"),
]
BASIN_FIELDS = ("basin", "lat_min", "lat_max", "lon_min", "lon_max", "depth_min_m", "depth_max_m",
                "sound_speed_min", "sound_speed_max", "substrate")


def attach_basin(df: DataFrame) -> DataFrame:
    """Basin of a position, null outside all of them. Twelve fixed boxes, so the choice is one expression, not a join."""
    struct = None
    for row in reversed(OCEAN_BASINS):
        _, la0, la1, lo0, lo1, *_rest = row
        hit = F.col("latitude").between(la0, la1) & F.col("longitude").between(lo0, lo1)
        value = F.struct(*[F.lit(float(v) if isinstance(v, (int, float)) else v).alias(n) for n, v in zip(BASIN_FIELDS, row)])
        struct = F.when(hit, value) if struct is None else F.when(hit, value).otherwise(struct)
    out = df.withColumn("_b", struct)
    return out.withColumns({n: F.col(f"_b.{n}") for n in BASIN_FIELDS if n not in ("lat_min", "lat_max", "lon_min", "lon_max")}).drop("_b")


def _step(method: str):
    if method not in ("planar", "wgs84"):
        raise ValueError("method is 'planar' or 'wgs84'")
    return planar_move if method == "planar" else wgs84_step


def towfish_position(df: DataFrame, method: str = "planar") -> DataFrame:
    """Towfish position behind the vessel by the cable layback."""
    lat, lon, lay = F.col("latitude"), F.col("longitude"), F.col("layback_m")
    moved = _step(method)(df, lat, lon, F.pmod(F.col("heading_deg") + 180.0, F.lit(360.0)), lay, "_tlat", "_tlon")
    return moved.withColumns({"towfish_lat": F.when(lay == 0, lat).otherwise(F.col("_tlat")),
                              "towfish_lon": F.when(lay == 0, lon).otherwise(F.col("_tlon"))}).drop("_tlat", "_tlon")


def geolocate(df: DataFrame, width: Column | int, u: str = "cx", nadir_col: Column | None = None, method: str = "planar") -> DataFrame:
    """Target position of pixel column ``u``; needs telemetry columns and towfish_lat/lon on the row."""
    w = F.lit(width).cast("double") if isinstance(width, int) else width
    mid = nadir_col if nadir_col is not None else w / 2.0
    stbd = F.col(u) >= mid
    half = F.greatest(F.lit(1.0), F.when(stbd, w - mid).otherwise(mid))
    frac = F.least(F.lit(1.0), F.abs(F.col(u) - mid) / half)
    out = df.withColumns({
        "channel": F.when(stbd, "Starboard").otherwise("Port"),
        "ground_range_m": ground_range(frac * F.col("slant_range_m"), F.col("altitude_m")),
        "_bearing": F.pmod(F.when(stbd, F.col("heading_deg") + 90.0).otherwise(F.col("heading_deg") - 90.0), F.lit(360.0))})
    moved = _step(method)(out, F.col("towfish_lat"), F.col("towfish_lon"), F.col("_bearing"), F.col("ground_range_m"), "_tlat", "_tlon")
    still = F.col("ground_range_m") <= 0
    return moved.withColumns({"target_lat": F.when(still, F.col("towfish_lat")).otherwise(F.col("_tlat")),
                              "target_lon": F.when(still, F.col("towfish_lon")).otherwise(F.col("_tlon"))}).drop("_bearing", "_tlat", "_tlon")


def error_ellipse(df: DataFrame, beamwidth_deg: float = 0.5, gps_accuracy_m: float = 2.5, conf: Column | float = 0.85) -> DataFrame:
    """95 % error ellipse: semi axes in metres and orientation."""
    c = F.lit(conf) if isinstance(conf, float) else conf
    beam = F.col("beamwidth_deg") if "beamwidth_deg" in df.columns else F.lit(beamwidth_deg)
    spread = F.col("ground_range_m") * F.sin(F.radians(beam))
    res = 0.25 * F.greatest(F.lit(1.0), (1.05 - c) * 2.0)
    gps2 = gps_accuracy_m ** 2
    return df.withColumns({
        "ellipse_a_m": F.sqrt(gps2 + spread * spread) * K95,
        "ellipse_b_m": F.sqrt(gps2 + res * res) * K95,
        "ellipse_phi_deg": F.pmod(F.col("heading_deg") + 90.0, F.lit(360.0))})


def ellipse_polygon(df: DataFrame, lat: str = "target_lat", lon: str = "target_lon", points: int = 32) -> DataFrame:
    """Outline of the ellipse as [[lon, lat], ...]; the major axis is laid along latitude before the rotation by -phi."""
    phi = F.radians(-F.col("ellipse_phi_deg"))
    staged = df.withColumns({
        "_dlat": F.col("ellipse_a_m") / METRES_PER_DEGREE,
        "_dlon": F.col("ellipse_b_m") / (METRES_PER_DEGREE * F.greatest(F.lit(0.1), F.cos(F.radians(F.col(lat))))),
        "_cos": F.cos(phi), "_sin": F.sin(phi)})
    circle = F.array(*[F.struct(F.lit(math.cos(2.0 * math.pi * i / (points - 1))).alias("c"), F.lit(math.sin(2.0 * math.pi * i / (points - 1))).alias("s"))
                       for i in range(points)])

    def vertex(p: Column) -> Column:
        x, y = F.col("_dlon") * p["c"], F.col("_dlat") * p["s"]
        return F.array(F.col(lon) + x * F.col("_cos") - y * F.col("_sin"), F.col(lat) + x * F.col("_sin") + y * F.col("_cos"))

    return staged.withColumn("polygon", F.transform(circle, vertex)).drop("_dlat", "_dlon", "_cos", "_sin")


def near_points(points: DataFrame, key: list[str], point_id: str, metres: float) -> DataFrame:
    """Pairs of located positions of one key within ``metres`` (a < b by first id), with the copies at each position.

    Positions fall into cells at least ``metres`` wide; the left side is listed in the neighbouring cells, the right
    side in its own. Latitude cells are uniform; longitude cells widen with the cosine of the cell row.
    """
    located = points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    spots = located.groupBy(*key, "latitude", "longitude").agg(F.min(point_id).alias("id"), F.count(F.lit(1)).alias("n"))
    left = spots.select(*key, F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("latitude").alias("lat_a"),
                        F.col("longitude").alias("lon_a"), F.explode(neighbour_cells(metres)).alias("_c"))
    right = spots.select(*key, F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("latitude").alias("lat_b"),
                         F.col("longitude").alias("lon_b"), grid_cell(metres).alias("_c"))
    return (left.join(right, [*key, "_c"]).filter("a < b")
            .withColumn("distance_m", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
            .filter(F.col("distance_m") <= metres).select(*key, "a", "n_a", "b", "n_b", "distance_m"))


def _row(metres: float, lat: Column) -> Column:
    return F.floor(lat / F.lit(_row_deg(metres)))


def _row_deg(metres: float) -> float:
    return metres / 111000.0  # one haversine degree of latitude is 111 195 m, so a cell is a little taller than the radius


def _col_deg(metres: float, row: Column) -> Column:
    # widest longitude span of ``metres`` within a cell row: the cosine is smallest at the row border away from the equator
    far = F.least(F.lit(89.9), F.greatest(F.abs(row), F.abs(row + 1)) * _row_deg(metres))
    return F.lit(_row_deg(metres)) / F.cos(F.radians(far))


def grid_cell(metres: float, lat: str = "latitude", lon: str = "longitude") -> Column:
    row = _row(metres, F.col(lat))
    return F.struct(row.alias("r"), F.floor(F.col(lon) / _col_deg(metres, row)).alias("c"))


def neighbour_cells(metres: float, lat: str = "latitude", lon: str = "longitude") -> Column:
    """Cells that can hold a point within ``metres``: three rows, and per row the columns its own width implies."""
    row = _row(metres, F.col(lat))

    def cells_of(dr: Column) -> Column:
        r = row + dr
        width = _col_deg(metres, r)
        reach = F.greatest(width, _col_deg(metres, row))
        first, last = F.floor((F.col(lon) - reach) / width), F.floor((F.col(lon) + reach) / width)
        return F.transform(F.sequence(first, last), lambda c: F.struct(r.alias("r"), c.alias("c")))

    return F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), cells_of))


def measure_distance(points: DataFrame, selections: DataFrame, point_id: str) -> DataFrame:
    """Great-circle distance of chosen pairs (columns a, b): an equi join per end, never all pairs."""
    p = points.filter(F.col("latitude").isNotNull()).select(point_id, "latitude", "longitude")
    a = p.toDF("a", "lat_a", "lon_a")
    b = p.toDF("b", "lat_b", "lon_b")
    out = selections.join(a, "a").join(b, "b")
    metres = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return out.withColumn("distance_m", metres).drop("lat_a", "lon_a", "lat_b", "lon_b")


def within_bounds(df: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    return df.filter(F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon))
