"""Geographic column expressions (degrees in, metres or degrees out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean earth radius, planar metres per degree, WGS-84 ellipsoid, knots per m/s, 95 % scale for two axes.
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
KNOTS_PER_MPS = 1.94384
K95 = 2.4477


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2.0)
    h = (half(lat1, lat2) * half(lat1, lat2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2))
    return F.lit(EARTH_RADIUS_M * 2.0) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1.0 - h)))


def ground_range(slant: Column, altitude: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), slant * slant - altitude * altitude))


def planar_step(lat: Column, lon: Column, bearing_deg: Column, distance_m: Column) -> tuple[Column, Column]:
    """Position after a short step on a local plane."""
    rad = F.radians(bearing_deg)
    return (lat + distance_m * F.cos(rad) / METRES_PER_DEGREE,
            lon + distance_m * F.sin(rad) / (METRES_PER_DEGREE * F.cos(F.radians(lat))))


def wgs84_step(df: DataFrame, lat: Column, lon: Column, bearing_deg: Column, distance_m: Column, out_lat: str, out_lon: str,
               rounds: int = 3) -> DataFrame:
    """Add the position after a step along the WGS-84 geodesic (direct solution after Vincenty, fixed number of rounds).

    For sonar distances (a few kilometres at most) three rounds converge far below a millimetre. Every intermediate is
    its own column so that it is computed once per row.
    """
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    c = F.col
    out = df.withColumns({"_al": F.radians(bearing_deg), "_tu": F.tan(F.radians(lat)) * (1 - f), "_lon": lon, "_d": distance_m})
    out = out.withColumn("_cu", 1 / F.sqrt(1 + c("_tu") * c("_tu")))
    out = out.withColumns({"_su": c("_tu") * c("_cu"), "_s1": F.atan2(c("_tu"), F.cos("_al")), "_sa": c("_cu") * F.sin("_al")})
    out = out.withColumn("_ca2", 1 - c("_sa") * c("_sa"))
    out = out.withColumn("_u2", c("_ca2") * ((a * a - b * b) / (b * b)))
    out = out.withColumns({
        "_base": c("_d") / (b * (1 + c("_u2") / 16384 * (4096 + c("_u2") * (-768 + c("_u2") * (320 - 175 * c("_u2")))))),
        "_bb": c("_u2") / 1024 * (256 + c("_u2") * (-128 + c("_u2") * (74 - 47 * c("_u2"))))})
    out = out.withColumn("_sg", c("_base"))
    for _ in range(rounds):
        out = out.withColumns({"_c2": F.cos(2 * c("_s1") + c("_sg")), "_ss": F.sin("_sg"), "_cs": F.cos("_sg")})
        delta = c("_bb") * c("_ss") * (c("_c2") + c("_bb") / 4 * (
            c("_cs") * (2 * c("_c2") * c("_c2") - 1)
            - c("_bb") / 6 * c("_c2") * (4 * c("_ss") * c("_ss") - 3) * (4 * c("_c2") * c("_c2") - 3)))
        out = out.withColumn("_sg", c("_base") + delta)
    out = out.withColumns({"_c2": F.cos(2 * c("_s1") + c("_sg")), "_ss": F.sin("_sg"), "_cs": F.cos("_sg"),
                           "_k": f / 16 * c("_ca2") * (4 + f * (4 - 3 * c("_ca2")))})
    out = out.withColumn("_x", c("_su") * c("_ss") - c("_cu") * c("_cs") * F.cos("_al"))
    lam = F.atan2(c("_ss") * F.sin("_al"), c("_cu") * c("_cs") - c("_su") * c("_ss") * F.cos("_al"))
    dl = lam - (1 - c("_k")) * f * c("_sa") * (
        c("_sg") + c("_k") * c("_ss") * (c("_c2") + c("_k") * c("_cs") * (2 * c("_c2") * c("_c2") - 1)))
    out = out.withColumns({
        out_lat: F.degrees(F.atan2(c("_su") * c("_cs") + c("_cu") * c("_ss") * F.cos("_al"),
                                   (1 - f) * F.sqrt(c("_sa") * c("_sa") + c("_x") * c("_x")))),
        out_lon: c("_lon") + F.degrees(dl)})
    return out.drop("_al", "_tu", "_lon", "_d", "_cu", "_su", "_s1", "_sa", "_ca2", "_u2", "_base", "_bb", "_sg", "_c2", "_ss", "_cs",
                    "_k", "_x")


def planar_move(df: DataFrame, lat: Column, lon: Column, bearing_deg: Column, distance_m: Column, out_lat: str, out_lon: str) -> DataFrame:
    la, lo = planar_step(lat, lon, bearing_deg, distance_m)
    return df.withColumns({out_lat: la, out_lon: lo})
