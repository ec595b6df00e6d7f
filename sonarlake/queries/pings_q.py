"""Telemetry, frame, quality and geolocation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from sonarlake.functions.scores import rounded
from sonarlake.operators import frames as fr
from sonarlake.operators import geolocate as geo
from sonarlake.operators import pings as pg
from sonarlake.operators import quality as ql
from sonarlake.operators import waterfall as wf

from . import tables as t
from .registry import query

NUM = "-?[0-9]+([.][0-9]+)?"


def no_digits(c):
    """Texts are compared with their numbers masked: engines print decimal ties differently."""
    return F.regexp_replace(c, NUM, "#")


HAV = ("6371000e0 * 2 * atan2(sqrt({h}), sqrt(greatest(0e0, 1 - ({h}))))")


def hav(a: str, b: str, c: str, d: str) -> str:
    h = (f"sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * "
         f"sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2)")
    return HAV.format(h=h)


@query("b01_validate_pings", "fx_pings", sql="""
select event_id, cast(latitude between -90 and 90 and longitude between -180 and 180 and altitude_m < slant_range_m and slant_range_m > 1 as int) as is_valid,
 array_to_string(list_filter([
   case when not (latitude between -90 and 90) then 'Invalid latitude: #' end,
   case when not (longitude between -180 and 180) then 'Invalid longitude: #' end,
   case when not (heading_deg >= 0 and heading_deg < 360) then 'Heading normalized to [#, #): #°' end,
   case when altitude_m <= 0.1e0 then 'Towfish altitude too low (#m); seabed collision risk or bad nadir.' end,
   case when altitude_m >= slant_range_m then 'Altitude (#m) exceeds slant range (#m).' end,
   case when slant_range_m <= 1 then 'Invalid slant range: #m' end], lambda x: x is not null), ' | ') as warnings
from fx_pings""")
def _(spark, sf):
    return pg.validate_pings(t.pings(spark, sf)).select(
        "event_id", F.col("is_valid").cast("int").alias("is_valid"), no_digits(F.array_join("warnings", " | ")).alias("warnings"))


@query("b02_normalise_heading", "fx_pings", sql="""
select event_id, heading_deg - 360 * floor(heading_deg / 360) as heading_deg, cast(heading_deg >= 360 or heading_deg < 0 as int) as heading_changed
from fx_pings""")
def _(spark, sf):
    return pg.normalise_heading(t.pings(spark, sf)).select("event_id", "heading_deg", F.col("heading_changed").cast("int").alias("heading_changed"))


STEPS = f"""steps as (
select survey_id, ping_id, t_s - pt as dt_s, t_s - pt <= 0 as non_monotonic,
 case when t_s - pt > 0 then {hav('plat', 'plon', 'latitude', 'longitude')} end as distance_m
from (select *, lag(t_s) over w as pt, lag(latitude) over w as plat, lag(longitude) over w as plon
      from fx_pings window w as (partition by survey_id order by ping_id)) q where pt is not null)"""


@query("e01_non_monotonic", "fx_pings", sql=f"with {STEPS} select survey_id, ping_id, round(dt_s, 4) as dt_s, cast(non_monotonic as int) as non_monotonic from steps")
def _(spark, sf):
    s = pg.trajectory_steps(t.pings(spark, sf))
    return s.select("survey_id", "ping_id", F.round("dt_s", 4).alias("dt_s"), F.col("non_monotonic").cast("int").alias("non_monotonic"))


@query("e02_step_speed", "fx_pings", sql=f"""with {STEPS} select survey_id, ping_id, round(distance_m, 3) as distance_m,
 round(distance_m / dt_s * 1.94384e0, 3) as speed_knots, cast(coalesce(distance_m / dt_s * 1.94384e0 > 15, false) as int) as teleport from steps""")
def _(spark, sf):
    s = pg.trajectory_steps(t.pings(spark, sf))
    return s.select("survey_id", "ping_id", F.round("distance_m", 3).alias("distance_m"), F.round("speed_knots", 3).alias("speed_knots"),
                    F.col("teleport").cast("int").alias("teleport"))


@query("e03_trajectory_verdict", "fx_pings", sql=f"""with {STEPS}
select p.survey_id, p.n_pings, coalesce(s.nm, 0) as n_non_monotonic, coalesce(s.tp, 0) as n_teleports,
 cast(coalesce(s.nm, 0) + coalesce(s.tp, 0) = 0 as int) as is_valid
from (select survey_id, count(*) as n_pings from fx_pings group by survey_id) p
left join (select survey_id, count(*) filter (non_monotonic) as nm, count(*) filter (distance_m / dt_s * 1.94384e0 > 15) as tp from steps group by survey_id) s using (survey_id)""")
def _(spark, sf):
    v = pg.validate_trajectory(t.pings(spark, sf))
    return v.withColumn("is_valid", F.col("is_valid").cast("int"))


@query("e03_trajectory_warnings", "fx_pings", sql=f"""with {STEPS}
select survey_id, ping_id, case when non_monotonic then 'Non-monotonic timestamp at index #: dt=#s'
 else 'GPS Teleport Jump detected between ping # & #: # kts > max # kts' end as warning
from steps where non_monotonic or distance_m / dt_s * 1.94384e0 > 15""")
def _(spark, sf):
    return pg.trajectory_warnings(t.pings(spark, sf)).withColumn("warning", no_digits(F.col("warning")))


def survey_heights(spark, sf):
    return t.pings(spark, sf).groupBy("survey_id").agg((F.max("ping_id") + 1).alias("n_rows"))


FRAMES_SQL = """fr as (
select survey_id, cast(k as bigint) as frame_id, k * 192 as y0, least(k * 192 + 384, n_rows) as y1, n_rows
from (select survey_id, n_rows, unnest(range(0, cast(case when n_rows <= 384 then 0 else ceil((n_rows - 384) / 192e0) end as bigint) + 1)) as k
      from (select survey_id, max(ping_id) + 1 as n_rows from fx_pings group by survey_id) a) b
where least(k * 192 + 384, n_rows) - k * 192 >= 64 or k = 0)"""


@query("e04_make_frames", "fx_pings", sql=f"with {FRAMES_SQL} select survey_id, frame_id, y0, y1 from fr")
def _(spark, sf):
    return fr.make_frames(survey_heights(spark, sf))


@query("e05_assign_frames", "fx_pings", sql=f"""with {FRAMES_SQL}
select p.survey_id, p.ping_id, fr.frame_id, p.ping_id - fr.y0 as frame_row from fx_pings p join fr on p.survey_id = fr.survey_id and p.ping_id >= fr.y0 and p.ping_id < fr.y1""")
def _(spark, sf):
    return fr.assign_frames(t.pings(spark, sf)).select("survey_id", "ping_id", "frame_id", "frame_row")


@query("e06_make_tiles", "fx_pings", sql="""
with h as (select survey_id, (max(ping_id) + 1) * 3 as n_rows from fx_pings group by survey_id),
s as (select survey_id, n_rows, unnest(range(0, cast(case when n_rows <= 2048 then 1 else ceil(n_rows / 1024e0) end as bigint))) as tile_id from h),
k as (select * from s where tile_id = 0 or n_rows - tile_id * 1024 >= 256)
select survey_id, tile_id, tile_id * 1024 as y0, coalesce(lead(tile_id) over (partition by survey_id order by tile_id) * 1024, n_rows) as y1 from k""")
def _(spark, sf):
    return fr.make_tiles(survey_heights(spark, sf).withColumn("n_rows", F.col("n_rows") * 3))


@query("e07_stalled_frames", "fx_cells", sql="""
with p as (select survey_id, cast(floor(ping / 16e0) as bigint) as frame_id, ping % 16 as r, col, v from fx_cells),
n as (select survey_id, frame_id, count(*) as n from p group by 1, 2),
d as (select a.survey_id, a.frame_id, avg((a.v - b.v) * (a.v - b.v)) as mse from p a join p b on a.survey_id = b.survey_id and a.frame_id = b.frame_id + 1 and a.r = b.r and a.col = b.col group by 1, 2)
select n.survey_id, n.frame_id, round(case when n.n = m.n then d.mse else 999e0 end, 4) as mse, cast(coalesce(n.n = m.n and d.mse < 2, false) as int) as is_duplicate
from n left join n m on n.survey_id = m.survey_id and n.frame_id = m.frame_id + 1 left join d on n.survey_id = d.survey_id and n.frame_id = d.frame_id""")
def _(spark, sf):
    return fr.stalled_frames(t.cells(spark, sf), 16).withColumn("mse", F.round("mse", 4)).withColumn("is_duplicate", F.col("is_duplicate").cast("int"))


def reason_frames(spark, sf):
    reasons = F.when(F.col("scqi") < 20, F.array(F.lit("snr"), F.lit("speed"))).when(F.col("scqi") < 55, F.array(F.lit("altitude"))).otherwise(
        F.array().cast("array<string>"))
    return t.frames(spark, sf).withColumn("reasons", reasons)


@query("e08_resurvey_areas", "fx_frames", sql="""
with low as (select *, frame_id - row_number() over (partition by survey_id order by frame_id) as g from fx_frames where scqi < 55)
select survey_id, min(frame_id) as first_frame, max(frame_id) as last_frame, count(*) as n_frames, round(avg(scqi), 6) as mean_scqi,
 round(min(longitude), 6) as min_lon, round(min(latitude), 6) as min_lat, round(max(longitude), 6) as max_lon, round(max(latitude), 6) as max_lat,
 case when min(scqi) < 20 and max(scqi) >= 20 then 'altitude,snr,speed' when min(scqi) < 20 then 'snr,speed' else 'altitude' end as reasons
from low group by survey_id, g""")
def _(spark, sf):
    a = fr.resurvey_areas(reason_frames(spark, sf))
    return a.withColumns({c: F.round(c, 6) for c in ("mean_scqi", "min_lon", "min_lat", "max_lon", "max_lat")}).withColumn("reasons", F.array_join("reasons", ","))


@query("c01_attach_ping", "fx_pings", "fx_det", sql="""
with n as (select survey_id, max(ping_id) + 1 as m from fx_pings group by survey_id),
o as (select d.det_id, d.survey_id, cast(least(m - 1, greatest(0, round_even(y1 / 399e0 * (m - 1), 0))) as bigint) as ping_id from fx_det d join n on d.survey_id = n.survey_id)
select o.det_id, o.ping_id, p.event_id from o join fx_pings p on o.survey_id = p.survey_id and o.ping_id = p.ping_id""")
def _(spark, sf):
    d = t.det(spark, sf).select("det_id", "survey_id", "y1").withColumn("n_rows", F.lit(400))
    return pg.attach_ping(d, t.pings(spark, sf), "y1").select("det_id", "ping_id", "event_id")


def scqi_input(spark, sf):
    return t.pings(spark, sf).withColumns({"snr_db": F.col("altitude_m") % 20, "snr_valid": F.col("event_id") % 9 != 0,
                                           "p10": F.lit(20.0), "p90": F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(
                                               20.0 + F.col("event_id") % 150)})


@query("s18_scqi", "fx_pings", sql="""
with i as (select *, altitude_m % 20e0 as snr_db, event_id % 9 <> 0 as ok, altitude_m / greatest(1e0, slant_range_m) * 100e0 as ratio,
  case when event_id % 11 = 0 then null else event_id % 150 end as span from fx_pings),
s as (select event_id, case when ok then least(100e0, greatest(0e0, (snr_db - 2e0) / 14e0 * 100e0)) else 30e0 end as sn,
 case when ratio between 10 and 20 then 100e0 when ratio < 10 then greatest(10e0, 100e0 - (10e0 - ratio) * 12e0) else greatest(10e0, 100e0 - (ratio - 20e0) * 6e0) end as al,
 least(100e0, greatest(0e0, 100e0 - (abs(pitch_deg) * 8e0 + abs(roll_deg) * 6e0 + abs(heave_m) * 20e0))) as mo,
 case when speed_knots between 3 and 4.5e0 then 100e0 when speed_knots > 4.5e0 then greatest(15e0, 100e0 - (speed_knots - 4.5e0) * 22e0) else greatest(30e0, 100e0 - (3e0 - speed_knots) * 25e0) end as sp,
 case when span is null then 50e0 else least(100e0, greatest(0e0, span / 140e0 * 100e0)) end as sh, ok, ratio, speed_knots, span from i),
z as (select *, 0.30e0 * sn + 0.25e0 * al + 0.20e0 * mo + 0.15e0 * sp + 0.10e0 * sh as total,
 cast(not ok or sn < 40 as int) + cast(ratio < 10 or ratio > 20 as int) + cast(mo < 50 as int) + cast(speed_knots > 5.5e0 or speed_knots < 2 as int)
 + cast(span is not null and sh < 35 as int) as n_reasons from s)
select event_id, round(total, 6) as scqi_raw, case when round(total, 1) >= 85 then 'EXCELLENT' when round(total, 1) >= 70 then 'GOOD' when round(total, 1) >= 55 then 'ACCEPTABLE' when round(total, 1) >= 40 then 'DEGRADED' else 'RESURVEY_REQUIRED' end as grade,
 n_reasons, cast(round(total, 1) < 55 or n_reasons >= 3 as int) as resurvey from z""")
def _(spark, sf):
    return ql.scqi(scqi_input(spark, sf)).select(
        "event_id", rounded(F.col("scqi_raw"), 6).alias("scqi_raw"), "grade", F.size("resurvey_reasons").alias("n_reasons"),
        F.col("resurvey_recommended").cast("int").alias("resurvey"))


@query("s18_scqi_no_image", "fx_pings", sql="""
select event_id, round(0.30e0 * 30 + 0.25e0 * 100 + 0.20e0 * 100 + 0.15e0 * 100 + 0.10e0 * 50, 6) as scqi_raw, 'GOOD' as grade, 1 as n_reasons from fx_pings""")
def _(spark, sf):
    blank = t.pings(spark, sf).select("event_id", F.lit(None).cast("double").alias("snr_db"), F.lit(None).cast("boolean").alias("snr_valid"),
                                      F.lit(None).cast("double").alias("p10"), F.lit(None).cast("double").alias("p90"))
    return ql.scqi(blank).select("event_id", F.round("scqi_raw", 6).alias("scqi_raw"), "grade", F.size("resurvey_reasons").alias("n_reasons"))


@query("s19_quality_control", "fx_pings", "fx_cells", sql=f"""with {STEPS},
z as (select survey_id, count(*) as n_cells, avg(cast(v = 0 as int)) as zr, avg(cast(v = 255 as int)) as sr, 20 * log10(greatest(1, max(v) - min(v))) as dr from fx_cells group by survey_id),
dd as (select survey_id, avg(cast(m < 2 as int)) as dp from (select survey_id, ping, avg(v) as m from fx_cells group by 1, 2) q group by 1),
mid as (select p.* from fx_pings p join (select survey_id, cast(floor(count(*) / 2e0) as bigint) as ping_id from fx_pings group by survey_id) m using (survey_id, ping_id)),
tj as (select survey_id, cast(coalesce(bool_or(non_monotonic or distance_m / dt_s * 1.94384e0 > 15), false) as int) as bad from steps group by survey_id),
w as (select z.*, dp, m.survey_id as rec, altitude_m, greatest(abs(pitch_deg), abs(roll_deg)) as tilt, altitude_m < slant_range_m and slant_range_m > 1 and latitude between -90 and 90 as ok, bad
 from z join dd using (survey_id) left join mid m using (survey_id) left join tj using (survey_id))
select survey_id, 1 as check_no, cast(n_cells > 0 as int) as passed, round(cast(n_cells as double), 4) as value from w
union all select survey_id, 2, cast(zr <= 0.60e0 as int), round(zr, 4) from w union all select survey_id, 3, cast(sr <= 0.25e0 as int), round(sr, 4) from w
union all select survey_id, 4, cast(dr >= 6 as int), round(dr, 4) from w union all select survey_id, 5, cast(dp <= 0.60e0 as int), round(dp, 4) from w
union all select survey_id, 6, cast(ok as int), cast(ok as int) from w where rec is not null
union all select survey_id, 7, cast(altitude_m between 2 and 40 as int), round(altitude_m, 4) from w where rec is not null
union all select survey_id, 8, cast(tilt <= 12 as int), round(tilt, 4) from w where rec is not null
union all select survey_id, 9, 1 - bad, 1 - bad from w where rec is not null""")
def _(spark, sf):
    p = t.pings(spark, sf)
    c = t.cells(spark, sf)
    stats = wf.snr_index(c, ["survey_id"]).select("survey_id", "n_cells", "zero_ratio", "saturation_ratio", "dynamic_range_db").join(
        wf.ping_dropout(c), "survey_id")
    q = ql.quality_control(stats, pg.validate_pings(ql.middle_pings(p)), pg.validate_trajectory(p))
    return q.select("survey_id", "check_no", F.col("passed").cast("int").alias("passed"), F.round("value", 4).alias("value"))


# ---- geolocation --------------------------------------------------------------------------------------------------

def objects(spark, sf, method="planar"):
    p = t.pings(spark, sf).withColumn("cx", (F.col("event_id") % 640).cast("double"))
    return geo.error_ellipse(geo.geolocate(geo.towfish_position(p, method), 640, "cx", method=method))


GEO = """tf as (select *, cast(event_id % 640 as double) as cx,
 case when layback_m = 0 then latitude else latitude - layback_m * cos(radians(heading_deg)) / 111320e0 end as tla,
 case when layback_m = 0 then longitude else longitude - layback_m * sin(radians(heading_deg)) / (111320e0 * cos(radians(latitude))) end as tlo from fx_pings),
g as (select *, case when cx >= 320 then 'Starboard' else 'Port' end as channel, case when cx >= 320 then heading_deg + 90 else heading_deg - 90 end as brg,
 sqrt(greatest(0e0, pow(least(1e0, abs(cx - 320) / 320e0) * slant_range_m, 2) - altitude_m * altitude_m)) as rg from tf),
e as (select *, tla + rg * cos(radians(brg)) / 111320e0 as la, tlo + rg * sin(radians(brg)) / (111320e0 * cos(radians(tla))) as lo,
 2.4477e0 * sqrt(6.25e0 + pow(rg * sin(radians(0.5e0)), 2)) as ea, 2.4477e0 * sqrt(6.25e0 + 0.0625e0) as eb, (heading_deg + 90) - 360 * floor((heading_deg + 90) / 360) as phi from g)"""


@query("s01_haversine", "fx_pings", sql=f"select event_id, round({hav('latitude', 'longitude', '13e0', '80e0')}, 3) as d from fx_pings")
def _(spark, sf):
    from sonarlake.functions.geo import haversine
    return t.pings(spark, sf).select("event_id", F.round(haversine(F.col("latitude"), F.col("longitude"), F.lit(13.0), F.lit(80.0)), 3).alias("d"))


@query("s02_towfish_position", "fx_pings", sql=f"with {GEO} select event_id, round(tla, 8) as towfish_lat, round(tlo, 8) as towfish_lon from e")
def _(spark, sf):
    return geo.towfish_position(t.pings(spark, sf)).select("event_id", F.round("towfish_lat", 8).alias("towfish_lat"), F.round("towfish_lon", 8).alias("towfish_lon"))


@query("s02_towfish_position_wgs84")
def _(spark, sf):
    return geo.towfish_position(t.pings(spark, sf), "wgs84").select("event_id", F.round("towfish_lat", 8).alias("towfish_lat"), F.round("towfish_lon", 8).alias("towfish_lon"))


@query("s03_geolocate", "fx_pings", sql=f"with {GEO} select event_id, channel, round(rg, 5) as ground_range_m, round(la, 8) as lat, round(lo, 8) as lon from e")
def _(spark, sf):
    return objects(spark, sf).select("event_id", "channel", F.round("ground_range_m", 5).alias("ground_range_m"),
                                     F.round("target_lat", 8).alias("lat"), F.round("target_lon", 8).alias("lon"))


@query("s03_geolocate_wgs84")
def _(spark, sf):
    return objects(spark, sf, "wgs84").select("event_id", "channel", F.round("target_lat", 8).alias("lat"), F.round("target_lon", 8).alias("lon"))


@query("s04_error_ellipse", "fx_pings", sql=f"with {GEO} select event_id, round(ea, 6) as a, round(eb, 6) as b, round(phi, 6) as phi from e")
def _(spark, sf):
    return objects(spark, sf).select("event_id", F.round("ellipse_a_m", 6).alias("a"), F.round("ellipse_b_m", 6).alias("b"), F.round("ellipse_phi_deg", 6).alias("phi"))


@query("s05_ellipse_polygon", "fx_pings", sql=f"""with {GEO},
v as (select *, unnest(range(0, 32)) as i, ea / 111320e0 as dla, eb / (111320e0 * greatest(0.1e0, cos(radians(la)))) as dlo from e),
x as (select *, dlo * cos(i * 2 * pi() / 31) as px, dla * sin(i * 2 * pi() / 31) as py, radians(-phi) as r from v)
select event_id, i as vertex, round(lo + px * cos(r) - py * sin(r), 8) as lon, round(la + px * sin(r) + py * cos(r), 8) as lat from x""")
def _(spark, sf):
    p = geo.ellipse_polygon(objects(spark, sf)).select("event_id", F.posexplode("polygon").alias("vertex", "p"))
    return p.select("event_id", "vertex", F.round(F.col("p")[0], 8).alias("lon"), F.round(F.col("p")[1], 8).alias("lat"))


@query("s06_ground_range", "fx_pings", sql="select event_id, round(sqrt(greatest(0e0, slant_range_m * slant_range_m - altitude_m * altitude_m)), 6) as rg from fx_pings")
def _(spark, sf):
    from sonarlake.functions.geo import ground_range
    return t.pings(spark, sf).select("event_id", F.round(ground_range(F.col("slant_range_m"), F.col("altitude_m")), 6).alias("rg"))


@query("c12_attach_basin", "fx_pings", sql="""
with p as (select event_id, latitude + (event_id % 5) * 10 - 25 as latitude, longitude - (event_id % 7) * 20 as longitude from fx_pings),
b(basin, a0, a1, o0, o1, d0) as (values ('Bay of Bengal (Central Abyssal Basin)', 11.5e0, 16.5e0, 83.5e0, 89.5e0, 2400e0), ('Arabian Sea (Deep Subsea Trench)', 12e0, 18e0, 63.5e0, 70.5e0, 2900e0),
 ('Central Indian Ocean (Pelagic Abyssal Plain)', -7.5e0, 2.5e0, 70e0, 88e0, 3800e0), ('North Atlantic (Sargasso Deep Basin)', 24e0, 31e0, -64e0, -48e0, 4100e0),
 ('Mid-Atlantic Ridge (Abyssal Rift Valley)', -4e0, 8e0, -32e0, -18e0, 3100e0), ('North Pacific (Pelagic Ocean Corridor)', 22e0, 32e0, 148e0, 172e0, 4300e0),
 ('South Pacific (Polynesian Deep Basin)', -18e0, -8e0, -138e0, -115e0, 3900e0), ('South China Sea (Central Deep Basin)', 13e0, 17e0, 113.5e0, 117.5e0, 2200e0),
 ('Mediterranean Sea (Ionian Deep Abyssal Plain)', 34.5e0, 36.2e0, 16.8e0, 20.5e0, 2600e0), ('Coral Sea (Queensland Abyssal Corridor)', -19.5e0, -14.5e0, 150.5e0, 156e0, 2500e0),
 ('Gulf of Mexico (Sigsbee Abyssal Plain)', 23.8e0, 25.8e0, -92.5e0, -88.5e0, 3200e0), ('Norwegian Sea (Vøring Deep Basin)', 67e0, 71e0, 1.5e0, 7e0, 1800e0))
select event_id, basin, d0 as depth_min_m from p left join b on latitude between a0 and a1 and longitude between o0 and o1""")
def _(spark, sf):
    p = t.pings(spark, sf).select("event_id", (F.col("latitude") + (F.col("event_id") % 5) * 10 - 25).alias("latitude"),
                                  (F.col("longitude") - (F.col("event_id") % 7) * 20).alias("longitude"))
    return geo.attach_basin(p).select("event_id", "basin", "depth_min_m")


@query("c09_near_points", "fx_det", sql=f"""
with s as (select survey_id, latitude, longitude, min(det_id) as id, count(*) as n from fx_det where latitude is not null group by 1, 2, 3),
p as (select a.survey_id, a.id as a, a.n as n_a, b.id as b, b.n as n_b, {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} as d from s a join s b on a.survey_id = b.survey_id and a.id < b.id and abs(a.latitude - b.latitude) < 0.0001e0)
select survey_id, a, n_a, b, n_b, round(d, 4) as distance_m from p where d <= 4.5e0""")
def _(spark, sf):
    return geo.near_points(t.det(spark, sf), ["survey_id"], "det_id", 4.5).withColumn("distance_m", F.round("distance_m", 4))


@query("c16_measure_distance", "fx_det", sql=f"""
with sel as (select det_id as a, det_id + 1 as b from fx_det)
select s.a, s.b, round({hav('p.latitude', 'p.longitude', 'q.latitude', 'q.longitude')}, 4) as distance_m from sel s join fx_det p on p.det_id = s.a join fx_det q on q.det_id = s.b
where p.latitude is not null and q.latitude is not null""")
def _(spark, sf):
    d = t.det(spark, sf)
    chosen = d.select(F.col("det_id").alias("a"), (F.col("det_id") + 1).alias("b"))
    return geo.measure_distance(d, chosen, "det_id").withColumn("distance_m", F.round("distance_m", 4))


@query("b06_within_bounds", "fx_det", sql="select det_id from fx_det where latitude between 13.02e0 and 13.10e0 and longitude between 80.01e0 and 80.12e0")
def _(spark, sf):
    return geo.within_bounds(t.det(spark, sf), 13.02, 13.10, 80.01, 80.12).select("det_id")
