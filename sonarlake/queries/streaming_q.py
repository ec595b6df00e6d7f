"""Streaming, extension and log-source queries."""
from __future__ import annotations

import struct
import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import functions as F

from sonarlake.functions import extend as xt
from sonarlake.operators import cfar as cf
from sonarlake.operators import shapes as sh
from sonarlake.plans.durable import save_table, shared_dir
from sonarlake.plans.ordered import dense_index
from sonarlake.plans.totals import with_totals
from sonarlake.sources import logs as lg
from sonarlake.sources import survey_store as store
from sonarlake.sources import telemetry as tl
from sonarlake.sources.files import read_image_cells, read_image_inventory, write_files
from sonarlake.streaming import streams as st
from sonarlake.streaming import tracks as ts
from sonarlake.streaming import trajectory as tj

from . import tables as t
from .detections_q import named, r
from .pings_q import STEPS, hav
from .registry import query
from .waterfall_q import targets


def folder(spark, label):
    return f"{shared_dir(spark)}/sonarlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def as_stream(spark, df, label):
    """Store a table and read it back as a stream of files."""
    stored, path = save_table(df, label)
    return lambda: spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1000).parquet(path)


def ping_stream(spark, sf):
    return as_stream(spark, t.pings(spark, sf).withColumn("ts", F.timestamp_micros(F.round(F.col("t_s") * 1000000).cast("bigint"))), "pings")


def drained(spark, stream, label):
    path = folder(spark, label)
    st.drain(stream, path, folder(spark, "stream-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


@query("u01_stream_pings", "fx_pings", sql="""select survey_id, ping_id, cast(altitude_m < slant_range_m and slant_range_m > 1 as int) as is_valid,
 cast(not (heading_deg >= 0 and heading_deg < 360) as int) + cast(altitude_m <= 0.1e0 as int) + cast(altitude_m >= slant_range_m as int) as n_warnings from fx_pings""")
def _(spark, sf):
    path = folder(spark, "incoming")
    t.pings(spark, sf).selectExpr("survey_id", "ping_id", "t_s as timestamp", "latitude", "longitude", "heading_deg as heading", "altitude_m as altitude", "slant_range_m").write.json(path)
    out = drained(spark, st.read_pings(spark, path).select("survey_id", "ping_id", "is_valid", "warnings"), "checked")
    return out.select("survey_id", "ping_id", F.col("is_valid").cast("int").alias("is_valid"), F.size("warnings").alias("n_warnings"))


WATERMARK = "(select floor(max(t_s) * 1000) / 1000 from {0}) - 600"
STREAM_STEPS = "select survey_id, ping_id, round(dt_s, 4) as dt_s, round(distance_m / dt_s * 1.94384e0, 3) as speed_knots, cast(coalesce(distance_m / dt_s * 1.94384e0 > 15, false) as int) as teleport from steps where ceil(t_s * 1000) / 1000 <= "
STREAM_STEPS_CTE = STEPS.replace("select survey_id, ping_id, t_s - pt", "select survey_id, ping_id, t_s, t_s - pt")


def timed(df):
    return df.withColumn("ts", F.timestamp_micros(F.round(F.col("t_s") * 1000000).cast("bigint")))


@contextmanager
def keyed_state(spark):
    """The state store that operators with timers need, for queries started inside."""
    before = spark.conf.get(tj.STORE[0])
    spark.conf.set(*tj.STORE)
    try:
        yield
    finally:
        spark.conf.set(tj.STORE[0], before)


def streamed_steps(spark, pings, closed=False):
    """Steps of a ping table read as a stream of files, with the operator's default settings."""
    stored, path = save_table(timed(pings), "pings")
    if closed:  # a later file, so it is read last
        tj.closing_ping(stored).write.mode("append").parquet(path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1000).parquet(path)
    with keyed_state(spark):
        out = drained(spark, tj.stream_trajectory(stream), "steps")
    return out.select("survey_id", "ping_id", r("dt_s", 4), r("speed_knots", 3), F.col("teleport").cast("int").alias("teleport"))


@query("u02_stream_trajectory", "fx_pings", sql=f"with {STREAM_STEPS_CTE} " + STREAM_STEPS.split(" where ")[0])
def _(spark, sf):
    """Every step: the recording is finished, so a closing ping follows it."""
    return streamed_steps(spark, t.pings(spark, sf), closed=True)


GAPPED = "survey_id, ping_id, case when ping_id > 300 then t_s + 864000e0 else t_s end as t_s, latitude, longitude from fx_pings where ping_id % 7 <> 3 and ping_id not between 90 and 140"


@query("u02_stream_lost_pings", "fx_pings", sql="with g as (select " + GAPPED + "), " + STREAM_STEPS_CTE.replace("fx_pings", "g") + " " + STREAM_STEPS + WATERMARK.format("g"))
def _(spark, sf):
    """The same with lost ping numbers and a pause of ten days."""
    p = t.pings(spark, sf).filter("ping_id % 7 <> 3 and ping_id not between 90 and 140")
    return streamed_steps(spark, p.withColumn("t_s", F.expr("case when ping_id > 300 then t_s + 864000D else t_s end")))


SCQI_FIRST = """w as (select p.*, k.s as start_s from fx_pings p, lateral (select unnest([floor(t_s / 43200), floor(t_s / 43200) - 1]) * 43200 as s) k where t_s < k.s + 86400 and t_s >= k.s),
f as (select *, count(*) over (partition by survey_id, start_s) as n_pings, row_number() over (partition by survey_id, start_s order by t_s, ping_id) as rn from w),
g as (select survey_id, start_s, n_pings, altitude_m / greatest(1e0, slant_range_m) * 100e0 as ratio, pitch_deg, roll_deg, heave_m, speed_knots from f where rn = 1),
c as (select *, 0.3e0 * 30 + 0.25e0 * case when ratio between 10 and 20 then 100e0 when ratio < 10 then greatest(10e0, 100e0 - (10e0 - ratio) * 12e0) else greatest(10e0, 100e0 - (ratio - 20e0) * 6e0) end
 + 0.2e0 * least(100e0, greatest(0e0, 100e0 - (abs(pitch_deg) * 8e0 + abs(roll_deg) * 6e0 + abs(heave_m) * 20e0)))
 + 0.15e0 * case when speed_knots between 3 and 4.5e0 then 100e0 when speed_knots > 4.5e0 then greatest(15e0, 100e0 - (speed_knots - 4.5e0) * 22e0) else greatest(30e0, 100e0 - (3e0 - speed_knots) * 25e0) end + 5 as total from g)"""


@query("u03_stream_scqi", "fx_pings", sql=f"with {SCQI_FIRST} select survey_id, cast(start_s as bigint) as start_s, n_pings, round(total, 6) as scqi_raw from c where start_s + 86400 <= (select floor(max(t_s) * 1000) / 1000 from fx_pings) - 600")
def _(spark, sf):
    out = drained(spark, st.stream_scqi(ping_stream(spark, sf)(), "1 day", "12 hours"), "quality")
    return out.select("survey_id", F.unix_seconds("start").alias("start_s"), "n_pings", r("scqi_raw"))


@query("u04_stream_track")
def _(spark, sf):
    d = named(t.det(spark, sf)).selectExpr("survey_id", "frame_id", "det_id", "(x1 + x2) / 2 as x", "(y1 + y2) / 2 as y", "class_name", "timestamp_seconds(frame_id * 10 + 1000) as ts")
    with keyed_state(spark):
        return drained(spark, ts.stream_track(as_stream(spark, d, "dets")(), delay="0 seconds"), "tracks")


@query("u05_stream_dedup", "fx_pings", sql="select survey_id, ping_id, event_id from fx_pings")
def _(spark, sf):
    p = t.pings(spark, sf).withColumn("ts", F.timestamp_micros(F.round(F.col("t_s") * 1000000).cast("bigint"))).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return drained(spark, st.stream_dedup(as_stream(spark, p, "copies")()), "unique").select("survey_id", "ping_id", "event_id")


@query("u06_stream_save", "fx_det", sql="select det_id, survey_id, frame_id from fx_det")
def _(spark, sf):
    path = folder(spark, "saved")
    store.stream_save(as_stream(spark, t.det(spark, sf), "dets")(), path, folder(spark, "stream-checkpoint"), once=True).awaitTermination()
    return store.detections(spark, path).select("det_id", "survey_id", "frame_id")


@query("u06_stream_replace", "fx_det", sql="""select det_id, survey_id, frame_id, case when survey_id % 3 = 0 then 'again' else 'first' end as run_id,
 case when survey_id % 3 = 0 then 2 else 1 end as version from fx_det where survey_id % 3 <> 0 or det_id % 2 = 0""")
def _(spark, sf):
    """Some surveys are sent a second time, as another run with half of the rows; the first batch is replayed in between."""
    path, one = folder(spark, "saved"), t.det(spark, sf).withColumn("run_id", F.lit("first"))
    again = one.filter("survey_id % 3 = 0 and det_id % 2 = 0").withColumn("run_id", F.lit("again"))
    for n, part in enumerate((one, one, again)):  # a new checkpoint under the same name asks for the same batch again
        store.stream_save(as_stream(spark, part, "dets")(), path, folder(spark, "stream-checkpoint"), "resent" if n == 2 else "sent", once=True).awaitTermination()
    out = store.detections(spark, path).join(store.surveys(spark, path).select("survey_id", "version"), "survey_id")
    return out.select("det_id", "survey_id", "frame_id", "run_id", F.col("version").cast("int").alias("version"))


@query("f04_surveys_newest_first", "fx_det", sql="""with c as (select survey_id, count(*) as n from fx_det group by survey_id),
v as (select survey_id, n, case when survey_id < 10 then 1 else 2 end as version from c where survey_id <> 4 union all select 4, 0, 3)
select survey_id, 'run' || version as run_id, round(survey_id * 1.5e0, 3) as scqi, n as n_detections, row_number() over (order by version desc, survey_id) as place from v""")
def _(spark, sf):
    path, det = folder(spark, "surveys"), t.det(spark, sf)
    for n, part in enumerate((det.filter("survey_id < 10"), det.filter("survey_id >= 10"))):
        heads = part.groupBy("survey_id").agg(F.lit(f"run{n + 1}").alias("run_id"), (F.first("survey_id") * F.lit(1.5)).alias("scqi"))
        store.save(heads, part, path)
    store.save(det.filter("survey_id = 4").groupBy("survey_id").agg(F.lit("run3").alias("run_id"), F.lit(6.0).alias("scqi")), det.limit(0), path)  # saved again, empty
    rows = store.surveys(spark, path).select("survey_id", "run_id", F.round("scqi", 3).alias("scqi"), "n_detections", F.monotonically_increasing_id().alias("_at"))
    return dense_index(rows, [], ["_at"], "place", start=1).drop("_at")


@query("u07_stream_legs", "fx_pings", sql="""with g as (select survey_id, t_s, case when t_s - lag(t_s) over (partition by survey_id order by t_s) < 7200 then 0 else 1 end as n from fx_pings),
s as (select survey_id, t_s, sum(n) over (partition by survey_id order by t_s rows unbounded preceding) as leg from g)
select survey_id, count(*) as n_pings, round(min(t_s), 4) as first_s, round(max(t_s), 4) as last_s from s group by survey_id, leg having max(t_s) + 7200 <= (select floor(max(t_s) * 1000) / 1000 from fx_pings) - 600""")
def _(spark, sf):
    return drained(spark, st.stream_legs(ping_stream(spark, sf)(), "2 hours"), "legs").select("survey_id", "n_pings", r("first_s", 4), r("last_s", 4))


@query("u08_stream_review", "fx_det", sql="select 'sample_' || det_id as id, 'HIGH' as uncertainty_flag, 'PENDING' as status from fx_det where mc_variance >= 0.045e0")
def _(spark, sf):
    path = folder(spark, "review")
    st.stream_review(as_stream(spark, named(t.det(spark, sf)), "dets")(), path, folder(spark, "stream-checkpoint"), once=True).awaitTermination()
    return spark.read.parquet(path).select("id", "uncertainty_flag", "status")


# ---- extension surface ------------------------------------------------------------------------------------------------------

def double_it(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"pred_id": pdf["pred_id"], "model_score": pdf["conf"] * 0.5 + pdf["seg_quality"] * 0.25})


@query("x01_score_with", "fx_pred", sql="select pred_id, round(conf * 0.5e0 + seg_quality * 0.25e0, 6) as model_score from fx_pred")
def _(spark, sf):
    return xt.score_with(t.pred(spark, sf).select("pred_id", "conf", "seg_quality"), double_it, "pred_id bigint, model_score double").withColumn("model_score", F.round("model_score", 6))


@query("x02_sql_functions", "fx_pings", sql=f"""select event_id, round({hav('latitude', 'longitude', '13e0', '80e0')}, 3) as d, round(sqrt(greatest(0e0, slant_range_m * slant_range_m - altitude_m * altitude_m)), 6) as g,
 round(case when altitude_m > 0 then 1 / (1 + pow(10 / altitude_m, 3)) else 0 end, 6) as s from fx_pings""")
def _(spark, sf):
    xt.register(spark)
    t.pings(spark, sf).createOrReplaceTempView("sonarlake_pings")
    return spark.sql("select event_id, round(haversine_m(latitude, longitude, 13D, 80D), 3) as d, round(ground_range_m(slant_range_m, altitude_m), 6) as g, "
                     "round(error_score(altitude_m, 10D), 6) as s from sonarlake_pings")


# ---- logs -------------------------------------------------------------------------------------------------------------------

def xtf_bytes(rows: pd.DataFrame) -> bytes:
    """An XTF file of ping rows (first half of the samples to port, second half to starboard)."""
    head = bytearray(1024)
    struct.pack_into("<H", head, 106, 2)
    out = [bytes(head)]
    for ping, samples in zip(rows["ping"], rows["samples"]):
        hdr = bytearray(242)
        struct.pack_into("<H6B", hdr, 0, 2024, 1, 2, int(ping) % 24, int(ping) % 60, 5, 25)
        struct.pack_into("<I", hdr, 14, int(ping))
        struct.pack_into("<4f", hdr, 26, 45.0, 0.5, -0.5, 0.1)
        struct.pack_into("<3f", hdr, 46, 12.0, 8.0, 3.5)
        struct.pack_into("<2d", hdr, 62, 80.0 + int(ping) * 0.001, 13.0 + int(ping) * 0.001)
        half = len(samples) // 2
        for ch, part in enumerate((samples[:half], samples[half:])):
            c = bytearray(64)
            struct.pack_into("<HHf", c, 0, ch, 0, 60.0)
            struct.pack_into("<I", c, 34, half)
            hdr += c + bytes(int(v) for v in part)
        out.append(struct.pack("<HBBHHHI", 0xFACE, 0, 0, 2, 0, 0, 14 + len(hdr)) + bytes(hdr))
    return b"".join(out)


def jsf_bytes(rows: pd.DataFrame) -> bytes:
    """A JSF file of ping rows, 16-bit envelopes with exponent 1 and a position in ten-thousandths of an arc-minute."""
    out = []
    for ping, samples in zip(rows["ping"], rows["samples"]):
        half = len(samples) // 2
        for ch, part in enumerate((samples[:half], samples[half:])):
            h = bytearray(240)
            struct.pack_into("<i", h, 0, 1700000000 + int(ping))
            struct.pack_into("<iih", h, 80, 48000000 + int(ping), 7800000 - int(ping), 2)
            struct.pack_into("<i", h, 108, 9500)
            struct.pack_into("<H", h, 114, half)
            struct.pack_into("<I", h, 116, 20000)
            struct.pack_into("<h", h, 168, 1)
            body = bytes(h) + b"".join(struct.pack("<H", int(v) * 2) for v in part)
            out.append(struct.pack("<HBBHBBBBHI", 0x1601, 0, 0, 80, 0, 20, ch, 0, 0, len(body)) + body)
    return b"".join(out)


def log_files(spark, sf, build):
    """Log files of 25 pings each, assembled from the waterfall."""
    rows = t.waterfall(spark, sf).withColumn("block", F.expr("cast(floor(ping / 25D) as bigint)"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ping")
        return pd.DataFrame({"path": [f"s{pdf['survey_id'].iloc[0]}/b{pdf['block'].iloc[0]}"], "content": [build(pdf)]})

    return rows.groupBy("survey_id", "block").applyInPandas(pack, "path string, content binary")


PATHS = "'s' || survey_id || '/b' || (ping // 25) as path, ping % 25 as ping_id"


@query("a03_read_xtf", "fx_cells", sql=f"select {PATHS}, col // 32 as channel, sum(v * (col % 32 + 1)) as checksum, round(any_value(13e0 + ping * 0.001e0), 6) as latitude, round(any_value(epoch_ms(make_timestamp(2024, 1, 2, ping % 24, ping % 60, 5e0)) / 1000e0 + 0.25e0), 3) as epoch_s from fx_cells group by survey_id, ping, channel")
def _(spark, sf):
    path = folder(spark, "xtf")
    write_files(log_files(spark, sf, xtf_bytes).withColumn("path", F.concat("path", F.lit(".xtf"))), path)
    x = named_logs(lg.read_xtf(spark, path, range_mb=0.004))  # ranges of some ten pings
    total = F.aggregate(F.transform("samples", lambda v, i: v * (i + 1)), F.lit(0), lambda a, v: a + v).cast("bigint")
    return x.select("path", "ping_id", "channel", total.alias("checksum"), r("latitude"), r("epoch_s", 3))


@query("x03_decode_xtf_sql", "fx_cells", sql=f"select {PATHS}, col // 32 as channel, sum(v) as total from fx_cells group by survey_id, ping, channel")
def _(spark, sf):
    xt.register_table_functions(spark)
    log_files(spark, sf, xtf_bytes).createOrReplaceTempView("sonarlake_logs")
    return spark.sql("select l.path, d.ping_id, d.channel, cast(aggregate(d.samples, 0, (a, v) -> a + v) as bigint) as total from sonarlake_logs l, lateral decode_xtf(l.path, l.content) d")


def named_logs(rows):
    """Logs named by folder and file, without root and suffix."""
    return rows.withColumn("path", F.regexp_extract("path", r"([^/]+/[^/]+)\.[a-z]+$", 1))


def jsf_traces(spark, sf):
    path = folder(spark, "jsf")
    write_files(log_files(spark, sf, jsf_bytes).withColumn("path", F.concat("path", F.lit(".jsf"))), path)
    return lg.group_traces(named_logs(lg.read_jsf(spark, path, range_mb=0.004)), chunk=16)


@query("a04_read_jsf", "fx_cells", sql=f"select {PATHS}, col // 32 as channel, (ping % 25) * 2 + col // 32 as trace_no, sum(v) * 1e0 as total from fx_cells group by survey_id, ping, channel")
def _(spark, sf):
    return jsf_traces(spark, sf).select("path", "ping_id", "channel", "trace_no", F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("a05_group_traces", sql="""with e as (select user_id % 10 as path, row_number() over (partition by user_id % 10 order by ts, event_id) - 1 as trace_no, cast(floor(value * 100) as bigint) % 2 as channel from events),
f as (select *, case when lag(channel) over w is null or lag(channel) over w = channel then trace_no end as f from e window w as (partition by path order by trace_no)),
s as (select *, max(f) over (partition by path order by trace_no) as s from f)
select path, trace_no, sum(case when (trace_no - s) % 2 = 0 then 1 else 0 end) over (partition by path order by trace_no) - 1 as ping_id from s""")
def _(spark, sf):
    e = t.base(spark, sf, "events").selectExpr("user_id % 10 as path", "ts", "event_id", "cast(floor(value * 100D) as bigint) % 2 as channel")
    return lg.group_traces(dense_index(e, ["path"], ["ts", "event_id"], "trace_no"), 256).select("path", "trace_no", F.col("ping_id").cast("bigint").alias("ping_id"))


@query("a06_decode_nav", "fx_cells", sql=f"""select distinct {PATHS}, round((7800000 - ping) / 600000e0, 8) as latitude, round((48000000 + ping) / 600000e0, 8) as longitude, 0 as synthetic, round(32 * 20000 * 1e-9 * 750, 6) as slant_range_m, 9.5e0 as altitude_m from fx_cells""")
def _(spark, sf):
    n = lg.decode_nav(jsf_traces(spark, sf))
    return n.select("path", "ping_id", r("latitude", 8), r("longitude", 8), F.col("navigation_synthetic").cast("int").alias("synthetic"), r("slant_range_m"), "altitude_m")


@query("a01_telemetry_json", "fx_pings", sql="select survey_id, count(*) as n, round(sum(altitude_m), 4) as altitude, 15e0 as depth, round(sum(heading_deg), 4) as heading, round(max(speed_knots), 6) as speed from fx_pings group by 1")
def _(spark, sf):
    path = folder(spark, "json")
    record = F.expr("struct(t_s as timestamp, latitude, longitude, heading_deg as heading, altitude_m as altitude, slant_range_m as slant_range, speed_knots as vessel_speed_knots)")
    parts = t.pings(spark, sf).groupBy("survey_id", F.expr("cast(ping_id / 500 as bigint)").alias("part")).agg(F.to_json(F.collect_list(record)).alias("content"))
    write_files(parts.withColumn("path", F.format_string("survey-%d/%d.json", "survey_id", "part")), path)
    rows = tl.read_telemetry_json(spark, path + "/*").withColumn("survey_id", F.regexp_extract("source_file", r"survey-(\d+)/", 1).cast("bigint"))
    return rows.groupBy("survey_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("altitude_m"), 4).alias("altitude"), F.max("depth_m").alias("depth"),
                                         F.round(F.sum("heading_deg"), 4).alias("heading"), F.round(F.max("vessel_speed_knots"), 6).alias("speed"))


def bmp(rows: pd.DataFrame) -> bytes:
    """A 24-bit bitmap of grey rows, first row on top."""
    lines = [bytes(int(v) for v in line for _ in range(3)) for line in rows["samples"]]
    width, pad = len(lines[0]) // 3, b"\0" * (-len(lines[0]) % 4)
    body = b"".join(line + pad for line in lines)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, -len(lines), 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


@query("a09_image_cells", "fx_cells", sql="select 's' || survey_id || '_b' || (ping // 25) || '.bmp' as name, ping % 25 as ping, col, v, 1 as n_bad from fx_cells")
def _(spark, sf):
    path = folder(spark, "images")
    files = log_files(spark, sf, bmp).select(F.concat(F.replace("path", F.lit("/"), F.lit("_")), F.lit(".bmp")).alias("path"), "content")
    write_files(files.unionByName(spark.createDataFrame([("broken.bmp", b"BMxx")], "path string, content binary")), path)
    cells, bad = read_image_cells(spark, path)
    return with_totals(cells, bad.agg(F.count_if(F.col("name") == "broken.bmp").cast("int").alias("n_bad")))


@query("a11_image_inventory", "fx_images", sql="select i.split, i.name, substring(i.name, 1, length(i.name) - 4) as stem, octet_length(encode(d.text)) as size_bytes, i.content_hash from fx_images i join documents d on d.doc_id = i.image_id")
def _(spark, sf):
    path = folder(spark, "inventory")
    texts = t.base(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("content"))
    write_files(t.images(spark, sf).join(texts, "image_id").withColumn("path", F.concat_ws("/", "split", F.lit("images"), "name")), path)
    return read_image_inventory(spark, path).select("split", "name", "stem", "size_bytes", "content_hash")


SUMMARIES = """with e as (select user_id % 9 as run, event_type as c, max(value) / 200e0 as v from events group by 1, 2),
s as (select run, avg(v) as m, max(v) filter (c = 'click') as click, max(v) filter (c = 'view') as view from e group by 1)"""


def summary_files(spark, sf):
    e = t.base(spark, sf, "events").groupBy(F.expr("user_id % 9").alias("run"), F.col("event_type").alias("c")).agg((F.max("value") / 200).alias("v"))
    metrics = lambda v: F.struct(v.alias("precision"), (v / 2).alias("recall"), v.alias("map50"), (v / 4).alias("map50_95"))
    per = e.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("c", metrics(F.col("v"))))).alias("per_class"), F.avg("v").alias("m"))
    overall = F.struct(F.col("m").alias("precision"), (F.col("m") / 2).alias("recall"), F.col("m").alias("map50"), (F.col("m") / 4).alias("map50_95"), (F.col("m") * 10).alias("inference_speed_ms"))
    body = F.to_json(F.struct(F.when(F.col("run") % 2 == 0, 512).alias("imgsz"), overall.alias("overall"), "per_class"))
    path = folder(spark, "summaries")
    write_files(per.select(F.format_string("exp/run%d/evaluation_summary.json", "run").alias("path"), body.alias("content")), path)
    return tl.read_eval_summaries(spark, path)


@query("a15_eval_summaries", sql=SUMMARIES + " select 'run' || run as run, case when run % 2 = 0 then 512 end as imgsz, round(m, 6) as map50, round(m * 10, 6) as ms, round(click / 2, 6) as click_recall from s")
def _(spark, sf):
    s = summary_files(spark, sf)
    return s.select("run", "imgsz", F.round("overall.map50", 6).alias("map50"), F.round("overall.inference_speed_ms", 6).alias("ms"), F.round(F.try_element_at("per_class", F.lit("click"))["recall"], 6).alias("click_recall"))


@query("d18_compare_runs", sql=SUMMARIES + """ select 'run' || run as experiment, case when run % 2 = 0 then 512 else 640 end as resolution, 0.25e0 as conf, round(m * 100, 4) as map50_pct, round(m * 50, 4) as recall_pct,
 round(m * 10, 4) as latency_ms, 0e0 as fps, round(coalesce(click, 0) * 100, 4) as click_map50_pct, 0e0 as mine_map50_pct from s""")
def _(spark, sf):
    rows = tl.compare_experiments(summary_files(spark, sf), ["click", "mine"])
    return rows.select("experiment", "resolution", "conf", *[F.round(c, 4).alias(c) for c in ("map50_pct", "recall_pct", "latency_ms")], "fps", F.round("click_map50_pct", 4).alias("click_map50_pct"), "mine_map50_pct")


@query("a02_telemetry_csv", "fx_pings", sql="select count(*) as n, round(sum(altitude_m), 3) as altitude, round(sum(latitude), 3) as latitude, 25e0 as layback, round(sum(slant_range_m), 3) as slant from fx_pings")
def _(spark, sf):
    path = folder(spark, "csv")
    t.pings(spark, sf).selectExpr("t_s as timestamp", "latitude as lat", "longitude as lon", "heading_deg as heading", "altitude_m as altitude", "slant_range_m as range").write.option("header", True).csv(path)
    rows = tl.read_telemetry_csv(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("altitude_m"), 3).alias("altitude"), F.round(F.sum("latitude"), 3).alias("latitude"), F.max("layback_m").alias("layback"),
                    F.round(F.sum("slant_range_m"), 3).alias("slant"))


@query("a16_training_log", sql="select count(*) as n, round(sum(value), 3) as train_box_loss, round(sum(value * 2), 3) as val_box_loss from events")
def _(spark, sf):
    path = folder(spark, "train")
    t.base(spark, sf, "events").select(F.col("event_id").alias(" epoch"), F.col("value").alias("  train/box_loss"), (F.col("value") * 2).alias(" val/box_loss ")).write.option("header", True).csv(path)
    return tl.read_training_log(spark, path).agg(F.count("epoch").alias("n"), F.round(F.sum("train_box_loss"), 3).alias("train_box_loss"), F.round(F.sum("val_box_loss"), 3).alias("val_box_loss"))


@query("a12_yolo_labels", "fx_labels", sql="select count(*) as n, count(distinct line) as lines from fx_labels")
def _(spark, sf):
    from sonarlake.sources.files import read_yolo_labels
    path = folder(spark, "yolo")
    t.labels(spark, sf).select("line").write.text(path + "/train/labels")
    return read_yolo_labels(spark, path).filter("split = 'train'").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("lines"))


@query("s20_shape_gate")
def _(spark, sf):
    rows = targets(spark, sf)
    from sonarlake.operators.waterfall import to_cells
    regions = cf.label_regions(cf.os_cfar(to_cells(rows)))
    return sh.shape_gate(sh.hull_stats(regions))


@query("x04_hull_stats")
def _(spark, sf):
    from sonarlake.operators.waterfall import to_cells
    return sh.hull_stats(cf.label_regions(cf.threshold_mask(to_cells(targets(spark, sf)), 0.85)))


