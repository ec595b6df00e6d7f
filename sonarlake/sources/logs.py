"""Sonar-log sources: XTF and JSF files decoded to trace rows, then plain DataFrame steps.

Files are read by byte ranges through the data source of ``log_source``; ``decode_xtf`` and ``decode_jsf`` decode contents
that are already in a table, one file per row. Grouping into pings, navigation and imagery are Spark work.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarlake.plans.durable import durable
from sonarlake.plans.ordered import with_chunks

# File layouts (markers, header sizes, field offsets) and fallback values.
XTF_FILE_HEADER, XTF_MAGIC, XTF_SONAR, XTF_PING_HEADER, XTF_CHANNEL_HEADER = 1024, 0xFACE, 0, 242, 64
JSF_MARKER, JSF_SIDESCAN, JSF_TRACE_HEADER = 0x1601, 80, 240
SOUND_SPEED = 1500.0
FALLBACK_LAT, FALLBACK_LON = 13.0827, 80.2707
BATCH = 512

XTF_SCHEMA = ("path string, ping_id bigint, channel int, ping_number bigint, year int, month int, day int, hour int, minute int, second int, hsecond int, "
              "latitude double, longitude double, heading_deg double, vessel_speed_knots double, altitude_m double, depth_m double, layback_m double, "
              "pitch_deg double, roll_deg double, heave_m double, slant_range_m double, samples array<int>")
JSF_SCHEMA = ("path string, trace_no bigint, channel int, t_s bigint, x int, y int, units int, altitude_mm int, n_samples int, interval_ns bigint, samples array<float>")


def header_epoch(df: DataFrame) -> DataFrame:
    """Epoch seconds from header time fields (1/100 s); null when the fields are no valid time."""
    whole = F.try_make_timestamp(F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.col("minute"), F.col("second").cast("decimal(8,6)"), F.lit("UTC"))
    ok = F.col("second").between(0, 59) & F.col("hsecond").between(0, 99)
    return df.withColumn("epoch_s", F.when(ok, F.unix_micros(whole) / 1e6 + F.col("hsecond") / 100.0))


# ---- XTF ------------------------------------------------------------------------------------------------------------------

def _xtf_records(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the sonar-ping payloads; after a bad marker the next good one counts, however far; a truncated record ends the file."""
    at, size = XTF_FILE_HEADER, len(data)
    while at + 14 <= size:
        magic, kind = struct.unpack_from("<HB", data, at)
        if magic != XTF_MAGIC:
            ahead = data.find(b"\xce\xfa", at + 1)
            if ahead < 0:
                return
            at = ahead
            continue
        length = struct.unpack_from("<I", data, at + 10)[0]
        if length < 14 or at + length > size:
            return
        if kind == XTF_SONAR:
            yield at + 14, at + length
        at += length


def _xtf_ping(data: bytes, start: int, end: int, n_channels: int) -> tuple[dict, dict[int, np.ndarray]] | None:
    if min(XTF_PING_HEADER, end - start) < 100:
        return None
    year, month, day, hour, minute, second, hsecond = struct.unpack_from("<H6B", data, start)
    number = struct.unpack_from("<I", data, start + 14)[0]
    layback = struct.unpack_from("<f", data, start + 18)[0]
    heading, pitch, roll, heave = struct.unpack_from("<4f", data, start + 26)
    depth, altitude, speed = struct.unpack_from("<3f", data, start + 46)
    east, north = struct.unpack_from("<2d", data, start + 62)
    lat = north if -90 <= north <= 90 else FALLBACK_LAT
    lon = east if -180 <= east <= 180 else FALLBACK_LON
    if lat == 0 and lon == 0:
        lat, lon = FALLBACK_LAT, FALLBACK_LON
    meta = {"ping_number": number, "year": year, "month": month, "day": day, "hour": hour, "minute": minute, "second": second, "hsecond": hsecond,
            "latitude": lat, "longitude": lon, "heading_deg": heading if 0 <= heading <= 360 else 45.0, "vessel_speed_knots": max(0.5, speed) if speed > 0 else 3.5,
            "altitude_m": max(1.0, altitude) if altitude > 0 else 10.0, "depth_m": max(0.5, depth) if depth > 0 else 15.0,
            "layback_m": layback if layback >= 0 else 25.0, "pitch_deg": pitch, "roll_deg": roll, "heave_m": heave, "slant_range_m": 75.0}
    at, sides = start + min(XTF_PING_HEADER, end - start), {}
    for i in range(n_channels):
        if at + XTF_CHANNEL_HEADER > end:
            break
        number_of, _, slant = struct.unpack_from("<HHf", data, at)
        count = struct.unpack_from("<I", data, at + 34)[0]
        at += XTF_CHANNEL_HEADER
        if count == 0 or count > 65536:
            count = min(1024, end - at)
        trace = np.frombuffer(data, np.uint8, max(0, min(count, end - at)), at)
        if not len(trace):
            break
        at += len(trace)
        port = number_of == 0 or i == 0
        if port:
            meta["slant_range_m"] = max(10.0, slant) if slant > 0 else 75.0
        sides[0 if port else 1] = trace
    return (meta, sides) if len(sides) == 2 else None


def decode_xtf_bytes(path: str, data: bytes) -> Iterator[dict]:
    """Two trace rows (port, starboard) per complete ping of one file."""
    if len(data) < XTF_FILE_HEADER:
        return
    n_channels = max(1, min(6, struct.unpack_from("<H", data, 106)[0]))
    ping_id = 0
    for start, end in _xtf_records(data):
        ping = _xtf_ping(data, start, end, n_channels)
        if ping is None:
            continue
        meta, sides = ping
        for channel, samples in sorted(sides.items()):
            yield {"path": path, "ping_id": ping_id, "channel": channel, **meta, "samples": samples.astype(np.int32)}
        ping_id += 1


# ---- JSF ------------------------------------------------------------------------------------------------------------------

def decode_jsf_bytes(path: str, data: bytes) -> Iterator[dict]:
    """One row per side-scan trace in message order; envelopes scaled by 2^-exponent."""
    at, size, n = 0, len(data), 0
    while at + 16 <= size:
        marker, kind, channel, length = struct.unpack_from("<H2xH2xB3xI", data, at)
        if marker != JSF_MARKER or at + 16 + length > size:
            ahead = data.find(b"\x01\x16", at + 1, at + 1 + 65536)
            at = ahead if ahead >= 0 else at + 65536
            continue
        if kind == JSF_SIDESCAN and length > JSF_TRACE_HEADER:
            yield {"path": path, "trace_no": n, "channel": channel, **_jsf_trace(data, at + 16, length)}
            n += 1
        at += 16 + length


def _jsf_trace(data: bytes, at: int, length: int) -> dict:
    field = lambda fmt, off: struct.unpack_from(fmt, data, at + off)[0]
    room, form = length - JSF_TRACE_HEADER, field("<h", 34)
    wide = form in (0, 1)
    listed = field("<H", 114) or room // 2
    count = min(listed, room // 2 if wide else room)
    raw = np.frombuffer(data, "<u2" if wide else np.uint8, count, at + JSF_TRACE_HEADER).astype(np.float32)
    if wide:
        raw = raw * np.float32(2.0 ** -field("<h", 168))
    return {"t_s": field("<i", 0), "x": field("<i", 80), "y": field("<i", 84), "units": field("<h", 88), "altitude_mm": field("<i", 108),
            "n_samples": listed, "interval_ns": field("<I", 116) or 15000, "samples": raw}


def _decode(files: DataFrame, decoder, schema: str) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                held = []
                for row in decoder(path, bytes(content)):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def decode_xtf(files: DataFrame) -> DataFrame:
    """Trace rows of XTF contents (columns path, content) with epoch seconds."""
    return header_epoch(_decode(files, decode_xtf_bytes, XTF_SCHEMA)).drop("year", "month", "day", "hour", "minute", "second", "hsecond")


def decode_jsf(files: DataFrame) -> DataFrame:
    return _decode(files, decode_jsf_bytes, JSF_SCHEMA)


def read_xtf(spark: SparkSession, path: str, range_mb: float | None = None) -> DataFrame:
    """Trace rows (port, starboard) of every complete ping of the XTF files below a folder, large files by byte ranges."""
    from .log_source import RANGE_MB, read_ranges

    rows = read_ranges(spark, path, "xtf", "ping_id", range_mb or RANGE_MB)
    return header_epoch(rows).drop("year", "month", "day", "hour", "minute", "second", "hsecond")


def read_jsf(spark: SparkSession, path: str, range_mb: float | None = None) -> DataFrame:
    """Side-scan traces of the JSF files below a folder, large files by byte ranges."""
    from .log_source import RANGE_MB, read_ranges

    return read_ranges(spark, path, "jsf", "trace_no", range_mb or RANGE_MB)


def group_traces(traces: DataFrame, chunk: int = 4096) -> DataFrame:
    """Number pings by message order: a trace on a channel the current ping already has opens the next ping.

    Logs of two channels are numbered by chunks; in logs of more channels a ping's start depends on all before it, so
    their (trace, channel) numbers run through one task per log, with the open ping's channels as the only state.
    """
    order = durable(traces.select("path", "trace_no", "channel"), "trace-order")  # numbered without the samples, which would be decoded and sorted each time
    many = order.groupBy("path").agg(F.countDistinct("channel").alias("_c")).filter("_c > 2").select("path")
    slim = order.join(many, "path", "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    folded = slim.repartition("path").sortWithinPartitions("path", "trace_no").mapInPandas(
        _fold_traces, f"path {kinds['path']}, trace_no {kinds['trace_no']}, ping_id bigint")
    paired = _group_pairs(order.join(many, "path", "left_anti"), chunk).select("path", "trace_no", F.col("ping_id").cast("bigint").alias("ping_id"))
    return traces.join(paired.unionByName(folded), ["path", "trace_no"])


def _fold_traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    log, ping, open_ = None, -1, set()
    for batch in batches:
        out = []
        for path, channel in zip(batch["path"].tolist(), batch["channel"].tolist()):
            if path != log:
                log, ping, open_ = path, -1, set()
            if ping < 0 or channel in open_:
                ping, open_ = ping + 1, set()
            open_.add(channel)
            out.append(ping)
        yield batch[["path", "trace_no"]].assign(ping_id=out)


def _group_pairs(traces: DataFrame, chunk: int) -> DataFrame:
    """The rule for two channels: traces come as runs of alternating channels. A trace starts a ping when its channel equals the previous trace's, or
    when its distance from the last such forced start is even: within a stretch of alternating channels, pairs are
    taken from its beginning. Forced starts are carried forward chunk by chunk.
    """
    chunks = with_chunks(traces, "trace_no", chunk, before=1)
    w = Window.partitionBy("path", "_chunk").orderBy("trace_no")
    prev = F.lag("channel").over(w)
    forced = chunks.withColumn("_f", F.when(prev.isNull() | (prev == F.col("channel")), F.col("trace_no"))).filter(F.col("_own"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = forced.withColumn("_s", F.last("_f", True).over(upto))
    ends = carried.groupBy("path", "_chunk").agg(F.max("_f").alias("_m"))
    back = Window.partitionBy("path").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    opens = ends.select("path", "_chunk", F.last("_m", True).over(back).alias("_open"))
    placed = carried.join(opens, ["path", "_chunk"]).withColumn("_s", F.coalesce("_s", "_open"))
    starts = placed.withColumn("_new", ((F.col("trace_no") - F.col("_s")) % 2 == 0).cast("int"))
    sums = starts.groupBy("path", "_chunk").agg(F.sum("_new").alias("_n"))
    before = sums.select("path", "_chunk", F.coalesce(F.sum("_n").over(back), F.lit(0)).alias("_before"))
    return (starts.join(before, ["path", "_chunk"]).withColumn("ping_id", F.sum("_new").over(upto) + F.col("_before") - 1)
            .drop("_chunk", "_own", "_f", "_s", "_open", "_new", "_before"))


def decode_nav(traces: DataFrame, key: str = "path") -> DataFrame:
    """Position, range and altitude per ping of grouped traces; a file whose positions are all zero is synthetic.

    Units 1 are thousandths of an arc-minute, others ten-thousandths. Range and altitude come from the file's first trace.
    """
    first_of_ping = F.min_by(F.struct("t_s", "x", "y", "units"), "trace_no")
    pings = traces.groupBy(key, "ping_id").agg(first_of_ping.alias("_p")).select(key, "ping_id", "_p.*")
    head = traces.groupBy(key).agg(
        F.min_by(F.struct("n_samples", "interval_ns", "altitude_mm"), "trace_no").alias("_h"), F.max(((F.col("x") != 0) | (F.col("y") != 0)).cast("int")).alias("_nav"))
    j = pings.join(head, key)
    div = F.when(F.col("units") == 1, 60000.0).otherwise(600000.0)
    has = F.col("_nav") == 1
    alt = F.greatest(F.lit(0.0), F.col("_h.altitude_mm") / 1000.0)
    return j.select(
        key, "ping_id", F.col("t_s").cast("double").alias("t_s"),
        F.when(has, F.col("y") / div).otherwise(FALLBACK_LAT + F.col("ping_id") * 1e-5).alias("latitude"),
        F.when(has, F.col("x") / div).otherwise(FALLBACK_LON + F.col("ping_id") * 1e-5).alias("longitude"), (~has).alias("navigation_synthetic"),
        (F.col("_h.n_samples") * F.col("_h.interval_ns") * 1e-9 * SOUND_SPEED / 2.0).alias("slant_range_m"),
        F.when(alt > 0, alt).otherwise(F.lit(15.0)).alias("depth_m"), F.when(alt > 0, alt).otherwise(F.lit(10.0)).alias("altitude_m"))


def log_metadata(pings: DataFrame, key: str = "path") -> DataFrame:
    return pings.groupBy(key).agg(F.countDistinct("ping_id").alias("num_pings"), F.first("slant_range_m").alias("max_slant_range_m"))
