import hashlib
import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonarlake.queries.streaming_q import jsf_bytes, xtf_bytes
from sonarlake.sources import export as ex
from sonarlake.sources import files as fl
from sonarlake.sources import logs as lg
from sonarlake.sources import telemetry as tl


@pytest.fixture
def pings():
    return pd.DataFrame({"ping": [3, 4, 5], "samples": [list(range(10)), list(range(10, 20)), list(range(20, 30))]})


def test_telemetry_json_aliases_and_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"timestamp": 5, "latitude": 1.5, "heading": 30, "slant_range": 50}, {"timestamp": 6, "altitude_m": 4}]))
    (tmp_path / "b.json").write_text(json.dumps({"timestamp": 7, "longitude": 2}))
    got = {r.timestamp: r for r in tl.read_telemetry_json(spark, str(tmp_path)).collect()}
    assert set(got) == {5.0, 6.0, 7.0}
    assert (got[5.0].heading_deg, got[5.0].slant_range_m, got[5.0].altitude_m, got[5.0].layback_m) == (30.0, 50.0, 10.0, 25.0)
    assert got[6.0].altitude_m == 4.0 and got[7.0].longitude == 2.0 and got[7.0].latitude == 0.0


def test_telemetry_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp,lat,lon,heading,range\n1,13.5,80.5,10,60\n")
    r = tl.read_telemetry_csv(spark, str(tmp_path / "t.csv")).first()
    assert (r.latitude, r.longitude, r.heading_deg, r.slant_range_m, r.depth_m) == (13.5, 80.5, 10.0, 60.0, 15.0)


def test_xtf_resync_and_truncation(spark, tmp_path, pings):
    whole = xtf_bytes(pings)
    record = (len(whole) - 1024) // 3
    broken = whole[:1024 + record] + b"junkjunk" + whole[1024 + record:-7]
    (tmp_path / "a.xtf").write_bytes(whole)
    (tmp_path / "b.xtf").write_bytes(broken)
    got = lg.read_xtf(spark, str(tmp_path)).toPandas()
    per = got.assign(f=got.path.str[-5:]).groupby("f").ping_id.nunique().to_dict()
    assert per == {"a.xtf": 3, "b.xtf": 2}
    first = got[(got.path.str.endswith("a.xtf")) & (got.ping_id == 0)].sort_values("channel")
    assert list(first.samples.iloc[0]) == [0, 1, 2, 3, 4] and list(first.samples.iloc[1]) == [5, 6, 7, 8, 9]
    assert first.slant_range_m.iloc[0] == 60.0 and first.latitude.iloc[0] == pytest.approx(13.003)


def test_jsf_pairs_range_and_resync(spark, tmp_path, pings):
    whole = jsf_bytes(pings)
    (tmp_path / "a.jsf").write_bytes(whole[:300] + whole[300:] + b"\x00" * 9)
    tr = lg.group_traces(lg.read_jsf(spark, str(tmp_path)))
    assert sorted((r.ping_id, r.channel) for r in tr.collect()) == [(i, c) for i in range(3) for c in (0, 1)]
    nav = lg.decode_nav(tr).orderBy("ping_id").first()
    assert nav.slant_range_m == pytest.approx(1500 * 20000e-9 * 5 / 2) and not nav.navigation_synthetic
    assert nav.latitude == pytest.approx((7800000 - 3) / 600000)


def test_group_traces_equals_fold(spark):
    channels = [0, 1, 0, 0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1]
    want, open_, ping = [], set(), -1
    for c in channels:
        if ping < 0 or c in open_:
            ping, open_ = ping + 1, set()
        open_.add(c)
        want.append(ping)
    df = spark.createDataFrame([("f", i, c) for i, c in enumerate(channels)], "path string, trace_no bigint, channel int")
    for chunk in (3, 4096):
        assert [r.ping_id for r in lg.group_traces(df, chunk).orderBy("trace_no").collect()] == want


def png(rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\x00" + bytes(r) for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_cells_and_inventory(spark, tmp_path):
    d = tmp_path / "train" / "images"
    d.mkdir(parents=True)
    (d / "a.png").write_bytes(png([[1, 2, 3], [4, 5, 250]]))
    (d / "b.png").write_bytes(b"not an image")
    cells, bad = fl.read_image_cells(spark, str(d))
    assert sorted((r.ping, r.col, r.v) for r in cells.collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 250)]
    assert [r.name for r in bad.collect()] == ["b.png"]
    inv = {r.name: r for r in fl.read_image_inventory(spark, str(tmp_path)).collect()}
    assert inv["a.png"].split == "train" and inv["b.png"].content_hash == hashlib.md5(b"not an image").hexdigest()


def test_yolo_labels(spark, tmp_path):
    d = tmp_path / "val" / "labels"
    d.mkdir(parents=True)
    (d / "x.txt").write_text("0 0.5 0.5 0.92 0.92\n1 a b\n")
    assert sorted((r.split, r.stem, r.line) for r in fl.read_yolo_labels(spark, str(tmp_path)).collect()) == [
        ("val", "x", "0 0.5 0.5 0.92 0.92"), ("val", "x", "1 a b")]


def test_eval_summaries(spark, tmp_path):
    for name, p in (("r1", 0.5), ("r2", 0.75)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "evaluation_summary.json").write_text(json.dumps({"imgsz": 832, "overall": {"precision": p, "map50": 0.4}, "per_class": {"mine": {"map50": 0.3}}}, indent=1))
    got = {r.experiment: r for r in tl.compare_experiments(tl.read_eval_summaries(spark, str(tmp_path))).collect()}
    assert got["r2"].precision_pct == 75.0 and got["r1"].mine_map50_pct == pytest.approx(30.0) and got["r1"].human_map50_pct == 0.0


def test_store_and_exports(spark, tmp_path):
    rows = [("s", 1, 2, 0.5, 13.0, 80.0, "can"), ("s", 0, 1, 0.7, None, None, "tire")]
    d = spark.createDataFrame(rows, "survey_id string, frame_id bigint, det_id bigint, conf double, latitude double, longitude double, class_name string")
    store = str(tmp_path / "store")
    for _ in range(2):
        ex.save_run(d, "s9", "r1", store)
    back = ex.load_detections(spark, store, survey_id="s9").collect()
    assert [(r.frame_id, r.run_id) for r in back] == [(0, "r1"), (1, "r1")]
    ex.export_geojson(d, str(tmp_path / "g"))
    feats = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert len(feats) == 1 and feats[0]["geometry"]["coordinates"] == [80.0, 13.0] and feats[0]["properties"]["det_id"] == 2
    assert ex.export_json(d, str(tmp_path / "j")) == 2
    ex.export_csv(d, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ex.CSV_COLUMNS


def test_jsf_file_versions(spark):
    df = spark.createDataFrame([("a", bytearray(b"x"), 1), ("b", bytearray(b""), 0)], "path string, content binary, length bigint")
    got = {r.path: r.version for r in ex.file_versions(df, "m").collect()}
    assert got == {"a": "m@" + hashlib.sha256(b"x").hexdigest()[:10], "b": "m@unavailable"}


def test_header_epoch_rejects_bad_fields(spark):
    df = spark.createDataFrame([(2024, 2, 30, 1, 1, 1, 0), (2024, 2, 29, 1, 1, 1, 50)], "year int, month int, day int, hour int, minute int, second int, hsecond int")
    assert [r.epoch_s for r in lg.header_epoch(df).orderBy("day").collect()] == [1709168461.5, None]


def test_group_traces_of_three_channels_equals_fold(spark):
    channels = [0, 1, 2, 0, 1, 2, 2, 0, 1, 0, 2, 1, 1, 2, 0, 0]
    want, open_, ping = [], set(), -1
    for c in channels:
        if ping < 0 or c in open_:
            ping, open_ = ping + 1, set()
        open_.add(c)
        want.append(ping)
    rows = [("three", i, c) for i, c in enumerate(channels)] + [("two", i, i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "path string, trace_no bigint, channel int")
    got = lg.group_traces(df, 4).orderBy("path", "trace_no").collect()
    assert [r.ping_id for r in got if r.path == "three"] == want
    assert [r.ping_id for r in got if r.path == "two"] == [0, 0, 1, 1, 2, 2]


def test_saving_an_empty_run_removes_the_survey(spark, tmp_path):
    store = str(tmp_path / "runs")
    d = spark.createDataFrame([(1, 5, 0), (2, 5, 1), (3, 6, 0)], "det_id bigint, survey_id bigint, frame_id bigint")
    ex.save_surveys(d.withColumn("run_id", F.lit("r0")), store)
    ex.save_run(d.filter("survey_id = 5").drop("survey_id"), 5, "r1", store)
    ex.save_run(d.filter("survey_id = 7").drop("survey_id"), 5, "r2", store)
    assert [(r.det_id, r.survey_id) for r in ex.load_detections(spark, store).collect()] == [(3, 6)]


@pytest.mark.parametrize("kind", ["xtf", "jsf"])
def test_byte_ranges_equal_a_walk_from_the_start(spark, tmp_path, kind):
    from sonarlake.sources import log_source as ls
    build, decode = (xtf_bytes, lg.decode_xtf_bytes) if kind == "xtf" else (jsf_bytes, lg.decode_jsf_bytes)
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"ping": range(60), "samples": [rng.integers(0, 256, 90).tolist() for _ in range(60)]})
    whole = build(rows)
    # sample bytes that look like two headers in a row, so that a range entered inside a record must be walked again
    head = struct.pack("<HBBHHHI", 0xFACE, 0, 0, 2, 0, 0, 20) + bytes(6) if kind == "xtf" else struct.pack("<HBBHBBBBHI", 0x1601, 0, 0, 80, 0, 20, 0, 0, 0, 4) + bytes(4)
    fake = rows.copy()
    fake["samples"] = [list((head * 5)[:90]) + [0] * max(0, 90 - 5 * len(head)) for _ in range(60)]
    cases = {"plain": whole, "short": whole[:-37], "noise": whole[:2500] + b"\xce\xfa\x01\x16" * 9 + whole[2500:], "fake": build(fake), "tiny": whole[:20], "empty": b"", "head": whole[:1024]}
    for name, data in cases.items():
        (tmp_path / f"{name}.{kind}").write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / f"deep.{kind}").write_bytes(whole)
    number = "ping_id" if kind == "xtf" else "trace_no"
    want = sorted((f"/{n}.{kind}", r[number], r["channel"], r["samples"].tolist()) for n, data in [*cases.items(), ("deep", whole)] for r in decode(n, data))
    for size in (700, 5000, 1 << 20):
        rows_ = ls.read_ranges(spark, str(tmp_path), kind, number, size / (1 << 20))
        got = sorted(("/" + r.path.split("/")[-1], r[number], r.channel, list(r.samples)) for r in rows_.collect())
        assert got == want
    assert spark.read.format("sonarlog").options(kind=kind, range_mb=str(700 / (1 << 20))).load(str(tmp_path)).rdd.getNumPartitions() > 100


def test_log_stream_reads_new_files(spark, tmp_path, pings):
    from sonarlake.sources.log_source import SonarLog
    spark.dataSource.register(SonarLog)
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"log-{k}.xtf").write_bytes(xtf_bytes(pings))
        stream = spark.readStream.format("sonarlog").options(kind="xtf", range_mb="0.001").load(str(tmp_path / "in"))
        q = stream.select("path", "range_no", "seq", "channel", "samples").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * len(pings) * (k + 1)
