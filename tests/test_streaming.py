import pytest
from pyspark.sql import functions as F

from sonarlake.operators import tracking as tr
from sonarlake.streaming import streams as st
from tests.test_operators import scene


def test_late_rows_are_dropped(spark, tmp_path):
    cols = "survey_id bigint, ping_id bigint, secs bigint"
    src, n = str(tmp_path / "in"), {"altitude_m": 10.0, "slant_range_m": 75.0, "pitch_deg": 0.0, "roll_deg": 0.0, "heave_m": 0.0, "speed_knots": 3.5}

    def put(rows):
        df = spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_seconds("secs")).withColumns({k: F.lit(v) for k, v in n.items()}).drop("secs")
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        st.drain(st.stream_scqi(stream, "10 seconds", None, "5 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))

    put([(1, 0, 100), (1, 1, 104), (1, 2, 130)])
    put([(1, 3, 101), (1, 4, 160)])
    got = {r.start.timestamp(): r.n_pings for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[k] for k in sorted(got)] == [2, 1]


def test_save_replaces_surveys_and_replays_once(spark, tmp_path):
    from sonarlake.sources import survey_store as store
    df = spark.range(20).select((F.col("id") % 3).alias("survey_id"), F.col("id").alias("det_id"), F.lit("known").alias("detection_type"))
    path, src = str(tmp_path / "store"), str(tmp_path / "in")

    def send(part, run, checkpoint, name="a"):
        part.withColumn("run_id", F.lit(run)).coalesce(1).write.mode("append").parquet(src)
        schema = part.withColumn("run_id", F.lit("")).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        store.stream_save(stream, path, str(tmp_path / checkpoint), name, once=True).awaitTermination()
        return {(r.survey_id, r.det_id, r.run_id) for r in store.detections(spark, path).collect()}

    first = {(i % 3, i, "r1") for i in range(20)}
    assert send(df, "r1", "cp") == first
    second = {x for x in first if x[0] != 1} | {(1, 1, "r2"), (1, 4, "r2")}
    assert send(df.filter("survey_id = 1 and det_id < 5"), "r2", "cp") == second  # a survey sent twice is stored once
    assert send(df.limit(0), "r3", "lost") == second  # all files again from a lost checkpoint: batches 0 and 1 are known
    assert {r.run_id for r in store.surveys(spark, path).collect()} == {"r1", "r2"}
    heads = spark.createDataFrame([(2, "r9", 80.0), (2, "r8", 70.0)], "survey_id int, run_id string, scqi double")
    store.save(heads, df.limit(0), path)
    assert {x[0] for x in {(r.survey_id,) for r in store.detections(spark, path).collect()}} == {0, 1}
    top = store.surveys(spark, path).first()
    assert (top.survey_id, top.run_id, top.n_detections, top.scqi) == (2, "r9", 0, 80.0)
    assert store.detections(spark, path, survey_id=1, run_id="r2", detection_type="known").count() == 2
    with pytest.raises(ValueError):
        store.save(heads, df, path)
    gone = []
    assert store.remove_superseded(spark, path, gone.append) == [] and gone == []


@pytest.fixture
def keyed_state(spark):
    from sonarlake.streaming.trajectory import STORE
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    yield
    spark.conf.set(STORE[0], before)


def test_trajectory_keeps_the_last_ping_over_batches_gaps_and_late_rows(spark, tmp_path, keyed_state):
    from sonarlake.operators.pings import trajectory_steps
    from sonarlake.streaming.trajectory import stream_trajectory
    cols = "survey_id bigint, ping_id bigint, t_s double, latitude double, longitude double"
    rows = [(s, i, 1000.0 + 10 * i + (200_000 if i > 60 else 0) - (25 if i % 11 == 0 else 0), 13 + i * 1e-4 + (i % 17 == 0), 80.0 + s)
            for s in (1, 2) for i in range(120) if i % 5 != 2 and not 20 <= i < 41]
    rows.append((3, 7, 1500.0, 1.0, 1.0))  # a survey of one ping
    cut = [[r for r in rows if r[1] < 50], [r for r in rows if 50 <= r[1] < 70], [r for r in rows if r[1] >= 70]]
    moved = [r for r in cut[0] if r[1] in (43, 48)]  # arrive one batch later, before the watermark passes them
    late = (1, 3, 1031.0, 0.0, 0.0)  # arrives long after
    src = str(tmp_path / "in")
    for part in ([r for r in cut[0] if r not in moved], cut[1] + moved, [*cut[2], late], [(9, 0, 900_000.0, 0.0, 0.0)]):
        df = spark.createDataFrame(part, cols).withColumn("ts", F.timestamp_millis((F.col("t_s") * 1000).cast("bigint")))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        st.drain(stream_trajectory(stream, delay="2 minutes", leg=8), str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ["survey_id", "ping_id", "dt_s", "speed_knots", "non_monotonic", "teleport"]
    want = trajectory_steps(spark.createDataFrame(rows, cols), chunk=16).select(columns)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_tracks_equal_batch_with_frames_in_pieces(spark, tmp_path, keyed_state):
    from sonarlake.streaming.tracks import stream_track
    cols = "survey_id bigint, frame_id bigint, det_id bigint, x double, y double, class_name string"
    df = spark.createDataFrame(scene(), cols).withColumn("ts", F.timestamp_seconds(F.col("frame_id") * 10 + 1000))
    last = spark.createDataFrame([(s, 1000, 9000 + s, 0.0, 0.0, "can") for s in (1, 2)], cols).withColumn("ts", F.timestamp_seconds(F.lit(100_000)))
    src = str(tmp_path / "in")
    early = "(frame_id < 9 or (frame_id between 9 and 11 and det_id % 2 = 0))"
    for part in (df.filter(early), df.filter(f"not {early} and frame_id < 33"), df.filter(f"not {early} and frame_id >= 33"), last):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        st.drain(stream_track(stream, delay="60 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.det_id: (r.track_id, r.hits) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.det_id: (r.track_id, r.hits) for r in tr.track(df).collect()}
