"""Detection sinks and stores: CSV, JSON, GeoJSON, SQL text, survey tables, missions, run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sonarlake.plans.ordered import dense_index

# Column order of the detection export.
CSV_COLUMNS = ["survey_id", "run_id", "frame_id", "timestamp", "class_name", "detection_type", "confidence", "x1", "y1", "x2", "y2", "mask_area_px",
               "anomaly_score", "reconstruction_error", "track_id", "latitude", "longitude", "positional_uncertainty_m", "snr_db", "scqi",
               "model_version", "config_hash"]
TEXT_COLUMNS = ["survey_id", "run_id", "class_name", "detection_type", "model_version", "config_hash"]
CRS84 = "urn:ogc:def:crs:OGC:1.3:CRS84"


def _or(df: DataFrame, name: str, default) -> Column:
    if name not in df.columns:
        return F.lit(default)
    return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))


def csv_rows(df: DataFrame) -> DataFrame:
    """The 22 export columns: the box exploded, model_version as JSON with sorted keys, absent columns null."""
    version = F.lit(None).cast("string")
    if "model_version" in df.columns:
        kind = df.schema["model_version"].dataType.typeName()
        version = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("model_version")))) if kind == "map" else F.col("model_version")
    box = {n: F.get("bbox", F.lit(i)) if "bbox" in df.columns else _or(df, n, None) for i, n in enumerate(("x1", "y1", "x2", "y2"))}
    picked = {c: box[c] if c in box else version if c == "model_version" else _or(df, c, None) for c in CSV_COLUMNS}
    known = {*df.columns, "model_version", *(box if "bbox" in df.columns else ())}
    return df.select(*[(v if c in known else v.cast("string" if c in TEXT_COLUMNS else "double")).alias(c) for c, v in picked.items()])


def export_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.mode("overwrite").csv(path, header=True)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def export_json(df: DataFrame, path: str) -> int:
    """One JSON record per line plus ``<path>_summary`` with the count; returns the count."""
    seen = Observation()
    json_rows(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    n = seen.get["n"]
    df.sparkSession.range(1).select(F.to_json(F.struct(F.lit(n).alias("count"))).alias("value")).write.mode("overwrite").text(path.rstrip("/") + "_summary")
    return n


def geojson_features(df: DataFrame) -> DataFrame:
    """One GeoJSON point feature per located record, the other columns as properties."""
    props = [c for c in df.columns if c not in ("latitude", "longitude")]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
                       F.struct(*props).alias("properties"))
    return df.filter("latitude is not null and longitude is not null").select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def export_geojson(df: DataFrame, path: str) -> None:
    """Newline-delimited features in CRS84, written in parallel; ``<path>_collection`` holds the collection header."""
    geojson_features(df).write.mode("overwrite").text(path)
    head = F.struct(F.lit("FeatureCollection").alias("type"), F.struct(F.lit("name").alias("type"), F.struct(F.lit(CRS84).alias("name")).alias("properties")).alias("crs"))
    df.sparkSession.range(1).select(F.to_json(head).alias("value")).write.mode("overwrite").text(path.rstrip("/") + "_collection")


def _numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ids count all records in order; records without a position use up their number but are left out."""
    return dense_index(df, [], order, "_no", start=1).filter("latitude is not null and longitude is not null")


def survey_features(df: DataFrame, order: Sequence[str], source: str = "survey") -> DataFrame:
    n = _numbered(df, order)
    props = F.struct(F.col("_no").alias("id"), _or(df, "class_name", "Target").alias("class_name"), _or(df, "conf", 0.0).alias("confidence"),
                     _or(df, "uncertainty_flag", "LOW").alias("uncertainty_flag"), _or(df, "uncertainty_variance", 0.0).alias("uncertainty_variance"),
                     _or(df, "error_ellipse_a", 0.0).alias("error_ellipse_a_m"), _or(df, "error_ellipse_b", 0.0).alias("error_ellipse_b_m"),
                     _or(df, "ground_range_m", 0.0).alias("ground_range_m"), _or(df, "channel", "Port").alias("channel"), _or(df, "source", source).alias("source"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return n.select(F.col("_no").alias("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("value"))


def survey_csv_rows(df: DataFrame, order: Sequence[str], source: str = "survey") -> DataFrame:
    """Survey report lines with fixed decimals; class and source are quoted."""
    n = _numbered(df, order)
    f = lambda fmt, c: F.format_string(fmt, c)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat_ws(",", F.col("_no").cast("string"), quoted(_or(df, "class_name", "Target")), f("%.3f", _or(df, "conf", 0.0)), _or(df, "uncertainty_flag", "LOW"),
                       f("%.6f", F.col("latitude")), f("%.6f", F.col("longitude")), f("%.2f", _or(df, "ground_range_m", 0.0)), _or(df, "channel", "Port"),
                       f("%.2f", _or(df, "error_ellipse_a", 0.0)), f("%.2f", _or(df, "error_ellipse_b", 0.0)), quoted(_or(df, "source", source)))
    return n.select(F.col("_no").alias("id"), line.alias("value"))


def export_survey(df: DataFrame, path: str, order: Sequence[str], form: str = "geojson", source: str = "survey") -> None:
    rows = survey_features(df, order, source) if form == "geojson" else survey_csv_rows(df, order, source)
    rows.select("value").write.mode("overwrite").text(path)


def sql_dump_rows(df: DataFrame, mission: str = "mission_default") -> DataFrame:
    """One INSERT statement per located row; quotes in class names are doubled."""
    f = lambda fmt, c: F.format_string(fmt, c)
    text = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    conf = _or(df, "conf", 0.0)
    fused = F.coalesce(F.col("fused_confidence"), conf) if "fused_confidence" in df.columns else conf
    values = F.concat_ws(", ", text(F.lit(mission)), text(F.replace(_or(df, "class_name", "Target"), F.lit("'"), F.lit("''"))), f("%.3f", conf), f("%.3f", fused),
                         text(_or(df, "uncertainty_flag", "LOW")), f("%.4f", _or(df, "uncertainty_variance", 0.0)), f("%.2f", _or(df, "ground_range_m", 0.0)),
                         text(_or(df, "channel", "Port")), f("%.2f", _or(df, "error_ellipse_a", 5.0)), f("%.2f", _or(df, "error_ellipse_b", 5.0)),
                         f("%.1f", _or(df, "error_ellipse_phi", 0.0)),
                         F.concat(F.lit("ST_SetSRID(ST_MakePoint("), f("%.6f", F.col("longitude")), F.lit(", "), f("%.6f", F.col("latitude")), F.lit("), 4326)")))
    head = ("INSERT INTO marine_debris_detections (mission_id, class_name, confidence, fused_confidence, uncertainty_flag, uncertainty_variance, "
            "ground_range_m, channel, error_ellipse_a, error_ellipse_b, error_ellipse_phi, geom) VALUES (")
    return df.filter("latitude is not null and longitude is not null").select(F.concat(F.lit(head), values, F.lit(");")).alias("value"))


def export_sql_dump(df: DataFrame, path: str, mission: str = "mission_default") -> None:
    sql_dump_rows(df, mission).write.mode("overwrite").text(path)


# ---- stores -----------------------------------------------------------------------------------------------------------------

def save_run(detections: DataFrame, survey_id, run_id: str, path: str) -> None:
    """Replace the rows of one survey; survey and run ids come from the header, whatever the records say."""
    stamped = detections.withColumns({"survey_id": F.lit(survey_id), "run_id": F.lit(run_id)})
    if stamped.isEmpty():  # dynamic overwrite touches only partitions that get rows
        drop_survey(detections.sparkSession, survey_id, path)
        return
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("survey_id").parquet(path)


def drop_survey(spark: SparkSession, survey_id, path: str) -> None:
    """Remove the stored rows of one survey."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/survey_id={survey_id}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def save_surveys(detections: DataFrame, path: str) -> None:
    """Replace the rows of every survey present in ``detections`` in one job; other surveys stay."""
    detections.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("survey_id").parquet(path)


def load_detections(spark: SparkSession, path: str, survey_id=None, run_id=None, detection_type=None, ordered: bool = True) -> DataFrame:
    """Stored detections, optionally filtered (survey prunes partitions) and ordered by frame, then id."""
    df = spark.read.parquet(path)
    for name, value in (("survey_id", survey_id), ("run_id", run_id), ("detection_type", detection_type)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df.orderBy("frame_id", "det_id") if ordered else df


def upsert_missions(old: DataFrame, new: DataFrame, mode: str = "replace", key: str = "mission_id") -> DataFrame:
    """``replace``: new rows win; ``ignore``: only missions not stored yet are added. ``new`` holds one row per mission."""
    if mode == "replace":
        return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    if mode == "ignore":
        return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)
    raise ValueError("mode is 'replace' or 'ignore'")


def mission_detection_rows(dets: DataFrame, mission_id: Column | str = "mission_default") -> DataFrame:
    """Rows of the mission store with field defaults."""
    d = {"class_name": "Target", "conf": 0.0, "uncertainty_flag": "LOW", "uncertainty_variance": 0.0, "latitude": 0.0, "longitude": 0.0, "ground_range_m": 0.0,
         "channel": "Port", "error_ellipse_a": 0.0, "error_ellipse_b": 0.0, "error_ellipse_phi": 0.0}
    mid = F.lit(mission_id) if isinstance(mission_id, str) else mission_id
    return dets.select(mid.alias("mission_id"), *[F.col(c) for c in ("det_id",) if c in dets.columns],
                       *[_or(dets, c, v).alias("confidence" if c == "conf" else c) for c, v in d.items()], F.lit("UNREVIEWED").alias("reviewed_status"))


def save_mission_detections(dets: DataFrame, path: str, mission_id: Column | str = "mission_default") -> None:
    mission_detection_rows(dets, mission_id).write.mode("append").partitionBy("mission_id").parquet(path)


def recount_missions(missions: DataFrame, stored: DataFrame) -> DataFrame:
    n = stored.groupBy("mission_id").agg(F.count(F.lit(1)).alias("total_detections"))
    return missions.drop("total_detections").join(n, "mission_id", "left").na.fill(0, ["total_detections"])


def write_run_log(df: DataFrame, path: str) -> None:
    """Stage records as JSON lines, one folder per run."""
    df.write.mode("append").partitionBy("run_id").json(path)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    schema = "stage string, started double, seconds double, ok boolean, error string, summary map<string,string>, run_id string"
    return spark.read.schema(schema).json(path)


def file_versions(files: DataFrame, label: str) -> DataFrame:
    """``label@<first ten hex digits of the content hash>`` per file of a binary-file table; empty files are unavailable."""
    v = F.when(F.col("length") > 0, F.concat(F.lit(label + "@"), F.substring(F.sha2("content", 256), 1, 10))).otherwise(F.lit(label + "@unavailable"))
    return files.select("path", v.alias("version"))
