"""Survey store: a header row and detections per survey, replaced as a whole and never half seen.

Every save writes its detections under a new version and then, as its commit, the headers of its surveys with that version:

* ``detections/version=7/survey_id=3/...``: rows of one save; written once, never changed;
* ``surveys/version=7/...``: header rows (survey_id, run_id, source_file, scqi, snr_db, config_hash, model_version, created_at,
  n_detections) and, for saves of a stream, the stream's name and batch number.

A survey's current version is the highest among its headers, so readers see the state before or after a save, and a save
that died before its commit leaves nothing that is read; the next one takes the same version and overwrites it. A replayed
micro-batch finds its own headers and writes nothing. One writer per store at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

HEADER = {"run_id": "string", "source_file": "string", "scqi": "double", "snr_db": "double", "config_hash": "string", "model_version": "map<string,string>"}
COMMIT = "survey_id bigint, " + ", ".join(f"{k} {v}" for k, v in HEADER.items()) + ", created_at timestamp, n_detections bigint, stream string, batch_id bigint, version bigint"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """All commits ever made, one row per saved survey."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/surveys")
    except Exception as e:  # noqa: BLE001 - the error class differs between classic and Connect sessions
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], COMMIT)


def surveys(spark: SparkSession, path: str) -> DataFrame:
    """The current header of every survey, newest first."""
    latest = headers(spark, path).groupBy("survey_id").agg(F.max(F.col("version")).alias("version"))
    current = headers(spark, path).join(latest, ["survey_id", "version"])
    return current.select("survey_id", *HEADER, "created_at", "n_detections", "version").orderBy(F.desc("created_at"), F.desc("version"), "survey_id")


def detections(spark: SparkSession, path: str, survey_id: int | None = None, run_id: str | None = None, detection_type: str | None = None) -> DataFrame:
    """Current detections with their survey's run; versions and surveys prune partitions."""
    current = surveys(spark, path).select("survey_id", "version", "run_id")
    for name, value in (("survey_id", survey_id), ("run_id", run_id)):
        if value is not None:
            current = current.filter(F.col(name) == value)
    if headers(spark, path).isEmpty():
        raise ValueError(f"no survey is stored at {path}")
    rows = spark.read.parquet(f"{path}/detections")
    rows = rows.withColumns({"survey_id": F.col("survey_id").cast("bigint"), "version": F.col("version").cast("bigint")})
    if survey_id is not None:
        rows = rows.filter(F.col("survey_id") == survey_id)
    rows = rows.drop("run_id").join(current, ["survey_id", "version"]).drop("version")
    return rows.filter(F.col("detection_type") == detection_type) if detection_type is not None else rows


def _value(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def save(survey_rows: DataFrame, dets: DataFrame, path: str, stream: str | None = None, batch_id: int | None = None) -> int:
    """Replace every survey of ``survey_rows`` (survey_id and any header columns) by its rows in ``dets``; returns the version.

    Rows of surveys without a header row are refused; a survey without rows is stored as empty. Survey and run of a row are
    those of the header, whatever columns of that name the rows hold. Repeated header rows of a survey count once (the
    largest). Nothing is stored for an empty ``survey_rows``.
    """
    spark = dets.sparkSession
    known = headers(spark, path)
    if stream is not None:
        done = known.filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).agg(F.max("version")).first()[0]
        if done is not None:
            return done
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    head = survey_rows.select(F.col("survey_id").cast("bigint").alias("survey_id"), *[_value(survey_rows, c, k).alias(c) for c, k in HEADER.items()])
    sortable = [c for c in HEADER if c != "model_version"]
    head = head.groupBy("survey_id").agg(F.max_by(F.struct(*HEADER), F.struct(*sortable)).alias("_h")).select("survey_id", "_h.*")
    rows = dets.withColumn("survey_id", F.col("survey_id").cast("bigint"))
    strange = rows.join(head, "survey_id", "left_anti")
    if not strange.isEmpty():
        raise ValueError("detections of a survey without a header")
    rows.drop("run_id", "version").write.mode("overwrite").partitionBy("survey_id").parquet(f"{path}/detections/version={version}")
    stored = spark.read.schema(rows.drop("run_id", "version").schema).option("basePath", f"{path}/detections/version={version}").parquet(f"{path}/detections/version={version}")
    counts = stored.groupBy("survey_id").agg(F.count(F.lit(1)).alias("n_detections"))
    commit = head.join(counts, "survey_id", "left").na.fill(0, ["n_detections"]).withColumns(
        {"created_at": F.current_timestamp(), "stream": F.lit(stream).cast("string"), "batch_id": F.lit(batch_id).cast("bigint")})
    commit.write.mode("overwrite").parquet(f"{path}/surveys/version={version}")
    return version


def stream_save(dets: DataFrame, path: str, checkpoint: str, name: str = "detections", once: bool = False) -> StreamingQuery:
    """Save a stream of detections: the surveys in a micro-batch replace their stored rows, also those of earlier batches.

    ``run_id`` and other header columns are taken from the rows where they have them. A micro-batch must hold whole surveys.
    A batch replayed after a crash is stored once; ``name`` tells streams into one store apart (a stream that starts anew
    with another checkpoint needs another name).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        held = [c for c in HEADER if c in batch.columns and c != "model_version"]
        save(batch.select("survey_id", *held).distinct(), batch, path, name, batch_id)

    w = dets.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w).start()


def remove_superseded(spark: SparkSession, path: str, delete) -> list[int]:
    """Versions none of whose surveys is current, each passed to ``delete(folder)`` (a file-system call of the caller's)."""
    all_ = headers(spark, path).select("version").distinct()
    live = surveys(spark, path).select("version").distinct()
    old = sorted(r.version for r in all_.join(live, "version", "left_anti").collect())
    for v in old:
        delete(f"{path}/detections/version={v}")
    return old
