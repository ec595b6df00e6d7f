"""Structured Streaming versions of ping checks, survey quality, sessions and the review feed.

Ping streams carry the batch columns plus ``ts`` (timestamp). Every operator agrees with its batch twin on data that is
not later than the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sonarlake.operators.detections import uncertainty_flag
from sonarlake.operators.pings import validate_pings
from sonarlake.operators.quality import scqi
from sonarlake.operators.review import enqueue
from sonarlake.sources import telemetry as tl


def read_pings(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """Telemetry files arriving in a folder, aliases and defaults resolved, checked record by record."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        raw = reader.schema(tl.json_schema() + ", survey_id bigint, ping_id bigint").json(path)
        cols = tl._resolve(raw, tl.JSON_ALIASES, [f for f in tl.FIELDS if f != "heave_m"])
    else:
        names = [n for f in tl.CSV_READ for n in [f, *tl.CSV_ALIASES.get(f, [])]]
        raw = reader.option("header", True).schema(", ".join(f"{n} string" for n in ["survey_id", "ping_id", *names])).csv(path)
        cols = tl._resolve(raw, tl.CSV_ALIASES, tl.CSV_READ)
    return validate_pings(raw.select(F.col("survey_id").cast("bigint"), F.col("ping_id").cast("bigint"), *cols))


def stream_scqi(pings: DataFrame, length: str = "96 seconds", slide: str | None = "48 seconds", delay: str = "10 minutes") -> DataFrame:
    """Survey quality per window from the window's first ping (``slide`` None = tumbling); late rows are dropped."""
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    first = F.min_by(F.struct("altitude_m", "slant_range_m", "pitch_deg", "roll_deg", "heave_m", "speed_knots"), F.struct("ts", "ping_id"))
    agg = pings.withWatermark("ts", delay).groupBy("survey_id", win.alias("w")).agg(first.alias("_f"), F.count(F.lit(1)).alias("n_pings"))
    flat = agg.select("survey_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_pings", "_f.*", F.lit(None).cast("double").alias("snr_db"),
                      F.lit(None).cast("boolean").alias("snr_valid"), F.lit(None).cast("double").alias("p10"), F.lit(None).cast("double").alias("p90"))
    return scqi(flat).select("survey_id", "start", "end", "n_pings", "scqi_raw", "scqi", "grade", "resurvey_recommended")


def stream_dedup(pings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First copy of each ping within the watermark."""
    return pings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["survey_id", "ping_id"])


def stream_legs(pings: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Survey legs: sessions of pings closed by a silence of ``gap``."""
    return (pings.withWatermark("ts", delay).groupBy("survey_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_pings"), F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s"))
            .select("survey_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_pings", "first_s", "last_s"))


# ---- sinks ----------------------------------------------------------------------------------------------------------------

def _append_once(path: str, partitions: list[str]):
    """Each micro-batch owns a partition named after it, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", *partitions).parquet(path))

    return write


def stream_review(dets: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Feed highly uncertain detections to the review queue table."""
    high = uncertainty_flag(dets).filter("uncertainty_flag = 'HIGH'")
    w = enqueue(high).writeStream.option("checkpointLocation", checkpoint).foreachBatch(_append_once(path, []))
    return (w.trigger(availableNow=True) if once else w).start()


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into Parquet files and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
