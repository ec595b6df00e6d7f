"""Telemetry and tabular file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Record fields with aliases and defaults (null = time of reading).
FIELDS: dict[str, tuple[list[str], float | None]] = {
    "timestamp": ([], None), "latitude": (["lat"], 0.0), "longitude": (["lon"], 0.0), "heading_deg": (["heading"], 0.0), "depth_m": (["depth"], 15.0),
    "altitude_m": (["altitude"], 10.0), "slant_range_m": (["slant_range", "range"], 75.0), "frequency_khz": ([], 450.0), "beamwidth_deg": ([], 0.5),
    "vessel_speed_knots": ([], 3.5), "layback_m": ([], 25.0), "pitch_deg": ([], 0.0), "roll_deg": ([], 0.0), "heave_m": ([], 0.0),
}
JSON_ALIASES = {"heading_deg": ["heading"], "depth_m": ["depth"], "altitude_m": ["altitude"], "slant_range_m": ["slant_range"]}
CSV_ALIASES = {"latitude": ["lat"], "longitude": ["lon"], "heading_deg": ["heading"], "depth_m": ["depth"], "altitude_m": ["altitude"], "slant_range_m": ["range"]}
CSV_READ = ["timestamp", "latitude", "longitude", "heading_deg", "depth_m", "altitude_m", "slant_range_m"]


def _resolve(df: DataFrame, aliases: dict[str, list[str]], readable: list[str]) -> list[Column]:
    out = []
    for name, (_, default) in FIELDS.items():
        found = [F.col(f"`{c}`").try_cast("double") for c in [name, *aliases.get(name, [])] if c in df.columns] if name in readable else []
        last = F.unix_micros(F.current_timestamp()) / 1e6 if default is None else F.lit(default)
        out.append(F.coalesce(*found, last).alias(name))
    return out


def json_schema() -> str:
    names = [n for f in FIELDS for n in [f, *JSON_ALIASES.get(f, [])]]
    return ", ".join(f"{n} double" for n in names)


def read_telemetry_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON telemetry (one object or an array per file), aliases and defaults resolved. Heave is not read from JSON."""
    df = spark.read.schema(json_schema()).option("multiLine", True).json(path)
    return df.select(*_resolve(df, JSON_ALIASES, [f for f in FIELDS if f != "heave_m"]), F.col("_metadata.file_path").alias("source_file"))


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TXT telemetry with a header; the other fields take their defaults."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*_resolve(df, CSV_ALIASES, CSV_READ), F.col("_metadata.file_path").alias("source_file"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Training results CSV: blanks around headers removed, box-loss and metric columns found by pattern."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    wanted = {"train_box_loss": ("train", "box_loss"), "val_box_loss": ("val", "box_loss"), "map50": ("metrics", "mAP50(B)"), "map50_95": ("metrics", "mAP50-95(B)"),
              "precision": ("metrics", "precision"), "recall": ("metrics", "recall")}
    picks = [F.col("epoch").try_cast("bigint").alias("epoch")]
    for name, (a, b) in wanted.items():
        hit = next((c for c in df.columns if a in c and b in c), None)
        picks.append((F.col(f"`{hit}`").try_cast("double") if hit else F.lit(None).cast("double")).alias(name))
    return df.select(*picks)


def read_eval_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation summaries found under a folder, with the run named after the file's folder."""
    metrics = "struct<precision:double,recall:double,map50:double,map50_95:double,inference_speed_ms:double,fps:double>"
    schema = f"imgsz int, conf_threshold double, overall {metrics}, per_class map<string,struct<precision:double,recall:double,map50:double,map50_95:double>>"
    df = (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", "evaluation_summary.json").json(path))
    return df.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def compare_experiments(summaries: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """One row per run with overall metrics in percent and one AP column per class."""
    names = classes if classes is not None else ["shipwreck", "airplane", "mine", "human"]
    pct = lambda c: F.coalesce(c, F.lit(0.0)) * 100
    o = lambda n: F.col(f"overall.{n}")
    return summaries.select(
        F.col("run").alias("experiment"), F.coalesce("imgsz", F.lit(640)).alias("resolution"), F.coalesce("conf_threshold", F.lit(0.25)).alias("conf"),
        pct(o("precision")).alias("precision_pct"), pct(o("recall")).alias("recall_pct"), pct(o("map50")).alias("map50_pct"), pct(o("map50_95")).alias("map50_95_pct"),
        F.coalesce(o("inference_speed_ms"), F.lit(0.0)).alias("latency_ms"), F.coalesce(o("fps"), F.lit(0.0)).alias("fps"),
        *[pct(F.try_element_at("per_class", F.lit(n))["map50"]).alias(f"{n}_map50_pct") for n in names])


def pivot_class_metrics(long: DataFrame, classes: list[str], value: str = "map50") -> DataFrame:
    """Long (experiment, class_name, value) to one row per experiment."""
    return long.groupBy("experiment").pivot("class_name", classes).agg(F.first(value))
