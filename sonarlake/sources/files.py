"""Image and label file sources, and upload checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted input extensions and the largest accepted upload.
LOG_EXTENSIONS = [".xtf", ".jsf"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".bmp", ".webp"]
MAX_BYTES = 1024 * 1024 * 1024


def _suffix(path: str):
    return F.lower(F.concat(F.lit("."), F.regexp_extract(F.col(path), r"\.([^./]+)$", 1)))


def _name(path: str):
    return F.element_at(F.split(F.col(path), "/"), -1)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def check_inputs(files: DataFrame, max_bytes: int = MAX_BYTES, path: str = "path", length: str = "length") -> DataFrame:
    """Kind and verdict per file from its name and size alone (contents are not read)."""
    ext = _suffix(path)
    kind = F.when(ext.isin(LOG_EXTENSIONS), "sonar_log").when(ext.isin(IMAGE_EXTENSIONS), "image")
    problem = F.when(kind.isNull(), "unsupported extension").when(F.col(length) == 0, "empty file").when(F.col(length) > max_bytes, "file too large")
    return files.withColumns({"kind": kind, "problem": problem, "accepted": problem.isNull()})


def read_image_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``<split>/images`` with their content hash."""
    f = read_files(spark, path)
    parts = F.split("path", "/")
    rows = f.filter(_suffix("path").isin(IMAGE_EXTENSIONS)).select(
        "path", F.element_at(parts, -3).alias("split"), _name("path").alias("name"), F.regexp_replace(_name("path"), r"\.[^.]*$", "").alias("stem"),
        F.col("length").alias("size_bytes"), F.md5("content").alias("content_hash"))
    return rows


def read_yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label text files, one row per line, with split and stem from the file path."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select(F.element_at(parts, -3).alias("split"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("stem"), F.col("value").alias("line"))


def read_image_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Grey cells of decodable images (name, ping, col, v) and the names of those that are not.

    Colour images are weighted to grey; the image reader stores channels in blue-green-red order. An image's bytes are
    turned into its rows inside one Arrow step, so no row carries the image along.
    """
    img = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    bad = img.filter((F.col("height") <= 0) | F.col("height").isNull()).select(_name("origin").alias("name"))
    whole = img.filter("height > 0").select(_name("origin").alias("name"), "height", "width", "nChannels", "data")
    lines = whole.mapInArrow(_grey_lines, "name string, ping int, line array<int>")
    return lines.select("name", "ping", F.posexplode("line").alias("col", "v")), bad


def _grey_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, height, width, channels, data in zip(*(c.to_pylist() if k < 4 else c for k, c in enumerate(batch.columns))):
            pixels = np.frombuffer(data.as_buffer(), "u1", height * width * channels).reshape(height, width, channels)
            step = max(1, (1 << 20) // max(1, width))
            for at in range(0, height, step):
                part = pixels[at:at + step]
                if channels == 1:
                    grey = part[:, :, 0].astype("int32")
                else:
                    grey = np.floor(0.114 * part[:, :, 0] + 0.587 * part[:, :, 1] + 0.299 * part[:, :, 2] + 0.5).astype("int32")
                lines = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype="int32") * width), pa.array(grey.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part), dtype="int32")), lines], names=["name", "ping", "line"])


def write_files(df: DataFrame, folder: str, path: str = "path", content: str = "content") -> int:
    """Write every row's bytes as a file below ``folder`` (relative path in ``path``) and return their number.

    The folder must be reachable from every executor. A file appears whole or not at all, so a repeated task does no harm.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .log_source import file_system

        files, top = file_system(folder)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                target = f"{top}/{name}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                draft = f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(data.as_buffer() if data.is_valid else b"")
                files.move(draft, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    done = df.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "n bigint")
    return done.agg(F.sum("n")).first()[0] or 0
