"""Tables written to the cluster's shared checkpoint folder.

Iterative jobs and multi-pass orderings need a result that is computed once and survives the loss of an executor. They
write it as Parquet under ``spark.checkpoint.dir`` and read it back, which keeps column pruning and size statistics.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names; a fresh local one only when the session is local and names none."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def save_table(df: DataFrame, label: str = "step") -> tuple[DataFrame, str]:
    """Write ``df`` once and return the stored table with its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sonarlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    return save_table(df, label)[0]


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete a superseded table of this application."""
    if path is None or f"/sonarlake/{spark.sparkContext.applicationId}/" not in path:
        return
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
