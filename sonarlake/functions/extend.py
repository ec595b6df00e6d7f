"""Extension surface: SQL functions, user scorers, and log decoding as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

SQL_FUNCTIONS = {
    "haversine_m": ("lat1 double, lon1 double, lat2 double, lon2 double",
                    "6371000D * 2 * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)), "
                    "sqrt(greatest(0D, 1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))"),
    "ground_range_m": ("slant double, altitude double", "sqrt(greatest(0D, slant * slant - altitude * altitude))"),
    "box_iou": ("ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double",
                "coalesce(try_divide(greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)), "
                "(ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1))), 0D)"),
    "error_score": ("err double, threshold double", "case when err > 0 and threshold > 0 then 1 / (1 + pow(threshold / err, 3)) else 0D end"),
    "cfar_score": ("contrast double", "least(1D, greatest(0D, (contrast - 1) / 3))"),
    "snr_score": ("snr_db double", "least(1D, greatest(0D, (snr_db - 3) / 17))"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for SQL text. They are inlined by the optimizer; no Python runs per row."""
    for name, (params, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({params}) returns double return {body}")
    return list(SQL_FUNCTIONS)


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """Run a user's batch scorer over Arrow batches; ``schema`` names the columns it returns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield scorer(pdf)

    return df.mapInPandas(run, schema)


@udtf(returnType="ping_id bigint, channel int, latitude double, longitude double, heading_deg double, slant_range_m double, samples array<int>")
class DecodeXtf:
    """``decode_xtf(path, content)``: trace rows of one XTF file's bytes, for use in SQL with LATERAL."""

    def eval(self, path: str, content: bytes):
        from sonarlake.sources.logs import decode_xtf_bytes

        for row in decode_xtf_bytes(path, bytes(content)):
            yield (row["ping_id"], row["channel"], float(row["latitude"]), float(row["longitude"]), float(row["heading_deg"]), float(row["slant_range_m"]),
                   [int(v) for v in row["samples"]])


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("decode_xtf", DecodeXtf)
