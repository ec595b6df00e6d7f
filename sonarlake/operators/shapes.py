"""Shape measures of mask regions and the gate that rejects implausible ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.functions.contour import convex_hull, outline, perimeter, polygon_area
from sonarlake.operators.cfar import KEY


def hull_stats(runs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Outline area, hull area and perimeter per region of labelled runs (``label_regions``), of any size.

    A region lies within one image, so the runs of a group are at most those of an image.
    """
    region = F.struct(F.col("region.ping").alias("p"), F.col("region.c0").alias("c"))
    flat = runs.select(*keys, region.alias("_r"), "ping", "c0", "c1")
    size = flat.groupBy(*keys, "_r").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("pixels"))
    small = flat.join(size, [*keys, "_r"]).select(
        *keys, F.col("_r.p").cast("bigint").alias("first_ping"), F.col("_r.c").cast("bigint").alias("first_col"), "ping", "c0", "c1", "pixels")
    group = [*keys, "first_ping", "first_col"]
    kinds = {f.name: f.dataType.simpleString() for f in small.schema.fields}

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = np.concatenate([np.arange(a, b + 1) for a, b in zip(pdf["c0"], pdf["c1"])])
        rows = np.repeat(pdf["ping"].to_numpy(), (pdf["c1"] - pdf["c0"] + 1).to_numpy())
        edge = outline(rows, cols)
        hull = convex_hull(edge)
        head = {k: pdf[k].iloc[0] for k in group}
        return pd.DataFrame([{**head, "pixels": int(pdf["pixels"].iloc[0]), "area": int(polygon_area(edge)) if len(edge) > 2 else 0,
                              "hull_area": polygon_area(hull) if len(hull) > 2 else 0.0, "perimeter": perimeter(edge),
                              "box_w": int(cols.max() - cols.min() + 1), "box_h": int(rows.max() - rows.min() + 1)}])

    schema = ", ".join(f"{k} {kinds[k]}" for k in group) + ", pixels bigint, area bigint, hull_area double, perimeter double, box_w bigint, box_h bigint"
    return small.groupBy(*group).applyInPandas(measure, schema)


def shape_gate(stats: DataFrame) -> DataFrame:
    """Aspect, extent, solidity and compactness with the verdict and its reason; the area test comes first."""
    one = F.lit(1.0)
    out = stats.withColumns({
        "aspect_ratio": F.round(F.col("box_w") / F.greatest(one, F.col("box_h")), 3), "extent": F.round(F.col("area") / F.greatest(one, F.col("box_w") * F.col("box_h")), 3),
        "solidity": F.round(F.col("area") / F.greatest(one, F.col("hull_area")), 3),
        "compactness": F.round(4.0 * np.pi * F.col("area") / F.greatest(one, F.col("perimeter") * F.col("perimeter")), 3)})
    tiny = F.col("area") < 10
    out = out.withColumns({"aspect_ratio": F.when(tiny, 1.0).otherwise(F.col("aspect_ratio"))} | {
        c: F.when(tiny, 0.0).otherwise(F.col(c)) for c in ("extent", "solidity", "compactness")})
    stretched = (F.col("aspect_ratio") > 7.5) | (F.col("aspect_ratio") < 0.13)
    porous = F.col("solidity") < 0.18
    return out.withColumns({
        "is_valid_debris": ~(tiny | stretched | porous),
        "rejection_reason": F.when(tiny, "Area too small (< 10 px)")
        .when(stretched, F.format_string("Aspect ratio anomaly (AR=%.2f, likely sonar scanline stripe)", "aspect_ratio"))
        .when(porous, F.format_string("Low solidity / diffuse reverberation (solidity=%.2f)", "solidity")).otherwise("Valid geometry")})
