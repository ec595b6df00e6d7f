"""Adaptive-threshold target candidates on waterfall cells, seabed regimes, and candidate regions.

``keys`` name the image a cell belongs to (a survey, or a survey and frame); ``ping`` counts rows from 0 inside it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sonarlake.operators.waterfall import histogram
from sonarlake.plans.durable import discard, durable, save_table
from sonarlake.plans.groups import first_member, map_groups, numbers, pairs_within, split_by_size
from sonarlake.plans.iterate import connected_components
from sonarlake.plans.ordered import with_chunks
from sonarlake.plans.spatial import BOX, box_pairs

CHUNK = 512
KEY = ("survey_id",)
# Regimes, their names and threshold factors.
NADIR, SAND, RIPPLE, ROCK = 0, 1, 2, 3
REGIME_NAMES = {NADIR: "Nadir Water Column", SAND: "Smooth Sand / Silt", RIPPLE: "Rippled Seabed", ROCK: "Rocky / High Clutter"}
REGIME_SCALE = {NADIR: 99.0, SAND: 1.45, RIPPLE: 1.85, ROCK: 2.30}


# ---- neighbourhood sums -----------------------------------------------------------------------------------------------

def _mirror(df: DataFrame, axis: str, size: str, reach: int) -> DataFrame:
    """Repeat the rows near both ends of ``axis`` outside it, reflected about the border cell (border not doubled)."""
    i, n = F.col(axis), F.col(size)
    low = F.when(i.between(1, reach), -i)
    high = F.when(i.between(n - 1 - reach, n - 2), 2 * (n - 1) - i)
    return df.withColumn("_at", F.explode(F.array_compact(F.array(i, low, high))))


def box_sums(cells: DataFrame, sums: Mapping[str, tuple[str, int]], keys: Sequence[str] = KEY, chunk: int = CHUNK) -> DataFrame:
    """Add ``name`` = sum of a column over the (2r+1) x (2r+1) square around each cell, reflected at the borders.

    ``sums`` maps name to (column, r). The square is split into a sum along the ping and a sum across pings, each taken
    as a difference of running totals. Rows are cut into ping chunks that repeat ``r`` neighbours, so a task holds one
    column strip of a chunk, never a whole survey. Radii must be smaller than the image.
    """
    reach = max(r for _, r in sums.values())
    size = cells.groupBy(*keys).agg((F.max("ping") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    base = cells.join(size, list(keys))

    along = Window.partitionBy(*keys, "ping").orderBy("_at")
    wide = _mirror(base, "col", "_w", reach)

    def differences(df: DataFrame, window, source: Mapping[str, str]) -> DataFrame:
        totals = df.withColumns({f"_t_{n}": F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, 0)) for n, c in source.items()})
        return totals.withColumns({
            n: F.lead(f"_t_{n}", sums[n][1]).over(window) - F.coalesce(F.lag(f"_t_{n}", sums[n][1] + 1).over(window), F.lit(0))
            for n in source}).drop(*[f"_t_{n}" for n in source])

    rows = differences(wide, along, {n: c for n, (c, _) in sums.items()}).filter(F.col("_at") == F.col("col")).drop("_at")
    tall = with_chunks(_mirror(rows, "ping", "_h", reach).withColumnRenamed("_at", "_row"), "_row", chunk, before=reach, after=reach)
    across = Window.partitionBy(*keys, "_chunk", "col").orderBy("_row")
    out = differences(tall, across, {n: n for n in sums})
    return out.filter(F.col("_own") & (F.col("_row") == F.col("ping"))).drop("_row", "_chunk", "_own", "_h", "_w")


def ring_mean(cells: DataFrame, guard: int = 4, ref: int = 14, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean level of the reference square without the guard square, at least 1."""
    n = (2 * ref + 1) ** 2 - (2 * guard + 1) ** 2
    summed = box_sums(cells, {"_ref": ("v", ref), "_guard": ("v", guard)}, keys)
    return summed.withColumn("background", F.greatest(F.lit(1.0), (F.col("_ref") - F.col("_guard")) / float(n))).drop("_ref", "_guard")


# ---- masks --------------------------------------------------------------------------------------------------------------

# Structuring elements as (row, column) offsets.
CROSS3 = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
ELLIPSE5 = [(-2, 0), (2, 0)] + [(r, c) for r in (-1, 0, 1) for c in (-2, -1, 0, 1, 2)]


def open_mask(mask: DataFrame, sizes: DataFrame, keys: Sequence[str] = KEY, element: Sequence[tuple[int, int]] = CROSS3) -> DataFrame:
    """Morphological opening of a sparse mask (keys, ping, col) with a symmetric element.

    Every set cell votes for the cells its element reaches; a cell survives when all its neighbours that lie inside the
    image voted. Cells outside the image do not count. ``sizes``: keys, h, w.
    """
    offsets = F.array(*[F.struct(F.lit(dp).alias("dp"), F.lit(dc).alias("dc")) for dp, dc in element])

    def spread(df: DataFrame) -> DataFrame:
        s = df.select(*keys, "ping", "col", F.explode(offsets).alias("_d"))
        return s.select(*keys, (F.col("ping") + F.col("_d.dp")).alias("ping"), (F.col("col") + F.col("_d.dc")).alias("col"))

    def inside(p: Column, c: Column) -> Column:
        return p.between(0, F.col("h") - 1) & c.between(0, F.col("w") - 1)

    p, c = F.col("ping"), F.col("col")
    expected = sum((inside(p + dp, c + dc).cast("int") for dp, dc in element), F.lit(0))
    votes = spread(mask).groupBy(*keys, "ping", "col").agg(F.count(F.lit(1)).alias("_n")).join(sizes, list(keys))
    eroded = votes.filter(inside(p, c) & (F.col("_n") == expected)).select(*keys, "ping", "col")
    return spread(eroded).distinct().join(sizes, list(keys)).filter(inside(p, c)).select(*keys, "ping", "col")


def image_sizes(cells: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return cells.groupBy(*keys).agg((F.max("ping") + 1).alias("h"), (F.max("col") + 1).alias("w"))


def os_cfar(cells: DataFrame, guard: int = 4, ref: int = 14, scaling: float = 1.65, keys: Sequence[str] = KEY, opened: bool = True) -> DataFrame:
    """Mask cells whose level exceeds the ring mean times the factor."""
    hit = ring_mean(cells, guard, ref, keys).filter(F.col("v") > F.col("background") * scaling).select(*keys, "ping", "col")
    return open_mask(hit, image_sizes(cells, keys), keys) if opened else hit


def regime_scale(regime: Column) -> Column:
    out = F.lit(1.65)
    for k, s in REGIME_SCALE.items():
        out = F.when(regime == k, F.lit(s)).otherwise(out)
    return out


def sa_cfar(cells: DataFrame, guard: int = 4, ref: int = 14, keys: Sequence[str] = KEY, opened: bool = True) -> DataFrame:
    """As ``os_cfar`` with a factor per seabed regime (column ``regime``); the water column never triggers."""
    hit = ring_mean(cells, guard, ref, keys).filter((F.col("regime") != NADIR) & (F.col("v") > F.col("background") * regime_scale(F.col("regime"))))
    hit = hit.select(*keys, "ping", "col")
    return open_mask(hit, image_sizes(cells, keys), keys) if opened else hit


def threshold_mask(cells: DataFrame, sensitivity: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Error-map mask: level above 255 (1 - 0.45 s)."""
    return cells.filter(F.col("v") > int(255.0 * (1.0 - 0.45 * sensitivity))).select(*keys, "ping", "col")


# ---- regions ------------------------------------------------------------------------------------------------------------

def runs_of(mask: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Horizontal runs (ping, c0, c1) of a mask: one node per run instead of one per cell."""
    w = Window.partitionBy(*keys, "ping").orderBy("col")
    return (mask.select(*keys, "ping", "col").withColumn("_g", F.col("col") - F.row_number().over(w))
            .groupBy(*keys, "ping", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_g"))


def label_regions(mask: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """8-connected regions of a mask: every run with its region id (the first run of the region)."""
    runs = runs_of(mask, keys).withColumn("node", F.struct(*keys, "ping", "c0"))
    below = runs.select(*keys, (F.col("ping") - 1).alias("ping"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("node").alias("b"))
    touch = runs.join(below, [*keys, "ping"]).filter((F.col("b0") <= F.col("c1") + 1) & (F.col("b1") >= F.col("c0") - 1))
    return connected_components(runs, touch.select(F.col("node").alias("a"), "b"), "node", label="region")


def box_rows(boxes: DataFrame, rows: DataFrame, ident: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """For each box and each ping it covers, the slice of samples inside the box.

    ``boxes``: keys, ident, whole-pixel x1, y1, x2, y2 (end exclusive). ``rows``: keys, ping, samples. An equi join on
    (keys, ping): a ping's samples are cut, never joined cell by cell.
    """
    asks = boxes.filter("x2 > x1 and y2 > y1").select(*keys, *ident, "x1", "x2", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("ping"))
    return asks.join(rows.hint("merge"), [*keys, "ping"]).select(
        *keys, *ident, "ping", "x1", F.slice("samples", (F.col("x1") + 1).cast("int"), (F.col("x2") - F.col("x1")).cast("int")).alias("part"))


def box_stats(boxes: DataFrame, rows: DataFrame, ident: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Count, sum and maximum of the samples inside each box."""
    cut = box_rows(boxes, rows, ident, keys)
    row_sum = F.aggregate("part", F.lit(0.0), lambda a, v: a + v)
    return cut.groupBy(*keys, *ident).agg(F.sum(F.size("part")).alias("n"), F.sum(row_sum).alias("s"), F.max(F.array_max("part")).alias("peak"))


def running_rows(rows: DataFrame, keys: Sequence[str] = KEY, chunk: int = CHUNK) -> DataFrame:
    """Running totals of an image, cut into chunks of pings: keys, _chunk, ping and the arrays _n, _s, _q.

    Element c of an array holds the count, sum or square sum of the samples left of column c, from the first ping of the
    chunk up to this one. Ping numbers of a chunk that are missing after its first ping repeat the totals before them.
    """
    tagged = rows.withColumn("_chunk", F.floor(F.col("ping") / float(chunk)).cast("bigint"))
    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ping")
        width = max((len(s) for s in pdf["samples"] if s is not None), default=0)
        v = np.full((len(pdf), width), np.nan)
        for i, s in enumerate(pdf["samples"]):
            if s is not None:
                v[i, :len(s)] = np.asarray(s, dtype=float)
        there, v = ~np.isnan(v), np.nan_to_num(v)
        at = np.arange(pdf["ping"].iloc[0], (pdf["_chunk"].iloc[0] + 1) * chunk)
        place = np.searchsorted(pdf["ping"].to_numpy(), at, side="right") - 1
        sums = lambda m: list(np.pad(m.cumsum(axis=0).cumsum(axis=1), ((0, 0), (1, 0)))[place])
        head = {c: [pdf[c].iloc[0]] * len(at) for c in (*keys, "_chunk")}
        return pd.DataFrame({**head, "ping": at, "_n": sums(there.astype(float)), "_s": sums(v), "_q": sums(v * v)})

    return tagged.select(*keys, "_chunk", F.col("ping").cast("bigint").alias("ping"), "samples").groupBy(*keys, "_chunk").applyInPandas(
        totals, ", ".join([*fields, "_chunk bigint", "ping bigint", "_n array<double>", "_s array<double>", "_q array<double>"]))


def box_totals(boxes: DataFrame, rows: DataFrame, ident: Sequence[str], keys: Sequence[str] = KEY, chunk: int = CHUNK) -> DataFrame:
    """Count, sum and square sum (n, s, q) of the samples inside each box, whatever its height.

    A box asks for the running totals at its last ping and at the ping before its first one, in each chunk it meets: two
    short rows where ``box_rows`` cuts every ping.
    """
    b = boxes.filter("x2 > x1 and y2 > y1").select(*keys, *ident, *[F.col(c).cast("bigint").alias(f"_{c}") for c in BOX])
    number = lambda c: F.floor(F.col(c) / float(chunk)).cast("bigint")
    b = b.withColumn("_chunk", F.explode(F.sequence(number("_y1"), F.floor((F.col("_y2") - 1) / float(chunk)).cast("bigint"))))
    last = F.least(F.col("_y2"), (F.col("_chunk") + 1) * chunk) - 1
    before = F.when(F.col("_y1") > F.col("_chunk") * chunk, F.struct((F.col("_y1") - 1).alias("ping"), F.lit(-1.0).alias("sign")))
    asks = b.withColumn("_a", F.explode(F.array_compact(F.array(F.struct(last.alias("ping"), F.lit(1.0).alias("sign")), before))))
    asks = asks.select(*keys, *ident, "_chunk", F.col("_a.ping").alias("ping"), F.col("_a.sign").alias("_sign"), "_x1", "_x2")
    met = asks.join(running_rows(rows, keys, chunk).hint("merge"), [*keys, "_chunk", "ping"])

    def part(name: str) -> Column:
        end = lambda c: F.get(name, F.greatest(F.lit(0), F.least(F.col(c), F.size(name) - 1)).cast("int"))
        return F.sum(F.col("_sign") * (end("_x2") - end("_x1")))

    out = met.groupBy(*keys, *ident).agg(part("_n").cast("bigint").alias("n"), part("_s").alias("s"), part("_q").alias("q"))
    return out.filter("n > 0")


def image_medians(cells: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return histogram(cells.filter("v is not null"), keys).groupBy(*keys).agg(F.expr("percentile(v, 0.5D, n)").alias("median"))


def extract_candidates(mask: DataFrame, rows: DataFrame, keys: Sequence[str] = KEY, min_area: int = 15, max_area: int = 10000,
                       regimes: DataFrame | None = None) -> DataFrame:
    """Candidate regions with box, centroid, peak and mean level of the box, contrast to the image median.

    ``rows`` is the wide image (keys, ping, samples); ``regimes`` optionally (keys, ping, col, regime) for the seabed at
    the centroid.
    """
    runs = label_regions(mask, keys)
    n = F.col("c1") - F.col("c0") + 1
    regions = runs.groupBy(*keys, "region").agg(
        F.min("c0").alias("x1"), F.min("ping").alias("y1"), (F.max("c1") + 1).alias("x2"), (F.max("ping") + 1).alias("y2"),
        F.sum(n).alias("area"), F.sum((F.col("c0") + F.col("c1")) / 2.0 * n).alias("_sx"), F.sum(F.col("ping") * n).alias("_sy"))
    regions = regions.filter(F.col("area").between(min_area, max_area)).withColumns({
        "cx": F.col("_sx") / F.col("area"), "cy": F.col("_sy") / F.col("area"),
        "candidate_id": F.struct(F.col("region.ping"), F.col("region.c0"))}).drop("_sx", "_sy", "region")
    stats = box_stats(regions, rows, ["candidate_id"], keys)
    cells = rows.select(*keys, "ping", F.posexplode("samples").alias("col", "v"))
    out = regions.join(stats, [*keys, "candidate_id"]).join(image_medians(cells, keys), list(keys))
    out = out.withColumns({
        "peak_intensity": F.col("peak"), "mean_intensity": F.col("s") / F.col("n"),
        "contrast_ratio": F.round(F.col("peak") / F.greatest(F.lit(1.0), F.col("median")), 2)}).drop("n", "s", "peak", "median")
    if regimes is None:
        return out
    at = regimes.select(*keys, F.col("ping").alias("_p"), F.col("col").alias("_c"), "regime")
    placed = out.withColumns({"_p": F.floor("cy"), "_c": F.floor("cx")})
    return placed.join(at, [*keys, "_p", "_c"], "left").drop("_p", "_c").withColumns({
        "regime_name": F.element_at(F.create_map(*[F.lit(x) for kv in REGIME_NAMES.items() for x in kv]), F.col("regime")),
        "applied_scaling_factor": regime_scale(F.col("regime"))})


def error_regions(errors: DataFrame, sensitivity: float = 0.85, min_area: int = 20, max_area: int = 15000, keys: Sequence[str] = KEY) -> DataFrame:
    """Anomalous regions of a reconstruction-error map (wide form, 0..255) with a score from peak and mean error."""
    cells = errors.select(*keys, "ping", F.posexplode("samples").alias("col", "v"))
    mask = open_mask(threshold_mask(cells, sensitivity, keys), image_sizes(cells, keys), keys, ELLIPSE5)
    cand = extract_candidates(mask, errors, keys, min_area, max_area)
    score = F.round(0.6 * F.col("peak_intensity") / 255.0 + 0.4 * F.col("mean_intensity") / 255.0, 3)
    return cand.select(*keys, "candidate_id", *BOX, "area", score.alias("anomaly_score"))


def near_pairs(boxes: DataFrame, gap_px: float, keys: Sequence[str], ident: str) -> DataFrame:
    """Box pairs (a < b) that touch or lie within ``gap_px`` of each other, identical boxes represented once."""
    spots = boxes.groupBy(*keys, *BOX).agg(F.min(ident).alias("_l"))
    pairs = box_pairs(spots, spots.withColumnRenamed("_l", "_r"), list(keys), "_l", "_r", pad=gap_px / 2.0)
    return pairs.filter(F.col("_l") < F.col("_r")).select(*keys, F.col("_l").alias("a"), F.col("_r").alias("b"))


def _near_members(gap_px: float):
    """Rows of whole images with ``_comp``, the same for the boxes that near boxes link."""
    def work(t: pa.Table, sizes: np.ndarray) -> pa.Table:
        x1, y1, x2, y2 = (numbers(t, c) for c in BOX)
        a, b = pairs_within(sizes)
        pad = gap_px / 2.0
        near = (np.minimum(x2[a], x2[b]) + pad >= np.maximum(x1[a], x1[b]) - pad) & (np.minimum(y2[a], y2[b]) + pad >= np.maximum(y1[a], y1[b]) - pad)
        return t.append_column("_comp", pa.array(first_member(t.num_rows, a[near], b[near]), pa.int64()))

    return work


def _joined_members(cands: DataFrame, gap_px: float, keys: Sequence[str], ident: str) -> DataFrame:
    """The same for images of any size."""
    spot = Window.partitionBy(*keys, *BOX)
    tagged = cands.withColumn("_node", F.struct(*keys, F.min(ident).over(spot).alias("i")))
    pairs = near_pairs(cands, gap_px, keys, ident).select(F.struct(*keys, F.col("a").alias("i")).alias("a"), F.struct(*keys, F.col("b").alias("i")).alias("b"))
    return tagged.join(connected_components(tagged.select("_node").distinct(), pairs, "_node", label="_comp"), "_node").drop("_node")


def merge_candidates(cands: DataFrame, gap_px: int = 20, keys: Sequence[str] = ("survey_id",), ident: str = "candidate_id") -> DataFrame:
    """Join fragments of one object: union box, summed area, highest peak and contrast, labels of the largest fragment.

    The largest fragment is the one with the highest area, then the lowest id.
    """
    extra = [c for c in cands.columns if c not in (*keys, *BOX, "area", "peak_intensity", "contrast_ratio", "cx", "cy")]

    def merged_of(members: DataFrame) -> DataFrame:
        return members.groupBy(*keys, "_comp").agg(
            F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("area").alias("area"),
            F.max("peak_intensity").alias("peak_intensity"), F.max("contrast_ratio").alias("contrast_ratio"),
            F.count(F.lit(1)).alias("merged_fragments"),
            F.min(F.struct((-F.col("area")).alias("a"), F.col(ident).alias("i"), F.struct("cx", "cy", *extra).alias("r"))).alias("_lead")).drop("_comp")

    (small,), large = split_by_size([cands], keys)
    merged = merged_of(map_groups(small, keys, [], _near_members(gap_px), StructType([*small.schema.fields, StructField("_comp", LongType())])))
    if large is not None:
        merged = merged.unionByName(merged_of(_joined_members(large[0], gap_px, keys, ident)))
    single = F.col("merged_fragments") == 1
    out = merged.select(*keys, *BOX, "area", "peak_intensity", "contrast_ratio", "merged_fragments", "_lead.r.*")
    return out.withColumns({"cx": F.when(single, F.col("cx")).otherwise((F.col("x1") + F.col("x2")) / 2.0),
                            "cy": F.when(single, F.col("cy")).otherwise((F.col("y1") + F.col("y2")) / 2.0)})


# ---- seabed regimes -----------------------------------------------------------------------------------------------------

def sobel_rows(rows: DataFrame, keys: Sequence[str] = KEY, chunk: int = CHUNK) -> DataFrame:
    """3 x 3 gradient magnitude per sample of a wide image, reflected borders; adds ``grad`` (array)."""
    chunks = with_chunks(rows, "ping", chunk, before=1, after=1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("ping")
    up, down = F.lag("samples").over(w), F.lead("samples").over(w)
    near = chunks.withColumns({"_u": F.coalesce(up, down), "_d": F.coalesce(down, up)}).filter("_own")
    n = F.size("samples")

    def magnitude(i: Column) -> Column:
        lo = F.abs(i - 1)
        hi = F.when(i + 1 > n - 1, n - 2).otherwise(i + 1)
        g = lambda name, k: F.get(name, k).cast("double")
        gx = (g("_u", hi) - g("_u", lo)) + 2 * (g("samples", hi) - g("samples", lo)) + (g("_d", hi) - g("_d", lo))
        gy = (g("_d", lo) + 2 * g("_d", i) + g("_d", hi)) - (g("_u", lo) + 2 * g("_u", i) + g("_u", hi))
        return F.sqrt(gx * gx + gy * gy)

    grads = F.transform(F.sequence(F.lit(0), n - 1), magnitude)
    return near.withColumn("grad", grads).drop("_u", "_d", "_chunk", "_own")


def seabed_features(rows: DataFrame, radius: int = 7, keys: Sequence[str] = KEY) -> DataFrame:
    """Local mean, deviation, roughness, smoothed gradient and distance from the nadir per cell, each scaled to [0, 1].

    Every cell of every image is described, whatever the image's size.
    """
    cells = sobel_rows(rows, keys).select(*keys, "ping", F.posexplode(F.arrays_zip("samples", "grad")).alias("col", "_z"))
    cells = cells.select(*keys, "ping", "col", F.col("_z.samples").alias("v"), F.col("_z.grad").alias("g"),
                         (F.col("_z.samples").cast("bigint") * F.col("_z.samples")).alias("vv"))
    # null samples (pings that are missing in an image of fixed size) add nothing; a square of nulls only has no features
    cells = cells.withColumns({"_has": F.col("v").isNotNull().cast("int"), "_hasg": F.col("g").isNotNull().cast("int")})
    s = box_sums(cells, {"_m": ("v", radius), "_q": ("vv", radius), "_g": ("g", 2), "_nv": ("_has", radius), "_ng": ("_hasg", 2)}, keys)
    s = s.withColumns({"_m": F.when(F.col("_nv") > 0, F.col("_m")), "_q": F.when(F.col("_nv") > 0, F.col("_q")), "_g": F.when(F.col("_ng") > 0, F.col("_g"))})
    n = float((2 * radius + 1) ** 2)
    s = s.withColumn("mean", F.col("_m") / n).withColumn(
        "std", F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / n - F.col("mean") * F.col("mean"))))
    size = image_sizes(cells, keys)
    s = s.join(size, list(keys)).withColumns({
        "rough": F.col("std") / (F.col("mean") + 1e-4), "grad": F.col("_g") / 25.0,
        "nadir_dist": F.abs(F.col("col") - F.col("w") / 2.0) / F.greatest(F.lit(1.0), F.col("w") / 2.0)})
    names = ("mean", "std", "rough", "grad", "nadir_dist")
    ext = s.groupBy(*keys).agg(*[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    scaled = s.join(ext, list(keys))
    return scaled.select(*keys, "ping", "col", "v", F.col("nadir_dist").alias("nadir_offset"), *[
        ((F.col(n) - F.col(f"_lo_{n}")) / F.greatest(F.lit(1e-5), F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in names])


def rank_regimes(centres: Sequence[Sequence[float]]) -> dict[int, int]:
    """Cluster number to regime from the cluster centres (mean, std, rough, grad, nadir distance)."""
    left = dict(enumerate(centres))
    nadir = max(left, key=lambda k: 1.5 * (1 - left[k][0]) + 1.5 * (1 - left[k][4]))
    left.pop(nadir)
    out = {nadir: NADIR}
    if left:
        rock = max(left, key=lambda k: 1.5 * left[k][2] + 1.2 * left[k][1] + 1.0 * left[k][3])
        left.pop(rock)
        out[rock] = ROCK
    for k, regime in zip(sorted(left, key=lambda k: left[k][2]), (SAND, RIPPLE)):
        out[k] = regime
    return out


FEATURES = ("mean", "std", "rough", "grad", "nadir_dist")


def rank_image_regimes(centres: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Regime per cluster (keys, cluster, regime) from its centre (FEATURES), image by image; ties go to the lower cluster."""
    water = 1.5 * (1 - F.col("mean")) + 1.5 * (1 - F.col("nadir_dist"))
    hard = 1.5 * F.col("rough") + 1.2 * F.col("std") + 1.0 * F.col("grad")
    # at most k rows per image meet in these windows
    by = Window.partitionBy(*keys)
    first = centres.withColumn("_w", F.row_number().over(by.orderBy(water.desc(), "cluster")) == 1)
    second = first.withColumn("_r", ~F.col("_w") & (F.row_number().over(Window.partitionBy(*keys, "_w").orderBy(hard.desc(), "cluster")) == 1))
    rest = F.row_number().over(Window.partitionBy(*keys, "_w", "_r").orderBy("rough", "cluster"))
    return second.withColumn("_n", rest).select(*keys, "cluster", F.when(F.col("_w"), NADIR).when(F.col("_r"), ROCK).when(F.col("_n") == 1, SAND).otherwise(RIPPLE).alias("regime"))


def seabed_regimes(features: DataFrame, k: int = 4, max_iter: int = 15, keys: Sequence[str] = KEY) -> DataFrame:
    """K-means regimes, each image clustered and ranked on its own, so a dark survey does not decide a bright one's.

    Lloyd steps as aggregates over (image, cluster), seeded by the averages of k equal bands of local brightness. The
    centres of all images are a table of one small row per image; nothing comes to the driver.
    """
    cells = durable(features, "features")
    band = F.least(F.lit(k - 1), F.floor(F.col("mean") * k)).cast("int")

    def centres_of(assigned: DataFrame) -> DataFrame:
        per = assigned.groupBy(*keys, "cluster").agg(*[F.avg(f).alias(f) for f in FEATURES])
        return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", *FEATURES))).alias("_c"))  # k structs

    def assign(centres: DataFrame) -> DataFrame:
        away = F.transform("_c", lambda c: F.struct(sum(((c[f] - F.col(f)) * (c[f] - F.col(f)) for f in FEATURES), F.lit(0.0)).alias("d"), c["cluster"].alias("n")))
        return cells.join(centres, list(keys)).withColumn("cluster", F.array_min(away)["n"])

    centres, path = save_table(centres_of(cells.withColumn("cluster", band)), "centres")
    for _ in range(max_iter):
        nxt, nxt_path = save_table(centres_of(assign(centres)), "centres")
        same = nxt.exceptAll(centres).isEmpty()
        discard(cells.sparkSession, path)
        centres, path = nxt, nxt_path
        if same:
            break
    regimes = rank_image_regimes(centres.select(*keys, F.explode("_c").alias("_x")).select(*keys, "_x.*"), keys)
    return assign(centres).drop("_c").join(regimes, [*keys, "cluster"]).drop("cluster")


def smooth_regimes(cells: DataFrame, keys: Sequence[str] = KEY, chunk: int = CHUNK) -> DataFrame:
    """5 x 5 median of the regime code (borders held), then water column only within a quarter of the half swath.

    There are four codes, so the median (the lower of two) is read off four neighbourhood counts. Cells without a code count
    as nothing; they get the median of the coded cells around them and are left out if there are none.
    """
    size = image_sizes(cells, keys)
    counts = cells.withColumns({f"_is{k}": (F.col("regime") == k).cast("int") for k in REGIME_NAMES})
    summed = _replicated_sums(counts.join(size, list(keys)), [f"_is{k}" for k in REGIME_NAMES], 2, keys, chunk)
    coded = sum((F.col(f"_is{k}") for k in REGIME_NAMES), F.lit(0))
    summed = summed.filter(coded > 0)
    below, median = F.lit(0), F.lit(ROCK)
    steps = []
    for k in REGIME_NAMES:
        below = below + F.col(f"_is{k}")
        steps.append((k, below))
    for k, b in reversed(steps):
        median = F.when(2 * b >= coded, F.lit(k)).otherwise(median)
    out = summed.withColumn("_m", median)
    off = F.abs(F.col("col") - F.col("w") / 2.0) / F.greatest(F.lit(1.0), F.col("w") / 2.0)
    return out.withColumn("regime", F.when((F.col("_m") == NADIR) & (off > 0.25), F.lit(SAND)).otherwise(F.col("_m"))).drop(
        "_m", "h", "w", *[f"_is{k}" for k in REGIME_NAMES])


def _replicated_sums(df: DataFrame, names: Sequence[str], radius: int, keys: Sequence[str], chunk: int) -> DataFrame:
    """Square sums with the border cell repeated outside the image. Needs columns h and w."""
    def outside(axis: str, size: str) -> Column:
        i, n = F.col(axis), F.col(size)
        low = F.when(i == 0, F.sequence(F.lit(-radius), F.lit(-1)).cast("array<bigint>")).otherwise(F.array().cast("array<bigint>"))
        high = F.when(i == n - 1, F.sequence(n.cast("bigint"), n.cast("bigint") + radius - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.explode(F.concat(F.array(i.cast("bigint")), low, high))

    row = Window.partitionBy(*keys, "ping").orderBy("_at").rowsBetween(-radius, radius)
    along = df.withColumn("_at", outside("col", "w")).withColumns({n: F.sum(n).over(row) for n in names}).filter(F.col("_at") == F.col("col"))
    tall = with_chunks(along.withColumn("_at", outside("ping", "h")), "_at", chunk, before=radius, after=radius)
    col = Window.partitionBy(*keys, "_chunk", "col").orderBy("_at").rowsBetween(-radius, radius)
    return tall.withColumns({n: F.sum(n).over(col) for n in names}).filter(F.col("_own") & (F.col("_at") == F.col("ping"))).drop("_at", "_chunk", "_own")


def regime_stats(cells: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Share and level statistics per regime, with the dominant seabed (water column excluded) of the image."""
    per = cells.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("pixel_count"), F.avg("v").alias("mean_intensity"), F.stddev_pop("v").alias("std_intensity"))
    total = per.groupBy(*keys).agg(F.sum("pixel_count").alias("_n"), F.max(F.when(F.col("regime") != NADIR, F.struct(
        F.col("pixel_count").alias("c"), (-F.col("regime")).alias("r")))).alias("_d"))
    return per.join(total, list(keys)).withColumns({
        "coverage_pct": F.col("pixel_count") / F.col("_n") * 100.0, "dominant_regime": -F.col("_d.r")}).drop("_n", "_d")


def project_mask(roi_cells: DataFrame, rois: DataFrame, threshold: float = 0.5) -> DataFrame:
    """ROI mask values (roi_id, r, c, p) to full-image cells by nearest-neighbour rescaling.

    ``rois``: roi_id, image keys, x1, y1, x2, y2 and the mask size mh, mw. Each mask cell lists the full-image cells that
    read it, so the work is one join on roi_id.
    """
    j = roi_cells.filter(F.col("p") >= threshold).join(rois.hint("merge"), "roi_id")
    ch, cw = F.greatest(F.lit(1), F.col("y2") - F.col("y1")), F.greatest(F.lit(1), F.col("x2") - F.col("x1"))

    def readers(i: Column, full: Column, mask: Column) -> Column:
        first = F.ceil(i * full / mask).cast("bigint")
        last = F.ceil((i + 1) * full / mask).cast("bigint") - 1
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    out = j.withColumn("_r", F.explode(readers(F.col("r"), ch, F.col("mh")))).withColumn("_c", F.explode(readers(F.col("c"), cw, F.col("mw"))))
    return out.withColumns({"row": F.col("y1") + F.col("_r"), "col": F.col("x1") + F.col("_c")}).drop("_r", "_c", "r", "c", "p")


def mask_stats(mask_cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area and centroid of each instance mask (keys, row, col)."""
    return mask_cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"), F.avg("col").alias("cx"), F.avg("row").alias("cy"))
