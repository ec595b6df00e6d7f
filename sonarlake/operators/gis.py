"""Density hot spots, quality heat map and sighting deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions.geo import haversine
from sonarlake.operators.geolocate import grid_cell, neighbour_cells
from sonarlake.plans.durable import discard, save_table
from sonarlake.plans.iterate import connected_components

# exp(x) is exactly 0 in double precision below this exponent, so points farther away add nothing at all
UNDERFLOW = 746.0


def _located(points: DataFrame) -> DataFrame:
    return points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def _extent(points: DataFrame, keys: Sequence[str], g: int, margin: float = 0.001) -> DataFrame:
    e = points.groupBy(*keys).agg(
        (F.min("latitude") - margin).alias("lat0"), (F.max("latitude") + margin).alias("lat1"),
        (F.min("longitude") - margin).alias("lon0"), (F.max("longitude") + margin).alias("lon1"), F.count(F.lit(1)).alias("n_points"))
    return e.withColumns({"dlat": (F.col("lat1") - F.col("lat0")) / (g - 1), "dlon": (F.col("lon1") - F.col("lon0")) / (g - 1)})


def kde_grid(points: DataFrame, g: int = 60, bandwidth: float = 0.0005, keys: Sequence[str] = ("survey_id",)) -> DataFrame:
    """Gaussian density on a g x g grid per key, scaled to a maximum of 1: keys, gi, gj, lat, lon, density.

    Identical positions are merged with their count; each adds to the grid cells within its numerical reach, which is
    a map-side expansion followed by one combining aggregate of at most g*g rows per key and task. Cells nobody reaches
    are filled in with 0.
    """
    located = _located(points)
    ext = _extent(located, keys, g)
    spots = located.groupBy(*keys, "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
    reach = (2.0 * UNDERFLOW) ** 0.5 * bandwidth
    p = spots.join(ext, list(keys))

    def span(at: str, lo: str, step: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - reach - F.col(lo)) / F.col(step)).cast("int"))
        last = F.least(F.lit(g - 1), F.floor((F.col(at) + reach - F.col(lo)) / F.col(step)).cast("int"))
        return F.sequence(first, last)

    # reach test per axis first: one exponential per row index and one per column index, multiplied at the cell
    inv = 1.0 / (bandwidth * bandwidth)
    rows = p.select(*keys, "n", "longitude", "lon0", "dlon", F.explode(span("latitude", "lat0", "dlat")).alias("gi"), "latitude", "lat0", "dlat")
    rows = rows.withColumn("_dy", F.pow(F.col("lat0") + F.col("gi") * F.col("dlat") - F.col("latitude"), F.lit(2.0)))
    cells = rows.withColumn("gj", F.explode(span("longitude", "lon0", "dlon")))
    dx = F.pow(F.col("lon0") + F.col("gj") * F.col("dlon") - F.col("longitude"), F.lit(2.0))
    dens = cells.groupBy(*keys, "gi", "gj").agg(F.sum(F.col("n") * F.exp(-0.5 * (F.col("_dy") + dx) * inv)).alias("_s"))
    grid = ext.select(*keys, "lat0", "lon0", "dlat", "dlon", "n_points", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("gi"))
    grid = grid.withColumn("gj", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    full = grid.join(dens, [*keys, "gi", "gj"], "left").na.fill(0.0, ["_s"])
    top = full.groupBy(*keys).agg(F.max("_s").alias("_top"))
    return full.join(top, list(keys)).select(
        *keys, "gi", "gj", (F.col("lat0") + F.col("gi") * F.col("dlat")).alias("lat"), (F.col("lon0") + F.col("gj") * F.col("dlon")).alias("lon"),
        (F.col("_s") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0))).alias("density"), "n_points", "dlat", "dlon")


def kde_hotspots(points: DataFrame, g: int = 60, bandwidth: float = 0.0005, percentile: float = 90.0, few: int = 5,
                 keys: Sequence[str] = ("survey_id",)) -> DataFrame:
    """Connected areas of high density with weighted centre, peak, cell count and the objects inside.

    With fewer than ``few`` points the threshold is at least half the maximum.
    """
    grid, _ = save_table(kde_grid(points, g, bandwidth, keys), "density")
    limits = grid.groupBy(*keys).agg(F.expr(f"percentile(density, {percentile / 100.0}D)").alias("_t"), F.max("density").alias("_m"),
                                     F.first("n_points").alias("_n"))
    limits = limits.select(*keys, F.when(F.col("_n") < few, F.greatest(F.col("_t"), 0.5 * F.col("_m"))).otherwise(F.col("_t")).alias("threshold"))
    hot = grid.join(limits, list(keys)).filter(F.col("density") >= F.col("threshold")).withColumn("node", F.struct(*keys, "gi", "gj"))
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    steps = hot.select(*keys, "gi", "gj", "node", F.explode(offsets).alias("_o")).select(
        F.struct(*keys, (F.col("gi") + F.col("_o.a")).alias("gi"), (F.col("gj") + F.col("_o.b")).alias("gj")).alias("b"), F.col("node").alias("a"))
    edges = steps.join(hot.select(F.col("node").alias("b")), "b", "left_semi")
    labelled = connected_components(hot, edges, "node", label="region")
    w = F.col("density")
    spots = labelled.groupBy(*keys, "region").agg(
        (F.sum(w * F.col("lat")) / F.sum(w)).alias("latitude"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("longitude"),
        F.max(w).alias("peak_density"), F.count(F.lit(1)).alias("cells"), F.first("threshold").alias("threshold"),
        (F.min("lat") - F.first("dlat") / 2).alias("lat_lo"), (F.max("lat") + F.first("dlat") / 2).alias("lat_hi"),
        (F.min("lon") - F.first("dlon") / 2).alias("lon_lo"), (F.max("lon") + F.first("dlon") / 2).alias("lon_hi"))
    # objects inside: positions are counted per exact location, then matched to the few boxes of their key
    located = _located(points).groupBy(*keys, "latitude", "longitude").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed(
        {"latitude": "plat", "longitude": "plon"})
    inside = located.join(spots.select(*keys, "region", "lat_lo", "lat_hi", "lon_lo", "lon_hi"), list(keys)).filter(
        F.col("plat").between(F.col("lat_lo"), F.col("lat_hi")) & F.col("plon").between(F.col("lon_lo"), F.col("lon_hi")))
    counts = inside.groupBy(*keys, "region").agg(F.sum("n").alias("n_objects"))
    out = spots.join(counts, [*keys, "region"], "left").na.fill(0, ["n_objects"])
    return out.select(*keys, F.col("region.gi").alias("first_gi"), F.col("region.gj").alias("first_gj"), "latitude", "longitude", "peak_density",
                      "cells", "n_objects", "threshold").orderBy(F.col("peak_density").desc(), *keys, "first_gi", "first_gj")


def scqi_heatmap(frames: DataFrame, cell: float = 0.0004) -> DataFrame:
    """Mean quality per rounded grid cell (half-even rounding of the cell index)."""
    return (frames.filter(F.col("latitude").isNotNull())
            .groupBy(F.bround(F.col("latitude") / cell).cast("bigint").alias("cell_i"), F.bround(F.col("longitude") / cell).cast("bigint").alias("cell_j"))
            .agg(F.avg("scqi").alias("scqi"), F.count(F.lit(1)).alias("n_frames"))
            .withColumns({"latitude": F.col("cell_i") * cell, "longitude": F.col("cell_j") * cell}))


def cell_polygon(lat: Column, lon: Column, dlat: Column, dlon: Column) -> Column:
    """Closed rectangle [[lon, lat], ...] around a centre."""
    corner = lambda a, b: F.array(lon + a * dlon, lat + b * dlat)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def dedup_sightings(df: DataFrame, metres: float = 4.5, ident: str = "det_id", keys: Sequence[str] = ("survey_id",)) -> DataFrame:
    """Merge repeated sightings: in input order, a record joins the first earlier leader within ``metres``, else leads.

    The best record of a cluster is kept (highest conf, then first), with the number of sightings and the mean
    confidence. Records without a position stay alone.

    The sequential loop is reproduced in rounds. Positions are reduced to distinct points and placed in grid cells. A
    point becomes a leader once its cell and all cells within reach hold no earlier undecided point; then the points it
    covers are out. When all leaders are known, every position joins the earliest leader within reach. Work per round is
    an aggregate over cells plus a join of points with the new leaders, so a dense pile of sightings never produces all
    its pairs.
    """
    spark = df.sparkSession
    located = _located(df)
    spots, _ = save_table(
        located.groupBy(*keys, "latitude", "longitude").agg(F.min(ident).alias("_id"))
        .withColumns({"_cell": grid_cell(metres), "_near": neighbour_cells(metres)}), "spots")

    def reached(points: DataFrame, leaders: DataFrame) -> DataFrame:
        listed = leaders.select(*keys, F.col("_id").alias("leader"), F.col("latitude").alias("_llat"), F.col("longitude").alias("_llon"),
                                F.explode("_near").alias("_cell"))
        near = haversine(F.col("_llat"), F.col("_llon"), F.col("latitude"), F.col("longitude")) <= metres
        return points.join(listed, [*keys, "_cell"]).filter(near)

    undecided, path = spots, None
    leader_parts: list[DataFrame] = []
    while not undecided.isEmpty():
        firsts = undecided.groupBy(*keys, "_cell").agg(F.min("_id").alias("_first"))
        own = undecided.join(firsts, [*keys, "_cell"]).filter(F.col("_id") == F.col("_first"))
        around = (own.select(*keys, "_id", F.explode("_near").alias("_cell"))
                  .join(firsts, [*keys, "_cell"]).groupBy(*keys, "_id").agg(F.min("_first").alias("_earliest")))
        new, _ = save_table(own.join(around, [*keys, "_id"]).filter(F.col("_earliest") >= F.col("_id")).select(*spots.columns), "leaders")
        leader_parts.append(new)
        out = reached(undecided, new).select(*keys, "_id").distinct()
        rest, rest_path = save_table(undecided.join(out, [*keys, "_id"], "left_anti"), "sightings")
        discard(spark, path)
        undecided, path = rest, rest_path
    leaders = spots.limit(0)
    for part in leader_parts:
        leaders = leaders.unionByName(part)
    clusters = reached(spots, leaders).groupBy(*keys, "latitude", "longitude").agg(F.min("leader").alias("leader"))
    conf = F.coalesce("conf", F.lit(0.0))
    members = located.join(clusters, [*keys, "latitude", "longitude"])
    alone = df.filter(F.col("latitude").isNull() | F.col("longitude").isNull()).withColumn("leader", F.col(ident))
    best = members.unionByName(alone.select(*members.columns)).groupBy(*keys, "leader").agg(
        F.max(F.struct(conf.alias("c"), (-F.col(ident)).alias("o"), F.struct(*df.columns).alias("r"))).alias("_m"),
        F.count(F.lit(1)).alias("sightings_count"), F.avg(conf).alias("fused_confidence"))
    return best.select("_m.r.*", "leader", "sightings_count", "fused_confidence")
