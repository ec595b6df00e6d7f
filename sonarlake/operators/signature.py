"""Acoustic shadows and signatures of objects on a wide waterfall, and verification of the claimed class.

``objects``: keys, ident, whole-pixel x1, y1, x2, y2. ``rows``: keys, ping, samples. Image height and width are numbers.
Objects of one image with the same box are measured once; the figures are joined back to them by the box.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions.boxes import clip
from sonarlake.functions.scores import let
from sonarlake.operators.cfar import KEY, box_rows, box_totals, sobel_rows
from sonarlake.plans.durable import durable
from sonarlake.plans.ordered import exact_quantiles
from sonarlake.plans.spatial import BOX

# Signature features in order, and material families of class names.
FEATURES = ["impedance_contrast_idx", "contrast_db", "peak_db", "shadow_depth", "highlight_shadow_ratio", "shadow_length_rel",
            "edge_sharpness", "texture_cv", "entropy", "log_area", "elongation", "fill_ratio"]
FAMILIES = {
    "metal": ["can", "chain", "hook", "metal-bottle", "metal-box", "valve", "wrench", "propeller", "pipeline or cable"],
    "glass": ["glass-bottle", "brown-glass-bottle", "glass-jar", "potion-glass-bottle"],
    "plastic": ["plastic-bidon", "plastic-bottle", "plastic-pipe", "plastic-propeller", "drink-carton", "drink-sachet", "shampoo-bottle",
                "standing-bottle", "bottle"],
    "rubber": ["tire", "small-tire", "large-tire"],
    "structure": ["Shipwrecks", "rotating-platform"],
}


def attach_family(df: DataFrame, class_col: str = "class_name") -> DataFrame:
    """Material family of a class name, ``other`` if unknown: a literal map, no join."""
    lookup = F.create_map(*[F.lit(x) for fam, names in FAMILIES.items() for n in names for x in (n, fam)])
    return df.withColumn("family", F.coalesce(F.try_element_at(lookup, F.col(class_col)), F.lit("other")))


def family_medians(df: DataFrame, value: str = "impedance_contrast_idx") -> DataFrame:
    named = attach_family(df)
    middle = exact_quantiles(named, ["family"], value, [0.5], "median").select("family", "median")
    return named.groupBy("family").agg(F.count(F.lit(1)).alias("n")).join(middle, "family", "left").select("family", "median", "n")


def _clamped(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    return F.struct(F.greatest(F.lit(0), x1).cast("int").alias("x1"), F.greatest(F.lit(0), y1).cast("int").alias("y1"),
                    F.least(F.lit(width), x2).cast("int").alias("x2"), F.least(F.lit(height), y2).cast("int").alias("y2"))


def region_stats(objects: DataFrame, rows: DataFrame, regions: Mapping[str, Column], ident: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Count, sum and mean of named regions around each object, one row per object with columns ``n_<name>``, ``s_<name>``, ``m_<name>``."""
    listed = objects.select(*keys, *ident, F.explode(F.array(*[F.struct(F.lit(n).alias("region"), c.alias("b")) for n, c in regions.items()])).alias("_x"))
    boxes = listed.select(*keys, *[F.col(c).alias(f"_id_{c}") for c in ident], F.col("_x.region").alias("region"), "_x.b.*")
    stats = box_totals(boxes, rows, [*[f"_id_{c}" for c in ident], "region"], keys).withColumnsRenamed({f"_id_{c}": c for c in ident})
    picks = []
    for n in regions:
        here = F.col("region") == n
        picks += [F.sum(F.when(here, F.col("n"))).alias(f"n_{n}"), F.sum(F.when(here, F.col("s"))).alias(f"s_{n}")]
    out = stats.groupBy(*keys, *ident).agg(*picks)
    return out.withColumns({f"m_{n}": F.col(f"s_{n}") / F.col(f"n_{n}") for n in regions})


def _box_sides() -> tuple[Column, Column]:
    return F.greatest(F.lit(2), F.col("x2") - F.col("x1")), F.greatest(F.lit(2), F.col("y2") - F.col("y1"))


def shadow_check(objects: DataFrame, rows: DataFrame, width: int, height: int, ident: str = "det_id", search: float = 1.8,
                 min_drop: float = 0.70, keys: Sequence[str] = KEY) -> DataFrame:
    """Is the strip on the far side from the nadir dark against the surroundings?"""
    bw, _ = _box_sides()
    pad, reach = F.greatest(F.lit(4), F.floor(bw * 0.5)), F.floor(bw * search)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    port = (x1 + x2) / 2.0 < width / 2.0
    ambient = _clamped(x1 - pad, y1 - pad, x2 + pad, y2 + pad, width, height)
    strip = F.when(port, _clamped(x1 - reach, y1, x1, y2, width, height)).otherwise(_clamped(x2, y1, x2 + reach, y2, width, height))
    s = region_stats(objects.select(*keys, *BOX).distinct(), rows, {"ambient": ambient, "strip": strip}, BOX, keys)
    return _judge(objects, s, F.col("m_strip"), min_drop, keys)


def shadow_any(objects: DataFrame, rows: DataFrame, width: int, height: int, ident: str = "det_id", search: float = 1.8,
               min_drop: float = 0.70, keys: Sequence[str] = KEY) -> DataFrame:
    """Shadow on any of the four sides, for images without a nadir: the darkest side counts."""
    bw, bh = _box_sides()
    pad = F.greatest(F.lit(4), F.floor(F.greatest(bw, bh) * 0.5))
    lx, ly = F.floor(bw * search), F.floor(bh * search)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    c = lambda *b: _clamped(*b, width, height)
    s = region_stats(objects.select(*keys, *BOX).distinct(), rows, {
        "ambient": c(x1 - pad, y1 - pad, x2 + pad, y2 + pad), "left": c(x1 - lx, y1, x1, y2), "right": c(x2, y1, x2 + lx, y2),
        "up": c(x1, y1 - ly, x2, y1), "down": c(x1, y2, x2, y2 + ly)}, BOX, keys)
    return _judge(objects, s, F.least("m_left", "m_right", "m_up", "m_down"), min_drop, keys)


def _judge(objects: DataFrame, stats: DataFrame, darkest: Column, min_drop: float, keys: Sequence[str]) -> DataFrame:
    ratio = darkest / F.greatest(F.lit(1.0), F.coalesce("m_ambient", F.lit(100.0)))
    s = stats.select(*keys, *BOX, ratio.alias("_r"))
    return objects.join(s.hint("merge"), [*keys, *BOX], "left").withColumns({
        "has_shadow": F.coalesce(F.col("_r") <= min_drop, F.lit(False)), "shadow_contrast": F.coalesce("_r", F.lit(1.0))}).drop("_r")


def acoustic_signature(objects: DataFrame, rows: DataFrame, width: int, height: int, ident: str = "det_id", keys: Sequence[str] = KEY,
                       edge: bool = True) -> DataFrame:
    """Signature features per object from its box, the ring around it and the strip on the far side from the nadir.

    Boxes under 3 px on a side are left out. With ``altitude_m``, ``range_to_object_m`` and ``range_per_px_m`` on the
    object, a height estimate is added.
    """
    o = objects.withColumn("_b", _clamped(F.round("x1"), F.round("y1"), F.round("x2"), F.round("y2"), width, height))
    o = o.select(*keys, ident, "_b.*", *[c for c in ("altitude_m", "range_to_object_m", "range_per_px_m") if c in objects.columns])
    o = o.filter("x2 - x1 >= 3 and y2 - y1 >= 3")
    shapes = durable(o.select(*keys, *BOX).distinct().withColumn("_shape", F.struct(*BOX)), "shapes")
    out = o.join(_shape_signature(shapes, rows, width, height, "_shape", keys, edge).drop("_shape").hint("merge"), [*keys, *BOX])
    if {"altitude_m", "range_to_object_m", "range_per_px_m"} <= set(objects.columns):
        length = F.col("shadow_px") * F.col("range_per_px_m")
        out = out.withColumn("height_m", F.when(
            (F.col("shadow_px") > 0) & (F.col("range_to_object_m") > 0) & (F.col("altitude_m") > 0),
            length * F.col("altitude_m") / (F.col("range_to_object_m") + length)))
    return out


def _shape_signature(o: DataFrame, rows: DataFrame, width: int, height: int, ident: str, keys: Sequence[str], edge: bool) -> DataFrame:
    """Signature features of distinct boxes."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    bw, bh = x2 - x1, y2 - y1
    pad = F.greatest(F.lit(4), F.floor(F.greatest(bw, bh) * 0.6))
    reach = bw * 2
    c = lambda *b: _clamped(*b, width, height)
    port = (x1 + x2) / 2.0 < width / 2.0
    strip = F.when(port, c(x1 - reach, y1, x1, y2)).otherwise(c(x2, y1, x2 + reach, y2))
    regions = {"outer": c(x1 - pad, y1 - pad, x2 + pad, y2 + pad), "inner": c(x1 - 2, y1 - 2, x2 + 2, y2 + 2), "box": c(x1, y1, x2, y2), "strip": strip}
    s = region_stats(o, rows, regions, [ident], keys)
    totals = rows.groupBy(*keys).agg(F.sum(F.size("samples")).alias("_tn"), F.sum(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)).alias("_ts"))
    s = s.join(totals.hint("merge"), list(keys)).withColumn("_rn", F.col("n_outer") - F.col("n_inner")).withColumn(
        "bg", F.when(F.col("_rn") >= 8, (F.col("s_outer") - F.col("s_inner")) / F.col("_rn"))
        .otherwise((F.col("_ts") - F.col("s_box")) / (F.col("_tn") - F.col("n_box"))))
    base = o.join(s.select(*keys, ident, "bg", "n_box", "m_box", "m_strip").hint("merge"), [*keys, ident])

    # value histogram of the box: percentile, deviation, entropy
    hist = (box_rows(o, rows, [ident], keys).select(*keys, ident, F.explode("part").alias("v"))
            .groupBy(*keys, ident, "v").agg(F.count(F.lit(1)).alias("n")))
    n_all = F.sum("n").over(Window.partitionBy(*keys, ident))
    p = F.col("n") / F.col("_n")
    values = hist.withColumn("_n", n_all).groupBy(*keys, ident).agg(
        F.expr("percentile(v, 0.95D, n)").alias("p95"), F.sum(-p * F.log2(p)).alias("entropy"),
        (F.sum(F.col("v") * F.col("v") * p) - F.pow(F.sum(F.col("v") * p), F.lit(2.0))).alias("var"))

    # shadow length: dark columns of the strip counted outward from the object
    strips = o.withColumn("_s", strip).withColumn("_port", port)
    cols = box_rows(strips.select(*keys, ident, "_s.*"), rows, [ident], keys).select(
        *keys, ident, "x1", F.posexplode("part").alias("k", "v"))
    profile = cols.groupBy(*keys, ident, (F.col("x1") + F.col("k")).alias("xc")).agg(F.avg("v").alias("m"))
    profile = profile.join(base.select(*keys, ident, "bg", F.col("x1").alias("ox1"), F.col("x2").alias("ox2")).hint("merge"), [*keys, ident])
    dist = F.when(F.col("xc") < F.col("ox1"), F.col("ox1") - 1 - F.col("xc")).otherwise(F.col("xc") - F.col("ox2"))
    run = profile.groupBy(*keys, ident).agg(F.min(F.when(~(F.col("m") < 0.7 * F.col("bg")), dist)).alias("_first"), F.count(F.lit(1)).alias("_len"))

    out = base.join(values.hint("merge"), [*keys, ident]).join(run.hint("merge"), [*keys, ident], "left")
    ratio = F.when(F.col("m_strip").isNotNull() & (F.col("m_strip") / F.greatest(F.lit(1.0), F.col("bg")) < 1.0),
                   F.col("m_strip") / F.greatest(F.lit(1.0), F.col("bg"))).otherwise(F.lit(1.0))
    out = out.withColumn("_ratio", ratio).withColumn(
        "shadow_px", F.when(F.col("_ratio") < 1.0, F.coalesce("_first", "_len")).otherwise(F.lit(0)))
    m, bg = F.col("m_box"), F.col("bg")
    # variance of a filled rectangle's pixel coordinates (sample form) gives the elongation in closed form
    area = F.col("n_box")
    spread = lambda side: (side * side - 1) / 12.0 * area / (area - 1)
    big, small = F.greatest(spread(bw), spread(bh)), F.least(spread(bw), spread(bh))
    out = out.withColumns({
        "impedance_contrast_idx": (m - bg) / (m + bg + 1.0),
        "contrast_db": 20.0 * F.log10((m + 1.0) / (bg + 1.0)),
        "peak_db": 20.0 * F.log10((F.col("p95") + 1.0) / (bg + 1.0)),
        "shadow_depth": clip(1.0 - F.col("_ratio"), 0.0, 1.0),
        "highlight_shadow_ratio": clip(m / F.greatest(F.lit(1.0), F.col("_ratio") * bg), 0.0, 50.0),
        "shadow_length_rel": F.col("shadow_px") / F.greatest(F.lit(1), F.greatest(bw, bh)),
        "texture_cv": F.sqrt(F.greatest(F.lit(0.0), F.col("var"))) / F.greatest(F.lit(1.0), m),
        "log_area": F.log1p(area.cast("double")),
        "elongation": F.sqrt(big / F.greatest(small, F.lit(1e-6))),
        "fill_ratio": area / F.greatest(F.lit(1), bw * bh)})
    if edge:
        grads = sobel_rows(rows, keys).select(*keys, "ping", F.col("grad").alias("samples"))
        # gradient of the mask: box grown by one minus box shrunk by one (the image border does not shrink it)
        shrink = F.struct(F.when(x1 == 0, x1).otherwise(x1 + 1).alias("x1"), F.when(y1 == 0, y1).otherwise(y1 + 1).alias("y1"),
                          F.when(x2 == width, x2).otherwise(x2 - 1).alias("x2"), F.when(y2 == height, y2).otherwise(y2 - 1).alias("y2"))
        e = region_stats(o, grads, {"grown": c(x1 - 1, y1 - 1, x2 + 1, y2 + 1), "shrunk": shrink}, [ident], keys)
        rim = (F.col("s_grown") - F.coalesce("s_shrunk", F.lit(0.0))) / (F.col("n_grown") - F.coalesce("n_shrunk", F.lit(0)))
        out = out.join(e.select(*keys, ident, rim.alias("_rim")).hint("merge"), [*keys, ident], "left").withColumn(
            "edge_sharpness", F.coalesce(F.col("_rim") / F.greatest(F.lit(1.0), bg), F.lit(0.0))).drop("_rim")
    return out.drop("m_strip", "_ratio", "_first", "_len", "var", "p95", "n_box")


# ---- class verification -----------------------------------------------------------------------------------------------

def class_scores(df: DataFrame, features: Sequence[str], mean: Sequence[float], std: Sequence[float], coef: Sequence[Sequence[float]],
                 intercept: Sequence[float]) -> DataFrame:
    """Softmax class probabilities ``probs`` (array) of a linear model; the coefficients are literals in the plan."""
    # added in the order of the formula and shifted only where exp could overflow or vanish: classes that tie stay as the plain softmax has them
    z = [sum(((F.col(f) - m) / s * w for f, m, s, w in zip(features, mean, std, row)), F.lit(float(b))) for row, b in zip(coef, intercept)]

    # every step is bound once: a plain reference inside a lambda would be evaluated again for each class
    def shares(v: Column) -> Column:
        shift = let(F.array_max(v), lambda top: F.when(F.abs(top) < 600.0, F.lit(0.0)).otherwise(top))
        e = let(shift, lambda by: F.transform(v, lambda x: F.exp(x - by)))
        return let(e, lambda es: let(F.aggregate(es, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(es, lambda x: x / total)))

    return df.withColumn("probs", let(F.array(*z), shares))


def top_classes(df: DataFrame, k: int = 3, classes: Sequence[str] | None = None) -> DataFrame:
    """The k most probable classes as ``nearest`` (array of class, p); ties go to the lower class number."""
    pairs = F.transform("probs", lambda p, i: F.struct((-p).alias("np"), i.alias("i")))
    best = F.slice(F.sort_array(pairs), 1, k)
    name = (lambda i: F.get(F.array(*[F.lit(c) for c in classes]), i)) if classes else (lambda i: i)
    return df.withColumn("nearest", F.transform(best, lambda s: F.struct(name(s["i"]).alias("class"), (-s["np"]).alias("p"))))


def verify_signature(df: DataFrame, claimed: str, confirm_ratio: float, mismatch_rank: int, mismatch_p: float,
                     validated: Column | None = None) -> DataFrame:
    """Verdict on the claimed class number (null = no claim): CONFIRMED, MISMATCH, UNCERTAIN or N/A.

    The rule compares the 0-based rank; the reported rank is 1-based.
    """
    ok = validated if validated is not None else F.lit(True)
    staged = df.withColumn("claimed_p", F.get("probs", F.col(claimed).cast("int")))
    staged = staged.withColumns({
        "_rank": F.size(F.filter("probs", lambda p: p > F.col("claimed_p"))), "claimed_vs_best": F.col("claimed_p") / F.array_max("probs")})
    known = F.col("claimed_p").isNotNull()
    verdict = F.when(~known | ~ok, "N/A").when(F.col("claimed_vs_best") >= confirm_ratio, "CONFIRMED").when(
        (F.col("_rank") >= mismatch_rank) & (F.col("claimed_p") < mismatch_p), "MISMATCH").otherwise("UNCERTAIN")
    return staged.withColumns({"verdict": verdict, "claimed_rank": F.when(known, F.col("_rank") + 1)}).drop("_rank")


def verdict_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    v = F.col("verdict")
    return df.groupBy(*keys).agg(*[F.count_if(v == name).alias(name.lower().replace("/", "")) for name in ("CONFIRMED", "UNCERTAIN", "MISMATCH", "N/A")])
