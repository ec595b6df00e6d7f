"""Labelled-dataset audit, splits, unions and region catalogues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.operators.detections import expand_bbox, to_pixels
from sonarlake.operators.evaluation import size_category
from sonarlake.plans.ordered import dense_index, running_sums
from sonarlake.plans.spatial import BOX, box_pairs
from sonarlake.plans.totals import with_totals

# Material super-classes of class names, and the classes kept.
MATERIALS = {
    "plastic-bottle": "plastic", "plastic-bidon": "plastic", "plastic-pipe": "plastic", "plastic-propeller": "plastic", "drink-sachet": "plastic",
    "glass-bottle": "glass", "brown-glass-bottle": "glass", "potion-glass-bottle": "glass", "glass-jar": "glass",
    "can": "metal", "metal-bottle": "metal", "metal-box": "metal", "valve": "metal", "wrench": "metal",
    "large-tire": "tire_rubber", "small-tire": "tire_rubber", "drink-carton": "carton", "rotating-platform": "background",
}
LITTER = ["plastic", "glass", "metal", "tire_rubber", "carton"]


def _lookup(mapping: Mapping, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def class_dim(spark: SparkSession, names: Mapping | Sequence[str]) -> DataFrame:
    items = enumerate(names) if not isinstance(names, Mapping) else names.items()
    return spark.createDataFrame([(int(k), str(v)) for k, v in items], "class_id bigint, class_name string")


# ---- labels ---------------------------------------------------------------------------------------------------------------

def parse_labels(lines: DataFrame) -> DataFrame:
    """Split label lines ``class cx cy w h``; values that are not numbers become null."""
    p = F.col("_fields")
    num = lambda i: F.get(p, F.lit(i)).try_cast("double")
    split = lines.withColumn("_fields", F.split(F.trim("line"), r"\s+"))
    return split.withColumns({"n_fields": F.size(p), "class_id": F.get(p, F.lit(0)).try_cast("bigint"), "cx": num(1), "cy": num(2), "w": num(3), "h": num(4)}).drop("_fields")


def validate_labels(lines: DataFrame, n_classes: int) -> DataFrame:
    """Errors per label line; a line that parses keeps its box even if out of range. Empty lines are ignored."""
    p = parse_labels(lines.filter(F.trim("line") != ""))
    five = F.col("n_fields") == 5
    numeric = F.col("class_id").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    ok = five & numeric
    x0, x1 = F.col("cx") - F.col("w") / 2.0, F.col("cx") + F.col("w") / 2.0
    y0, y1 = F.col("cy") - F.col("h") / 2.0, F.col("cy") + F.col("h") / 2.0
    errors = F.array_compact(F.array(
        F.when(~five, F.concat(F.lit("Expected 5 values (class cx cy w h), found "), F.col("n_fields").cast("string"), F.lit("."))),
        F.when(five & ~numeric, F.concat(F.lit("Non-numeric value in '"), F.trim("line"), F.lit("'."))),
        F.when(ok & ~F.col("class_id").between(0, n_classes - 1),
               F.concat(F.lit("Class ID "), F.col("class_id").cast("string"), F.lit(f" out of range [0, {n_classes - 1}]."))),
        F.when(ok & ((F.col("w") <= 0) | (F.col("h") <= 0)), F.lit("Non-positive box size.")),
        F.when(ok & ~(F.col("cx").between(0, 1) & F.col("cy").between(0, 1)), F.lit("Center coordinates outside [0, 1].")),
        F.when(ok & ((x0 < -0.05) | (x1 > 1.05) | (y0 < -0.05) | (y1 > 1.05)), F.lit("Box extends significantly outside image bounds."))))
    return p.withColumn("errors", errors).withColumn("is_box", ok)


def class_counts(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Instances per class, classes without any included."""
    c = boxes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return classes.join(c, "class_id", "left").na.fill(0, ["n"])


def size_distribution(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(size_category(F.col("w") * F.col("h")).alias("size_cat")).agg(F.count(F.lit(1)).alias("n"))


def aspect_distribution(boxes: DataFrame) -> DataFrame:
    a = F.col("w") / (F.col("h") + 1e-6)
    cat = F.when(a > 3.0, "extreme_wide").when(a > 1.5, "wide").when(a >= 0.67, "square_ish").when(a >= 0.33, "tall").otherwise("extreme_tall")
    return boxes.groupBy(cat.alias("aspect")).agg(F.count(F.lit(1)).alias("n"))


def missing_labels(images: DataFrame, labels: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(labels.select(key), key, "left_anti")


def duplicate_images(images: DataFrame) -> DataFrame:
    """Contents that occur more than once: first image and number of later copies."""
    g = images.groupBy("content_hash").agg(F.min(F.struct("image_id", "name")).alias("_f"), (F.count(F.lit(1)) - 1).alias("copies"))
    return g.filter("copies > 0").select("content_hash", F.col("_f.image_id").alias("first_id"), F.col("_f.name").alias("first_name"), "copies")


def dataset_summary(images: DataFrame, label_lines: DataFrame, n_classes: int) -> DataFrame:
    """Counts per split and in total (split null): images, corrupt, labelled, missing, invalid, background, boxes.

    ``images``: image_id, split, readable. ``label_lines``: image_id, line; an image with only blank lines is background.
    """
    checked = validate_labels(label_lines, n_classes).groupBy("image_id").agg(
        F.count_if("is_box").alias("boxes"), F.max((F.size("errors") > 0).cast("int")).alias("bad"))
    files = label_lines.select("image_id").distinct().withColumn("has_file", F.lit(1))
    j = images.join(files, "image_id", "left").join(checked, "image_id", "left").na.fill(0, ["has_file", "boxes", "bad"])
    ok, labelled = F.col("readable"), F.col("readable") & (F.col("has_file") == 1)
    return j.rollup("split").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(~ok).alias("corrupt"), F.count_if(labelled).alias("labels"),
        F.count_if(ok & (F.col("has_file") == 0)).alias("missing"), F.count_if(labelled & (F.col("bad") == 1)).alias("invalid"),
        F.count_if(labelled & (F.col("boxes") == 0)).alias("background"), F.sum(F.when(labelled, F.col("boxes")).otherwise(0)).alias("boxes"))


def dataset_health(summary: DataFrame) -> DataFrame:
    return summary.withColumn("is_healthy", (F.col("corrupt") == 0) & (F.col("invalid") == 0) & (F.col("missing") == 0))


def leakage_report(images: DataFrame, group: str = "survey_group", splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Groups found in more than one split with their count in each."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in splits]
    spans = sum(((F.col(s) > 0).cast("int") for s in splits), F.lit(0))
    return images.filter(F.col(group).isNotNull()).groupBy(group).agg(*counts).filter(spans > 1)


def survey_group(name: Column, prefix: str = "Shipwrecks") -> Column:
    """Survey id of a frame name: the name without its trailing number; null for names of other kinds."""
    return F.when(name.startswith(prefix), F.regexp_replace(name, r"_\d+$", ""))


def frame_group(name: Column) -> Column:
    """Source frame of an augmented copy (``<frame>_jpg.rf.<hash>.jpg``), else the name without extension."""
    source = F.regexp_extract(name, r"^(.*?)_(?:jpg|png|jpeg)\.rf\.", 1)
    return F.when(source != "", source).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


# ---- splits ---------------------------------------------------------------------------------------------------------------

def shuffle_key(ident: Column, seed: int = 42) -> Column:
    """Repeatable pseudo-random position of an integer id (multiplicative mix modulo a prime)."""
    return F.pmod((ident.cast("bigint") % 1000003) * 48271 + seed * 7919, F.lit(1000003))


def _cut(df: DataFrame, keys: Sequence[str], ident: str, fractions: Sequence[tuple[str, float]], seed: int) -> DataFrame:
    """Number rows in shuffled order and cut at truncated shares of the count; the last split takes the rest."""
    numbered = dense_index(df.withColumn("_mix", shuffle_key(F.col(ident), seed)), list(keys), ["_mix", ident], "_pos").drop("_mix")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out, upto, split = numbered.join(n, list(keys)) if keys else with_totals(numbered, n), F.lit(0), F.lit(fractions[-1][0])
    bounds = []
    for name, share in fractions[:-1]:
        upto = upto + F.floor(F.col("_n") * share)
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        split = F.when(F.col("_pos") < bound, name).otherwise(split)
    return out.withColumn("split", split).drop("_pos", "_n")


def stratified_split(df: DataFrame, cls: str, ident: str, fractions=(("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    return _cut(df, [cls], ident, fractions, seed)


def ratio_split(df: DataFrame, ident: str, fractions=(("train", 0.70), ("val", 0.15), ("test", 0.15)), seed: int = 42) -> DataFrame:
    return _cut(df, [], ident, fractions, seed)


def group_split(df: DataFrame, group: str, fractions=(("a", 0.5), ("b", 0.5)), seed: int = 0) -> DataFrame:
    """Whole groups to splits; cut points are the truncated cumulative shares of the group count."""
    groups = dense_index(df.select(group).distinct().withColumn("_mix", shuffle_key(F.col(group), seed)), [], ["_mix", group], "_pos")
    n = groups.agg(F.count(F.lit(1)).alias("_n"))
    split, share, bounds = F.lit(fractions[-1][0]), 0.0, []
    for name, part in fractions[:-1]:
        share += part
        bounds.append((name, F.floor(F.col("_n") * share)))
    for name, bound in reversed(bounds):
        split = F.when(F.col("_pos") < bound, name).otherwise(split)
    marked = with_totals(groups, n).withColumn("split", split).select(group, "split")
    return df.drop("split").join(marked, group)


def assign_survey_splits(groups: DataFrame, group: str = "survey_group", size: str = "n", val_frac: float = 0.10, test_frac: float = 0.12,
                         slack: float = 1.6, seed: int = 0) -> DataFrame:
    """Whole surveys to test, then val, then train, in shuffled order, each split filled greedily.

    A split takes a survey while it is below its target and stays within ``slack`` times the target. Between two
    surveys that are too big to fit, acceptance is a running sum; since a survey that does not fit exceeds 0.6 of the
    target, only a handful of passes are needed whatever the number of surveys.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    order = F.xxhash64(F.lit(seed), group)
    left = dense_index(groups.withColumn("_mix", order), [], ["_mix", group], "_pos").select(group, size, "_pos")
    parts = []
    for name, frac in (("test", test_frac), ("val", val_frac)):
        target = frac * total
        have, start, accepted = 0.0, 0, []
        while have < target:
            room = target * slack - have
            fits = left.filter((F.col("_pos") >= start) & (F.col(size) <= room)).withColumn("_one", F.lit(1))
            run = running_sums(fits, ["_one"], ["_pos"], {"_upto": size})
            stop = run.filter((F.col("_upto") > room) & (F.col("_upto") - F.col(size) < target - have)).agg(F.min("_pos")).first()[0]
            take = run.filter(F.col("_upto") - F.col(size) < target - have)
            take = take if stop is None else take.filter(F.col("_pos") < stop)
            got = take.agg(F.sum(size)).first()[0] or 0
            accepted.append(take.select(group, F.lit(name).alias("split")))
            have += got
            if stop is None:
                break
            start = stop + 1
        for a in accepted:
            parts.append(a)
            left = left.join(a.select(group), group, "left_anti")
    out = left.select(group, F.lit("train").alias("split"))
    for p in parts:
        out = out.unionByName(p)
    return out


# ---- unions and catalogues ------------------------------------------------------------------------------------------------

def remap_classes(labels: DataFrame, mapping: DataFrame, default: int = 0) -> DataFrame:
    """Old class ids to unified ids (mapping: class_id, new_id); ids without a mapping take the default."""
    return labels.join(mapping, "class_id", "left").withColumn("class_id", F.coalesce("new_id", F.lit(default))).drop("new_id")


def union_datasets(parts: Sequence[tuple[str, DataFrame, Mapping[int, int], int]]) -> DataFrame:
    """Union of label tables with a source prefix on the image name and remapped class ids: (prefix, labels, map, default)."""
    out = None
    for prefix, labels, mapping, default in parts:
        one = labels.withColumns({"name": F.concat(F.lit(prefix + "_"), F.col("name")), "source": F.lit(prefix),
                                  "class_id": F.coalesce(_lookup({int(k): int(v) for k, v in mapping.items()}, F.col("class_id").cast("int")), F.lit(default))})
        out = one if out is None else out.unionByName(one)
    return out


def to_material(df: DataFrame, class_col: str = "class_name") -> DataFrame:
    """Material of a class (default plastic); background images keep no label."""
    out = df.withColumn("material", F.coalesce(_lookup(MATERIALS, F.col(class_col)), F.lit("plastic")))
    return out.withColumn("material_id", F.when(F.col("material") != "background", F.array_position(F.array(*[F.lit(x) for x in LITTER]), F.col("material")) - 1))


def centered_labels(df: DataFrame, size: float = 0.92) -> DataFrame:
    return df.withColumns({"cx": F.lit(0.5), "cy": F.lit(0.5), "w": F.lit(float(size)), "h": F.lit(float(size))})


def roi_catalogue(labels: DataFrame, ratio: float, width: Column | float, height: Column | float) -> DataFrame:
    """Expanded region per label with a sample id. ``labels``: image_name, class_name, box_no, cx, cy, w, h, split."""
    r = expand_bbox(to_pixels(labels, width, height), ratio, width, height)
    sid = F.concat(F.regexp_replace("image_name", r"\.[^.]*$", ""), F.lit("_roi"), F.lpad(F.col("box_no").cast("string"), 2, "0"), F.lit("_"), F.col("class_name"))
    # a region is empty exactly when it starts beyond the image
    return r.withColumn("sample_id", sid).filter((F.col("rx1") < width) & (F.col("ry1") < height))


def roi_counts(catalogue: DataFrame) -> DataFrame:
    """Regions per class and per split in one pass."""
    return catalogue.groupingSets([[F.col("class_name")], [F.col("split")]], F.col("class_name"), F.col("split")).agg(F.count(F.lit(1)).alias("n"))


def background_patches(frames: DataFrame, labels: DataFrame, per_frame: int, sizes: Sequence[int], margin: int = 12, seed: int = 1, tries: int = 12) -> DataFrame:
    """Seeded random squares that keep ``margin`` from every labelled box, the first ``per_frame`` of each frame.

    ``frames``: image_id, width, height. ``labels``: image_id, BOX. Candidates are compared with labels on grid tiles.
    """
    mix = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "image_id", "try_no"), F.lit(1 << 30))
    c = frames.withColumn("try_no", F.explode(F.sequence(F.lit(0), F.lit(per_frame * tries - 1))))
    c = c.withColumn("_s", F.get(F.array(*[F.lit(int(s)) for s in sizes]), F.pmod(mix(1), F.lit(len(sizes))).cast("int")))
    c = c.withColumn("side", F.least(F.greatest(F.lit(24), F.col("_s")), F.least("width", "height") - 1))
    c = c.withColumns({"x1": F.pmod(mix(2), F.col("width") - F.col("side")).cast("double"), "y1": F.pmod(mix(3), F.col("height") - F.col("side")).cast("double")})
    c = c.withColumns({"x2": F.col("x1") + F.col("side"), "y2": F.col("y1") + F.col("side")})
    boxes = labels.select("image_id", *BOX).distinct().withColumn("_r", F.lit(0))
    hit = box_pairs(c, boxes, ["image_id"], "try_no", "_r", pad=margin / 2.0).select("image_id", "try_no").distinct()
    free = c.join(hit.hint("merge"), ["image_id", "try_no"], "left_anti")
    # per frame at most per_frame * tries candidates exist, so gathering them is bounded
    first = free.groupBy("image_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("try_no", *BOX))), 1, per_frame).alias("_ok"))
    return first.select("image_id", F.inline("_ok"))
