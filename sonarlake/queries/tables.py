"""Survey tables derived from the given star schema: pings, cells, labelled boxes, predictions, detections, ...

Each derivation exists twice: Spark (below) and SQL (``SQL``), written so both engines compute identical values. The two
tables that need consecutive numbers (pings per survey, predictions) are numbered with a range-partitioned ordering and
stored once per application under the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarlake.plans.durable import save_table
from sonarlake.plans.ordered import dense_index

_STORED: dict[tuple[str, str, str], tuple[str, object]] = {}


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        df, path = save_table(build(), name)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def pings(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        events = base(spark, sf, "events").withColumn("survey_id", F.expr("user_id % 10"))
        numbered = dense_index(events, ["survey_id"], ["ts", "event_id"], "ping_id")
        return numbered.selectExpr(
            "survey_id", "ping_id", "event_id",
            "unix_micros(cast(ts as timestamp)) / 1000000D as t_s",
            "13D + (event_id % 97) * 0.001D + case when event_id % 50 = 0 then 1D else 0D end as latitude",
            "80D + (event_id % 89) * 0.001D as longitude",
            "cast((event_id * 7) % 400 as double) as heading_deg",
            "value / 10D as altitude_m",
            "case when event_id % 33 = 0 then 5D else 75D end as slant_range_m",
            "((event_id % 21) - 10) * 0.4D as pitch_deg", "((event_id % 17) - 8) * 0.5D as roll_deg",
            "(event_id % 7) * 0.1D as heave_m", "1D + (event_id % 13) * 0.5D as speed_knots",
            "case when event_id % 4 = 0 then 0D else 25D end as layback_m")

    return _stored(spark, sf, "fx_pings", build)


def waterfall(spark: SparkSession, sf: str) -> DataFrame:
    """Wide form: one row per ping with an array of samples."""
    return base(spark, sf, "embeddings").selectExpr(
        "cast(floor(vec_id / 250D) as bigint) as survey_id", "vec_id % 250 as ping",
        "transform(embedding, e -> cast(least(255, greatest(0, floor((e + 0.5D) * 255D))) as int)) as samples")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return waterfall(spark, sf).selectExpr("survey_id", "ping", "posexplode(samples) as (col, v)")


LABEL = [
    "cast(floor(o_orderkey / 4D) as bigint) as image_id", "o_orderkey as gt_id", "o_custkey % 5 as class_id",
    "cast((o_orderkey % 4) * 80 + o_custkey % 30 as double) as x1", "cast((o_custkey * 7) % 200 as double) as y1",
    "cast((o_orderkey % 4) * 80 + o_custkey % 30 + 20 + o_custkey % 40 as double) as x2",
    "cast((o_custkey * 7) % 200 + 20 + (o_orderkey * 3) % 50 as double) as y2"]


def gt(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "orders").selectExpr(*LABEL)


# Lines that tie in these columns give rows that differ in their number only, so the further columns of the SQL's order,
# which no derived column reads, do not change the table.
PRED_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def pred(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        # the label's box follows from two short columns, so they are carried through the ordering instead of the box
        lines = base(spark, sf, "lineitem").select(*PRED_ORDER)
        orders = base(spark, sf, "orders").select("o_orderkey", "o_custkey")
        joined = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        numbered = dense_index(joined, [], PRED_ORDER, "pred_id", start=1, keep=["o_orderkey", "o_custkey", "l_linenumber", "l_partkey", "l_suppkey"])
        return numbered.selectExpr("pred_id", "l_linenumber", "l_partkey", "l_suppkey", *LABEL).selectExpr(
            "pred_id", "image_id", "gt_id as source_gt",
            "case when l_linenumber >= 6 then (class_id + 1) % 5 else class_id end as class_id",
            "(50 + (l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 900) / 1000D as conf",
            "x1 + (l_partkey % 15) - 7 as x1", "y1 + (l_suppkey % 15) - 7 as y1",
            "x2 + (l_partkey % 15) - 7 + (l_linenumber % 5) as x2", "y2 + (l_suppkey % 15) - 7 + (l_partkey % 5) as y2",
            "(l_suppkey % 40) / 10D as contrast_ratio",
            "case when l_partkey % 3 = 0 then null else (l_partkey % 100) / 100D end as anomaly_score",
            "(l_suppkey % 25) * 1D as snr_db", "(l_partkey % 120) / 100D as shadow_contrast",
            "(l_suppkey % 60) / 1000D as mc_variance", "(l_linenumber * 13 % 100) / 100D as seg_quality")

    return _stored(spark, sf, "fx_pred", build)


def det(spark: SparkSession, sf: str) -> DataFrame:
    return pred(spark, sf).selectExpr(
        "pred_id as det_id", "image_id % 20 as survey_id", "cast(floor(image_id / 20D) as bigint) as frame_id",
        "case when pred_id % 6 = 0 then null else source_gt end as track_id", "class_id",
        "case when conf >= 0.35D then 'known' else 'unknown' end as detection_type", "conf", "x1", "y1", "x2", "y2",
        "mc_variance",
        "case when pred_id % 41 = 0 then null else 13D + (source_gt % 400) * 0.0005D + (pred_id % 5) * 0.00001D end as latitude",
        "case when pred_id % 41 = 0 then null else 80D + (source_gt % 300) * 0.0005D + (pred_id % 3) * 0.00001D end as longitude")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    # twenty pings a frame, added in ping order: a mean that lies on a cell border must not depend on the order of arrival
    def mean(c: str) -> Column:
        return F.aggregate("_p", F.lit(0.0), lambda a, p: a + p[c]) / F.size("_p")

    return (pings(spark, sf).withColumn("frame_id", F.expr("cast(floor(ping_id / 20D) as bigint)"))
            .groupBy("survey_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("ping_id", "latitude", "longitude"))).alias("_p"))
            .select("survey_id", "frame_id", mean("latitude").alias("latitude"), mean("longitude").alias("longitude"))
            .withColumn("scqi", F.expr("(survey_id * 31 + frame_id * 17) % 100 * 1D")))


def passes(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "part").selectExpr("p_partkey", "explode(sequence(0, 4)) as pass").selectExpr(
        "p_partkey as object_id", "pass", "explode(sequence(0, 4)) as class_idx").withColumn(
        "w", F.expr("1D + (object_id * 13 + pass * 7 * (object_id % 4) + class_idx * 29) % 50"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "labels").selectExpr("doc_id", "quality as y", "(doc_id * 37 % 101) / 100D as score")


def images(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "documents").selectExpr(
        "doc_id as image_id", "concat(source, '_', lang, '_', cast(doc_id as string), '.png') as name",
        "case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end as split",
        "md5(text) as content_hash", "n_chars as size_bytes")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return pred(spark, sf).selectExpr(
        "image_id", "pred_id as line_no",
        "case when pred_id % 97 = 0 then concat(cast(class_id as string), ' 0.5 0.5 0.2') "
        "when pred_id % 89 = 0 then concat(cast(class_id as string), ' a 0.5 0.2 0.2') "
        "when pred_id % 83 = 0 then concat(cast(class_id + 5 as string), ' 0.5 0.5 0.2 0.2') "
        "else concat(cast(class_id as string), ' 0.', cast(10 + pred_id % 90 as string), ' 0.', "
        "cast(10 + source_gt % 90 as string), ' 0.', cast(10 + pred_id % 40 as string), ' 0.', "
        "cast(10 + source_gt % 30 as string)) end as line")


SQL = {
    "fx_pings": """
select user_id % 10 as survey_id,
       row_number() over (partition by user_id % 10 order by ts, event_id) - 1 as ping_id,
       event_id, epoch_us(ts) / 1000000e0 as t_s,
       13e0 + (event_id % 97) * 0.001e0 + case when event_id % 50 = 0 then 1e0 else 0e0 end as latitude,
       80e0 + (event_id % 89) * 0.001e0 as longitude,
       cast((event_id * 7) % 400 as double) as heading_deg,
       value / 10e0 as altitude_m,
       case when event_id % 33 = 0 then 5e0 else 75e0 end as slant_range_m,
       ((event_id % 21) - 10) * 0.4e0 as pitch_deg, ((event_id % 17) - 8) * 0.5e0 as roll_deg,
       (event_id % 7) * 0.1e0 as heave_m, 1e0 + (event_id % 13) * 0.5e0 as speed_knots,
       case when event_id % 4 = 0 then 0e0 else 25e0 end as layback_m
from events""",
    "fx_cells": """
select cast(floor(vec_id / 250e0) as bigint) as survey_id, vec_id % 250 as ping, cast(pos as int) as col,
       cast(least(255, greatest(0, floor((e + 0.5e0) * 255e0))) as int) as v
from (select vec_id, i - 1 as pos, embedding[i] as e from embeddings, range(1, 65) r(i))""",
    "fx_gt": """
select cast(floor(o_orderkey / 4e0) as bigint) as image_id, o_orderkey as gt_id, o_custkey % 5 as class_id,
       cast((o_orderkey % 4) * 80 + o_custkey % 30 as double) as x1, cast((o_custkey * 7) % 200 as double) as y1,
       cast((o_orderkey % 4) * 80 + o_custkey % 30 + 20 + o_custkey % 40 as double) as x2,
       cast((o_custkey * 7) % 200 + 20 + (o_orderkey * 3) % 50 as double) as y2
from orders""",
    "fx_pred": """
select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as pred_id,
       g.image_id, g.gt_id as source_gt, case when l_linenumber >= 6 then (g.class_id + 1) % 5 else g.class_id end as class_id,
       (50 + (l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 900) / 1000e0 as conf,
       g.x1 + (l_partkey % 15) - 7 as x1, g.y1 + (l_suppkey % 15) - 7 as y1,
       g.x2 + (l_partkey % 15) - 7 + (l_linenumber % 5) as x2, g.y2 + (l_suppkey % 15) - 7 + (l_partkey % 5) as y2,
       (l_suppkey % 40) / 10e0 as contrast_ratio,
       case when l_partkey % 3 = 0 then null else (l_partkey % 100) / 100e0 end as anomaly_score,
       (l_suppkey % 25) * 1e0 as snr_db, (l_partkey % 120) / 100e0 as shadow_contrast,
       (l_suppkey % 60) / 1000e0 as mc_variance, (l_linenumber * 13 % 100) / 100e0 as seg_quality
from lineitem join fx_gt g on l_orderkey = g.gt_id""",
    "fx_det": """
select pred_id as det_id, image_id % 20 as survey_id, cast(floor(image_id / 20e0) as bigint) as frame_id,
       case when pred_id % 6 = 0 then null else source_gt end as track_id, class_id,
       case when conf >= 0.35e0 then 'known' else 'unknown' end as detection_type, conf, x1, y1, x2, y2, mc_variance,
       case when pred_id % 41 = 0 then null else 13e0 + (source_gt % 400) * 0.0005e0 + (pred_id % 5) * 0.00001e0 end as latitude,
       case when pred_id % 41 = 0 then null else 80e0 + (source_gt % 300) * 0.0005e0 + (pred_id % 3) * 0.00001e0 end as longitude
from fx_pred""",
    "fx_frames": """
select survey_id, cast(floor(ping_id / 20e0) as bigint) as frame_id, avg(latitude) as latitude, avg(longitude) as longitude,
       (survey_id * 31 + cast(floor(ping_id / 20e0) as bigint) * 17) % 100 * 1e0 as scqi
from fx_pings group by survey_id, cast(floor(ping_id / 20e0) as bigint)""",
    "fx_passes": """
select p_partkey as object_id, a.r_regionkey as pass, b.r_regionkey as class_idx,
       1e0 + (p_partkey * 13 + a.r_regionkey * 7 * (p_partkey % 4) + b.r_regionkey * 29) % 50 as w
from part cross join region a cross join region b""",
    "fx_scores": "select doc_id, quality as y, (doc_id * 37 % 101) / 100e0 as score from labels",
    "fx_images": """
select doc_id as image_id, concat(source, '_', lang, '_', cast(doc_id as varchar), '.png') as name,
       case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end as split,
       md5(text) as content_hash, n_chars as size_bytes
from documents""",
    "fx_labels": """
select image_id, pred_id as line_no,
       case when pred_id % 97 = 0 then concat(cast(class_id as varchar), ' 0.5 0.5 0.2')
            when pred_id % 89 = 0 then concat(cast(class_id as varchar), ' a 0.5 0.2 0.2')
            when pred_id % 83 = 0 then concat(cast(class_id + 5 as varchar), ' 0.5 0.5 0.2 0.2')
            else concat(cast(class_id as varchar), ' 0.', cast(10 + pred_id % 90 as varchar), ' 0.', cast(10 + source_gt % 90 as varchar),
                        ' 0.', cast(10 + pred_id % 40 as varchar), ' 0.', cast(10 + source_gt % 30 as varchar)) end as line
from fx_pred""",
}

NEEDS = {"fx_pred": ["fx_gt"], "fx_det": ["fx_pred"], "fx_frames": ["fx_pings"], "fx_labels": ["fx_pred"]}


def with_tables(names: Iterable[str], sql: str) -> str:
    """Prefix ``sql`` with the derivations it uses, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in NEEDS.get(name, []):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    body = sql.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} as ({SQL[n].strip()})" for n in ordered)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
