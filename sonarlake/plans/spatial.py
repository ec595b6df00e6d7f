"""Equi-joinable forms of box and point proximity.

A box is listed under every grid tile it touches at its own size level, so box overlap becomes an equi join on
(key, level, tile). Sizes may differ by any factor: smaller boxes are also listed at the coarser levels that occur.
Sides are shuffled by hint: Spark's size check sees compressed files and not the tiles, and would send millions of rows
through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.functions.boxes import iou

BASE_TILE = 32.0
WIDE_TILE = 128.0  # for boxes of whole objects: most touch one or two tiles of one level
BOX = ("x1", "y1", "x2", "y2")


def _level(pad: float, tile: float) -> Column:
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 2 * pad
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1.0)) / tile))).cast("int")


def box_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], l_id: str, r_id: str, pad: float = 0.0,
              tile: float = BASE_TILE) -> DataFrame:
    """Each pair of boxes of one key whose boxes, grown by ``pad``, touch; once per pair.

    Output: keys, ``l_id``, ``r_id`` and the coordinates as ``l_x1 .. r_y2``. Both sides are listed at their own level and
    at the coarser levels that occur on the other side; a pair meets at the coarser of its two levels only, in several
    tiles of it, and is reported by the tile that holds the top-left corner of the overlap. Three bits per listing tell so:
    own level, first column and first row of the box; a tile reports a pair if each bit is set on either side.
    """
    def levels(df: DataFrame) -> Column:
        return df.agg(F.collect_set(_level(pad, tile)).alias("_l")).scalar()

    def listed(df: DataFrame, other: DataFrame, ident: str, side: str) -> DataFrame:
        base = df.select(*keys, F.col(ident).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in BOX], _level(pad, tile).alias("_own"))
        base = base.withColumn("_level", F.explode(F.array_union(F.array("_own"), levels(other)))).filter("_level >= _own")
        size = F.lit(tile) * F.pow(F.lit(2.0), F.col("_level"))
        for t, c in (("_tx", "x"), ("_ty", "y")):
            base = base.withColumn("_first", F.floor((F.col(f"{side}_{c}1") - pad) / size))
            base = base.withColumn(t, F.explode(F.sequence("_first", F.floor((F.col(f"{side}_{c}2") + pad) / size)))).withColumn(
                f"_at{t}", F.col(t) == F.col("_first"))
        bits = F.when(F.col("_own") == F.col("_level"), 1).otherwise(0) + F.when(F.col("_at_tx"), 2).otherwise(0) + F.when(F.col("_at_ty"), 4).otherwise(0)
        return base.withColumn(f"_{side}", bits.cast("byte")).drop("_own", "_first", "_at_tx", "_at_ty")

    pairs = listed(left, right, l_id, "l").join(listed(right, left, r_id, "r").hint("merge"), [*keys, "_level", "_tx", "_ty"])
    ox, oy = F.greatest("l_x1", "r_x1") - pad, F.greatest("l_y1", "r_y1") - pad
    pairs = pairs.filter(F.col("_l").bitwiseOR(F.col("_r")) == 7).filter((F.least("l_x2", "r_x2") + pad >= ox) & (F.least("l_y2", "r_y2") + pad >= oy))
    return pairs.drop("_level", "_tx", "_ty", "_l", "_r").withColumnsRenamed({"l_id": l_id, "r_id": r_id})


def pair_iou() -> Column:
    return iou(*[F.col(f"l_{c}") for c in BOX], *[F.col(f"r_{c}") for c in BOX])


def best_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], r_id: str, min_iou: float = 0.0,
                 accept: Column | None = None, match: str = "best_id", score: str = "best_iou") -> DataFrame:
    """Every left row with its best right box of the same key: highest IoU, then lowest ``r_id``; null if none.

    Identical boxes of a key are collapsed on both sides before pairing, so a pile of exact copies costs one pair.
    ``accept`` is an optional condition on ``l_x1 .. r_y2``; otherwise IoU must exceed ``min_iou``.
    """
    shape = [*keys, *BOX]
    lefts = left.select(*shape).distinct().withColumn("_lk", F.struct(*BOX))
    rights = right.groupBy(*shape).agg(F.min(r_id).alias("_rid"))
    pairs = box_pairs(lefts, rights, keys, "_lk", "_rid", tile=WIDE_TILE).withColumn("_iou", pair_iou())
    pairs = pairs.filter(accept if accept is not None else F.col("_iou") > min_iou)
    best = pairs.groupBy(*keys, *[F.col(f"l_{c}").alias(c) for c in BOX]).agg(
        F.max(F.struct(F.col("_iou"), (-F.col("_rid")).alias("neg"))).alias("_b"))
    best = best.select(*shape, (-F.col("_b.neg")).alias(match), F.col("_b._iou").alias(score))
    return left.join(best.hint("merge"), shape, "left")
