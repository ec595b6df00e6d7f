"""Box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def iou(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    zero = F.lit(0.0)
    inter = (F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1))
             * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1)))
    union = area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def centre_inside(px1: Column, py1: Column, px2: Column, py2: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Is the centre of box p inside the other box (borders included)?"""
    cx, cy = (px1 + px2) / 2, (py1 + py2) / 2
    return cx.between(x1, x2) & cy.between(y1, y2)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))
