"""Column expressions on boxes, polygons and areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size limits in px^2 and the width factor of the instance-relative boundary band.
SMALL_AREA = 32 * 32
MEDIUM_AREA = 96 * 96
LARGE_LIMIT = 10**10
BAND_FACTOR = 0.19


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length shared by two half-open intervals, 0 when they are apart."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0).cast("bigint"))


def box_iou(ax: Column, ay: Column, aw: Column, ah: Column,
            bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """IoU of two xywh boxes; 0 when both are empty."""
    inter = (F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0))
             * F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0))).cast("double")
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, F.try_divide(inter, union)).otherwise(F.lit(0.0))


def clip_interval(start: Column, length: Column, limit: Column) -> tuple[Column, Column]:
    """Both ends of [start, start+length) after clamping to [0, limit]."""
    low = F.least(F.greatest(start, F.lit(0.0)), limit.cast("double"))
    high = F.least(F.greatest(start + length, F.lit(0.0)), limit.cast("double"))
    return low, high


def clip_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Clipped xywh box as a struct, NULL when nothing is left inside the image."""
    x0, x1 = clip_interval(x, w, width)
    y0, y1 = clip_interval(y, h, height)
    return F.when(
        (x1 - x0 > 0) & (y1 - y0 > 0),
        F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")),
    )


def equivalent_diameter(area: Column) -> Column:
    """Diameter of the disc with the given pixel area."""
    return F.lit(2.0) * F.sqrt(F.greatest(area.cast("double"), F.lit(0.0)) / F.lit(math.pi))


def instance_band(area: Column, factor: float = BAND_FACTOR) -> Column:
    """Whole-pixel band width of one instance: at least 1, halves rounded to even."""
    return F.greatest(F.lit(1), F.bround(F.lit(factor) * equivalent_diameter(area)).cast("bigint"))


def image_band(width: Column, height: Column, ratio: float) -> Column:
    """Whole-pixel band width from a share of the image diagonal."""
    return F.greatest(F.lit(1), F.bround(F.lit(ratio) * F.hypot(width, height)).cast("bigint"))


def report_size_bin(area: Column) -> Column:
    """Half-open size bins used by the recall report (not the closed ranges of average precision)."""
    return (F.when(area < SMALL_AREA, "small").when(area < MEDIUM_AREA, "medium").otherwise("large"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of a flat [x0, y0, x1, y1, ...] array."""
    n = (F.size(points) / 2).cast("int")

    def corner(i: Column) -> Column:
        j = F.when(i == n - 1, F.lit(0)).otherwise(i + 1)
        x0, y0 = F.get(points, i * 2), F.get(points, i * 2 + 1)
        x1, y1 = F.get(points, j * 2), F.get(points, j * 2 + 1)
        return x0 * y1 - x1 * y0

    terms = F.transform(F.sequence(F.lit(0), n - 1), corner)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(n > 0, F.abs(total) * 0.5).otherwise(F.lit(0.0))


def register_sql_functions(spark) -> None:
    """SQL names for the three scalar functions users call in ad-hoc queries."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION box_iou(ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, "
        "bx DOUBLE, by DOUBLE, bw DOUBLE, bh DOUBLE) RETURNS DOUBLE RETURN "
        "coalesce(try_divide(greatest(least(ax+aw, bx+bw)-greatest(ax, bx), 0)"
        " * greatest(least(ay+ah, by+bh)-greatest(ay, by), 0),"
        " aw*ah + bw*bh - greatest(least(ax+aw, bx+bw)-greatest(ax, bx), 0)"
        " * greatest(least(ay+ah, by+bh)-greatest(ay, by), 0)), 0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION equivalent_diameter(area DOUBLE) RETURNS DOUBLE "
              "RETURN 2 * sqrt(greatest(area, 0) / pi())")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION size_bin(area DOUBLE) RETURNS STRING RETURN "
              f"CASE WHEN area < {SMALL_AREA} THEN 'small' WHEN area < {MEDIUM_AREA} THEN 'medium' ELSE 'large' END")
