"""Flips, quarter turns and crops of boxes and masks, and seeded augmentation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chances of a flip and of a turn.
FLIP_CHANCE, TURN_CHANCE = 0.5, 0.75
OPS = ["vflip", "hflip", "rot90_k1", "rot90_k2", "rot90_k3"]


def moved_box(op: str, x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Box after one operation; quarter turns are counter-clockwise."""
    right, below = width - x - w, height - y - h
    new = {"vflip": (x, below, w, h), "hflip": (right, y, w, h), "rot90_k1": (y, right, h, w),
           "rot90_k2": (right, below, w, h), "rot90_k3": (below, x, h, w)}[op]
    return F.struct(F.lit(op).alias("op"), *[v.alias(n) for v, n in zip(new, "xywh")])


def d4_boxes(boxes: DataFrame) -> DataFrame:
    """Every box under every operation; `boxes(x, y, w, h, width, height, ...)`."""
    args = [F.col(c) for c in ("x", "y", "w", "h", "width", "height")]
    rest = [c for c in boxes.columns if c not in ("x", "y", "w", "h")]
    return boxes.select(*rest, F.inline(F.array(*[moved_box(op, *args) for op in OPS])))


def moved_point(op: str, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Point after one operation."""
    return {"vflip": (x, height - y), "hflip": (width - x, y), "rot90_k1": (y, width - x),
            "rot90_k2": (width - x, height - y), "rot90_k3": (height - y, x)}[op]


def chance(seed: int, op: str, *keys: str) -> Column:
    """Uniform number in [0, 1) that depends only on the keys, the seed and the operation: 32 bits of an MD5 of their text."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)), F.lit(op))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(2 ** 32))


def augmentation_plan(images: DataFrame, *, seed: int, low: int, high: int) -> DataFrame:
    """Flip, turn and crop window drawn for every image; the crop fits the image."""
    draw = lambda op: chance(seed, op, "image_id")
    side = lambda op, limit: F.least((F.floor(draw(op) * (high - low + 1)) + low), limit)
    sized = images.select("image_id", "width", "height", side("crop_w", F.col("width")).alias("cw"),
                          side("crop_h", F.col("height")).alias("ch"),
                          (draw("vflip") < FLIP_CHANCE).alias("vflip"),
                          F.when(draw("turn") < TURN_CHANCE, F.floor(draw("quarter") * 3) + 1).otherwise(F.lit(0)).alias("quarters"))
    return sized.withColumns({"cx": F.floor(draw("crop_x") * (F.col("width") - F.col("cw") + 1)),
                              "cy": F.floor(draw("crop_y") * (F.col("height") - F.col("ch") + 1))})


def crop_boxes(boxes: DataFrame, resolution: int) -> DataFrame:
    """Boxes cut to the window `(cx, cy, cw, ch)` and scaled to a square of `resolution`; empty ones go."""
    x0, x1 = F.greatest(F.col("x") - F.col("cx"), F.lit(0)), F.least(F.col("x") + F.col("w") - F.col("cx"), "cw")
    y0, y1 = F.greatest(F.col("y") - F.col("cy"), F.lit(0)), F.least(F.col("y") + F.col("h") - F.col("cy"), "ch")
    cut = boxes.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}).where("_x1 > _x0 AND _y1 > _y0")
    sx = lambda v: v * F.lit(resolution) / F.col("cw")
    sy = lambda v: v * F.lit(resolution) / F.col("ch")
    return cut.withColumns({"x": sx(F.col("_x0")), "y": sy(F.col("_y0")), "w": sx(F.col("_x1") - F.col("_x0")),
                            "h": sy(F.col("_y1") - F.col("_y0"))}).drop("_x0", "_x1", "_y0", "_y1")
