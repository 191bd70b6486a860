"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.functions.geometry import SMALL_AREA
from masklake.operators import augment, masks

PERCENTILES = (50, 75, 90, 95, 99, 100)


def counts_per_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    n = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return images.select("image_id").join(n, "image_id", "left").na.fill(0, ["n"])


def count_summary(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations per image, images without any included.

    Counts are first grouped by value, so the exact percentiles see one weighted row per distinct count.
    """
    grouped = counts_per_image(images, annotations).groupBy("n").agg(F.count(F.lit(1)).alias("f"))
    ps = [F.round(F.expr(f"percentile(n, {p / 100}D, f)"), 9).alias(f"p{p}") for p in PERCENTILES]
    above = lambda k: F.sum(F.when(F.col("n") > k, F.col("f")).otherwise(0))
    images_n, total = F.sum("f"), F.sum(F.col("n") * F.col("f"))
    mean = total / images_n
    std = F.sqrt(F.greatest((images_n * F.sum(F.col("n") * F.col("n") * F.col("f")) - total * total), F.lit(0))) / images_n
    return grouped.agg(
        images_n.alias("images"), total.alias("total_annotations"), F.round(mean, 9).alias("mean"), F.round(std, 9).alias("std"),
        F.min("n").alias("min"), F.max("n").alias("max"), *ps, above(-1).alias("_all"),
        F.sum(F.when(F.col("n") == 0, F.col("f")).otherwise(0)).alias("images_with_zero_gt"), above(100).alias("images_above_100"),
        above(200).alias("images_above_200"), above(500).alias("images_above_500"),
        F.round(above(200) / images_n, 9).alias("fraction_above_200")).drop("_all")


def count_buckets(images: DataFrame, annotations: DataFrame, edges: tuple[int, ...]) -> DataFrame:
    """Images per half-open count bucket, the last one open; empty buckets stay."""
    counts = counts_per_image(images, annotations)
    spans = list(zip(edges, [*edges[1:], None]))
    inside = lambda a, b: (F.col("n") >= a) & ((F.col("n") < b) if b is not None else F.lit(True))
    name = lambda a, b: f">={a}" if b is None else f"{a}-{b - 1}"
    wide = counts.agg(*[F.count_if(inside(a, b)).alias(name(a, b)) for a, b in spans])
    return wide.unpivot([], [f"`{name(a, b)}`" for a, b in spans], "bucket", "images")


def crop_scale_report(plan: DataFrame, annotations: DataFrame, resolution: int) -> DataFrame:
    """Crop sizes, scale factors and objects kept, per crop variant."""
    whole = plan.withColumns({"cw": F.col("width"), "ch": F.col("height"), "cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint"),
                              "variant": F.lit("whole_image")})
    both = plan.withColumn("variant", F.lit("random_crop")).unionByName(whole)
    kept = (augment.crop_boxes(annotations.join(both, "image_id"), resolution).groupBy("variant", "image_id")
            .agg(F.count(F.lit(1)).alias("kept")))
    rows = both.join(kept, ["variant", "image_id"], "left").na.fill(0, ["kept"])
    sides = F.array(F.col("cw"), F.col("ch"))
    out = []
    for col in ("cw", "ch"):
        out += [F.min(col).alias(f"{col}_min"), F.round(F.avg(col), 6).alias(f"{col}_mean"), F.max(col).alias(f"{col}_max")]
    scale = F.lit(resolution) * (1 / F.col("cw") + 1 / F.col("ch")) / 2
    return rows.groupBy("variant").agg(
        *out, F.round(F.avg(scale), 6).alias("scale_mean"), F.round(F.avg("kept"), 6).alias("mean_objects"),
        F.round(F.avg(F.aggregate(F.transform(F.arrays_zip(F.array("cw", "ch").alias("s"), F.array("width", "height").alias("f")),
                                              lambda z: (z["s"] >= z["f"] - 1).cast("double")), F.lit(0.0), lambda a, v: a + v) / 2), 6)
        .alias("full_image_frac"))


def small_object_gain(plan: DataFrame, annotations: DataFrame, resolution: int, small_area: int = SMALL_AREA) -> DataFrame:
    """How many more pixels small objects get from crop-then-scale than from scaling the whole image."""
    small = annotations.where(F.col("w") * F.col("h") < small_area).join(plan, "image_id")
    whole = F.col("w") * F.col("h") * F.lit(float(resolution) ** 2) / (F.col("width") * F.col("height"))
    cut = augment.crop_boxes(small.withColumn("whole_px", whole), resolution)
    ratio = F.col("w") * F.col("h") / F.col("whole_px")
    return cut.agg(F.count(F.lit(1)).alias("objects"), F.round(F.avg(ratio), 6).alias("mean_ratio"),
                   F.round(F.median(ratio), 6).alias("median_ratio"))


def d4_invariants(slabs: DataFrame, width: int, height: int) -> DataFrame:
    """Per operation: objects compared and the largest change of mask and box area."""
    keys = ["image_id", "gt_id"]
    w, h = F.lit(width).cast("bigint"), F.lit(height).cast("bigint")
    before = masks.mask_stats(slabs, keys).select(*keys, F.col("area").alias("a0"), (F.col("w") * F.col("h")).alias("b0"))
    moved = {"vflip": masks.flip_vertical(slabs, h), "hflip": masks.flip_horizontal(slabs, w)}
    moved.update({f"rot90_k{k}": masks.rotate_quarter(slabs, k, w, h) for k in (1, 2, 3)})
    every = None
    for op, df in moved.items():
        tagged = df.withColumn("op", F.lit(op))
        every = tagged if every is None else every.unionByName(tagged)
    after = masks.mask_stats(every, ["op", *keys])
    both = after.join(before, keys, "full_outer")
    box = F.abs(F.col("w") * F.col("h") - F.col("b0")) / F.col("b0")
    same = F.count_if(F.col("op").isNull() | F.col("a0").isNull()) == 0
    return (both.groupBy("op").agg(F.count(F.lit(1)).alias("n_obj"), F.max(F.abs(F.col("area") - F.col("a0"))).alias("max_mask_area_delta"),
                                   F.max(box).alias("max_box_area_rel_delta"), same.alias("same"))
            .withColumn("ok", F.col("same") & (F.col("max_mask_area_delta") == 0) & (F.col("max_box_area_rel_delta") < 1e-3)).drop("same"))
