"""Top-k selections over images and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masklake.operators import boundary, matching


def merge_top(dumps: list[DataFrame], k: int, group: list[str] | None = None) -> DataFrame:
    """Best `k` predictions per group after merging several producers' tables.

    A table that carries mask and box sizes (`mask_h, mask_w, w, h`) must not hold placeholder masks; the merge is refused if one does.
    """
    merged = dumps[0]
    for dump in dumps[1:]:
        merged = merged.unionByName(dump)
    if {"mask_h", "mask_w", "w", "h"} <= set(merged.columns) and not placeholder_masks(merged).isEmpty():
        raise ValueError("a producer's masks are placeholders of one pixel; merge real masks")
    return matching.top_per_image(merged, k, group)


def placeholder_masks(preds: DataFrame) -> DataFrame:
    """Predictions whose mask grid is 1 x 1 although the box is in pixels; must be empty."""
    return preds.where("mask_h = 1 AND mask_w = 1 AND (w > 1 OR h > 1)")


def densest_images(images: DataFrame, gts: DataFrame, n: int, min_gt: int = 5) -> DataFrame:
    """The `n` images with most annotations, ties to the lower id."""
    counts = gts.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_gt")).where(F.col("n_gt") >= min_gt)
    return (counts.join(images.select("image_id"), "image_id", "left_semi")
            .orderBy(F.col("n_gt").desc(), "image_id").limit(n))


def best_boundary_images(images: DataFrame, preds: DataFrame, gts: DataFrame, n: int, *, score: float,
                         min_gt: int = 5, pool: int = 64) -> DataFrame:
    """The `n` best images by union boundary IoU within the `pool` densest ones."""
    chosen = densest_images(images, gts, pool, min_gt)
    return (scored_images(images.join(chosen, "image_id", "left_semi"), preds, gts, score)
            .orderBy(F.col("biou").desc(), "image_id").limit(n))


def scored_images(images: DataFrame, preds: DataFrame, gts: DataFrame, score: float) -> DataFrame:
    """Union boundary IoU of images that have predictions at `score` or above."""
    p = preds.where(F.col("score") >= score).join(images, "image_id", "left_semi")
    g = gts.join(images, "image_id", "left_semi")
    return boundary.union_boundary_iou(images, p, g).where("pred_px > 0").select("image_id", "biou")


def best_per_density(images: DataFrame, preds: DataFrame, gts: DataFrame, buckets: list[tuple[int, int | None]],
                     per_bucket: int, *, score: float) -> DataFrame:
    """Best images by union boundary IoU in each half-open annotation-count bucket, the last one open."""
    counts = gts.groupBy("image_id").agg(F.count_distinct("gt_id").alias("n_gt"))
    spans = F.array(*[F.struct(F.lit(f"{a}-{'+' if b is None else b}").alias("bucket"), F.lit(a).alias("lo"),
                               F.lit(b).cast("int").alias("hi")) for a, b in buckets])
    inside = F.filter(spans, lambda s: (F.col("n_gt") >= s["lo"]) & (s["hi"].isNull() | (F.col("n_gt") < s["hi"])))
    placed = counts.withColumn("_b", F.explode(inside)).select("image_id", "n_gt", "_b.bucket")
    scored = scored_images(images.join(placed, "image_id", "left_semi"), preds, gts, score)
    order = Window.partitionBy("bucket").orderBy(F.col("biou").desc(), "image_id")
    return (placed.join(scored, "image_id").withColumn("pos", F.row_number().over(order))
            .where(F.col("pos") <= per_bucket).select("bucket", "pos", "image_id", "n_gt", "biou"))
