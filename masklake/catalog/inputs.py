"""Operator inputs in their working shape, cut from the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masklake.catalog.fixtures import spark_view
from masklake.operators.masks import box_slabs


def pred_slabs(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions as one-slab masks with their attributes."""
    p = spark_view(spark, sf, "fx_pred").withColumn("area", F.col("w") * F.col("h"))
    return box_slabs(p).select("image_id", "category_id", "pred_id", "score", "area", "c0", "c1", "r0", "r1")


def gt_slabs(spark: SparkSession, sf: str, crowd_others: int | None = None) -> DataFrame:
    """Annotations as one-slab masks; `crowd_others` keeps one original category and makes the rest crowd."""
    g = spark_view(spark, sf, "fx_gt")
    if crowd_others is not None:
        g = g.withColumn("iscrowd", F.when(F.col("original_category_id") == crowd_others, F.col("iscrowd"))
                         .otherwise(F.lit(1).cast("bigint")))
    g = g.withColumns({"gt_id": F.col("ann_id"), "area_mask": F.col("w") * F.col("h"),
                       "area_meta": F.col("w") * F.col("h")})
    return box_slabs(g).select("image_id", "category_id", "gt_id", "original_category_id", "iscrowd",
                               "area_mask", "area_meta", "c0", "c1", "r0", "r1")


def as_ranked_rows(preds: DataFrame) -> DataFrame:
    """Prediction attributes without geometry."""
    return preds.select("image_id", "category_id", "pred_id", "score", "area")


def shaped_slabs(slabs: DataFrame, key: str) -> DataFrame:
    """One-slab masks turned into shapes by their key: every third an L, every third a ring, where there is room; `n_slabs` says how many pieces."""
    w, h = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    x, y = F.col("c0") + F.floor(w / 3), F.col("r0") + F.floor(h / 3)
    part = lambda a, b, c, d: F.struct(*[F.lit(v).cast("bigint").alias(n) if isinstance(v, int) else v.cast("bigint").alias(n)
                                         for n, v in zip(("c0", "c1", "r0", "r1"), (a, b, c, d), strict=True)])
    c0, c1, r0, r1 = (F.col(c) for c in ("c0", "c1", "r0", "r1"))
    corner = F.array(part(c0, c1, r0, y), part(c0, x, y, r1))
    ring = F.array(part(c0, c1, r0, y), part(c0, x, y, y + 1), part(c1 - 1, c1, y, y + 1), part(c0, c1, y + 1, r1))
    kind = F.when((w < 6) | (h < 6), 0).otherwise(F.pmod(F.col(key), F.lit(3)))
    shapes = F.when(kind == 1, corner).when(kind == 2, ring).otherwise(F.array(part(c0, c1, r0, r1)))
    return (slabs.withColumn("_parts", shapes).withColumn("n_slabs", F.size("_parts")).drop("c0", "c1", "r0", "r1")
            .withColumn("_p", F.explode("_parts")).select(*[c for c in slabs.columns if c not in ("c0", "c1", "r0", "r1")], "n_slabs", "_p.*"))


def shapes_sql(source: str, key: str) -> str:
    """The same shapes as boxes (x, y, w, h) for the oracle."""
    return f"""(SELECT image_id, {key}, unnest(CASE WHEN w < 6 OR h < 6 OR {key} % 3 = 0 THEN [[x, y, w, h]]
        WHEN {key} % 3 = 1 THEN [[x, y, w, h // 3], [x, y + h // 3, w // 3, h - h // 3]]
        ELSE [[x, y, w, h // 3], [x, y + h // 3, w // 3, 1], [x + w - 1, y + h // 3, 1, 1], [x, y + h // 3 + 1, w, h - h // 3 - 1]] END) AS b FROM {source})"""
