"""Turning raw annotations into the exported form, with the reason of every drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masklake.functions.bind import let
from masklake.functions.geometry import clip_box, polygon_area
from masklake.operators import prefix

# Per-image object limit of the training filter, smallest kept mask, default names.
MAX_OBJECTS = 1000
MIN_MASK_AREA = 4
ONLY_CATEGORY, ONLY_CATEGORY_NAME = 1, "tree"


def clip_polygon(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda v, i: F.least(
        F.greatest(v, F.lit(0.0)), F.when(i % 2 == 0, width).otherwise(height).cast("double")))


def usable_shape(p: Column) -> Column:
    """A polygon struct with at least three points, paired coordinates and numbers only."""
    return (p["n"] >= 6) & (p["n"] % 2 == 0) & p["numeric"]


def has_pixels(points: Column) -> Column:
    """A flat polygon with an extent on both axes and at least one pixel of area."""
    extent = lambda odd: let(F.filter(points, lambda v, i: i % 2 == odd), lambda side: F.array_max(side) > F.array_min(side))
    return extent(0) & extent(1) & (polygon_area(points) >= 1.0)


def clean_annotations(rows: DataFrame, collapse: bool = True, clip: bool = True) -> DataFrame:
    """Clipped box and polygons, category, area and `drop_reason` (NULL when the annotation is kept).

    The exported `area` is that of the clipped box, not of the mask. Run-length masks are passed through.
    Reasons in order: a box that is not four numbers, an unusable segmentation, an empty mask, a box with
    nothing left inside the image.
    """
    width, height, seg = F.col("width"), F.col("height"), F.col("segmentation")
    shapes = F.transform(F.filter(seg["polygons"], usable_shape),
                         lambda p: clip_polygon(p["points"], width, height) if clip else p["points"])
    part = lambda i: F.get("bbox", F.lit(i))
    box = F.when((F.col("bbox_len") == 4) & F.col("bbox_numeric"),
                 clip_box(part(0), part(1), part(2), part(3), width, height))

    def judge(found: Column) -> Column:
        left = F.filter(found["shapes"], has_pixels)
        return let(left, lambda polygons: F.struct(
            polygons.alias("polygons"), found["box"].alias("box"),
            F.when((F.col("bbox_len") != 4) | ~F.col("bbox_numeric"), "invalid_bbox")
            .when(F.col("segmentation_is_empty_list"), "empty_mask")
            .when(found["kind"].isin("missing", "malformed"), "invalid_segmentation")
            .when((found["kind"] == "polygons") & (F.size(polygons) == 0),
                  F.when(F.size(found["shapes"]) > 0, "empty_mask").otherwise("invalid_segmentation"))
            .when(found["box"].isNull(), "invalid_bbox").alias("reason")))

    rows = rows.withColumn("_r", let(F.struct(shapes.alias("shapes"), box.alias("box"), seg["kind"].alias("kind")), judge))
    original = F.coalesce("category_id", F.lit(ONLY_CATEGORY).cast("bigint"))
    return (rows.withColumns({
        "original_category_id": original,
        "category_id": F.lit(ONLY_CATEGORY).cast("bigint") if collapse else original,
        "polygons": F.col("_r.polygons"), "drop_reason": F.col("_r.reason"),
        **{c: F.col(f"_r.box.{c}") for c in "xywh"}, "area": F.col("_r.box.w") * F.col("_r.box.h")}).drop("_r"))


def assign_ids(rows: DataFrame, raw_id: str, order: list[str], name: str = "id") -> DataFrame:
    """Unique ids: the first row of a raw id keeps it, repeats get numbers above the largest raw id.

    Dropped rows take part. Repeats are numbered in `order` over the whole table by ranges, so a raw id
    shared by very many rows is no hot spot. The replacement numbers differ from a sequential scan's.
    """
    place = F.struct(*order)
    first = rows.groupBy(raw_id).agg(F.min(place).alias("_first"))
    marked = rows.withColumn("_place", place).join(first, raw_id)
    keep = marked.where("_place = _first").withColumn(name, F.col(raw_id))
    repeats = marked.where("_place <> _first")
    top = rows.agg(F.coalesce(F.max(raw_id), F.lit(0)).alias("_top"))
    numbered = prefix.row_numbers(repeats.drop("_first", "_place"), [F.col(c) for c in order], "_rn")
    fresh = numbered.join(top.hint("broadcast")).withColumn(name, F.col("_top") + F.col("_rn")).drop("_top", "_rn")
    return keep.drop("_first", "_place").select(*rows.columns, name).unionByName(fresh.select(*rows.columns, name))


def export_outcomes(images: DataFrame, cleaned: DataFrame, skip_empty: bool = False) -> DataFrame:
    """What happened to the images: counts of every outcome, one row."""
    per = cleaned.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(F.col("drop_reason").isNull()).alias("kept"),
        F.count_if(F.col("drop_reason") == "empty_mask").alias("empty_masks"))
    all_images = images.select("image_id").join(per, "image_id", "left").na.fill(0)
    no_raw, emptied = F.col("raw") == 0, (F.col("raw") > 0) & (F.col("kept") == 0)
    skipped = (no_raw | emptied) if skip_empty else F.lit(False)
    return all_images.agg(
        F.count(F.lit(1)).alias("images_total"), F.count_if(no_raw).alias("images_with_no_raw_annotations"),
        F.count_if(emptied).alias("images_empty_after_cleaning"),
        F.count_if(no_raw & skipped).alias("images_skipped_no_raw_annotations"),
        F.count_if(emptied & skipped).alias("images_skipped_empty_after_cleaning"),
        F.count_if((F.col("kept") == 0) & ~skipped).alias("images_retained_empty"),
        F.count_if(~skipped).alias("images_exported"),
        F.coalesce(F.sum("empty_masks"), F.lit(0)).alias("dropped_annotations_empty_mask"))


def category_table(cleaned: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """`(id, name)` of the categories in use and declared, with default names for undeclared ones."""
    default = F.when(F.col("id") == ONLY_CATEGORY, ONLY_CATEGORY_NAME).otherwise(F.concat(F.lit("category_"), F.col("id").cast("string")))
    used = cleaned.where("drop_reason IS NULL").select(F.col("category_id").alias("id")).distinct()
    always = cleaned.sparkSession.range(ONLY_CATEGORY, ONLY_CATEGORY + 1)
    if declared is None:
        declared = always.select("id", F.lit(ONLY_CATEGORY_NAME).alias("name"))
    ids = used.union(declared.select("id")).union(always).distinct()
    named = declared.groupBy("id").agg(F.max("name").alias("declared_name"))
    return ids.join(named, "id", "left").select("id", F.coalesce("declared_name", default).alias("name"))


def image_size(samples: DataFrame, default: int = 2048) -> DataFrame:
    return samples.withColumns({"width": F.coalesce("width", F.lit(default).cast("bigint")),
                                "height": F.coalesce("height", F.lit(default).cast("bigint"))})


def drop_crowds(rows: DataFrame) -> DataFrame:
    return rows.where("iscrowd = 0")


def drop_crowded_queries(rows: DataFrame, limit: int = MAX_OBJECTS, keys: tuple[str, ...] = ("image_id", "category_id")) -> DataFrame:
    """Rows of (image, category) pairs with at most `limit` objects; counts are combined before the join."""
    full = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return rows.join(full, list(keys), "left_anti")


def filter_predictions(preds: DataFrame, score: float, min_area: int = MIN_MASK_AREA) -> DataFrame:
    return preds.where((F.col("score") >= score) & (F.col("area") >= min_area))
