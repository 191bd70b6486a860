"""From raw samples to checked dataset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masklake.operators import cleaning, digests, parsing, views
from masklake.session import materialize
from masklake.sources import sinks

PLACE = ["part", "split", "bucket"]


def export_tables(samples: DataFrame, collapse: bool = True) -> dict[str, DataFrame]:
    """`images`, `annotations`, `categories` of raw samples `(split, image_id, width, height, coco_annotations)`."""
    sized = cleaning.image_size(samples)
    rows = materialize(parsing.annotation_rows(parsing.parse_payload(sized)), "annotations")
    cleaned = cleaning.clean_annotations(rows, collapse=collapse)
    ids = cleaning.assign_ids(cleaned.drop("segmentation"), "raw_id", ["image_id", "local_index"])
    kept = ids.where("drop_reason IS NULL")
    images = sized.select("image_id", "split", "width", "height", F.concat(
        F.lit("images/"), "split", F.lit("/"), "split", F.lit("_"), F.lpad(F.col("image_id").cast("string"), 6, "0"), F.lit(".png")).alias("file_name"))
    return {"images": images, "categories": cleaning.category_table(cleaned),
            "annotations": kept.select("id", "image_id", "split", "category_id", "original_category_id", "x", "y", "w", "h",
                                       "polygons", "area", "iscrowd", F.col("raw_id").alias("source_annotation_id"))}


def _refuse(differences: DataFrame, what: str) -> None:
    """Raises when two digest tables differ, naming some of the places."""
    found = differences.limit(20).collect()
    if found:
        places = ", ".join(f"{r.part} of {r.split} bucket {r.bucket} {r.change}" for r in found)
        raise views.ContractError(f"{what}: {places}")


def prepare_views(images: DataFrame, annotations: DataFrame, root: str, arm: str = "prompt-view",
                  expected_images: dict[str, int] | None = None) -> DataFrame:
    """Writes the category-preserving view below `root` and signs it; returns the manifest, one row per split.

    `images(image_id, split, file_name, ...)`, `annotations(ann_id, image_id, split, category_id, original_category_id, iscrowd, ...)`.
    A source that breaks `view_checks`, a manifest that breaks its rules, a source that differs from the signed one and an existing view
    that differs from its source are refused before anything is written. The manifest is written last: without it the view is not
    prepared, and a job that was lost on the way can run again.
    """
    spark = images.sparkSession
    views.require(views.view_checks(images, annotations))
    view = views.restore_categories(annotations)
    trees = materialize(views.view_trees(images, annotations, view), "trees")
    manifest = materialize(views.signed_manifest(images, annotations, trees, arm, "annotations", "view"), "manifest")
    rules = views.signed_checks(manifest, arm, "annotations", "view").unionByName(views.manifest_checks(manifest, expected_images))
    views.require(rules.withColumn("detail", F.coalesce("split", F.lit("all splits"))))
    if sinks.path_exists(spark, f"{root}/manifest/_SUCCESS"):
        _refuse(digests.differing(spark.read.parquet(f"{root}/trees"), trees, PLACE), "the source changed since the view was prepared")
    if sinks.path_exists(spark, f"{root}/view/_SUCCESS"):
        _refuse(_view_drift(spark, root, trees), "the existing view differs from its source")
    else:
        view.write.mode("overwrite").parquet(f"{root}/view")
    if not sinks.path_exists(spark, f"{root}/manifest/_SUCCESS"):
        trees.write.mode("overwrite").parquet(f"{root}/trees")
        manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def _view_drift(spark: SparkSession, root: str, trees: DataFrame) -> DataFrame:
    written = digests.bucket_digests(spark.read.parquet(f"{root}/view"), ["ann_id"], ["split"]).select(F.lit("view").alias("part"), "*")
    return digests.differing(trees.where("part = 'view'"), written, PLACE)


def view_drift(images: DataFrame, annotations: DataFrame, root: str) -> DataFrame:
    """Buckets in which the source, or the written view, is not what was signed: `(part, split, bucket, rows_before, rows_after, change)`."""
    spark = images.sparkSession
    signed = spark.read.parquet(f"{root}/trees")
    now = views.view_trees(images, annotations, views.restore_categories(annotations))
    source = digests.differing(signed.where("part <> 'view'"), now.where("part <> 'view'"), PLACE)
    return source.unionByName(_view_drift(spark, root, signed))


def verify_views(images: DataFrame, annotations: DataFrame, root: str, arm: str = "prompt-view",
                 expected_images: dict[str, int] | None = None) -> DataFrame:
    """The signed manifest of a prepared view; a missing or broken one, a drifted source and a drifted view are refused."""
    spark = images.sparkSession
    if not sinks.path_exists(spark, f"{root}/manifest/_SUCCESS"):
        raise views.ContractError(f"{root} holds no prepared view")
    manifest = spark.read.parquet(f"{root}/manifest")
    rules = views.signed_checks(manifest, arm, "annotations", "view").unionByName(views.manifest_checks(manifest, expected_images))
    views.require(rules.withColumn("detail", F.coalesce("split", F.lit("all splits"))))
    signed = spark.read.parquet(f"{root}/trees")
    again = views.signed_manifest(images, annotations, signed, arm, "annotations", "view")
    if not manifest.exceptAll(again).isEmpty():
        raise views.ContractError("the manifest does not belong to the digests beside it, or its counts are not the source's")
    _refuse(view_drift(images, annotations, root), "the prepared view does not hold any more")
    return manifest
