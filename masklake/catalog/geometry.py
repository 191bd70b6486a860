"""Registered queries: views, manifests, tiling, mask algebra, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from masklake.catalog import inputs
from masklake.catalog.evaluation import OVERLAP, TOUCH, PLAIN_MET
from masklake.catalog.fixtures import CANVAS, oracle, spark_view
from masklake.functions import rle
from masklake.operators import augment, digests, masks, pairs, stats, tiling, views

big = lambda c: F.col(c).cast("bigint").alias(c)


def fold_split(spark, sf):
    placed, anns = views.fold_split(spark_view(spark, sf, "fx_images"), spark_view(spark, sf, "fx_gt"), 0)
    return views.fold_counts(placed, anns).select("part", big("images"), big("annotations"))


def restored(spark, sf):
    return views.restore_categories(spark_view(spark, sf, "fx_gt")).select("ann_id", "image_id", "category_id", "iscrowd")


def _split_images(spark, sf):
    return spark_view(spark, sf, "fx_images").select(
        "image_id", "width", "height", F.when(F.col("image_id") % 4 == 0, "test").otherwise("train").alias("split"),
        F.concat(F.lit("images/"), F.format_string("img_%06d.png", F.col("image_id").cast("int"))).alias("file_name"))


def _split_gt(spark, sf):
    return spark_view(spark, sf, "fx_gt").withColumn("split", F.when(F.col("image_id") % 4 == 0, "test").otherwise("train"))


def _damaged(spark, sf):
    """Images and annotations that break every rule somewhere; `DAMAGED` says the same in SQL."""
    images, gt = _split_images(spark, sf), _split_gt(spark, sf)
    i, a = F.col("image_id"), F.col("ann_id")
    images = images.unionByName(images.where("image_id % 50 = 0")).where("image_id % 17 <> 0").withColumns({
        "file_name": F.when(i % 11 == 0, F.concat(F.lit("../"), "file_name")).when(i % 13 != 0, F.col("file_name")),
        "width": F.when(i % 28 == 0, F.lit(500).cast("bigint")).otherwise(F.col("width")),
        "split": F.when(i % 36 == 0, F.lit("train")).otherwise(F.col("split"))})
    gt = gt.unionByName(gt.where("ann_id % 97 = 0")).withColumns({
        "original_category_id": F.when(a % 29 != 0, F.col("original_category_id")),
        "category_id": F.when(a % 31 == 0, F.lit(2).cast("bigint")).otherwise(F.col("category_id"))})
    return images, gt


DAMAGED = """bi AS (SELECT image_id, CASE WHEN image_id % 28 = 0 THEN 500 ELSE width END AS width, height,
            image_id % 11 = 0 OR image_id % 13 = 0 AS bad_path, CASE WHEN image_id % 4 = 0 AND image_id % 36 <> 0 THEN 'test' ELSE 'train' END AS split
            FROM (SELECT * FROM fx_images UNION ALL SELECT * FROM fx_images WHERE image_id % 50 = 0) q WHERE image_id % 17 <> 0),
        bg AS (SELECT ann_id, image_id, CASE WHEN ann_id % 29 <> 0 THEN original_category_id END AS original_category_id,
            CASE WHEN ann_id % 31 = 0 THEN 2 ELSE category_id END AS category_id FROM (SELECT * FROM fx_gt UNION ALL SELECT * FROM fx_gt WHERE ann_id % 97 = 0) q)"""


def view_source_checks(spark, sf):
    """The rules on sound tables and, as `damaged`, on broken ones."""
    sound = views.view_checks(_split_images(spark, sf), spark_view(spark, sf, "fx_gt"))
    return sound.withColumn("tables", F.lit("sound")).unionByName(views.view_checks(*_damaged(spark, sf)).withColumn("tables", F.lit("damaged")))


def class_counts(spark, sf):
    gt = spark_view(spark, sf, "fx_gt")
    out = None
    for name, keep in views.LABELS.items():
        row = views.class_split_counts(gt, keep).withColumn("class_split", F.lit(name))
        crowd = views.class_split(gt, keep).agg(F.sum("iscrowd").alias("crowd_after"))
        row = row.join(crowd.hint("broadcast"))
        out = row if out is None else out.unionByName(row)
    return out.select("class_split", big("scored"), big("ignored"), big("already_crowd"), big("crowd_after"))


def valid_regions(spark, sf):
    p = inputs.pred_slabs(spark, sf).select("image_id", "pred_id", *masks.SLAB)
    out = views.valid_region(p, masks.box_slabs(spark_view(spark, sf, "fx_regions")), ["pred_id"])
    return out.select("image_id", "pred_id", *[big(c) for c in ("area", "x", "y", "w", "h")])


def prompt_pairs(spark, sf):
    return views.prompt_pairs(spark_view(spark, sf, "fx_images"), spark_view(spark, sf, "fx_gt"))


def batch_plan(spark, sf):
    return views.batch_plan(spark_view(spark, sf, "fx_images"), 4, 2, seed=42, epoch=0)


def batch_counts(spark, sf):
    out = views.batch_counts(batch_plan(spark, sf), views.prompt_pairs(spark_view(spark, sf, "fx_images"), spark_view(spark, sf, "fx_gt")))
    return out.select(*[big(c) for c in out.columns])


def digest_match(spark, sf):
    """Digests of the annotations, of the same rows in another order, with some values changed, and with some rows less."""
    gt = spark_view(spark, sf, "fx_gt").select("ann_id", "image_id", "x", "y", "w", "h")
    changed = gt.withColumn("w", F.when(F.col("ann_id") % 1001 == 0, F.col("w") + 1).otherwise(F.col("w")))
    parts = {"as_is": gt, "reordered": gt.orderBy(F.desc("x"), "ann_id"), "changed": changed, "some_less": gt.where("ann_id % 1001 <> 0")}
    out = None
    for name, df in parts.items():
        one = views.content_digest(df).select(F.lit(name).alias("variant"), big("rows"), "digest")
        out = one if out is None else out.unionByName(one)
    return out


def manifest(spark, sf):
    out = views.view_manifest(_split_images(spark, sf), _split_gt(spark, sf))
    return out.select("split", *[big(c) for c in out.columns if c != "split"])


def manifest_rules(spark, sf):
    """Rules on a manifest whose test split has lost a category and whose training split has annotations without one."""
    gt = _split_gt(spark, sf).where("split = 'train' OR original_category_id = 2").withColumn(
        "original_category_id", F.when((F.col("split") == "test") | (F.col("ann_id") % 29 != 0), F.col("original_category_id")))
    return views.manifest_checks(views.view_manifest(_split_images(spark, sf), gt), {"train": 1, "test": 1})


def protocol(spark, sf):
    images, gt = _split_images(spark, sf).where("split = 'test'"), _split_gt(spark, sf).where("split = 'test'")
    check = lambda i, g: views.protocol_checks(i, g, n_images=439, n_annotations=30646, side=CANVAS, split="test")
    return check(images, gt).withColumn("tables", F.lit("sound")).unionByName(check(*_damaged(spark, sf)).withColumn("tables", F.lit("damaged")))


def tree_sql(source: str, key: str, row: str, by: str, buckets: int) -> str:
    """Digest tree of `source` as two tables, `h` and `tree`; `row` is the row's JSON text."""
    words = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS w{i}" for i in range(8))
    return f"""h AS (SELECT {by}, CAST('0x' || substr(sha256(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {buckets} AS bucket, sha256({row}) AS h FROM {source}),
        tree AS (SELECT {by}, bucket, n AS rows, sha256(concat_ws('|', n, w0, w1, w2, w3, w4, w5, w6, w7)) AS digest
                 FROM (SELECT {by}, bucket, count(*) AS n, {words} FROM h GROUP BY ALL) q)"""


def drift(spark, sf):
    """The annotations against a version in which some are changed, some gone and some repeated."""
    old = spark_view(spark, sf, "fx_gt").select("ann_id", "image_id", "x", "y", "w", "h")
    pick = lambda n, k: F.pmod("ann_id", F.lit(n)) == k
    new = old.where(~pick(997, 1)).withColumn("w", F.when(pick(997, 0), F.col("w") + 1).otherwise(F.col("w")))
    ids = F.when(pick(997, 2), F.array("ann_id", "ann_id")).when(pick(997, 3), F.array("ann_id", -F.col("ann_id"))).otherwise(F.array("ann_id"))
    new = new.withColumn("ann_id", F.explode(ids))
    return digests.drifted_rows(old, new, ["ann_id"])


def digest_tree(spark, sf):
    gt = _split_gt(spark, sf).select("ann_id", "image_id", "split", "w")
    return digests.bucket_digests(gt, ["ann_id"], ["split"], 64)


def protocol_record(spark, sf):
    return views.protocol_record(spark_view(spark, sf, "fx_images"), spark_view(spark, sf, "fx_gt").where("image_id % 7 <> 0"))


def signed_rules(spark, sf):
    """Rules on a signed manifest, once as it is and once for another arm and path and without a test split."""
    images, gt = _split_images(spark, sf), _split_gt(spark, sf)
    trees = views.view_trees(images, gt, views.restore_categories(gt))
    signed = views.signed_manifest(images, gt, trees, "prompt-view", "annotations", "view")
    sound = views.signed_checks(signed, "prompt-view", "annotations", "view").withColumn("manifest", F.lit("sound"))
    other = views.signed_checks(signed.where("split = 'train'"), "another", "annotations", "elsewhere").withColumn("manifest", F.lit("damaged"))
    return sound.unionByName(other)


def export_rules(spark, sf):
    images = _split_images(spark, sf)
    return views.export_checks(images, spark_view(spark, sf, "fx_gt"), images.where("image_id % 50 <> 0").select("file_name"), 0, 40)


def tile_starts(spark, sf):
    i = spark_view(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 900 + 100).alias("dim"))
    return (i.select("image_id", F.posexplode(tiling.tile_starts(F.col("dim"), F.least(F.lit(256).cast("bigint"), "dim"), 64)).alias("pos", "start"))
            .select("image_id", big("pos"), "start"))


def tile_grid(spark, sf):
    images = spark_view(spark, sf, "fx_images")
    return tiling.tile_grid(images, 256, 64, whole=F.col("image_id") % 10 == 0)


def tiles_of_objects(spark, sf):
    tiles = masks.box_slabs(tiling.tile_grid(spark_view(spark, sf, "fx_images"), 256, 64), "x0", "y0")
    gt = inputs.gt_slabs(spark, sf)
    return tiling.assign_to_tiles(gt, tiles, "gt_id", extent=CANVAS)


def _windows(spark, sf):
    """Every annotation's box as a half-scale mask in a window of its own place."""
    g = spark_view(spark, sf, "fx_gt")
    half = lambda c: F.floor(F.col(c) / 2)
    return g.select("image_id", F.col("ann_id").alias("pred_id"), F.lit(200).cast("bigint").alias("mw"), F.lit(128).cast("bigint").alias("mh"),
                    (F.col("ann_id") % 3 * 56).alias("x0"), (F.col("ann_id") % 2 * 128).alias("y0"), F.lit(400).cast("bigint").alias("w"),
                    F.lit(384).cast("bigint").alias("h"),
                    (F.col("x") % 140).alias("c0"), (F.col("x") % 140 + half("w")).alias("c1"),
                    (F.col("y") % 70).alias("r0"), (F.col("y") % 70 + half("h")).alias("r1"))


def lifted(spark, sf):
    out, _ = tiling.lift(_windows(spark, sf), ["image_id", "pred_id"], min_area=4, margin=2)
    return out.select("image_id", "pred_id", *[big(c) for c in ("area", "gx", "gy", "gw", "gh", "lx0", "ly0")], "edge_touch")


def edge_flags(spark, sf):
    out, _ = tiling.lift(_windows(spark, sf), ["image_id", "pred_id"], min_area=4, margin=8)
    return out.groupBy("image_id").agg(F.count_if("edge_touch").alias("touching"), F.count(F.lit(1)).alias("n"))


def embedded(spark, sf):
    """Masks written as run lengths on the image canvas and read back."""
    s = inputs.gt_slabs(spark, sf).select("image_id", "gt_id", *masks.SLAB).withColumns(
        {"width": F.lit(CANVAS).cast("bigint"), "height": F.lit(CANVAS).cast("bigint")})
    runs = masks.slabs_to_runs(s, ["image_id", "gt_id", "width", "height"], "height")
    back = masks.runs_to_slabs(runs.withColumn("runs", rle.decode_counts(rle.encode_counts(F.col("runs")))), "runs", "height")
    return masks.mask_stats(back, ["image_id", "gt_id"]).select("image_id", "gt_id", *[big(c) for c in ("area", "x", "y", "w", "h")])


def cropped(spark, sf):
    s = inputs.gt_slabs(spark, sf).select("image_id", "gt_id", *masks.SLAB)
    v = lambda n: F.lit(n).cast("bigint")
    return masks.mask_stats(masks.crop(s, v(100), v(60), v(256), v(200)), ["image_id", "gt_id"]).select(
        "image_id", "gt_id", *[big(c) for c in ("area", "x", "y", "w", "h")])


def span_counts(spark, sf):
    """Column spans per image and their pixels."""
    s = inputs.gt_slabs(spark, sf).select("image_id", "gt_id", *masks.SLAB)
    return masks.column_spans(s).groupBy("image_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("r1") - F.col("r0")).alias("px"))


def _count_text(df):
    """Column-major counts text of a rectangle, made by the encoder from its runs."""
    h = F.lit(CANVAS).cast("bigint")
    gap = h - F.col("h")
    body = F.flatten(F.array_repeat(F.array(F.col("h"), gap), (F.col("w") - 1).cast("int")))
    runs = F.concat(F.array(F.col("x") * h + F.col("y")), body, F.array(F.col("h"), h * h - (F.col("x") + F.col("w") - 1) * h - F.col("y") - F.col("h")))
    return df.select("image_id", F.col("ann_id").alias("gt_id"), rle.encode_counts(runs).alias("counts"), h.alias("height"))


def decoded(spark, sf):
    text = _count_text(spark_view(spark, sf, "fx_gt"))
    slabs = masks.runs_to_slabs(text.withColumn("runs", rle.decode_counts(F.col("counts"))).drop("counts"), "runs", "height")
    return masks.mask_stats(slabs, ["image_id", "gt_id"]).select("image_id", "gt_id", *[big(c) for c in ("area", "x", "y", "w", "h", "n_slabs")])


def mask_boxes(spark, sf):
    s = inputs.pred_slabs(spark, sf)
    return masks.mask_stats(s, ["image_id", "pred_id"]).select("image_id", "pred_id", *[big(c) for c in ("area", "x", "y", "w", "h")])


def rasterised(spark, sf):
    """Polygon outlines turned into pixels by centre sampling."""
    from masklake.operators.raster import polygons_to_spans
    g = spark_view(spark, sf, "fx_gt")
    pts = F.array(*[c.cast("double") for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y"), F.col("x") + F.col("w"),
                                               F.col("y") + F.col("h"), F.col("x"), F.col("y") + F.col("h"))])
    spans = polygons_to_spans(g.select("image_id", F.col("ann_id").alias("gt_id"), pts.alias("points")), ["image_id", "gt_id"], "points")
    return masks.mask_stats(spans, ["image_id", "gt_id"]).select("image_id", "gt_id", *[big(c) for c in ("area", "x", "y", "w", "h")])


def intersection(spark, sf):
    met = pairs.intersections(inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf), ["image_id"], "pred_id", "gt_id", extent=CANVAS)
    return met.groupBy("image_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("inter").alias("px"))


def union_masks(spark, sf):
    u = masks.union(inputs.gt_slabs(spark, sf).select("image_id", *masks.SLAB), ["image_id"])
    return u.groupBy("image_id").agg(F.sum(masks.slab_pixels()).alias("px"))


def eroded(spark, sf):
    """Erosion by the general sweep, by each mask's own band width."""
    from masklake.functions.geometry import instance_band
    s = inputs.gt_slabs(spark, sf).select("image_id", "gt_id", instance_band(F.col("area_mask")).alias("d"), *masks.SLAB)
    return masks.mask_stats(masks.erode_general(s, ["image_id", "gt_id"]), ["image_id", "gt_id"]).select(
        "image_id", "gt_id", *[big(c) for c in ("area", "x", "y", "w", "h")])


def bands(spark, sf):
    from masklake.functions.geometry import instance_band
    s = inputs.gt_slabs(spark, sf).select("image_id", "gt_id", instance_band(F.col("area_mask")).alias("d"), F.lit(1).alias("n_slabs"), *masks.SLAB)
    b = masks.boundary_band(s, ["image_id", "gt_id"])
    return b.groupBy("image_id", "gt_id").agg(F.sum(masks.slab_pixels() * F.col("wt")).alias("band_px"))


def displayed(spark, sf):
    s = inputs.gt_slabs(spark, sf).select("image_id", "gt_id", *masks.SLAB)
    v = lambda n: F.lit(n).cast("bigint")
    return masks.mask_stats(masks.rescale(s, ["image_id", "gt_id"], v(CANVAS), v(CANVAS), v(256), v(256)), ["image_id", "gt_id"]).select(
        "image_id", "gt_id", *[big(c) for c in ("area", "x", "y", "w", "h")])


def mask_components(spark, sf):
    """Connected regions of all annotations of an image taken together."""
    out = tiling.components(inputs.gt_slabs(spark, sf).select("image_id", *masks.SLAB), ["image_id"])
    one = out.groupBy("image_id", "component").agg(F.first("area").alias("area"))
    return one.groupBy("image_id").agg(F.count(F.lit(1)).alias("components"), F.sum("area").alias("px"), F.max("area").alias("largest"))


def transformed(spark, sf):
    return augment.d4_boxes(spark_view(spark, sf, "fx_gt").withColumns({"width": F.lit(600).cast("bigint"), "height": F.lit(CANVAS).cast("bigint")})).select(
        "op", "ann_id", *[big(c) for c in ("x", "y", "w", "h")])


def choices(spark, sf):
    return augment.augmentation_plan(spark_view(spark, sf, "fx_images"), seed=0, low=224, high=288)


def cropped_objects(spark, sf):
    """Annotations after a fixed crop per image, scaled to 1008."""
    g = spark_view(spark, sf, "fx_gt").withColumns({
        "cx": F.col("image_id") % 200, "cy": F.col("image_id") % 100, "cw": F.lit(256).cast("bigint"), "ch": F.lit(300).cast("bigint")})
    out = augment.crop_boxes(g, 1008)
    return out.select("ann_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


def gt_summary(spark, sf):
    return stats.count_summary(spark_view(spark, sf, "fx_images"), spark_view(spark, sf, "fx_gt"))


def gt_buckets(spark, sf):
    return stats.count_buckets(spark_view(spark, sf, "fx_images"), spark_view(spark, sf, "fx_gt"), (0, 1, 10, 20, 25, 30, 35, 50, 100))


def crop_scale(spark, sf):
    images = spark_view(spark, sf, "fx_images")
    return stats.crop_scale_report(augment.augmentation_plan(images, seed=0, low=224, high=288), spark_view(spark, sf, "fx_gt"), 1008)


def pixel_gain(spark, sf):
    plan = augment.augmentation_plan(spark_view(spark, sf, "fx_images"), seed=0, low=224, high=288)
    return stats.small_object_gain(plan, spark_view(spark, sf, "fx_gt"), 1008)


def d4_invariants(spark, sf):
    s = inputs.gt_slabs(spark, sf).select("image_id", "gt_id", *masks.SLAB)
    return stats.d4_invariants(s, 600, CANVAS)


PLAN5 = """plan AS (SELECT image_id, p // 8 AS group_id, p // 4 AS batch_id, p % 4 AS slot FROM (
          SELECT image_id, row_number() OVER (ORDER BY md5(concat_ws(':', image_id, 42, 0)), image_id) - 1 AS p, count(*) OVER () AS n FROM fx_images) q
          WHERE p < n // 8 * 8)"""


def _draw(op: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', image_id, 0, '{op}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


AUGMENT = f"""drawn AS (SELECT image_id, width, height, least(CAST(floor({_draw('crop_w')} * 65) AS BIGINT) + 224, width) AS cw,
            least(CAST(floor({_draw('crop_h')} * 65) AS BIGINT) + 224, height) AS ch, {_draw('vflip')} < 0.5 AS vflip,
            CASE WHEN {_draw('turn')} < 0.75 THEN CAST(floor({_draw('quarter')} * 3) AS BIGINT) + 1 ELSE 0 END AS quarters FROM fx_images),
        plan AS (SELECT *, CAST(floor({_draw('crop_x')} * (width - cw + 1)) AS BIGINT) AS cx,
            CAST(floor({_draw('crop_y')} * (height - ch + 1)) AS BIGINT) AS cy FROM drawn)"""
CROPPED = """SELECT *, greatest(x - cx, 0) AS x0, least(x + w - cx, cw) AS x1, greatest(y - cy, 0) AS y0, least(y + h - cy, ch) AS y1"""
BAND = "greatest(1, CAST(round_even(0.19 * (2 * sqrt(CAST(w * h AS DOUBLE) / pi())), 0) AS BIGINT))"
SPLIT = "CASE WHEN image_id % 4 = 0 THEN 'test' ELSE 'train' END"
DISPLAY = ("SELECT image_id, ann_id AS gt_id, x // 2 AS x, y // 2 AS y, (x + w + 1) // 2 - x // 2 AS w, (y + h + 1) // 2 - y // 2 AS h FROM fx_gt")
LIFT = """SELECT image_id, ann_id AS pred_id, ann_id % 3 * 56 AS wx, ann_id % 2 * 128 AS wy, (x % 140) * 2 AS lx0, (y % 70) * 3 AS ly0,
          (w // 2) * 2 AS gw, (h // 2) * 3 AS gh FROM fx_gt"""
CROP = """SELECT image_id, ann_id AS gt_id, greatest(x, 100) - 100 AS x, greatest(y, 60) - 60 AS y,
          least(x + w, 356) - greatest(x, 100) AS w, least(y + h, 260) - greatest(y, 60) AS h FROM fx_gt"""
OKROW = "SELECT '{}' AS \"check\", CAST({} AS BOOLEAN) AS ok, CAST({} AS STRING) AS detail"
SUMMARY = ["p50", "p75", "p90", "p95", "p99", "p100"]

CASES = {
    "spl1_fold_split": (fold_split, oracle("""SELECT part, count(*) AS images, CAST(coalesce(sum(n), 0) AS BIGINT) AS annotations FROM (
        SELECT i.image_id, CASE WHEN validation_fold = 0 THEN 'val' WHEN validation_fold > 0 THEN 'train' ELSE 'excluded' END AS part,
               CASE WHEN validation_fold >= 0 THEN (SELECT count(*) FROM fx_gt g WHERE g.image_id = i.image_id) END AS n FROM fx_images i) q GROUP BY part""",
        "fx_images", "fx_gt")),
    "view1_restored_categories": (restored, oracle("SELECT ann_id, image_id, original_category_id AS category_id, iscrowd FROM fx_gt", "fx_gt")),
    "view1_source_checks": (view_source_checks, oracle(f"WITH {DAMAGED} " + " UNION ALL ".join(
        f"SELECT q.*, '{name}' AS tables FROM (" + " UNION ALL ".join([
            OKROW.format("image ids are unique", f"(SELECT count(*) = count(DISTINCT image_id) FROM {i})", f"(SELECT count(*) - count(DISTINCT image_id) FROM {i})"),
            OKROW.format("annotation ids are unique", f"(SELECT count(*) = count(DISTINCT ann_id) FROM {g})", f"(SELECT count(*) - count(DISTINCT ann_id) FROM {g})"),
            OKROW.format("image paths are relative", f"({paths}) = 0", f"({paths})"),
            OKROW.format("original categories are 1 or 2", f"(SELECT count(*) FILTER (WHERE original_category_id IS NULL) FROM {g}) = 0",
                         f"(SELECT count(*) FILTER (WHERE original_category_id IS NULL) FROM {g})"),
            OKROW.format("source is collapsed", f"(SELECT count(*) FILTER (WHERE category_id <> 1) FROM {g}) = 0", f"(SELECT count(*) FILTER (WHERE category_id <> 1) FROM {g})"),
            OKROW.format("annotations refer to known images", f"(SELECT count(*) = 0 FROM {g} ANTI JOIN {i} USING (image_id))",
                         f"(SELECT count(*) FROM {g} ANTI JOIN {i} USING (image_id))")]) + ") q"
        for name, i, g, paths in (("sound", "fx_images", "fx_gt", "SELECT 0"), ("damaged", "bi", "bg", "SELECT count(*) FILTER (WHERE bad_path) FROM bi"))), "fx_images", "fx_gt")),
    "view2_class_split": (class_counts, oracle("""SELECT n AS class_split, count(*) FILTER (WHERE original_category_id = k AND iscrowd = 0) AS scored,
        count(*) FILTER (WHERE original_category_id <> k) AS ignored, count(*) FILTER (WHERE original_category_id = k AND iscrowd = 1) AS already_crowd,
        count(*) FILTER (WHERE original_category_id <> k OR iscrowd = 1) AS crowd_after
        FROM fx_gt CROSS JOIN (VALUES ('tree', 2), ('canopy', 1)) v(n, k) GROUP BY n""", "fx_gt")),
    "view3_valid_regions": (valid_regions, oracle("""SELECT image_id, pred_id, w * h AS area, x, y, w, h FROM (
        SELECT image_id, pred_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM (
          SELECT p.image_id, p.pred_id, greatest(p.x, max(r.x)) AS x0, greatest(p.y, max(r.y)) AS y0,
                 least(p.x + p.w, min(r.x + r.w)) AS x1, least(p.y + p.h, min(r.y + r.h)) AS y1
          FROM fx_pred p JOIN fx_regions r ON p.image_id = r.image_id GROUP BY p.image_id, p.pred_id, p.x, p.y, p.w, p.h) a) b WHERE w > 0 AND h > 0""",
        "fx_pred", "fx_regions")),
    "view4_prompt_pairs": (prompt_pairs, oracle("""SELECT i.image_id, CAST(k AS BIGINT) AS category_id, n AS prompt,
        (SELECT count(*) FROM fx_gt g WHERE g.image_id = i.image_id AND g.original_category_id = k) AS targets
        FROM fx_images i CROSS JOIN (VALUES ('tree', 2), ('canopy', 1)) v(n, k)""", "fx_images", "fx_gt")),
    "view5_batch_plan": (batch_plan, oracle(f"WITH {PLAN5} SELECT image_id, group_id, batch_id, slot FROM plan", "fx_images")),
    "view6_batch_counts": (batch_counts, oracle(f"""WITH {PLAN5} SELECT batch_id, count(*) * 2 AS pairs, count(*) AS images,
        CAST(sum(t) AS BIGINT) AS tree_targets, CAST(sum(c) AS BIGINT) AS canopy_targets FROM (SELECT i.image_id, batch_id, count(g.image_id) FILTER (WHERE original_category_id = 2) AS t,
        count(g.image_id) FILTER (WHERE original_category_id = 1) AS c FROM plan i LEFT JOIN fx_gt g USING (image_id) GROUP BY 1, 2) q GROUP BY 1""", "fx_images", "fx_gt")),
    "man1_content_digest": (digest_match, oracle("""WITH v AS (SELECT 'as_is' AS variant, * FROM fx_gt UNION ALL SELECT 'reordered', * FROM fx_gt
          UNION ALL SELECT 'changed', * REPLACE (CASE WHEN ann_id % 1001 = 0 THEN w + 1 ELSE w END AS w) FROM fx_gt
          UNION ALL SELECT 'some_less', * FROM fx_gt WHERE ann_id % 1001 <> 0),
        h AS (SELECT variant, sha256('{"ann_id":' || ann_id || ',"h":' || h || ',"image_id":' || image_id || ',"w":' || w || ',"x":' || x || ',"y":' || y || '}') AS h FROM v),
        b AS (SELECT variant, CAST('0x' || substr(h, 1, 2) AS BIGINT) AS bucket, count(*) AS n, """ + ", ".join(
            f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS w{i}" for i in range(8)) + """ FROM h GROUP BY 1, 2),
        d AS (SELECT variant, n, sha256(concat_ws('|', bucket, n, w0, w1, w2, w3, w4, w5, w6, w7)) AS d FROM b)
        SELECT variant, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM d GROUP BY 1""", "fx_gt")),
    "man1_drifted_rows": (drift, oracle("""SELECT ann_id, rows_before, rows_after, change FROM (
          SELECT ann_id, 1 AS rows_before, 1 AS rows_after, 'changed' AS change FROM fx_gt WHERE ann_id % 997 = 0
          UNION ALL SELECT ann_id, 1, 0, 'removed' FROM fx_gt WHERE ann_id % 997 = 1
          UNION ALL SELECT ann_id, 1, 2, 'changed' FROM fx_gt WHERE ann_id % 997 = 2
          UNION ALL SELECT -ann_id, 0, 1, 'added' FROM fx_gt WHERE ann_id % 997 = 3) q""", "fx_gt")),
    "man3_digest_tree": (digest_tree, oracle(f"""WITH g AS (SELECT *, {SPLIT} AS split FROM fx_gt), """ + tree_sql(
        "g", "ann_id", """'{"ann_id":' || ann_id || ',"image_id":' || image_id || ',"split":"' || split || '","w":' || w || '}'""", "split", 64)
        + " SELECT split, bucket, rows, digest FROM tree", "fx_gt")),
    "man4_signed_manifest": (signed_rules, oracle("""SELECT split, "check", ok, manifest FROM (
          SELECT s.split, v.n AS "check", true AS ok, 'sound' AS manifest FROM (VALUES ('train'), ('test')) s(split) CROSS JOIN (VALUES ('version'), ('arm'),
            ('category list'), ('source path'), ('view path'), ('source digest is SHA-256'), ('view digest is SHA-256')) v(n)
          UNION ALL SELECT 'train', v.n, v.n NOT IN ('arm', 'view path'), 'damaged' FROM (VALUES ('version'), ('arm'),
            ('category list'), ('source path'), ('view path'), ('source digest is SHA-256'), ('view digest is SHA-256')) v(n)
          UNION ALL SELECT NULL, 'splits are train and test', count(DISTINCT CASE WHEN image_id % 4 = 0 THEN 'test' ELSE 'train' END) = 2, 'sound' FROM fx_images
          UNION ALL SELECT NULL, 'splits are train and test', false, 'damaged') q""", "fx_images")),
    "man6_protocol_record": (protocol_record, oracle("""WITH g AS (SELECT * FROM fx_gt WHERE image_id % 7 <> 0), """ + tree_sql(
        "fx_images", "image_id", """'{"image_id":' || image_id || '}'""", "1 AS k", 4096).replace("SELECT 1 AS k, bucket", "SELECT bucket")
        + """ SELECT CAST(sum(rows) AS BIGINT) AS images, (SELECT count(*) FROM g) AS annotations,
          (SELECT count(*) FROM fx_images ANTI JOIN g USING (image_id)) AS images_without_annotations,
          sha256(string_agg(digest, '' ORDER BY bucket)) AS image_ids_sha256 FROM tree""", "fx_images", "fx_gt")),
    "man3_view_manifest": (manifest, oracle(f"""SELECT * FROM (SELECT {SPLIT} AS split, count(*) AS images FROM fx_images GROUP BY 1) i JOIN (
        SELECT {SPLIT} AS split, count(*) AS annotations, """ + ", ".join(
        [f"count(*) FILTER (WHERE original_category_id = {c}) AS category_{c}" for c in (1, 2)]
        + [f"count(*) FILTER (WHERE original_category_id = {c} AND iscrowd = {v}) AS category_{c}_crowd_{v}" for c in (1, 2) for v in (0, 1)])
        + " FROM fx_gt GROUP BY 1) a USING (split)", "fx_images", "fx_gt")),
    "man4_manifest_rules": (manifest_rules, oracle(f"""WITH g AS (SELECT {SPLIT} AS split, iscrowd,
          CASE WHEN image_id % 4 = 0 OR ann_id % 29 <> 0 THEN original_category_id END AS c FROM fx_gt WHERE image_id % 4 <> 0 OR original_category_id = 2),
        m AS (SELECT split, n, count(*) AS a, count(*) FILTER (WHERE c = 1) AS c1, count(*) FILTER (WHERE c = 2) AS c2,
          count(*) FILTER (WHERE c = 1 AND iscrowd = 0) AS s1, count(*) FILTER (WHERE c = 2 AND iscrowd = 0) AS s2
          FROM g JOIN (SELECT {SPLIT} AS split, count(*) AS n FROM fx_images GROUP BY 1) i USING (split) GROUP BY 1, 2)
        SELECT split, unnest(['categories are present', 'categories add up', 'crowd flags add up', 'scored targets of both categories', 'locked image count']) AS "check",
          unnest([c1 > 0 AND c2 > 0, c1 + c2 = a, true, s1 > 0 AND s2 > 0, n = 1]) AS ok FROM m""", "fx_images", "fx_gt")),
    "man6_protocol_checks": (protocol, oracle(f"""WITH {DAMAGED}, si AS (SELECT *, 'test' AS split FROM fx_images WHERE image_id % 4 = 0), sg AS (SELECT * FROM fx_gt WHERE image_id % 4 = 0)
        """ + " UNION ALL ".join(f"SELECT q.*, '{name}' AS tables FROM (" + " UNION ALL ".join(OKROW.format(*r) for r in [
            ("image count", f"(SELECT count(*) FROM {i}) = 439", f"(SELECT count(*) FROM {i})"),
            ("annotation count", f"(SELECT count(*) FROM {g}) = 30646", f"(SELECT count(*) FROM {g})"),
            ("image ids are unique", f"(SELECT count(*) = count(DISTINCT image_id) FROM {i})", f"(SELECT count(*) - count(DISTINCT image_id) FROM {i})"),
            ("image size", f"(SELECT count(*) FROM {i} WHERE width <> 512 OR height <> 512) = 0", f"(SELECT count(*) FROM {i} WHERE width <> 512 OR height <> 512)"),
            ("source split", f"(SELECT count(*) FROM {i} WHERE split <> 'test') = 0", f"(SELECT count(*) FROM {i} WHERE split <> 'test')"),
            ("annotations refer to known images", f"(SELECT count(*) = 0 FROM {g} ANTI JOIN {i} USING (image_id))", f"(SELECT count(*) FROM {g} ANTI JOIN {i} USING (image_id))"),
            ("category is collapsed", f"(SELECT count(*) FROM {g} WHERE category_id <> 1) = 0", f"(SELECT count(*) FROM {g} WHERE category_id <> 1)"),
            ("images without annotations", "true", f"(SELECT count(DISTINCT image_id) FROM {i} ANTI JOIN {g} USING (image_id))")]) + ") q"
            for name, i, g in (("sound", "si", "sg"), ("damaged", "bi", "bg"))), "fx_images", "fx_gt")),
    "man7_export_rules": (export_rules, oracle("""WITH n AS (SELECT (SELECT count(*) FROM fx_images WHERE image_id % 50 = 0) AS m,
        (SELECT max(c) FROM (SELECT count(*) AS c FROM fx_gt GROUP BY image_id) q) AS t, (SELECT count(*) FROM fx_images ANTI JOIN fx_gt USING (image_id)) AS e)
        """ + " UNION ALL ".join(OKROW.format(*r) + " FROM n" for r in [
            ("image files exist", "m = 0", "m"), ("objects per image", "t <= 40", "t"), ("empty images match the report", "e = 0", "e")]), "fx_images", "fx_gt")),
    "til1_tile_starts": (tile_starts, """SELECT p_partkey AS image_id, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY s) - 1 AS BIGINT) AS pos, s AS start FROM (
        SELECT DISTINCT p_partkey, unnest(list_append(range(0, greatest(p_partkey % 900 + 100 - 256, 0) + 1, 192), greatest(p_partkey % 900 + 100 - 256, 0))) AS s FROM part) q"""),
    "til2_tile_grid": (tile_grid, oracle("""SELECT image_id, 'r' || r || '_c' || c AS window_id, CAST(r AS BIGINT) AS tile_row, CAST(c AS BIGINT) AS tile_col,
        CAST([0, 192, 256][c + 1] AS BIGINT) AS x0, CAST([0, 192, 256][r + 1] AS BIGINT) AS y0, CAST(CASE WHEN image_id % 10 = 0 THEN 512 ELSE 256 END AS BIGINT) AS w,
        CAST(CASE WHEN image_id % 10 = 0 THEN 512 ELSE 256 END AS BIGINT) AS h
        FROM fx_images CROSS JOIN (SELECT unnest(range(3)) AS r) a CROSS JOIN (SELECT unnest(range(3)) AS c) b WHERE image_id % 10 <> 0 OR (r = 0 AND c = 0)""", "fx_images")),
    "til3_objects_in_tiles": (tiles_of_objects, oracle("""SELECT image_id, ann_id AS gt_id, 'r' || r || '_c' || c AS window_id FROM fx_gt
        CROSS JOIN (SELECT unnest(range(3)) AS r) a CROSS JOIN (SELECT unnest(range(3)) AS c) b SEMI JOIN fx_images USING (image_id)
        WHERE x < [0, 192, 256][c + 1] + 256 AND x + w > [0, 192, 256][c + 1] AND y < [0, 192, 256][r + 1] + 256 AND y + h > [0, 192, 256][r + 1]""", "fx_gt", "fx_images")),
    "til5_lifted_instances": (lifted, oracle(f"""SELECT image_id, pred_id, gw * gh AS area, wx + lx0 AS gx, wy + ly0 AS gy, gw, gh, lx0, ly0,
        lx0 <= 2 OR ly0 <= 2 OR lx0 + gw >= 398 OR ly0 + gh >= 382 AS edge_touch FROM ({LIFT}) q WHERE gw * gh >= 4""", "fx_gt")),
    "til6_edge_touch": (edge_flags, oracle(f"""SELECT image_id, count(*) FILTER (WHERE lx0 <= 8 OR ly0 <= 8 OR lx0 + gw >= 392 OR ly0 + gh >= 376) AS touching,
        count(*) AS n FROM ({LIFT}) q GROUP BY 1""", "fx_gt")),
    "til7_embedded_runs": (embedded, oracle("SELECT image_id, ann_id AS gt_id, w * h AS area, x, y, w, h FROM fx_gt", "fx_gt")),
    "til8_cropped_masks": (cropped, oracle(f"SELECT image_id, gt_id, w * h AS area, x, y, w, h FROM ({CROP}) q WHERE w > 0 AND h > 0", "fx_gt")),
    "msk1_decoded_counts": (decoded, oracle("SELECT image_id, ann_id AS gt_id, w * h AS area, x, y, w, h, w AS n_slabs FROM fx_gt", "fx_gt")),
    "msk2_column_spans": (span_counts, oracle("SELECT image_id, CAST(sum(w) AS BIGINT) AS spans, CAST(sum(w * h) AS BIGINT) AS px FROM fx_gt GROUP BY 1", "fx_gt")),
    "msk3_rasterised_polygons": (rasterised, oracle("SELECT image_id, ann_id AS gt_id, w * h AS area, x, y, w, h FROM fx_gt", "fx_gt")),
    "msk5_area_and_box": (mask_boxes, oracle("SELECT image_id, pred_id, w * h AS area, x, y, w, h FROM fx_pred", "fx_pred")),
    "msk6_intersections": (intersection, oracle(f"""WITH {PLAIN_MET} SELECT image_id, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS px FROM met GROUP BY 1""", "fx_pred", "fx_gt")),
    "msk7_union_masks": (union_masks, oracle("""WITH c AS (SELECT DISTINCT image_id, y, y + h AS y1, unnest(range(x, x + w)) AS col FROM fx_gt),
        o AS (SELECT *, max(y1) OVER (PARTITION BY image_id, col ORDER BY y, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c)
        SELECT image_id, CAST(sum(greatest(y1 - greatest(y, coalesce(m, 0)), 0)) AS BIGINT) AS px FROM o GROUP BY 1""", "fx_gt")),
    "msk10_erosion": (eroded, oracle(f"""SELECT image_id, ann_id AS gt_id, (w - 2 * d) * (h - 2 * d) AS area, x + d AS x, y + d AS y, w - 2 * d AS w, h - 2 * d AS h
        FROM (SELECT *, {BAND} AS d FROM fx_gt) q WHERE w > 2 * d AND h > 2 * d""", "fx_gt")),
    "msk11_boundary_band": (bands, oracle(f"""SELECT image_id, ann_id AS gt_id, w * h - greatest(w - 2 * d, 0) * greatest(h - 2 * d, 0) AS band_px
        FROM (SELECT *, {BAND} AS d FROM fx_gt) q""", "fx_gt")),
    "msk12_display_scale": (displayed, oracle(f"SELECT image_id, gt_id, w * h AS area, x, y, w, h FROM ({DISPLAY}) q", "fx_gt")),
    "msk13_components": (mask_components, None),
    "msk15_d4_boxes": (transformed, oracle("""SELECT unnest(['vflip', 'hflip', 'rot90_k1', 'rot90_k2', 'rot90_k3']) AS op, ann_id,
        unnest([x, 600 - x - w, y, 600 - x - w, 512 - y - h]) AS x, unnest([512 - y - h, y, 600 - x - w, 512 - y - h, x]) AS y,
        unnest([w, w, h, w, h]) AS w, unnest([h, h, w, h, w]) AS h FROM fx_gt""", "fx_gt")),
    "msk16_augmentation_plan": (choices, oracle(f"WITH {AUGMENT} SELECT * FROM plan", "fx_images")),
    "msk17_cropped_objects": (cropped_objects, oracle("""SELECT ann_id, round(x0 * 1008 / 256.0::DOUBLE, 6) AS x, round(y0 * 1008 / 300.0::DOUBLE, 6) AS y,
        round((x1 - x0) * 1008 / 256.0::DOUBLE, 6) AS w, round((y1 - y0) * 1008 / 300.0::DOUBLE, 6) AS h FROM (
        SELECT ann_id, greatest(x - image_id % 200, 0) AS x0, greatest(y - image_id % 100, 0) AS y0, least(x + w - image_id % 200, 256) AS x1,
               least(y + h - image_id % 100, 300) AS y1 FROM fx_gt) q WHERE x1 > x0 AND y1 > y0""", "fx_gt")),
    "sta1_count_summary": (gt_summary, oracle("""WITH c AS (SELECT i.image_id, count(g.image_id) AS n FROM fx_images i LEFT JOIN fx_gt g USING (image_id) GROUP BY 1)
        SELECT count(*) AS images, CAST(sum(n) AS BIGINT) AS total_annotations, round(avg(n), 9) AS mean, round(stddev_pop(n), 9) AS std, min(n) AS min, max(n) AS max, """
        + ", ".join(f"round(quantile_cont(n, {p / 100}), 9) AS p{p}" for p in (50, 75, 90, 95, 99, 100)) + """,
        count(*) FILTER (WHERE n = 0) AS images_with_zero_gt, count(*) FILTER (WHERE n > 100) AS images_above_100, count(*) FILTER (WHERE n > 200) AS images_above_200,
        count(*) FILTER (WHERE n > 500) AS images_above_500, round(avg(CASE WHEN n > 200 THEN 1.0 ELSE 0.0 END), 9) AS fraction_above_200 FROM c""", "fx_images", "fx_gt")),
    "sta2_count_buckets": (gt_buckets, oracle("""WITH c AS (SELECT i.image_id, count(g.image_id) AS n FROM fx_images i LEFT JOIN fx_gt g USING (image_id) GROUP BY 1)
        SELECT CASE WHEN hi IS NULL THEN '>=' || lo ELSE lo || '-' || (hi - 1) END AS bucket, count(c.n) AS images
        FROM (VALUES (0, 1), (1, 10), (10, 20), (20, 25), (25, 30), (30, 35), (35, 50), (50, 100), (100, NULL)) b(lo, hi)
        LEFT JOIN c ON n >= lo AND (hi IS NULL OR n < hi) GROUP BY lo, hi""", "fx_images", "fx_gt")),
    "sta4_crop_scale": (crop_scale, oracle(f"""WITH {AUGMENT},
        windows AS (SELECT 'random_crop' AS variant, image_id, width, height, cw, ch, cx, cy FROM plan
          UNION ALL SELECT 'whole_image', image_id, width, height, width, height, 0, 0 FROM plan),
        kept AS (SELECT variant, image_id, count(*) AS kept FROM ({CROPPED} FROM fx_gt JOIN windows USING (image_id)) q WHERE x1 > x0 AND y1 > y0 GROUP BY 1, 2)
        SELECT variant, min(cw) AS cw_min, round(avg(cw), 6) AS cw_mean, max(cw) AS cw_max, min(ch) AS ch_min, round(avg(ch), 6) AS ch_mean, max(ch) AS ch_max,
          round(avg(1008 * (1.0::DOUBLE / cw + 1.0::DOUBLE / ch) / 2), 6) AS scale_mean, round(avg(coalesce(kept, 0)), 6) AS mean_objects,
          round(avg((CASE WHEN cw >= width - 1 THEN 1.0 ELSE 0.0 END + CASE WHEN ch >= height - 1 THEN 1.0 ELSE 0.0 END)::DOUBLE / 2), 6) AS full_image_frac
        FROM windows LEFT JOIN kept USING (variant, image_id) GROUP BY 1""", "fx_images", "fx_gt")),
    "sta5_pixel_gain": (pixel_gain, oracle(f"""WITH {AUGMENT},
        cut AS ({CROPPED}, w * h * 1016064.0::DOUBLE / (width * height) AS whole_px FROM fx_gt JOIN plan USING (image_id) WHERE w * h < 1024),
        ratios AS (SELECT ((x1 - x0) * 1008.0::DOUBLE / cw) * ((y1 - y0) * 1008.0::DOUBLE / ch) / whole_px AS r FROM cut WHERE x1 > x0 AND y1 > y0)
        SELECT count(*) AS objects, round(avg(r), 6) AS mean_ratio, round(median(r), 6) AS median_ratio FROM ratios""", "fx_images", "fx_gt")),
    "sta6_d4_invariants": (d4_invariants, """SELECT unnest(['vflip', 'hflip', 'rot90_k1', 'rot90_k2', 'rot90_k3']) AS op, count(*) AS n_obj,
        CAST(0 AS BIGINT) AS max_mask_area_delta, 0.0::DOUBLE AS max_box_area_rel_delta, true AS ok FROM lineitem"""),
}
