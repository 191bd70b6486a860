"""Splits, category views, batch plans and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masklake.operators import digests, masks, prefix

# The two prompt categories, in prompt order.
CATEGORIES = [(1, "canopy"), (2, "tree")]
LABELS = {"tree": 2, "canopy": 1}
# Splits of a view manifest.
SPLITS = ["test", "train"]
MANIFEST_VERSION = 1


class ContractError(ValueError):
    """An input breaks a rule that the operator refuses to work around."""


def require(checks: DataFrame) -> None:
    """Raise when any row of `(check, ok, detail)` is not ok."""
    bad = checks.where("NOT ok")
    failed = [f"{r['check']}: {r['detail']}" for r in bad.limit(20).collect()]
    if failed:
        more = bad.count() - len(failed) if len(failed) == 20 else 0
        raise ContractError("; ".join(failed) + (f"; and {more} more" if more else ""))


def constraint_rows(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """`(check, ok, detail)` from a one-row aggregate; each check is a condition and what to show."""
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"),
                              detail.cast("string").alias("detail")) for k, (ok, detail) in checks.items()])
    return df.select(F.inline(rows))


def fold_split(images: DataFrame, annotations: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Images and annotations with `part` = val or train; images without a fold are left out."""
    side = F.when(F.col("validation_fold") == fold, "val").when(F.col("validation_fold") >= 0, "train")
    placed = images.withColumn("part", side)
    kept = placed.where("part IS NOT NULL")
    return placed, annotations.join(kept.select("image_id", "part"), "image_id")


def fold_checks(placed: DataFrame) -> DataFrame:
    """A split must leave images on both sides, as `(check, ok, detail)`."""
    n = placed.agg(F.count_if(F.col("part") == "val").alias("val"), F.count_if(F.col("part") == "train").alias("train"))
    return constraint_rows(n, {"val is not empty": (F.col("val") > 0, F.col("val")), "train is not empty": (F.col("train") > 0, F.col("train"))})


def fold_counts(placed: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images and annotations per part, excluded images as part `excluded`."""
    anns = annotations.groupBy("part").agg(F.count(F.lit(1)).alias("annotations"))
    return (placed.groupBy(F.coalesce("part", F.lit("excluded")).alias("part")).agg(F.count(F.lit(1)).alias("images"))
            .join(anns, "part", "left").na.fill(0))


def restore_categories(annotations: DataFrame) -> DataFrame:
    """The category-preserving view; geometry and crowd flags stay."""
    return annotations.withColumn("category_id", F.col("original_category_id"))


def view_checks(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """What the category view demands of its source, as `(check, ok, detail)`."""
    unsafe = F.col("file_name").isNull() | (F.col("file_name") == "") | F.col("file_name").rlike(r"(^/)|(^|/)\.\.(/|$)")
    i = images.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("d"), F.count_if(unsafe).alias("bad"))
    a = annotations.agg(
        F.count(F.lit(1)).alias("na"), F.count_distinct("ann_id").alias("da"),
        F.count_if(~F.coalesce(F.col("original_category_id").isin(1, 2), F.lit(False))).alias("cat"),
        F.count_if(~F.col("category_id").eqNullSafe(1)).alias("col"))
    dangling = (annotations.join(images.select("image_id"), "image_id", "left_anti").agg(F.count(F.lit(1)).alias("gone")))
    one = i.join(a.hint("broadcast")).join(dangling.hint("broadcast"))
    zero = lambda c: (F.col(c) == 0, F.col(c))
    return constraint_rows(one, {
        "image ids are unique": (F.col("n") == F.col("d"), F.col("n") - F.col("d")),
        "annotation ids are unique": (F.col("na") == F.col("da"), F.col("na") - F.col("da")),
        "image paths are relative": zero("bad"), "original categories are 1 or 2": zero("cat"),
        "source is collapsed": zero("col"), "annotations refer to known images": zero("gone")})


def class_split(annotations: DataFrame, keep: int) -> DataFrame:
    """Ground truth in which only `keep` is scored; the other class becomes crowd and is thereby ignored.

    An unknown class and a missing column are refused at once, an annotation without a class when it is met.
    """
    if keep not in LABELS.values():
        raise ContractError(f"unknown class {keep}; known: {sorted(LABELS.items())}")
    if "original_category_id" not in annotations.columns:
        raise ContractError("annotations have no original_category_id; the split needs the category-preserving view")
    original = F.col("original_category_id")
    crowd = F.when(original.isNull(), F.raise_error(F.lit("an annotation has no original_category_id"))).when(
        original == keep, F.col("iscrowd")).otherwise(F.lit(1))
    return annotations.withColumn("iscrowd", crowd)


def class_split_checks(annotations: DataFrame, keep: int) -> DataFrame:
    """What a class split demands, as `(check, ok, detail)`: annotations, a class on each, and scored ones of the kept class."""
    c = F.col("original_category_id")
    n = annotations.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("none"),
                        F.count_if((c == keep) & (F.col("iscrowd") == 0)).alias("kept"))
    return constraint_rows(n, {"there are annotations": (F.col("n") > 0, F.col("n")),
                               "every annotation has a class": (F.col("none") == 0, F.col("none")),
                               "the kept class has scored annotations": (F.col("kept") > 0, F.col("kept"))})


def class_split_counts(annotations: DataFrame, keep: int) -> DataFrame:
    target = F.col("original_category_id") == keep
    return annotations.agg(
        F.count_if(target & (F.col("iscrowd") == 0)).alias("scored"), F.count_if(~target).alias("ignored"),
        F.count_if(target & (F.col("iscrowd") == 1)).alias("already_crowd"))


def valid_region(preds: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions cut to every region of their image, with new area and box.

    `preds(image_id, keys..., slab)` and `regions(image_id, region_id, slab)` are slab tables. All regions of an
    image apply together; predictions with nothing left, and those of images without regions, disappear.
    """
    count = regions.groupBy("image_id").agg(F.count_distinct("region_id").alias("_k"))
    layer = regions.select("image_id", *[F.col(c).alias("_" + c) for c in masks.SLAB])
    cut = (preds.join(layer, "image_id").withColumns({
        "c0": F.greatest("c0", "_c0"), "c1": F.least("c1", "_c1"),
        "r0": F.greatest("r0", "_r0"), "r1": F.least("r1", "_r1")})
        .where("c1 > c0 AND r1 > r0").join(count, "image_id"))
    ks = ["image_id", *keys, "_k"]
    inside = masks.covered_by(cut.select(*ks, *masks.SLAB), ks, F.col("_k"))
    return masks.mask_stats(inside, ["image_id", *keys])


def prompt_pairs(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image with every prompt category and its target count, zero where a category is absent."""
    prompts = F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias("category_id"), F.lit(n).alias("prompt"))
                                  for c, n in CATEGORIES]))
    n = annotations.groupBy("image_id", F.col("original_category_id").alias("category_id")).agg(F.count(F.lit(1)).alias("targets"))
    return (images.select("image_id", prompts.alias("p")).select("image_id", "p.*")
            .join(n, ["image_id", "category_id"], "left").na.fill(0, ["targets"]))


def batch_plan(images: DataFrame, batch: int, accumulate: int, seed: int, epoch: int) -> DataFrame:
    """Seeded shuffle cut into groups of `batch * accumulate` images, incomplete groups dropped."""
    shuffled = images.select("image_id", F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.lit(str(seed)), F.lit(str(epoch)))).alias("_h"))
    numbered = prefix.row_numbers(shuffled, [F.col("_h"), F.col("image_id")], "_rn")
    size = batch * accumulate
    total = images.agg(F.count(F.lit(1)).alias("_n"))
    pos = F.col("_rn") - 1
    return (numbered.join(total.hint("broadcast")).where(pos < F.floor(F.col("_n") / size) * size)
            .select("image_id", F.floor(pos / size).alias("group_id"), F.floor(pos / batch).alias("batch_id"),
                    (pos % batch).alias("slot")))


def batch_counts(plan: DataFrame, pairs: DataFrame) -> DataFrame:
    """Image and target counts per batch."""
    target = lambda c: F.sum(F.when(F.col("category_id") == c, F.col("targets")).otherwise(0))
    return (plan.join(pairs, "image_id").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("image_id").alias("images"),
        target(2).alias("tree_targets"), target(1).alias("canopy_targets")))


def content_digest(df: DataFrame, buckets: int = 256) -> DataFrame:
    """SHA-256 of a table that does not depend on row order: `(rows, digest)`.

    Rows are hashed one by one. The hashes of a bucket are added up in four parts and hashed, then the
    bucket hashes; sums combine before the shuffle, so no task ever holds the rows of a bucket. Equal
    tables give equal digests and a changed, added or lost row changes the sums.
    """
    cols = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(row.alias("h")).withColumn("bucket", F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % buckets)
    word = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    per = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(word(i)).alias(f"w{i}") for i in range(8)])
    text = F.concat_ws("|", "bucket", "n", *[f"w{i}" for i in range(8)])
    return (per.select("n", F.sha2(text, 256).alias("d"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                 F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("digest")))


def view_manifest(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Counts per split: images, annotations, per category, crowd by category."""
    n = images.groupBy("split").agg(F.count(F.lit(1)).alias("images"))
    cat = lambda c: F.count_if(F.col("original_category_id") == c)
    crowd = lambda c, v: F.count_if((F.col("original_category_id") == c) & (F.col("iscrowd") == v))
    a = annotations.groupBy("split").agg(
        F.count(F.lit(1)).alias("annotations"), cat(1).alias("category_1"), cat(2).alias("category_2"),
        *[crowd(c, v).alias(f"category_{c}_crowd_{v}") for c in (1, 2) for v in (0, 1)])
    return n.join(a, "split", "left").na.fill(0)


def view_trees(images: DataFrame, annotations: DataFrame, view: DataFrame) -> DataFrame:
    """Digest trees of a view and what it comes from: `(part, split, bucket, rows, digest)`, part is images, annotations or view."""
    tree = lambda df, key, part: digests.bucket_digests(df, [key], ["split"]).select(F.lit(part).alias("part"), "*")
    return (tree(images, "image_id", "images").unionByName(tree(annotations, "ann_id", "annotations"))
            .unionByName(tree(view, "ann_id", "view")))


def signed_manifest(images: DataFrame, annotations: DataFrame, trees: DataFrame, arm: str, source: str, view: str) -> DataFrame:
    """`view_manifest` with version, arm, category list, the relative paths, and digests of source and view, one row per split."""
    roots = digests.root(trees, ["split", "part"])
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("digest")))
    signs = roots.groupBy("split").agg(F.sha2(F.concat_ws("|", of("images"), of("annotations")), 256).alias("source_sha256"),
                                       of("view").alias("view_sha256"))
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in CATEGORIES])
    return view_manifest(images, annotations).join(signs, "split", "left").select(
        F.lit(MANIFEST_VERSION).alias("version"), F.lit(arm).alias("arm"), known.alias("categories"), "split",
        F.lit(source).alias("source"), F.lit(view).alias("view"), "source_sha256", "view_sha256",
        *[c for c in view_manifest(images, annotations).columns if c != "split"])


def signed_checks(manifest: DataFrame, arm: str, source: str, view: str) -> DataFrame:
    """What a signed manifest must say besides `manifest_checks`, as `(split, check, ok)`; the splits as a whole have split NULL."""
    c, known = F.col, F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in CATEGORIES])
    sha = lambda name: c(name).rlike("^[0-9a-f]{64}$")
    rules = {"version": c("version") == MANIFEST_VERSION, "arm": c("arm") == arm, "category list": c("categories") == known,
             "source path": c("source") == source, "view path": c("view") == view,
             "source digest is SHA-256": sha("source_sha256"), "view digest is SHA-256": sha("view_sha256")}
    rows = manifest.select("split", F.inline(F.array(*[
        F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules.items()])))
    names = manifest.agg((F.array_sort(F.collect_list("split")) == F.array(*map(F.lit, SPLITS))).alias("ok"))
    return rows.unionByName(names.select(F.lit(None).cast("string").alias("split"), F.lit("splits are train and test").alias("check"), "ok"))


def manifest_checks(manifest: DataFrame, expected_images: dict[str, int] | None = None) -> DataFrame:
    """Rules a manifest row must satisfy, as `(split, check, ok)`."""
    c = F.col
    rules = {"categories are present": (c("category_1") > 0) & (c("category_2") > 0),
             "categories add up": c("category_1") + c("category_2") == c("annotations"),
             "crowd flags add up": (c("category_1_crowd_0") + c("category_1_crowd_1") == c("category_1"))
             & (c("category_2_crowd_0") + c("category_2_crowd_1") == c("category_2")),
             "scored targets of both categories": (c("category_1_crowd_0") > 0) & (c("category_2_crowd_0") > 0)}
    if "view_sha256" in manifest.columns:
        rules["digest is SHA-256"] = c("view_sha256").rlike("^[0-9a-fA-F]{64}$")
    if expected_images:
        want = F.coalesce(*[F.when(c("split") == s, F.lit(n)) for s, n in expected_images.items()])
        rules["locked image count"] = c("images") == want
    return manifest.select("split", F.inline(F.array(*[
        F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules.items()])))


def protocol_checks(images: DataFrame, annotations: DataFrame, *, n_images: int, n_annotations: int, side: int,
                    split: str) -> DataFrame:
    """Evaluation-set rules against expected values, as `(check, ok, detail)`."""
    i = images.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("d"),
                   F.count_if(~((F.col("width") == side) & (F.col("height") == side))).alias("odd"),
                   F.count_if(~F.col("split").eqNullSafe(split)).alias("other"))
    a = annotations.agg(F.count(F.lit(1)).alias("na"), F.count_if(~F.col("category_id").eqNullSafe(1)).alias("cat"))
    known = images.select("image_id").distinct()
    gone = annotations.join(known, "image_id", "left_anti").agg(F.count(F.lit(1)).alias("gone"))
    empty = known.join(annotations.select("image_id"), "image_id", "left_anti").agg(F.count(F.lit(1)).alias("empty"))
    one = i.join(a.hint("broadcast")).join(gone.hint("broadcast")).join(empty.hint("broadcast"))
    c, zero = F.col, lambda n: (F.col(n) == 0, F.col(n))
    return constraint_rows(one, {
        "image count": (c("n") == n_images, c("n")), "annotation count": (c("na") == n_annotations, c("na")),
        "image ids are unique": (c("n") == c("d"), c("n") - c("d")), "image size": zero("odd"), "source split": zero("other"),
        "annotations refer to known images": zero("gone"), "category is collapsed": zero("cat"),
        "images without annotations": (F.lit(True), c("empty"))})


def protocol_record(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """What an evaluation set is, as one row: `(images, annotations, images_without_annotations, image_ids_sha256)`."""
    ids = digests.root(digests.bucket_digests(images.select("image_id"), ["image_id"])).select(
        F.col("rows").alias("images"), F.col("digest").alias("image_ids_sha256"))
    total = annotations.agg(F.count(F.lit(1)).alias("annotations"))
    empty = images.join(annotations.select("image_id"), "image_id", "left_anti").agg(F.count(F.lit(1)).alias("images_without_annotations"))
    return ids.join(total.hint("broadcast")).join(empty.hint("broadcast")).select(
        "images", "annotations", "images_without_annotations", "image_ids_sha256")


def export_checks(images: DataFrame, annotations: DataFrame, files: DataFrame, empty_reported: int,
                  limit: int = 1000) -> DataFrame:
    """Exported tables against the files on disk and the export report, as `(check, ok, detail)`."""
    missing = images.join(files, "file_name", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    per = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    full = per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    empty = images.join(per, "image_id", "left_anti").agg(F.count(F.lit(1)).alias("empty"))
    one = missing.join(full.hint("broadcast")).join(empty.hint("broadcast"))
    return constraint_rows(one, {
        "image files exist": (F.col("missing") == 0, F.col("missing")),
        "objects per image": (F.col("most") <= limit, F.col("most")),
        "empty images match the report": (F.col("empty") == empty_reported, F.col("empty"))})
