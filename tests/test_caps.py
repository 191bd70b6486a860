"""Legal inputs that a cap or shortcut once dropped or changed."""

import json

import pytest
from pyspark.sql import functions as F

from masklake.operators import matching, recall, suppression, views
from masklake.operators.masks import box_slabs
from masklake.operators.parsing import parse_payload
from masklake.plans import evaluate
from masklake.sources import coco
from masklake.sources.sinks import read_report, write_report


def nested(levels, escape=False):
    text = json.dumps({"annotations": [{"bbox": [1, 2, 3, 4]}]})
    for _ in range(levels):
        text = json.dumps({"coco_annotations": text})
    return text.replace("coco_annotations", "coco\\u005fannotations", 1) if escape else text


def test_payloads_nested_to_any_depth(spark):
    rows = [(k, nested(k)) for k in range(6)] + [(9, nested(1, escape=True)), (10, '{"coco_annotations": 5}'), (11, None)]
    got = {r.id: (r.parse_error, r.n) for r in parse_payload(spark.createDataFrame(rows, "id long, coco_annotations string"))
           .select("id", "parse_error", F.size("annotations").alias("n")).collect()}
    assert all(got[k] == (None, 1) for k in [*range(6), 9]) and got[11] == (None, 0)


def test_two_slab_copies_keep_all_their_slabs(spark):
    slab = lambda i, p, s, c0, c1: (i, 1, p, s, 200, c0, c1, 0, 10)
    schema = "image_id long, category_id long, pred_id long, score double, area long, c0 long, c1 long, r0 long, r1 long"
    preds = spark.createDataFrame([slab(1, 1, 0.9, 0, 10), slab(1, 1, 0.9, 20, 30), slab(1, 2, 0.8, 0, 10), slab(1, 2, 0.8, 40, 50),
                                   slab(1, 3, 0.7, 0, 10), slab(1, 3, 0.7, 20, 30), slab(2, 4, 0.9, 0, 10)], schema)
    gts = spark.createDataFrame([(1, 1, 7, 0, 9)], "image_id long, category_id long, gt_id long, iscrowd long, x long")
    kept = matching.cap_copies(preds, gts, ["c0", "c1", "r0", "r1"], ["image_id"])
    assert sorted((r.pred_id, r.c0) for r in kept.collect()) == [(1, 0), (1, 20), (2, 0), (2, 40)]
    full = spark.createDataFrame([(1, 1, g, 0, 100, 100, c, c + 10, 0, 10) for g, c in ((7, 0), (8, 20), (9, 40))],
                                 "image_id long, category_id long, gt_id long, iscrowd long, area_mask long, area_meta long, c0 long, c1 long, r0 long, r1 long")
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    rows = preds.select("image_id", "pred_id", "score").distinct()
    plain, capped = (recall.f1_sweep(rows, preds, full, images, match_iou=0.3, geometry=g).orderBy("step").collect()
                     for g in (None, ["c0", "c1", "r0", "r1"]))
    assert plain == capped


def test_empty_boxes_suppress_nothing(spark):
    rows = [(1, 1, 0.9, 5, 5, 3, 9), (1, 2, 0.8, 5, 5, 3, 9), (1, 3, 0.7, 0, 4, 0, 4), (1, 4, 0.6, 0, 4, 0, 4)]
    df = spark.createDataFrame(rows, "image_id long, pred_id long, score double, c0 long, c1 long, r0 long, r1 long")
    assert {r.pred_id for r in suppression.suppress(df, 0.5).collect()} == {1, 2, 3}
    slabs = df.where("c1 > c0")
    assert {r.pred_id for r in suppression.suppress(df, 0.5, slabs=slabs).collect()} == {1, 2, 3}


def test_only_the_best_predictions_are_paired(spark):
    n = 600
    preds = spark.range(n).selectExpr("1L AS image_id", "1L AS category_id", "id AS pred_id", "double(1000 - id) / 1000 AS score",
                                      "100L AS area", "id * 20 AS x", "0L AS y", "10L AS w", "10L AS h")
    gts = preds.selectExpr("image_id", "category_id", "pred_id AS gt_id", "0L AS iscrowd", "100L AS area_mask", "100L AS area_meta", "x", "y", "w", "h")
    won = matching.coco_match(evaluate.mask_edges(box_slabs(preds), box_slabs(gts))).where("area = 0 AND bits % 2 = 1")
    assert sorted(r.pred_id for r in won.collect()) == list(range(512))


def dump(path, images):
    record = lambda i, k: {"image_id": i, "category_id": 1, "score": k / 10, "bbox": [k, 0, 1, 1], "segmentation": {"size": [4, 4], "counts": "x"}}
    rows = [record(i, k) for i in images for k in range(3)]
    if path.suffix == ".json":
        path.write_text(json.dumps(rows, indent=1))
    else:
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_dump_ids_are_unique_over_files_and_repeatable(spark, tmp_path):
    for kind in ("json", "jsonl"):
        files = [dump(tmp_path / f"{name}.{kind}", images) for name, images in (("b", [1, 2]), ("a", [1]), ("c", range(3, 400)))]
        first = coco.read_predictions(spark, files).collect()
        assert len({r.pred_id for r in first}) == len(first) == 9 + 3 * 397
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        again = coco.read_predictions(spark, files).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        key = lambda rows: sorted((r.pred_id, r.image_id, r.score) for r in rows)
        assert key(first) == key(again)
        by_file = key(coco.read_predictions(spark, files[0]).collect())
        assert [(p, s) for p, _, s in by_file] == [(k, (k % 3) / 10) for k in range(6)]


def test_raw_instances_of_both_shapes(spark, tmp_path):
    item = lambda k: {"image_id": 1, "category_id": 1, "score": k / 10, "area": k, "tile_id": "t"}
    (tmp_path / "a.json").write_text(json.dumps({"instances": [item(0), item(1)], "other": 3}))
    (tmp_path / "b.json").write_text(json.dumps([item(2), item(3), item(4)]))
    rows = coco.read_raw_instances(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()
    assert [r.area for r in sorted(rows, key=lambda r: r.pred_id)] == [0, 1, 2, 3, 4] and len({r.pred_id for r in rows}) == 5


def test_a_failed_report_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "report")
    write_report(spark.range(3).toDF("n"), path)
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("n"))
    try:
        write_report(bad, path)
    except Exception as error:
        assert "no" in str(error)
    assert sorted(r.n for r in read_report(spark, path).collect()) == [0, 1, 2]
    write_report(spark.range(1).toDF("n"), path)
    assert read_report(spark, path).count() == 1


def test_class_split_refusals(spark):
    schema = "ann_id long, original_category_id int, iscrowd int"
    good = spark.createDataFrame([(1, 2, 0), (2, 1, 0)], schema)
    assert sorted((r.ann_id, r.iscrowd) for r in views.class_split(good, 2).collect()) == [(1, 0), (2, 1)]
    with pytest.raises(views.ContractError, match="unknown class"):
        views.class_split(good, 7)
    with pytest.raises(views.ContractError, match="original_category_id"):
        views.class_split(good.drop("original_category_id"), 2)
    with pytest.raises(Exception, match="has no original_category_id"):
        views.class_split(good.unionByName(spark.createDataFrame([(3, None, 0)], schema)), 2).collect()
    views.require(views.class_split_checks(good, 2))
    for bad in (good.limit(0), good.where("original_category_id = 1")):
        with pytest.raises(views.ContractError):
            views.require(views.class_split_checks(bad, 2))


def test_fold_split_needs_both_sides(spark):
    images = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "image_id long, validation_fold int")
    annotations = spark.createDataFrame([(1,), (2,)], "image_id long")
    views.require(views.fold_checks(views.fold_split(images, annotations, 0)[0]))
    for fold, part in ((5, images), (0, images.where("validation_fold = 0"))):
        with pytest.raises(views.ContractError, match="is not empty"):
            views.require(views.fold_checks(views.fold_split(part, annotations, fold)[0]))


def test_failed_rules_beyond_those_listed_are_counted(spark):
    checks = spark.range(25).selectExpr("concat('rule ', id) AS check", "false AS ok", "'x' AS detail")
    with pytest.raises(views.ContractError, match="and 5 more"):
        views.require(checks)


def test_scratch_owns_its_tables(spark):
    import os

    from masklake.session import materialize, scratch

    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        gone = materialize(spark.range(3), "gone")
        assert gone.count() == 3
    where = lambda df: df._written_path.removeprefix("file:")
    assert os.path.exists(where(kept)) and not os.path.exists(where(gone))
