"""Average precision on analytic cases, sources, sinks, gates, and the registered queries."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from masklake.operators import matching, precision, runs, views
from masklake.plans import evaluate, export, merge
from masklake.sources import coco, sinks

SF = "/root/testdata/sf0.001"


def squares(spark, crowd_canopy=False, drop_canopy_preds=False):
    gts, preds = [], []
    for image in (1, 2):
        for k, (lo, hi, original) in enumerate([(20, 44, 2), (80, 120, 1)]):
            area, crowd = (hi - lo) ** 2, int(crowd_canopy and original == 1)
            gts.append((image, 1, image * 10 + k, crowd, area, area, lo, hi, lo, hi))
            if not (drop_canopy_preds and original == 1):
                preds.append((image, 1, image * 10 + k, 0.9, area, lo, hi, lo, hi))
    g = spark.createDataFrame(gts, "image_id long, category_id long, gt_id long, iscrowd int, area_mask long, area_meta long, c0 long, c1 long, r0 long, r1 long")
    p = spark.createDataFrame(preds, "image_id long, category_id long, pred_id long, score double, area long, c0 long, c1 long, r0 long, r1 long")
    return p, g


def ap(preds, gts):
    ranked = matching.top_per_image(preds, 512)
    rows = evaluate.coco_metrics(ranked, evaluate.mask_edges(preds, gts), gts).collect()
    return {r.metric: r.value for r in rows}


def test_perfect_predictions_and_ignored_class(spark):
    assert ap(*squares(spark))["AP"] > 0.99
    assert ap(*squares(spark, crowd_canopy=True))["AP"] > 0.99
    without = ap(*squares(spark, drop_canopy_preds=True))["AP"]
    tree = ap(*squares(spark, crowd_canopy=True, drop_canopy_preds=True))["AP"]
    assert without < 0.99 and tree > without + 0.05


def test_hot_score_is_split_into_ranges(spark):
    bits = spark.range(2000).selectExpr("1L category_id", "id pred_id", "0.5D score", "id image_id", "1 rank", "id % 3 k")
    bits = bits.select("*", F.when(F.col("k") < 2, 1).otherwise(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("ig"))
    npig = spark.createDataFrame([(1, [1400, 0, 0, 0])], "category_id long, npig array<long>")
    steps = precision.precision_steps(bits, npig, [0]).collect()
    tp = fp = 0
    best = {}
    for i in range(2000):
        hit = i % 3 < 2
        tp, fp = tp + hit, fp + (not hit)
        if hit:
            level = max(k for k in range(101) if tp / 1400 >= k * 0.01)
            best[level] = max(best.get(level, 0), tp / (tp + fp + precision.EPS))
    assert {r.level: r.precision for r in steps} == pytest.approx(best)


def test_cut_off_log_and_absent_log(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    path.write_text('{"action": "staged", "epoch": 3}\n{"action": "error", "epoch": 4}\n{"action": "sta')
    rows, bad = coco.read_jsonl(spark, str(path), "action STRING, epoch BIGINT")
    assert rows.count() == 2 and bad.count() == 1
    absent, _ = coco.read_jsonl(spark, str(tmp_path / "none.jsonl"), "action STRING, epoch BIGINT")
    assert absent.count() == 0


def test_documents_and_dumps(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"info": {"source": "x"}, "images": [{"id": 1, "file_name": "a.png", "width": 8, "height": 8}], '
                                     '"annotations": [{"id": 5, "image_id": 1, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 1, "name": "tree"}]}')
    doc = coco.read_coco(spark, str(tmp_path / "a.json"))
    assert doc["annotations"].first().bbox == [1, 2, 3, 4] and doc["categories"].first().name == "tree"
    (tmp_path / "raw.json").write_text('{"instances": [{"image_id": 1, "score": 0.8, "bbox": [0, 0, 4, 4]}, {"image_id": 1, "score": 0.9, "bbox": [0, 0, 4, 4]}, '
                                       '{"image_id": 2, "score": 0.9, "bbox": [0, 0, 4, 4]}]}')
    raw = coco.read_raw_instances(spark, str(tmp_path / "raw.json"))
    images = spark.createDataFrame([(1,)], "image_id long")
    kept = merge.merge_raw_instances(raw, images, dedup_iou=0.3, maxdets=512, method="box-nms").collect()
    assert [(r.image_id, r.score) for r in kept] == [(1, 0.9)]
    (tmp_path / "p.json").write_text('[{"image_id": 1, "score": 0.5}, {"image_id": 2, "score": 0.6}]')
    assert coco.read_predictions(spark, str(tmp_path / "p.json"), images).count() == 1


def test_unknown_split_names_the_known_ones(spark, tmp_path):
    spark.createDataFrame([("train", 1), ("test", 2)], "split string, i int").write.parquet(str(tmp_path / "s"))
    assert coco.read_split(spark, str(tmp_path / "s"), "test").count() == 1
    with pytest.raises(ValueError, match="train"):
        coco.read_split(spark, str(tmp_path / "s"), "val")


def test_write_once_and_digest(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "view")
    assert sinks.write_once(df, path) and not sinks.write_once(df.repartition(3), path)
    with pytest.raises(views.ContractError):
        sinks.write_once(df.withColumn("v", F.col("id") * 3), path)
    assert sinks.reusable(spark, path, []) and not sinks.reusable(spark, str(tmp_path / "gone"), [])


def test_export_plan(spark):
    samples = spark.createDataFrame(
        [(7, "train", '{"annotations": [{"id": 1, "category_id": 2, "bbox": [1, 1, 4, 4], "segmentation": [[1, 1, 5, 1, 5, 5, 1, 5]]},'
                      ' {"id": 1, "category_id": 1, "bbox": [2, 2, 4, 4], "segmentation": [2, 2, 6, 2, 6, 6, 2, 6]}]}'),
         (8, "train", None)], "image_id long, split string, coco_annotations string")
    samples = samples.withColumns({"width": F.lit(None).cast("long"), "height": F.lit(None).cast("long")})
    tables = export.export_tables(samples)
    assert tables["images"].where("width = 2048").count() == 2
    assert sorted(r.id for r in tables["annotations"].collect()) == [1, 2]


def test_view_contract_fails_closed(spark):
    images = spark.createDataFrame([(7, "images/a.png")], "image_id long, file_name string")
    ok = spark.createDataFrame([(10, 7, 1, 1), (11, 7, 1, 2)], "ann_id long, image_id long, category_id long, original_category_id long")
    views.require(views.view_checks(images, ok))
    for bad in [(10, 7, 1, 2), (12, 8, 1, 2), (12, 7, 1, 3), (12, 7, 1, None), (12, 7, 2, 2)]:
        with pytest.raises(views.ContractError):
            views.require(views.view_checks(images, ok.union(spark.createDataFrame([bad], ok.schema))))
    with pytest.raises(views.ContractError):
        views.require(views.view_checks(spark.createDataFrame([(7, "../a.png")], images.schema), ok))


def test_log_rows_need_an_epoch(spark):
    log = spark.createDataFrame([("r", None, 0, 1.0)], "run string, epoch long, source_priority int, value double")
    with pytest.raises(ValueError):
        runs.merge_logs(log, ["run"])


FAST = ["cln3_clipped_boxes", "view4_prompt_pairs", "til2_tile_grid", "msk7_union_masks", "msk11_boundary_band", "val1_box_issues",
        "cmp2_baseline_deltas", "gate1_comparability", "log1_merged_logs", "sta1_count_summary", "top1_merged_topk", "nms2_box_greedy"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))
