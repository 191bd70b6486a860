"""Writers: what is read back equals what was written, and a failure leaves what was there."""

import json

import pytest
from pyspark.sql import functions as F

from masklake.operators.views import ContractError
from masklake.sources import coco, sinks


def test_report_survives_a_failure_at_the_swap(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    with pytest.raises(ContractError):
        sinks.read_report(spark, path)
    sinks.write_report(spark.range(3).toDF("n"), path)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_swap", broken)
        with pytest.raises(OSError, match="lost"):
            sinks.write_report(spark.range(5).toDF("n"), path)
    assert sinks.read_report(spark, path, "n bigint").count() == 3
    for n in (6, 7, 8):
        sinks.write_report(spark.range(n).toDF("n"), path)
        assert sinks.read_report(spark, path).count() == n
    assert sum(p.name.startswith("v-") for p in (tmp_path / "report").iterdir()) == 2


def test_one_document_round_trip(spark, tmp_path):
    path = str(tmp_path / "coco.json")
    images = spark.range(40).select(F.col("id").alias("image_id"), F.lit("train").alias("split"), F.lit(64).cast("bigint").alias("width"),
                                    F.lit(32).cast("bigint").alias("height"), F.concat(F.lit('a "b", '), F.col("id")).alias("file_name"))
    annotations = spark.range(300).select(
        "id", (F.col("id") % 40).alias("image_id"), F.lit(1).cast("bigint").alias("category_id"), (F.col("id") % 2 + 1).alias("original_category_id"),
        *[(F.col("id") % 7 + k).cast("double").alias(c) for k, c in enumerate("xywh")],
        F.array(F.array(*[(F.col("id") + k).cast("double") for k in range(6)])).alias("polygons"),
        F.lit(2.5).alias("area"), F.lit(0).cast("bigint").alias("iscrowd"))
    categories = spark.createDataFrame([(1, "tree \u6728")], "id bigint, name string")
    rows = sinks.document_rows({"images": images, "annotations": annotations, "categories": categories})
    outcomes = spark.createDataFrame([(40, 3)], "images_exported bigint, dropped bigint")
    for info in ({"version": "1"}, {"version": "2"}):
        sinks.write_coco_document(rows, path, info, outcomes)
    document = json.loads((tmp_path / "coco.json").read_text())
    assert document["info"] == {"version": "2", "images_exported": 40, "dropped": 3}
    assert [i["id"] for i in document["images"]] == list(range(40)) and [a["id"] for a in document["annotations"]] == list(range(300))
    back = coco.read_coco(spark, path)
    columns = ["id", "file_name", "width", "height", "source_split"]
    assert sorted(map(tuple, back["images"].select(*columns).collect())) == sorted(map(tuple, rows["images"].select(*columns).collect()))
    texts = rows["annotations"].withColumn("segmentation", F.to_json("segmentation"))
    assert sorted(map(tuple, back["annotations"].select(*texts.columns).collect())) == sorted(map(tuple, texts.collect()))
    assert back["categories"].collect() == categories.collect()
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["coco.json"]
    empty = {k: v.limit(0) for k, v in rows.items()}
    sinks.write_coco_document(empty, path)
    assert json.loads((tmp_path / "coco.json").read_text()) == {"info": {}, "images": [], "annotations": [], "categories": []}


def test_dump_provenance_and_ledger(spark, tmp_path):
    preds = spark.range(20).select((F.col("id") % 4).alias("image_id"), F.col("id").alias("pred_id"), (F.col("id") / 20).alias("score"))
    for run in ("a", "b"):
        sinks.write_predictions(preds, str(tmp_path / "dump"), run)
    back = coco.read_predictions(spark, str(tmp_path / "dump"), preds.where("image_id < 2").select("image_id").distinct())
    assert {(r.run, r.n) for r in back.groupBy("run").agg(F.count("*").alias("n")).collect()} == {("a", 10), ("b", 10)}
    sinks.write_provenance(spark, str(tmp_path / "provenance"), {"run": "a", "threshold": 0.5}, preds, preds.select("image_id").distinct())
    row = spark.read.parquet(str(tmp_path / "provenance")).first()
    assert (row.run, row.threshold, row.n_images, row.n_predictions) == ("a", 0.5, 4, 20) and row.created_utc is not None
    for n in (1, 2):
        sinks.append_ledger(spark.createDataFrame([(f"run{n}", n)], "run string, value int"), str(tmp_path / "ledger"))
    good, bad = coco.read_jsonl(spark, str(tmp_path / "ledger" / "*.json"), "run STRING, value INT, ts STRING")
    assert sorted((r.run, r.value) for r in good.collect()) == [("run1", 1), ("run2", 2)] and bad.count() == 0
    for n in (1, 2):
        (tmp_path / f"run{n}").mkdir()
        (tmp_path / f"run{n}" / "record.json").write_text(json.dumps({"metric": n}))
    runs = coco.read_runs(spark, [str(tmp_path / f"run{n}") for n in (1, 2)], "metric INT")
    assert sorted(map(tuple, runs.collect())) == [(1, "run1"), (2, "run2")]


def test_written_tables_are_read_back(spark, tmp_path):
    ids = spark.range(50).withColumn("image_id", F.col("id") % 5)
    tables = {"images": ids.select("image_id").distinct(), "annotations": ids, "categories": spark.range(1)}
    sinks.write_coco(tables, str(tmp_path / "set"))
    for name, table in tables.items():
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "set" / name)).select(*table.columns).collect())) == sorted(map(tuple, table.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_coco(tables, str(tmp_path / "set"))
