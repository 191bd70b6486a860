from pyspark.sql import functions as F

from masklake import session
from masklake.functions import rle
from masklake.operators import suppression
from masklake.plans import merge


def test_merged_masks_carry_no_text(spark, monkeypatch):
    runs = [(1, 1, 0.9, [0, 8, 56]), (1, 2, 0.8, [0, 8, 56]), (1, 3, 0.7, [32, 8, 24]), (2, 4, 0.6, [0, 8, 56]), (1, 5, 0.5, [0, 16, 48]), (9, 6, 0.9, [0, 8, 56]), (1, 7, 0.4, None)]
    rows = spark.createDataFrame(runs, "image_id long, pred_id long, score double, runs array<long>")
    dump = rows.select("image_id", "pred_id", "score", F.array(F.lit(0)).alias("bbox"),
                       F.struct(rle.encode_counts(F.col("runs")).alias("counts"), F.array(F.lit(8), F.lit(8)).alias("size")).alias("segmentation"))
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    seen, plain = [], suppression.suppress
    monkeypatch.setattr(suppression, "suppress", lambda preds, *a, **b: seen.append(dict(preds.dtypes)) or plain(preds, *a, **b))
    kept = merge.merge_raw_instances(dump, images, dedup_iou=0.5, maxdets=10, extent=8)
    assert sorted(r.pred_id for r in kept.collect()) == [1, 3, 4, 7]
    assert set(kept.columns) == {"image_id", "pred_id", "score", "bbox", "segmentation"}
    assert "string" not in seen[0].values()  # the run-length text went through every shuffle of the suppression


def test_a_clean_table_forgets_the_jobs_before(spark, monkeypatch):
    calls, plain = [], session.forget
    monkeypatch.setattr(session, "forget", lambda s: calls.append(s) or plain(s))
    table = session.materialize(spark.range(3).groupBy("id").count(), "plain")
    assert not calls and session.cleaned(table).count() == 3 and len(calls) == 1
