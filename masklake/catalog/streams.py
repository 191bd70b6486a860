"""Registered queries: streaming operators driven over the given tables, sources and file identity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from masklake.catalog import inputs
from masklake.catalog.evaluation import nms_oracle
from masklake.catalog.fixtures import CANVAS, oracle, spark_view
from masklake.operators import tiling
from masklake.session import checkpoint_root
from masklake.sources import coco
from masklake.streaming import stateful


def _replayed(spark, df, label):
    """The rows as a file stream: written once, then read as a stream of its files."""
    root = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in"), root


def _drain(stream, root, mode="append"):
    """Runs a stream over all its input into a table and reads that table."""
    out = f"{root}/out"
    if mode == "append":
        query = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
                 .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    else:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
                 .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def partial_output(spark, sf):
    p = spark_view(spark, sf, "fx_pred").select("image_id", "pred_id", "score")
    stream, root = _replayed(spark, p, "partial")
    stateful.append_partial_results(stream, f"{root}/table", f"{root}/state", "r1").awaitTermination()
    return spark.read.parquet(f"{root}/table").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


def finished_images(spark, sf):
    """Images whose windows have all been reported; every 20th image misses one."""
    grid = tiling.tile_grid(spark_view(spark, sf, "fx_images"), 256, 64)
    done = grid.where("NOT (image_id % 20 = 0 AND window_id = 'r2_c2')").select("image_id", "window_id", F.lit(9).cast("bigint").alias("n_windows"))
    stream, root = _replayed(spark, done, "windows")
    return _drain(stateful.window_progress(stream, timeout=None), root)


def suppressed_images(spark, sf):
    """Suppression of every image once its windows are in; every 20th image misses one and stays out. The stream is resumed once."""
    grid = tiling.tile_grid(spark_view(spark, sf, "fx_images"), 256, 64)
    done = grid.where("NOT (image_id % 20 = 0 AND window_id = 'r2_c2')").select("image_id", "window_id", F.lit(9).cast("bigint").alias("n_windows"))
    root = f"{checkpoint_root(spark)}/settled-{uuid.uuid4().hex}"
    instances = inputs.pred_slabs(spark, sf).select("image_id", "pred_id", "score", "c0", "c1", "r0", "r1")
    for part in ("window_id < 'r1_c2'", "window_id >= 'r1_c2'"):
        done.where(part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(done.schema).parquet(f"{root}/in")
        stateful.merge_settled(stateful.window_progress(stream, timeout=None), lambda: instances, f"{root}/out", f"{root}/state",
                               dedup_iou=0.5, extent=CANVAS).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("image_id", "pred_id", F.round("score", 9).alias("score"), "complete")


def log_progress(spark, sf):
    """Every row that a log gains, over three attempts that are written one after the other while the stream resumes."""
    log = spark_view(spark, sf, "fx_metric_log")
    root = f"{checkpoint_root(spark)}/progress-{uuid.uuid4().hex}"
    for attempt in range(3):
        log.where(F.col("source_priority") == attempt).select("run", "epoch").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("run string, epoch bigint").parquet(f"{root}/in")
        out = _drain(stateful.forward_progress(stream), root)
    return out


def live_best(spark, sf):
    log = spark_view(spark, sf, "fx_metric_log").select("run", "name", "value", F.when(F.col("name") == "error", "min").otherwise("max").alias("mode"))
    stream, root = _replayed(spark, log, "best")
    return _drain(stateful.best_metric(stream), root, "complete")


def limited(spark, sf):
    return coco.first_images(spark_view(spark, sf, "fx_images").select("image_id", "width"), 50)


def identity(spark, sf):
    """Size and digests of the input files themselves."""
    f = coco.file_identity(spark, f"{sf}/lineitem.parquet", 1024)
    return f.select("length", (F.length("sha256") == 64).alias("has_digest"), (F.col("sha256") != F.col("prefix_sha256")).alias("prefix_differs"))


CASES = {
    "str1_partial_output": (partial_output, oracle("SELECT image_id, count(*) AS n FROM fx_pred GROUP BY 1", "fx_pred")),
    "str2_finished_images": (finished_images, oracle("""SELECT image_id, CAST(9 AS BIGINT) AS windows, true AS complete FROM fx_images WHERE image_id % 20 <> 0""", "fx_images")),
    "str2_suppressed_images": (suppressed_images, f"SELECT *, true AS complete FROM ({nms_oracle(0.5, '>=', 'ASC')}) q WHERE image_id % 20 <> 0"),
    "str3_log_progress": (log_progress, oracle("""WITH high AS (SELECT run, source_priority AS a, max(epoch) AS high FROM fx_metric_log GROUP BY 1, 2)
        SELECT DISTINCT l.run, l.epoch FROM fx_metric_log l
        WHERE l.epoch > coalesce((SELECT max(high) FROM high h WHERE h.run = l.run AND h.a < l.source_priority), -1)""", "fx_metric_log")),
    "str4_live_best": (live_best, oracle("""SELECT run, name, CASE WHEN name = 'error' THEN min(value) ELSE max(value) END AS best FROM fx_metric_log GROUP BY 1, 2""", "fx_metric_log")),
    "src7_image_limit": (limited, oracle("SELECT image_id, width FROM fx_images ORDER BY image_id LIMIT 50", "fx_images")),
    "man2_file_identity": (identity, None),
}
