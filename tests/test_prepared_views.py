"""Digest trees locate drift; prepared views refuse a source or a view that changed."""

import pytest
from pyspark.sql import functions as F

from masklake.operators import digests
from masklake.operators.views import ContractError
from masklake.plans import export


@pytest.fixture()
def tables(spark):
    split = F.when(F.col("image_id") % 3 == 0, "test").otherwise("train")
    images = spark.range(30).withColumnRenamed("id", "image_id").withColumn("split", split).withColumn(
        "file_name", F.concat(F.lit("images/"), F.col("image_id").cast("string"), F.lit(".png")))
    anns = spark.range(300).select(F.col("id").alias("ann_id"), (F.col("id") % 29).alias("image_id"), F.lit(1).alias("category_id"),
                                   (F.col("id") % 2 + 1).cast("int").alias("original_category_id"),
                                   (F.col("id") % 7 == 0).cast("int").alias("iscrowd"), (F.col("id") * 3).alias("x")).withColumn("split", split)
    return images, anns


def test_drifted_rows_with_repeated_and_missing_keys(spark):
    old = [(1, "a"), (2, "b"), (2, "c"), (3, "d"), (5, "e"), (5, "e"), (None, "n")]
    new = [(1, "a"), (2, "c"), (2, "b"), (3, "D"), (5, "e"), (6, "f"), (None, "n")]
    a, b = (spark.createDataFrame(rows, "k long, v string") for rows in (old, new))
    for buckets in (1, 4096):
        got = {(r.k, r.rows_before, r.rows_after, r.change) for r in digests.drifted_rows(a, b, ["k"], buckets).collect()}
        assert got == {(3, 1, 1, "changed"), (5, 2, 1, "changed"), (6, 0, 1, "added")}
    assert digests.drifted_rows(a, a.orderBy(F.desc("v")), ["k"]).isEmpty()
    assert digests.root(digests.bucket_digests(a.limit(0), ["k"])).first()[0] == 0


def test_prepare_verify_and_drift(tables, spark, tmp_path):
    images, anns = tables
    root = str(tmp_path / "views")
    with pytest.raises(ContractError, match="no prepared view"):
        export.verify_views(images, anns, root)
    first = {r.split: r for r in export.prepare_views(images, anns, root, expected_images={"train": 20, "test": 10}).collect()}
    assert first["train"].images == 20 and first["test"].annotations + first["train"].annotations == 300
    again = {r.split: r for r in export.prepare_views(images, anns.orderBy(F.desc("x")), root).collect()}
    assert again == first
    assert export.verify_views(images, anns, root).count() == 2
    changed = anns.withColumn("x", F.when(F.col("ann_id") == 17, -1).otherwise(F.col("x")))
    for act in (export.prepare_views, export.verify_views):
        with pytest.raises(ContractError, match="annotations of train bucket"):
            act(images, changed, root)
    drift = export.view_drift(images, changed, root).collect()
    assert [(r.part, r.split, r.rows_before, r.rows_after) for r in drift] == [("annotations", "train", 1, 1)]
    less = anns.where("ann_id <> 5").withColumn("category_id", F.col("original_category_id"))
    less.write.mode("overwrite").parquet(f"{root}/view")
    with pytest.raises(ContractError, match="view of train bucket [0-9]+ removed"):
        export.verify_views(images, anns, root)
    with pytest.raises(ContractError, match="existing view differs"):
        export.prepare_views(images, anns, root)


def test_broken_sources_and_locked_counts_are_refused(tables, tmp_path):
    images, anns = tables
    root = str(tmp_path / "views")
    with pytest.raises(ContractError, match="locked image count"):
        export.prepare_views(images, anns, root, expected_images={"train": 21, "test": 10})
    with pytest.raises(ContractError, match="annotations refer to known images"):
        export.prepare_views(images.where("image_id <> 4"), anns, root)
    with pytest.raises(ContractError, match="splits are train and test"):
        export.prepare_views(images.where("split = 'test'"), anns.where("split = 'test'"), root)
    assert not (tmp_path / "views").exists()


def test_drift_shuffles_a_row_once(spark):
    """One aggregation by key serves both tables; a key's type may differ between them, and rows of one key are a bag."""
    a = spark.createDataFrame([(k % 7, k % 3, f"t{k}") for k in range(60)] + [(None, None, None)] * 2, "k int, j int, t string")
    b = a.where("t IS NULL OR t <> 't5'").withColumn("k", F.col("k").cast("bigint"))
    b = b.unionByName(b.where("t = 't8'")).unionByName(spark.createDataFrame([(99, 9, "x")], "k bigint, j int, t string"))
    drift = digests.drifted_rows(a, b, ["k", "j"], 4)
    assert drift._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(k#") == 1
    assert sorted(map(tuple, drift.collect())) == [(1, 2, 3, 4, "changed"), (5, 2, 3, 2, "changed"), (99, 9, 0, 1, "added")]
