"""Groups that the overlap join keeps whole are settled where their pairs are found; nothing is written for them."""

import random

from pyspark.sql import functions as F

from masklake.operators import greedy, matching, pairs, recall, suppression

BOXES = "image_id bigint, pred_id bigint, score double, c0 bigint, c1 bigint, r0 bigint, r1 bigint"


def _boxes(spark, n=150, images=3):
    rng = random.Random(11)
    rows = [(k % images, k, rng.randint(0, 9) / 10, x := rng.randint(0, 50), x + 20, y := rng.randint(0, 50), y + 20) for k in range(n)]
    return spark.createDataFrame(rows, BOXES)


def _written(monkeypatch):
    labels, write = [], greedy.materialize
    monkeypatch.setattr(greedy, "materialize", lambda df, label: labels.append(label) or write(df, label))
    return labels


def _edges(boxes):
    area = (F.col("c1") - F.col("c0")) * (F.col("r1") - F.col("r0"))
    preds = boxes.where("pred_id % 2 = 0").withColumn("area", area)
    gts = boxes.where("pred_id % 2 = 1").select("image_id", F.col("pred_id").alias("gt_id"), F.lit(0).alias("iscrowd"),
                                                area.alias("area_mask"), area.alias("area_meta"), "c0", "c1", "r0", "r1")
    return matching.mask_pairs(preds, gts, floor=0.2, group=["image_id"])


def test_suppression_in_place(spark, monkeypatch):
    boxes = _boxes(spark)
    labels = _written(monkeypatch)
    got = {tuple(r) for r in suppression.suppress(boxes, 0.3).collect()}
    assert "conflicts" not in labels
    assert got == {tuple(r) for r in suppression.suppress(boxes, 0.3, limit=greedy.FOLD_LIMIT).collect()} and "conflicts" in labels
    assert 0 < len(got) < 150
    # one group is cut by the join, three are not
    mixed = boxes.unionByName(boxes.where("pred_id < 100").withColumn("image_id", F.lit(9).cast("bigint")))
    want = {tuple(r) for r in suppression.suppress(mixed, 0.3, limit=greedy.FOLD_LIMIT).collect()}
    monkeypatch.setattr(pairs, "large_groups", lambda l, r, on, _, of=pairs.large_groups: of(l, r, on, 3500))
    labels.clear()
    assert {tuple(r) for r in suppression.suppress(mixed, 0.3).collect()} == want
    assert "conflicts" in labels


def test_matching_in_place(spark, monkeypatch):
    edges = _edges(_boxes(spark))
    labels = _written(monkeypatch)
    for match in (matching.score_greedy_match, matching.overlap_greedy_match):
        labels.clear()
        got = {tuple(r) for r in match(edges, ["image_id"]).collect()}
        assert not labels
        assert got == {tuple(r) for r in match(edges.drop(greedy.CUT), ["image_id"]).collect()} and labels
        assert len(got) > 20


def test_a_null_end_is_never_used_up(spark):
    rows = [(1, None, 5, False, 0.9), (1, None, 6, False, 0.8), (1, 2, None, False, 0.7), (1, 2, 7, False, 0.6), (1, 3, 5, False, 0.5), (1, 3, 5, True, 0.4)]
    df = spark.createDataFrame(rows, "image_id bigint, a bigint, b bigint, reuse boolean, s double")
    order = [-F.col("s")]
    want = sorted(map(str, greedy.greedy_match(df, ["image_id"], order).collect()))
    assert sorted(map(str, greedy.greedy_match(df.withColumn(greedy.CUT, F.lit(False)), ["image_id"], order).collect())) == want
    conflicts = df.select("image_id", F.col("a").alias("hi"), F.col("b").alias("lo"), "s")
    want = sorted(map(str, greedy.greedy_drop(conflicts, ["image_id"], order).collect()))
    assert sorted(map(str, greedy.greedy_drop(conflicts.withColumn(greedy.CUT, F.lit(False)), ["image_id"], order).collect())) == want


def test_coverage_of_candidates_that_reach_the_score(spark):
    boxes = _boxes(spark)
    low = boxes.agg(F.count_if(F.col("score") < 0.3)).first()[0]
    assert boxes.count() - recall.scored_from(boxes, 0.3).count() == low > 0
    one = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.31499999999)], "k int, score double")
    assert [r.k for r in recall.scored_from(one, 0.315).orderBy("k").collect()] == [1, 2, 3]  # equal in single precision


def test_histogram_parses_what_it_counts(spark, monkeypatch):
    from masklake.catalog import annotations

    monkeypatch.setattr(annotations, "materialize", lambda *_: 1 / 0)
    monkeypatch.setattr(annotations, "spark_view", lambda *_: spark.createDataFrame(
        [("train", 1, 7, '[{"id":1,"category_id":3,"segmentation":[[1,2,3]]},{"id":2,"iscrowd":1}]'), ("test", 2, 8, "null"), ("test", 3, 8, "[oops")],
        "split string, sample_index bigint, image_id bigint, coco_annotations string"))
    out = annotations.category_histogram(spark, "")
    assert "polygons" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("train", "3", 0, 1), ("train", "missing", 1, 1)]
