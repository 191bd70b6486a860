import random

from masklake.operators import matching, pairs, tiling

SLABS = "image_id long, category_id long, {} long, c0 long, c1 long, r0 long, r1 long"


def boxes(spark, name, n, images=3, seed=1):
    draw = random.Random(seed)
    rows = [(i % images, 1, i, a := draw.randint(0, 300), a + draw.randint(1, 90), b := draw.randint(0, 300), b + draw.randint(1, 90)) for i in range(n)]
    return spark.createDataFrame(rows, SLABS.format(name))


def test_groups_joined_whole_and_in_cells(spark):
    left, right = boxes(spark, "p", 200), boxes(spark, "g", 150, 4, 2)
    rows = [{tuple(r) for r in pairs.overlap_join(left, right, ["image_id"], cell=32, whole=n).select(
        "image_id", "l_p", "r_g", "overlap").collect()} for n in (pairs.WHOLE, 1800, 0)]
    assert rows[0] and rows[0] == rows[1] == rows[2]


def test_pairs_are_summed_where_they_are_joined_and_nothing_is_broadcast(spark):
    left, right = boxes(spark, "p", 60), boxes(spark, "g", 50, 3, 2)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    met = plan(pairs.intersections(left, right, ["image_id"], "p", "g"))
    assert met.count("Exchange hashpartitioning") == 2 and "Broadcast" not in met
    tiles = right.selectExpr("image_id", "cast(g AS string) AS window_id", "c0", "c1", "r0", "r1")
    assert "Broadcast" not in plan(tiling.assign_to_tiles(left, tiles, "p"))


def test_matching_in_one_pass_equals_rounds(spark):
    draw = random.Random(4)
    rows = [(i % 2, 1, p, g, p / 40, int(g % 5 == 0), draw.choice([100, 2000, 20000]), draw.choice([0.5, 0.6, 0.77, 0.9]))
            for i in range(2) for p in range(40) for g in range(30) if draw.random() < 0.3]
    df = spark.createDataFrame(rows, "image_id long, category_id long, pred_id long, gt_id long, score double, iscrowd long, gt_area long, iou double")
    assert {tuple(r) for r in matching.coco_match(df).collect()} == {tuple(r) for r in matching.coco_match(df, 5).collect()}


def test_suppression_reads_its_best_copies_once(spark, monkeypatch):
    from masklake.operators import suppression

    written = []
    keep = suppression.materialize
    monkeypatch.setattr(suppression, "materialize", lambda df, label: written.append(label) or keep(df, label))
    p = boxes(spark, "pred_id", 300).withColumn("score", pairs.F.rand(3)).cache()
    copies = p.unionByName(p.limit(50).withColumn("pred_id", pairs.F.col("pred_id") + 1000))
    by_box, by_mask = (suppression.suppress(copies, 0.3, slabs=s) for s in (None, copies))
    assert {tuple(r) for r in by_box.collect()} == {tuple(r) for r in by_mask.collect()}
    assert written == ["best", "best"]
