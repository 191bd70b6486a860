"""Scans that carry over ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from masklake.operators import prefix, ranking, runs


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_best_before(spark, parts):
    rng = random.Random(parts)
    rows = []
    for key, n in (("hot", 400), ("b", 9), ("c", 1)):
        name = "x"
        for k in range(n):
            name = rng.choice("xyz") if rng.random() < (0.02 if key == "hot" else 0.4) else name
            rows.append((key, k, None if rng.random() < 0.01 else name, rng.randint(0, 60)))
    want = {}
    for key in {r[0] for r in rows}:
        last, best = object(), None
        for _, k, name, value in [r for r in rows if r[0] == key]:
            if name != last:
                last, best = name, None
            want[key, k] = best
            best = value if best is None else max(best, value)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, epoch bigint, name string, value bigint").repartition(4)
    got = prefix.best_before(df, ["run"], [F.col("epoch")], F.col("name"), F.col("value"), "best", parts)
    assert {(r.run, r.epoch): r.best for r in got.collect()} == want
    if parts == 16:
        split = prefix.ranged(df, [F.col("run"), F.col("epoch")], parts)
        assert split.where("run = 'hot'").select("_part").distinct().count() > 8


def test_forward_rows(spark):
    rows = [("a", 0, 5), ("a", 1, 5), ("a", 2, 4), ("a", 3, None), ("a", 4, 7), ("b", 1, 0), ("b", 2, 1), ("b", 3, 0)]
    out = runs.forward_rows(spark.createDataFrame(rows, "run string, at bigint, epoch bigint"), ["run"], ["at"])
    assert sorted(map(tuple, out.collect())) == [("a", 0, 5), ("a", 4, 7), ("b", 1, 0), ("b", 2, 1)]
    assert runs.forward_rows(out.limit(0), ["run"], ["at"]).count() == 0


def test_merge_refuses_placeholder_masks(spark):
    schema = "image_id bigint, pred_id bigint, score double, mask_h int, mask_w int, w double, h double"
    real = spark.createDataFrame([(1, 1, 0.5, 64, 64, 9.0, 9.0), (1, 2, 0.9, 1, 1, 1.0, 1.0)], schema)
    fake = spark.createDataFrame([(1, 3, 0.7, 1, 1, 12.0, 3.0)], schema)
    assert [r.pred_id for r in ranking.merge_top([real, real.where("false")], 1, ["image_id"]).collect()] == [2]
    with pytest.raises(ValueError):
        ranking.merge_top([real, fake], 2, ["image_id"])


def test_decisions(spark):
    delta = spark.createDataFrame([("r", "AP", 0.02), ("r", "B", -0.01), ("s", "AP", 0.0)], "run string, metric string, delta double")
    criteria = spark.createDataFrame([(1, "r", "primary_effect", "AP", 0.01), (1, "r", "non_regression", "B", -0.02), (2, "r", "non_regression", "B", 0.0),
                                      (3, "s", "primary_effect", "Speed", 0.0), (4, "s", "primary_effect", "AP", None)],
                                     "declaration bigint, run string, role string, metric string, minimum_delta double")
    out = runs.judged(delta, criteria)
    assert out.count() == 5
    got = {r.declaration: (r.criteria, r.failed, r.accepted) for r in runs.decisions(out).collect()}
    assert got == {1: (2, 0, True), 2: (1, 1, False), 3: (1, 1, False), 4: (1, 1, False)}
