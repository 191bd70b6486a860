"""The fold and the rounds must agree with a plain sequential pass."""

import random

import pytest
from pyspark.sql import functions as F

from masklake.operators import greedy, matching, suppression


def boxes(n, seed, images=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(images), i, round(rnd.random(), 1), x := rnd.randrange(60), x + 5 + rnd.randrange(20),
             y := rnd.randrange(60), y + 5 + rnd.randrange(20)) for i in range(n)]


def iou(a, b):
    w = min(a[4], b[4]) - max(a[3], b[3])
    h = min(a[6], b[6]) - max(a[5], b[5])
    inter = max(w, 0) * max(h, 0)
    area = lambda t: (t[4] - t[3]) * (t[6] - t[5])
    return inter / (area(a) + area(b) - inter)


def sequential_nms(rows, thr):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(k[0] != r[0] or iou(k, r) < thr for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


SCHEMA = "image_id long, pred_id long, score double, c0 long, c1 long, r0 long, r1 long"


def test_suppression_fold_and_rounds(spark):
    rows = boxes(200, 1) + [(0, 900 + i, 0.5, 3, 20, 3, 20) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sequential_nms(rows, 0.3)
    for limit in (4096, 0):
        got = {r.pred_id for r in suppression.suppress(df, 0.3, cell=16, limit=limit).collect()}
        assert got == want, limit
    slabs = {r.pred_id for r in suppression.suppress(df, 0.3, slabs=df, cell=16).collect()}
    assert slabs == want


@pytest.mark.parametrize("block", [1, 64])
def test_suppression_in_ordered_blocks(spark, block):
    rows = boxes(150, 5, images=2) + [(1, 900 + i, 0.5, 3, 20 + i, 3, 20) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.pred_id for r in suppression.suppress(df, 0.3, cell=16, limit=60, block=block).collect()}
    assert got == sequential_nms(rows, 0.3)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 50_000, []
    survivors = greedy._block_survivors
    monkeypatch.setattr(greedy, "_block_survivors", lambda *a: rounds.append(1) or survivors(*a))
    at = F.col("id") * 10
    df = spark.range(n).select(F.lit(0).cast("long").alias("image_id"), F.col("id").alias("pred_id"), (-at).cast("double").alias("score"),
                               at.alias("c0"), (at + 16).alias("c1"), F.lit(0).cast("long").alias("r0"), F.lit(8).cast("long").alias("r1"))
    got = suppression.suppress(df, 0.2, block=20_000)
    assert got.agg(F.count(F.lit(1)), F.max(F.col("pred_id") % 2)).first()[:] == (n // 2, 0)
    assert len(rounds) <= 2 * n // 20_000 + 1


def test_suppression_is_idempotent_and_capped(spark):
    df = spark.createDataFrame(boxes(120, 2), SCHEMA)
    once = suppression.suppress(df, 0.4)
    again = suppression.suppress(df.join(once.select("image_id", "pred_id"), ["image_id", "pred_id"]), 0.4)
    assert once.count() == again.count()
    assert suppression.suppress(df, 0.4, maxdets=5).groupBy("image_id").count().agg(F.max("count")).first()[0] == 5


def sequential_match(edges):
    used_a, used_b, out = set(), set(), set()
    for a, b, s, v in sorted(edges, key=lambda e: (-e[2], e[0], -e[3], e[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), out.add((a, b))
    return out


def test_matching_fold_and_rounds(spark):
    rnd = random.Random(3)
    score = {a: round(rnd.random(), 1) for a in range(40)}
    edges = [(a, b, score[a], round(0.5 + rnd.random() / 2, 1)) for a in range(40) for b in range(15) if rnd.random() < 0.3]
    df = spark.createDataFrame([(1, *e) for e in edges], "image_id long, pred_id long, gt_id long, score double, iou double")
    want = sequential_match(edges)
    for limit in (4096, 0):
        got = {(r.pred_id, r.gt_id) for r in matching.score_greedy_match(df, ["image_id"], limit).collect()}
        assert got == want, limit


def reference_coco(edges, area, thr):
    low, high = matching.AREA_RANGES[area]
    used, out = set(), set()
    for p in sorted({e[0] for e in edges}, key=lambda p: (-next(e[2] for e in edges if e[0] == p), p)):
        best = None
        for _, g, _, crowd, size, v in (e for e in edges if e[0] == p):
            ignored = int(crowd == 1 or size < low or size > high)
            if v < thr or (g in used and not crowd):
                continue
            if best is None or (ignored, -v, -g) < best[0]:
                best = ((ignored, -v, -g), g, ignored, crowd)
        if best:
            out.add((p, best[1], best[2]))
            used.add(best[1])
    return out


def test_coco_matching_small_and_large_groups(spark):
    rnd = random.Random(4)
    gts = {g: (int(rnd.random() < 0.2), rnd.choice([500, 1024, 5000, 9216, 20000])) for g in range(12)}
    score = {p: round(rnd.random(), 1) for p in range(30)}
    edges = [(p, g, score[p], *gts[g], round(0.5 + rnd.random() / 2, 2)) for p in range(30) for g in range(12) if rnd.random() < 0.35]
    df = spark.createDataFrame([(1, 1, *e) for e in edges],
                               "image_id long, category_id long, pred_id long, gt_id long, score double, iscrowd long, gt_area long, iou double")
    for limit in (4096, 0):
        rows = matching.coco_match(df, limit).collect()
        for a, name in enumerate(matching.AREA_NAMES):
            for t in (0, 4, 8):
                got = {(r.pred_id, r.gt_id, r.ignored) for r in rows if r.area == a and r.bits >> t & 1}
                assert got == reference_coco(edges, name, matching.IOU_THRESHOLDS[t]), (limit, name, t)
