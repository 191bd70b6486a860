"""Span algebra against dense arrays."""

import numpy as np
from pyspark.sql import functions as F

from masklake.functions import rle
from masklake.operators import boundary, masks, pairs, raster, tiling


def dense_slabs(name, grid):
    """One-pixel-high slabs of a boolean array."""
    return [(name, int(c), int(c) + 1, int(r), int(r) + 1) for r, c in zip(*np.nonzero(grid))]


def grid_of(df, name, shape):
    out = np.zeros(shape, bool)
    for r in df.where(F.col("mask_id") == name).collect():
        assert not out[r.r0:r.r1, r.c0:r.c1].any()
        out[r.r0:r.r1, r.c0:r.c1] = True
    return out


def erode(grid, d):
    padded = np.pad(grid, d)
    out = np.ones_like(grid)
    for dr in range(2 * d + 1):
        for dc in range(2 * d + 1):
            out &= padded[dr:dr + grid.shape[0], dc:dc + grid.shape[1]]
    return out


SCHEMA = "mask_id string, c0 long, c1 long, r0 long, r1 long"


def random_masks(seed):
    rng = np.random.default_rng(seed)
    blob = np.zeros((24, 30), bool)
    for _ in range(6):
        r, c = rng.integers(0, 16), rng.integers(0, 20)
        blob[r:r + rng.integers(4, 10), c:c + rng.integers(4, 12)] = True
    blob[10, 12] = False
    return {"blob": blob, "noise": rng.random((24, 30)) < 0.7}


def test_union_and_erosion(spark):
    grids = random_masks(5)
    df = spark.createDataFrame([s for n, g in grids.items() for s in dense_slabs(n, g)], SCHEMA)
    joined = masks.union(df, ["mask_id"])
    eroded = masks.erode_general(joined.withColumn("d", F.lit(2).cast("long")), ["mask_id"])
    for name, grid in grids.items():
        assert (grid_of(joined, name, grid.shape) == grid).all()
        assert (grid_of(eroded, name, grid.shape) == erode(grid, 2)).all()


def test_runs_and_text_round_trip(spark):
    grids = random_masks(6)
    rows = []
    for name, grid in grids.items():
        flat, runs, state = grid.T.reshape(-1), [], False
        count = 0
        for v in flat:
            if v != state:
                runs.append(count)
                count, state = 0, v
            count += 1
        rows.append((name, runs + [count], 24, 30))
    df = spark.createDataFrame(rows, "mask_id string, runs array<long>, height long, width long")
    text = df.withColumn("back", rle.decode_counts(rle.encode_counts(F.col("runs"))))
    assert text.where("back <> runs").count() == 0
    slabs = masks.runs_to_slabs(df, "runs", "height")
    again = masks.slabs_to_runs(slabs, ["mask_id", "height", "width"], "height")
    assert {r.mask_id: r.runs for r in again.collect()} == {r[0]: r[1] for r in rows}
    for name, grid in grids.items():
        assert (grid_of(slabs, name, grid.shape) == grid).all()


def test_equal_columns_are_one_slab(spark):
    # An L of 40 columns and a run that wraps over three columns; NULL and empty masks have no slabs.
    tall = [5, 8, *[2, 8] * 9, *[7, 3] * 30, 1000]
    df = spark.createDataFrame([("l", tall, 10), ("wrap", [4, 25, 1], 10), ("none", None, 10), ("void", [100], 10), ("flat", [1, 2], None)],
                               "mask_id string, runs array<long>, height long")
    got = {(r.mask_id, r.c0, r.c1, r.r0, r.r1) for r in masks.runs_to_stacks(df, "runs", "height").collect()}
    plain = masks.runs_to_slabs(df, "runs", "height")
    cells = lambda rows: sorted((m, c, r) for m, c0, c1, r0, r1 in rows for c in range(c0, c1) for r in range(r0, r1))
    assert cells(got) == cells([(r.mask_id, r.c0, r.c1, r.r0, r.r1) for r in plain.collect()])
    assert {g for g in got if g[0] == "wrap"} == {("wrap", 0, 1, 4, 10), ("wrap", 1, 2, 0, 10), ("wrap", 2, 3, 0, 9)}
    assert len([g for g in got if g[0] == "l"]) < 10 < plain.where("mask_id = 'l'").count()


def test_known_counts_text(spark):
    # The published coder writes small runs as single characters from code 48 on.
    df = spark.createDataFrame([([5, 3, 2, 4, 30],)], "runs array<long>")
    text = df.select(rle.encode_counts(F.col("runs"))).first()[0]
    assert text == "5321l0"


def test_overlaps_across_grid_levels(spark):
    rng = np.random.default_rng(7)
    rows = [(1, i, int(x), int(x + w), int(y), int(y + h)) for i, (x, y, w, h) in enumerate(
        zip(rng.integers(0, 900, 120), rng.integers(0, 900, 120), rng.choice([3, 40, 900], 120), rng.choice([5, 60, 700], 120)))]
    df = spark.createDataFrame(rows, "image_id long, mask_id long, c0 long, c1 long, r0 long, r1 long")
    want = {(a[1], b[1], max(0, min(a[3], b[3]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[4], b[4]))) for a in rows for b in rows}
    want = {w for w in want if w[2]}
    got = pairs.overlap_join(df, df, ["image_id"], cell=8).collect()
    assert len(got) == len(want)
    assert {(r.l_mask_id, r.r_mask_id, r.overlap) for r in got} == want


def test_components_are_four_connected(spark):
    grid = np.zeros((12, 12), bool)
    grid[0:6, 0:6] = True
    grid[6:12, 6:12] = True  # touches the first one at a corner only
    grid[0:3, 8:10] = True   # too small
    df = spark.createDataFrame(dense_slabs("m", grid), SCHEMA)
    out = tiling.components(df, ["mask_id"], min_area=25).groupBy("component").agg(F.first("area").alias("a")).collect()
    assert sorted(r.a for r in out) == [36, 36]


def test_polygon_pixels(spark):
    df = spark.createDataFrame([("t", [0.0, 0.0, 10.0, 0.0, 0.0, 10.0])], "mask_id string, points array<double>")
    spans = raster.polygons_to_spans(df, ["mask_id"], "points")
    want = np.fromfunction(lambda r, c: (r + 0.5) + (c + 0.5) < 10, (10, 10))
    assert (grid_of(spans, "t", want.shape) == want).all()


def test_lifted_window_masks(spark):
    rows = [("right_column", 1, 2, 0, 2, 2, 2, 0, 0, 8, 4), ("whole", 0, 2, 0, 2, 2, 2, 3, 2, 4, 4)]
    df = spark.createDataFrame(rows, "mask_id string, c0 long, c1 long, r0 long, r1 long, mw long, mh long, x0 long, y0 long, w long, h long")
    out, _ = tiling.lift(df, ["mask_id"], min_area=4, margin=0)
    got = {r.mask_id: (r.gx, r.gy, r.gw, r.gh, r.area) for r in out.collect()}
    assert got == {"right_column": (4, 0, 4, 4, 16), "whole": (3, 2, 4, 4, 16)}


def disc(cx, cy, radius, size=200):
    y, x = np.mgrid[0:size, 0:size]
    return (x - cx) ** 2 + (y - cy) ** 2 <= radius ** 2


def disc_slabs(spark, discs, key, extra):
    rows = []
    for i, (x, y, r) in enumerate(discs):
        grid = disc(x, y, r)
        for c in np.flatnonzero(grid.any(axis=0)):
            on = np.flatnonzero(grid[:, c])
            rows.append((1, 1, i, int(grid.sum()), int(c), int(c) + 1, int(on[0]), int(on[-1]) + 1))
    df = spark.createDataFrame(rows, f"image_id long, category_id long, {key} long, area long, c0 long, c1 long, r0 long, r1 long")
    return df.select("*", *extra)


def test_boundary_iou_of_discs(spark):
    gts = disc_slabs(spark, [(50, 50, 20), (140, 50, 20), (50, 150, 20)], "gt_id",
                     [F.lit(0).alias("iscrowd"), F.col("area").alias("area_mask"), F.col("area").alias("area_meta")]).drop("area")
    preds = disc_slabs(spark, [(50, 50, 20), (142, 52, 20), (150, 150, 15)], "pred_id", [F.lit(0.9).alias("score")])
    got = {r.pred_id: (r.gt_id, r.boundary_iou) for r in boundary.instance_boundary_iou(preds, gts).collect()}
    assert got[0] == (0, 1.0)
    assert got[1][0] == 1 and 0.2 < got[1][1] < 0.95
    assert got[2] == (None, None)
