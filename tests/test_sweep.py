import random

import numpy as np
from pyspark.sql import functions as F

from masklake.operators import masks, sweep

COLUMNS = "k long, c0 long, c1 long, r0 long, r1 long"


def test_lines_are_not_rows(spark):
    far = 4_000_000_000
    df = spark.createDataFrame([(1, 0, far, 0, 10), (1, 5, far, 5, 20), (2, 7, far, 1, 2)], COLUMNS)
    whole = {tuple(r) for r in masks.union(df, ["k"]).collect()}
    assert whole == {(1, 0, 5, 0, 10), (1, 5, far, 0, 20), (2, 7, far, 1, 2)}
    core = masks.erode_general(df.withColumn("d", F.lit(2).cast("long")), ["k"]).select("k", *masks.SLAB)
    assert {tuple(r) for r in core.collect()} == {(1, 2, far - 2, 2, 8), (1, 7, far - 2, 8, 18)}


def test_runs_of_many_masks_cut_into_any_batches(monkeypatch):
    import pyarrow as pa

    draw = random.Random(3)
    for rows, cut in ((4096, 1000), (3, 7), (1, 1), (5, 100)):
        monkeypatch.setattr(sweep, "ROWS", rows)
        data = []
        for k in range(40):
            need = draw.randint(1, 3)
            ends = [(a := draw.randint(0, 12), a + draw.randint(1, 8), b := draw.randint(0, 12), b + draw.randint(1, 8)) for _ in range(draw.randint(1, 9))]
            data += [(k, *s, need, i == 0) for i, s in enumerate(sorted(ends))]
        batch = pa.record_batch([pa.array(c) for c in zip(*data)], names=["k", *sweep.RUN, "_need", "_first"])
        parts = [batch.slice(a, cut) for a in range(0, len(data), cut)]
        got = [tuple(r.values()) for b in sweep.runs(iter(parts), ["k"]) for r in b.to_pylist()]
        for k in range(40):
            depth, seen = np.zeros((30, 30), int), np.zeros((30, 30), int)
            for row in data:
                if row[0] == k:
                    need = row[5]
                    depth[row[1]:row[2], row[3]:row[4]] += 1
            own = [r for r in got if r[0] == k]
            for r in own:
                seen[r[1]:r[2], r[3]:r[4]] += 1
            assert (seen == (depth >= need)).all()
            assert not any(a[2] == b[1] and a[3:] == b[3:] for a in own for b in own)
