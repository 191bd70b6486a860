import random

import numpy as np

from masklake.operators import tiling


def test_components_in_a_task_and_in_rounds(spark):
    draw = random.Random(5)
    rows = [(k, a := draw.randint(0, 36), a + draw.randint(1, 6), b := draw.randint(0, 36), b + draw.randint(1, 6)) for k in range(3) for _ in range(30)]
    df = spark.createDataFrame(rows, "k long, c0 long, c1 long, r0 long, r1 long")
    whole, rounds = ({tuple(r) for r in tiling.components(df, ["k"], min_area=9, limit=n).collect()} for n in (1 << 18, 0))
    assert whole == rounds
    for k in range(3):
        grid = np.zeros((50, 50), bool)
        for row in rows:
            if row[0] == k:
                grid[row[1]:row[2], row[3]:row[4]] = True
        sizes, seen = [], np.zeros_like(grid)
        for start in zip(*np.nonzero(grid)):
            stack, n = [start], 0
            while stack:
                x, y = stack.pop()
                if 0 <= x < 50 and 0 <= y < 50 and grid[x, y] and not seen[x, y]:
                    seen[x, y], n = True, n + 1
                    stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
            sizes += [n] if n >= 9 else []
        assert sorted({(r[1], r[6]) for r in whole if r[0] == k}, key=lambda p: p[1]) == sorted({(r[1], r[6]) for r in rounds if r[0] == k}, key=lambda p: p[1])
        assert sorted(a for _, a in {(r[1], r[6]) for r in whole if r[0] == k}) == sorted(sizes)


def test_masks_without_key_are_left_out(spark):
    df = spark.createDataFrame([(None, 0, 9, 0, 9), (1, 0, 9, 0, 9)], "k long, c0 long, c1 long, r0 long, r1 long")
    for limit in (1 << 18, 0):
        assert [r.k for r in tiling.components(df, ["k"], limit=limit).collect()] == [1]
