"""Run lengths to slabs and back: one list and one explode, one shuffle."""

import contextlib
import io

import pyarrow as pa
from pyspark.sql import functions as F

from masklake.operators import masks, sweep


def _plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_runs_become_slabs_in_one_explode(spark):
    rows = [(1, [3, 4, 2, 1], 5), (2, [0, 23, 2], 5), (3, [7], 5), (4, None, 5), (5, [1, 2], None), (None, [4, 12, 1], 4)]
    df = spark.createDataFrame(rows, "k long, runs array<long>, height int")
    slabs = masks.runs_to_slabs(df, "runs", "height")
    assert _plan(slabs).count("Generate") == 1  # a run's pieces were a second list, filtered by a lambda
    found = sorted(tuple(r) for r in slabs.select(F.coalesce("k", F.lit(0)), "height", *masks.SLAB).collect())
    assert found == sorted([(0, 4, 1, 2, 0, 4), (0, 4, 2, 3, 0, 4), (0, 4, 3, 4, 0, 4), (1, 5, 0, 1, 3, 5), (1, 5, 1, 2, 0, 2), (1, 5, 1, 2, 4, 5),
                            (2, 5, 0, 1, 0, 5), (2, 5, 1, 4, 0, 5), (2, 5, 4, 5, 0, 3)])


ROWS = [(k, 9, 7, c, c + 2, k % 3, k % 3 + 2) for k in range(1, 12) for c in (0, 3, 5)] + [(None, 9, 7, 0, 9, 0, 7), (20, 9, 7, 0, 1, 0, 1)]


def _check(key, found):
    pixels = [False] * 63
    for row in ROWS:
        if row[0] == key:
            for c in range(row[3], row[4]):
                pixels[7 * c + row[5]:7 * c + row[6]] = [True] * (row[6] - row[5])
    assert [on for i, n in enumerate(found) for on in [i % 2 == 1] * n] == pixels and 0 not in found[1:]


def test_run_lengths_take_one_shuffle(spark):
    slabs = spark.createDataFrame(ROWS, "k long, width int, height int, c0 int, c1 int, r0 int, r1 int").repartition(3)
    runs = masks.slabs_to_runs(slabs, ["k", "width", "height"], "height")
    assert _plan(runs).count("Exchange hashpartitioning") == 1  # the runs were shuffled by the same keys once more
    found = runs.collect()
    assert len(found) == 13
    for row in found:
        _check(row.k, row.runs)


def test_run_lengths_of_masks_cut_by_batches(monkeypatch):
    monkeypatch.setattr(sweep, "ROWS", 2)
    monkeypatch.setattr(sweep, "MASKS", 2)
    columns = [list(c) for c in zip(*((k, h, w, c0, c1, r0, r1, 1, i == 0 or ROWS[i - 1][0] != k) for i, (k, w, h, c0, c1, r0, r1) in enumerate(ROWS)))]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "_h", "_w", *sweep.RUN, "_need", "_first"])
    for size in (1, 2, 5, 100):
        batches = [whole.slice(a, size) for a in range(0, len(ROWS), size)]
        rows = [r for b in sweep.lengths(sweep.runs(iter(batches), ["k", "_h", "_w"], "_mask"), ["k"]) for r in b.to_pylist()]
        assert [r["k"] for r in rows] == [*range(1, 12), None, 20]
        for row in rows:
            _check(row["k"], row["runs"])
