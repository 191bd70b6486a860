"""Polygon outlines to pixel spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from masklake.operators.sweep import spread, whole_groups

SPAN = ["c0", "c1", "r0", "r1"]


def polygons_to_spans(polygons: DataFrame, keys: list[str], points: str) -> DataFrame:
    """Slabs of one-column spans covered by flat [x0, y0, x1, y1, ...] outlines.

    A pixel belongs to a polygon when its centre lies inside by the even-odd rule. Each edge is cut with the
    column centres it passes; the crossings of a column are sorted and paired. Outlines along pixel borders
    come out exactly, others differ from sub-pixel rasterisers by border pixels.

    The outlines of one key, which apply together, are brought together; their crossings are made and paired in a task.
    """
    rows = (polygons.where(F.size(points) >= 6).select(*keys, F.col(points).cast("array<double>").alias("_points"))
            .withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) == 1))
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in SPAN]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1024):
            outlines = table.column("_points").combine_chunks()
            outlines = outlines.chunk(0) if isinstance(outlines, pa.ChunkedArray) else outlines
            first = table.column("_first").to_numpy()
            group, *spans = _spans(np.cumsum(first) - 1, outlines)
            where = np.flatnonzero(first)
            if len(group):
                named = table.select(keys).take(pa.array(where[group])).combine_chunks()
                for batch in named.to_batches():
                    yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in spans]], [*keys, *SPAN])

    return rows.mapInArrow(run, schema)


def _spans(group: np.ndarray, outlines: pa.Array) -> tuple[np.ndarray, ...]:
    """`(group, c0, c1, r0, r1)` from outlines."""
    size = outlines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    corner = size // 2
    begin = np.cumsum(size) - size
    value = outlines.flatten()
    known = value.is_valid().to_numpy(zero_copy_only=False)
    value = value.fill_null(0.0).to_numpy(zero_copy_only=False)
    outline, i = spread(corner)
    here, there = begin[outline] + 2 * i, begin[outline] + 2 * ((i + 1) % corner[outline])
    x0, y0, x1, y1 = value[here], value[here + 1], value[there], value[there + 1]
    cuts = known[here] & known[there] & (x0 != x1)
    lost = ~(known[here + 1] & known[there + 1])
    outline, x0, y0, x1, y1, lost = (v[cuts] for v in (outline, x0, y0, x1, y1, lost))
    low = np.ceil(np.minimum(x0, x1) - 0.5).astype(np.int64)
    high = np.ceil(np.maximum(x0, x1) - 0.5).astype(np.int64) - 1
    edge, k = spread(np.maximum(high - low + 1, 0))
    column = low[edge] + k
    slope = (y1 - y0) / (x1 - x0)
    y = y0[edge] + (column + 0.5 - x0[edge]) * slope[edge]
    y[lost[edge]] = -np.inf  # a crossing without a place comes first and makes no span
    of = group[outline[edge]]
    order = np.lexsort((y, column, of))
    of, column, y = of[order], column[order], y[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (column[1:] != column[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(of)) - first[np.cumsum(new) - 1] if len(of) else of
    opens = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:]) if len(of) else of
    opens = opens[np.isfinite(y[opens]) & np.isfinite(y[opens + 1])]
    r0, r1 = (np.ceil(y[at] - 0.5).astype(np.int64) for at in (opens, opens + 1))
    some = r1 > r0
    opens, r0, r1 = opens[some], r0[some], r1[some]
    return of[opens], column[opens], column[opens] + 1, r0, r1
