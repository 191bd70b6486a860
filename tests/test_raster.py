from pyspark.sql import functions as F

from masklake.operators import masks
from masklake.operators.raster import polygons_to_spans


def test_outlines_of_a_key_apply_together(spark):
    square = lambda a, b: [float(v) for v in (a, a, b, a, b, b, a, b)]
    rows = [(1, square(0, 10)), (1, square(2, 8)), (2, square(0, 4)), (3, [0.0, 0.0, 4.0, 0.0]), (4, [0.0, 0.0, 8.0, 0.0, 0.0, 8.0]), (5, None)]
    df = spark.createDataFrame(rows, "k long, points array<double>").repartition(4)
    spans = polygons_to_spans(df, ["k"], "points")
    got = {r.k: (r.area, r.n_slabs) for r in masks.mask_stats(spans, ["k"]).collect()}
    assert got == {1: (64, 16), 2: (16, 4), 4: (28, 7)}
    assert "Generate" not in spans._jdf.queryExecution().executedPlan().toString()  # columns are no rows before the shuffle
