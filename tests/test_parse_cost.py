"""Parsing reads every value once and gives the same on odd payloads."""

from pyspark.sql import functions as F

from masklake.catalog.fixtures import spark_view
from masklake.operators import cleaning, parsing


def _times(df, name):
    return df._jdf.queryExecution().analyzed().toString().count(name)


def test_numbers_are_told_by_one_look_at_the_kind(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("1e300",), ("-0",), ('"1"',), ("true",), ("null",), ("[1]",), ('{"a":1}',), ("x",), (None,)], "t string")
    df = df.select("t", parsing.is_number(F.try_parse_json("t")).alias("n"))
    assert _times(df, "schema_of_variant") == 1
    assert {r.t: r.n for r in df.collect()} == {t: t in ("1", "1.5", "1e300", "-0") for t in ("1", "1.5", "1e300", "-0", '"1"', "true", "null", "[1]", '{"a":1}', "x", None)}


def test_odd_segmentations(spark):
    texts = {"[]": "missing", "null": "missing", '" "': "missing", '"oops"': "malformed", "3": "malformed", "true": "malformed",
             '{"size":[2,2],"counts":"ab"}': "rle", "{}": "rle", "[1,2,3,4,5,6]": "polygons", "[[1,2,3],4,[]]": "polygons", '[["a",1]]': "polygons", "[4,[1]]": "polygons"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.segmentation_struct(F.try_parse_json("t")).alias("s")).select("t", "s.*")
    rows = {r.t: r for r in df.collect()}
    assert {t: r.kind for t, r in rows.items()} == texts
    assert [(p.n, p.numeric, p.points) for p in rows["[1,2,3,4,5,6]"].polygons] == [(6, True, [1, 2, 3, 4, 5, 6])]
    assert [(p.n, p.numeric) for p in rows["[[1,2,3],4,[]]"].polygons] == [(3, True), (0, True)]
    assert [(p.n, p.numeric) for p in rows['[["a",1]]'].polygons] == [(2, False)]
    assert rows['{"size":[2,2],"counts":"ab"}'].counts == "ab" and rows["{}"].has_counts is False and rows["{}"].polygons is None


def test_pixels_of_odd_outlines(spark):
    shapes = [([0.0, 0, 4, 0, 4, 4], True), ([0.0, 0, 4, 0, 8, 0], False), ([], False), ([1.0, 1, 1.5, 1, 1.5, 1.5], False), ([2.0, 1, 2, 9, 2, 3], False)]
    df = spark.createDataFrame([(i, [float(v) for v in s[0]]) for i, s in enumerate(shapes)], "i int, p array<double>")
    got = {r.i: bool(r.ok) for r in df.select("i", cleaning.has_pixels(F.col("p")).alias("ok")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(shapes)}


def test_views_run_as_code_that_the_jvm_compiles(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "p_partkey bigint, x int").write.parquet(str(tmp_path / "part.parquet"))
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    spark_view(spark, str(tmp_path), "fx_images")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
