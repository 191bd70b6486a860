"""Registered queries: parsing, validation, cleaning and filtering of annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from masklake.catalog.fixtures import oracle, spark_view
from masklake.operators import cleaning, parsing, validation
from masklake.session import materialize

KEYS = ["split", "sample_index"]


def _side():
    """Side of every canvas as a column; made when asked for, so that the module imports without a session."""
    return F.lit(512).cast("bigint")


def _parsed(spark, sf):
    samples = spark_view(spark, sf, "fx_payload").select("split", "sample_index", "image_id", "coco_annotations")
    return parsing.parse_payload(samples)


def _stored(spark, sf):
    """Samples and annotations of one parse, written once."""
    return materialize(parsing.annotation_rows(_parsed(spark, sf), keep_empty=True), "annotations")


def _rows(spark, sf, stored=None):
    stored = _stored(spark, sf) if stored is None else stored
    return stored.where("local_index IS NOT NULL").drop("parse_error").withColumns({"width": _side(), "height": _side()})


def _checked(spark, sf, stored=None):
    return validation.with_issues(_rows(spark, sf, stored))


def _parse_errors(stored, *columns):
    return parsing.samples_of(stored, *KEYS, "parse_error").where("parse_error IS NOT NULL").select(*columns, F.lit("parse_error").alias("code"))


def _cleaned(spark, sf, collapse=True):
    return cleaning.clean_annotations(_rows(spark, sf), collapse=collapse)


def parse(spark, sf):
    p = _parsed(spark, sf)
    return p.select("sample_index", F.coalesce(F.size("annotations"), F.lit(-1)).cast("bigint").alias("n"),
                    F.col("parse_error").isNotNull().alias("failed"))


def polygons(spark, sf):
    """Every polygon of every annotation with its coordinate count."""
    rows = _rows(spark, sf).where("segmentation.kind = 'polygons'")
    return (rows.select("sample_index", "local_index", F.posexplode("segmentation.polygons").alias("pos", "p"))
            .select("sample_index", F.col("local_index").cast("bigint").alias("local_index"), F.col("pos").cast("bigint").alias("pos"),
                    F.col("p.n").cast("bigint").alias("n"), "p.numeric"))


def boxes(spark, sf):
    d = spark_view(spark, sf, "fx_dirty")
    codes = validation.box_issues(*[F.col(c) for c in "xywh"], _side(), _side())
    return d.select("row_key", F.explode(codes).alias("code"))


def _segment_issues(spark, sf, rle):
    rows = _checked(spark, sf).where("segmentation.kind = 'rle'" if rle else "segmentation.kind <> 'rle'")
    return (validation.issue_rows(rows, ["sample_index", "local_index"]).where("startswith(code, 'segmentation_')")
            .select("sample_index", F.col("local_index").cast("bigint").alias("local_index"), "code"))


def segments(spark, sf):
    return _segment_issues(spark, sf, False)


def rle_checks(spark, sf):
    return _segment_issues(spark, sf, True)


def category_area(spark, sf):
    d = spark_view(spark, sf, "fx_dirty")
    # the columns of a parsed annotation; box and segmentation are sound, so only category and area can fail
    rows = d.select("row_key", F.lit(512).cast("bigint").alias("width"), F.lit(512).cast("bigint").alias("height"),
                    F.col("category_id").isNotNull().alias("has_category"), F.lit(True).alias("has_area"), F.lit(True).alias("area_number"),
                    F.col("area").cast("double").alias("area"), F.lit(4).alias("bbox_len"), F.lit(True).alias("bbox_numeric"),
                    F.array(*[F.lit(v).cast("double") for v in (1, 1, 2, 2)]).alias("bbox"),
                    F.from_json(F.lit('{"kind": "rle", "has_counts": true}'), parsing.SEGMENTATION).alias("segmentation"))
    return validation.issue_rows(validation.with_issues(rows), ["row_key"]).select("row_key", "code")


REPORT = ["annotations", "valid", "invalid", "bbox_valid", "bbox_invalid", "segmentation_valid",
          "segmentation_invalid", "crowd", "issues"]


def _report(spark, sf, stored=None):
    stored = _stored(spark, sf) if stored is None else stored
    return validation.sample_report(parsing.samples_of(stored, *KEYS, "parse_error"), _checked(spark, sf, stored), KEYS)


def sample_reports(spark, sf):
    return _report(spark, sf).select(*KEYS, *[F.col(c).cast("bigint").alias(c) for c in REPORT], "is_empty")


def split_reports(spark, sf):
    out = validation.split_report(_report(spark, sf))
    return out.select(*[F.col(c).cast("bigint").alias(c) if c not in ("split", "per_sample_median") else c for c in out.columns])


def issue_histogram(spark, sf):
    stored = _stored(spark, sf)
    rows = validation.issue_rows(_checked(spark, sf, stored), ["split"]).select("split", "code")
    return validation.histogram(rows.unionByName(_parse_errors(stored, "split")), "split", "code")


def bad_examples(spark, sf):
    stored = _stored(spark, sf)
    issues = validation.issue_rows(_checked(spark, sf, stored), [*KEYS, "local_index"])
    errors = _parse_errors(stored, *KEYS, F.lit(0).alias("local_index"), F.lit(0).alias("issue_index"))
    out = validation.bad_examples(_report(spark, sf, stored), issues.unionByName(errors), KEYS, "sample_index", split="split")
    return out.select("split", "sample_index", F.col("pos").cast("bigint").alias("pos"), "code")


def category_histogram(spark, sf):
    """Counted as it is parsed, and only the counted columns: the outer explode keeps Spark from copying the parse into inferred filters."""
    rows = parsing.annotation_rows(_parsed(spark, sf), keep_empty=True).where("local_index IS NOT NULL")
    return validation.histogram(rows, "split", "category_text", "iscrowd")


def clipped_polygons(spark, sf):
    from masklake.functions.geometry import polygon_area
    rows = _cleaned(spark, sf).where("segmentation.kind = 'polygons'")
    total = F.aggregate(F.transform("polygons", lambda p: polygon_area(p)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("sample_index", F.col("local_index").cast("bigint").alias("local_index"),
                       F.size("polygons").cast("bigint").alias("n"), F.round(total, 6).alias("polygon_area"))


def clipped_boxes(spark, sf):
    from masklake.functions.geometry import clip_box
    d = spark_view(spark, sf, "fx_dirty")
    out = d.select("row_key", clip_box(*[F.col(c) for c in "xywh"], _side(), _side()).alias("b")).where("b IS NOT NULL")
    return out.select("row_key", "b.*")


def clean(spark, sf):
    c = _cleaned(spark, sf)
    kept = lambda n: F.when(F.col("drop_reason").isNull(), F.col(n)).alias(n)
    return c.select("sample_index", F.col("local_index").cast("bigint").alias("local_index"), "drop_reason",
                    "category_id", "original_category_id", "iscrowd", *[kept(n) for n in ("x", "y", "w", "h", "area")])


def empty_masks(spark, sf):
    return (_cleaned(spark, sf).where("drop_reason = 'empty_mask'")
            .select("sample_index", F.col("local_index").cast("bigint").alias("local_index")))


def ids(spark, sf):
    d = spark_view(spark, sf, "fx_dirty").select("row_key", "image_id", F.col("ann_id").cast("bigint").alias("raw_id"))
    return cleaning.assign_ids(d, "raw_id", ["image_id", "row_key"]).select("row_key", "raw_id", "id")


def outcomes(spark, sf):
    return cleaning.export_outcomes(spark_view(spark, sf, "fx_images"), _cleaned(spark, sf))


def categories(spark, sf):
    return cleaning.category_table(_cleaned(spark, sf, collapse=False))


def sizes(spark, sf):
    p = spark_view(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("bigint")).alias("width"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("bigint")).alias("height"))
    return cleaning.image_size(p)


def no_crowds(spark, sf):
    return cleaning.drop_crowds(spark_view(spark, sf, "fx_gt")).select("ann_id", "image_id")


def few_objects(spark, sf):
    g = spark_view(spark, sf, "fx_gt").select("ann_id", "image_id", F.col("original_category_id").alias("category_id"))
    return cleaning.drop_crowded_queries(g, 20).select("ann_id", "image_id")


def scored(spark, sf):
    p = spark_view(spark, sf, "fx_pred").withColumn("area", F.col("w") * F.col("h"))
    return cleaning.filter_predictions(p, 0.5, 400).select("pred_id", "image_id")


# Oracle: the payload was written by rules on `j`, so every expected value follows from `j` alone.
ANNS = """WITH anns AS (
      SELECT p.*, i AS local_index,
             CASE WHEN j % 19 = 0 THEN x - 450 ELSE x END AS bx, CASE WHEN j % 17 = 0 THEN 0 WHEN j % 23 = 0 THEN w + 500 ELSE w END AS bw,
             CASE WHEN j % 3 = 0 THEN x + 300 ELSE x END AS px, j % 13 AS s,
             CASE WHEN j % 37 = 0 OR j % 41 = 0 THEN 'shape' WHEN j % 53 = 0 THEN 'text' ELSE 'ok' END AS b,
             CASE WHEN j % 59 = 0 THEN 0 WHEN j % 7 = 0 OR j % 11 = 0 THEN 1 ELSE 0 END AS crowd
      FROM fx_payload p JOIN (SELECT CAST(unnest(range(2)) AS BIGINT) AS i) k
        ON i < CASE WHEN UNREADABLE OR j % 40 < 7 THEN 0 WHEN j % 40 BETWEEN 13 AND 20 THEN 2 ELSE 1 END),
    issues AS (
      SELECT sample_index, split, local_index, 0 AS o, 'missing_category_id' AS code FROM anns WHERE j % 29 = 0
      UNION ALL SELECT sample_index, split, local_index, 1, 'bbox_missing_or_malformed' FROM anns WHERE b = 'shape'
      UNION ALL SELECT sample_index, split, local_index, 1, 'bbox_non_numeric' FROM anns WHERE b = 'text'
      UNION ALL SELECT sample_index, split, local_index, 2, 'bbox_non_positive_size' FROM anns WHERE b = 'ok' AND bw <= 0
      UNION ALL SELECT sample_index, split, local_index, 3, 'bbox_negative_origin' FROM anns WHERE b = 'ok' AND bx < 0
      UNION ALL SELECT sample_index, split, local_index, 4, 'bbox_out_of_bounds' FROM anns WHERE b = 'ok' AND bx + bw > 512
      UNION ALL SELECT sample_index, split, local_index, 5, CASE s WHEN 3 THEN 'segmentation_rle_size_mismatch' WHEN 4 THEN 'segmentation_rle_missing_counts'
          WHEN 5 THEN 'segmentation_missing' WHEN 6 THEN 'segmentation_malformed' WHEN 7 THEN 'segmentation_missing'
          WHEN 8 THEN 'segmentation_polygon_too_short' WHEN 9 THEN 'segmentation_polygon_odd_length'
          WHEN 10 THEN 'segmentation_polygon_non_numeric' WHEN 12 THEN 'segmentation_polygon_empty'
          ELSE 'segmentation_polygon_out_of_bounds' END FROM anns WHERE s > 2 OR (s = 0 AND px + w > 512)
      UNION ALL SELECT sample_index, split, local_index, 6, 'segmentation_polygon_empty' FROM anns WHERE s = 11 AND h = 1
      UNION ALL SELECT sample_index, split, local_index, 7, 'area_non_positive' FROM anns WHERE j % 43 = 0 OR j % 47 = 0),
    errors AS (SELECT sample_index, split FROM fx_payload WHERE UNREADABLE),
    per AS (SELECT sample_index, local_index, count(*) AS n, count(*) FILTER (WHERE code LIKE 'bbox%') AS nb,
                   count(*) FILTER (WHERE code LIKE 'segm%') AS ns FROM issues GROUP BY 1, 2),
    report AS (
      SELECT p.split, p.sample_index, count(a.sample_index) AS annotations, count(a.sample_index) FILTER (WHERE coalesce(n, 0) = 0) AS valid,
             count(a.sample_index) FILTER (WHERE n > 0) + max(CASE WHEN P_UNREADABLE THEN 1 ELSE 0 END) AS invalid,
             count(a.sample_index) FILTER (WHERE coalesce(nb, 0) = 0) AS bbox_valid, count(a.sample_index) FILTER (WHERE nb > 0) AS bbox_invalid,
             count(a.sample_index) FILTER (WHERE coalesce(ns, 0) = 0) AS segmentation_valid, count(a.sample_index) FILTER (WHERE ns > 0) AS segmentation_invalid,
             count(a.sample_index) FILTER (WHERE a.crowd = 1) AS crowd,
             CAST(coalesce(sum(n), 0) + max(CASE WHEN P_UNREADABLE THEN 1 ELSE 0 END) AS BIGINT) AS issues
      FROM fx_payload p LEFT JOIN anns a ON a.sample_index = p.sample_index
      LEFT JOIN per ON per.sample_index = a.sample_index AND per.local_index = a.local_index GROUP BY 1, 2),
    cleaned AS (
      SELECT *, least(greatest(bx, 0), 512) AS x0, least(greatest(bx + bw, 0), 512) AS x1, least(y + h, 512) AS y1 FROM anns),
    dropped AS (
      SELECT *, CASE WHEN b <> 'ok' THEN 'invalid_bbox' WHEN s IN (7, 11, 12) OR (s = 0 AND px >= 512) THEN 'empty_mask'
                     WHEN s IN (5, 6, 8, 9, 10) THEN 'invalid_segmentation'
                     WHEN x1 - x0 <= 0 OR y1 - y <= 0 THEN 'invalid_bbox' END AS drop_reason,
             CASE WHEN j % 29 = 0 OR j % 31 = 0 THEN 1 ELSE original_category_id END AS orig FROM cleaned)
    """


# An object without any annotation key is refused like the broken forms.
BROKEN = ("(j % 40 BETWEEN 3 AND 6 OR (j % 40 BETWEEN 21 AND 28 AND j % 29 = 0 AND j % 37 = 0 AND j % 13 = 5))")


def _fill(text: str) -> str:
    return text.replace("P_UNREADABLE", BROKEN.replace("j %", "p.j %")).replace("UNREADABLE", BROKEN)


ANNS = _fill(ANNS)


def _o(body: str) -> str:
    return oracle(ANNS + _fill(body), "fx_payload")


D = "fx_dirty"
CASES = {
    "par1_parse_payload": (parse, _o("""SELECT p.sample_index, CASE WHEN UNREADABLE THEN -1 WHEN j % 40 < 3 THEN 0
        WHEN j % 40 BETWEEN 13 AND 20 THEN 2 ELSE 1 END::BIGINT AS n, UNREADABLE AS failed FROM fx_payload p""")),
    "par2_polygons": (polygons, _o("""SELECT sample_index, local_index, CAST(0 AS BIGINT) AS pos,
        CAST(CASE s WHEN 8 THEN 4 WHEN 9 THEN 7 WHEN 10 THEN 6 WHEN 12 THEN 6 ELSE 8 END AS BIGINT) AS n, s <> 10 AS numeric
        FROM anns WHERE s IN (0, 1, 8, 9, 10, 11, 12)""")),
    "val1_box_issues": (boxes, oracle("""SELECT row_key, 'bbox_non_positive_size' AS code FROM fx_dirty WHERE w <= 0 OR h <= 0
        UNION ALL SELECT row_key, 'bbox_negative_origin' FROM fx_dirty WHERE x < 0 OR y < 0
        UNION ALL SELECT row_key, 'bbox_out_of_bounds' FROM fx_dirty WHERE x + w > 512.000001 OR y + h > 512.000001""", D)),
    "val2_segmentation_issues": (segments, _o("SELECT sample_index, local_index, code FROM issues WHERE code LIKE 'segm%' AND code NOT LIKE '%rle%'")),
    "val3_rle_issues": (rle_checks, _o("SELECT sample_index, local_index, code FROM issues WHERE code LIKE '%rle%'")),
    "val4_category_area_issues": (category_area, oracle("""SELECT row_key, 'missing_category_id' AS code FROM fx_dirty WHERE category_id IS NULL
        UNION ALL SELECT row_key, 'area_non_positive' FROM fx_dirty WHERE area <= 0""", D)),
    "val5_sample_report": (sample_reports, _o(f"SELECT split, sample_index, {', '.join(REPORT)}, annotations = 0 AS is_empty FROM report")),
    "val6_split_report": (split_reports, _o("""SELECT split, count(*) AS samples, """ + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}" for c in REPORT[:7]) + """, min(annotations) AS per_sample_min,
        quantile_cont(annotations, 0.5) AS per_sample_median, max(annotations) AS per_sample_max,
        count(*) FILTER (WHERE annotations = 0) AS empty_samples FROM report GROUP BY split""")),
    "val6_issue_histogram": (issue_histogram, _o("""SELECT split, code, count(*) AS n FROM (SELECT split, code FROM issues
        UNION ALL SELECT split, 'parse_error' FROM errors) q GROUP BY 1, 2""")),
    "top5_first_bad_examples": (bad_examples, _o("""SELECT split, sample_index, pos, code FROM (
        SELECT split, sample_index, code, row_number() OVER (PARTITION BY split, sample_index ORDER BY local_index, o) AS pos FROM (
          SELECT split, sample_index, local_index, o, code FROM issues UNION ALL SELECT split, sample_index, 0, 0, 'parse_error' FROM errors) u
        WHERE (split, sample_index) IN (SELECT (split, sample_index) FROM (SELECT split, sample_index, row_number() OVER (PARTITION BY split ORDER BY sample_index) AS k
          FROM report WHERE issues > 0) r WHERE k <= 20)) q WHERE pos <= 5""")),
    "sta3_category_histogram": (category_histogram, _o("""SELECT split, CASE WHEN j % 29 = 0 THEN 'missing' WHEN j % 31 = 0 THEN 'None'
        ELSE CAST(original_category_id AS STRING) END AS category_text, CAST(crowd AS BIGINT) AS iscrowd, count(*) AS n FROM anns GROUP BY 1, 2, 3""")),
    "cln1_clipped_polygons": (clipped_polygons, _o("""SELECT sample_index, local_index,
        CAST(CASE WHEN s = 1 OR (s = 0 AND px < 512) THEN 1 ELSE 0 END AS BIGINT) AS n,
        CAST(CASE WHEN s = 1 THEN w * h WHEN s = 0 AND px < 512 THEN (least(px + w, 512) - px) * h ELSE 0 END AS DOUBLE) AS polygon_area
        FROM anns WHERE s IN (0, 1, 7, 8, 9, 10, 11, 12) AND s <> 7""")),
    "cln3_clipped_boxes": (clipped_boxes, oracle("""SELECT * FROM (SELECT row_key, least(greatest(x, 0), 512) AS x, least(greatest(y, 0), 512) AS y,
        least(greatest(x + w, 0), 512) - least(greatest(x, 0), 512) AS w, least(greatest(y + h, 0), 512) - least(greatest(y, 0), 512) AS h
        FROM fx_dirty) q WHERE w > 0 AND h > 0""", D)),
    "cln4_clean_annotations": (clean, _o("""SELECT sample_index, local_index, drop_reason, CAST(1 AS BIGINT) AS category_id,
        CAST(orig AS BIGINT) AS original_category_id, CAST(crowd AS BIGINT) AS iscrowd,
        CAST(CASE WHEN drop_reason IS NULL THEN x0 END AS DOUBLE) AS x, CAST(CASE WHEN drop_reason IS NULL THEN y END AS DOUBLE) AS y,
        CAST(CASE WHEN drop_reason IS NULL THEN x1 - x0 END AS DOUBLE) AS w, CAST(CASE WHEN drop_reason IS NULL THEN y1 - y END AS DOUBLE) AS h,
        CAST(CASE WHEN drop_reason IS NULL THEN (x1 - x0) * (y1 - y) END AS DOUBLE) AS area FROM dropped""")),
    "cln5_empty_masks": (empty_masks, _o("SELECT sample_index, local_index FROM dropped WHERE drop_reason = 'empty_mask'")),
    "cln6_unique_ids": (ids, oracle("""WITH r AS (SELECT row_key, image_id, CAST(ann_id AS BIGINT) AS raw_id,
          row_number() OVER (PARTITION BY CAST(ann_id AS BIGINT) ORDER BY image_id, row_key) AS k FROM fx_dirty)
        SELECT row_key, raw_id, raw_id AS id FROM r WHERE k = 1
        UNION ALL SELECT row_key, raw_id, (SELECT max(raw_id) FROM r) + row_number() OVER (ORDER BY image_id, row_key) FROM r WHERE k > 1""", D)),
    "cln7_export_outcomes": (outcomes, oracle(ANNS + """, i AS (SELECT f.image_id, count(d.sample_index) AS raw, count(d.sample_index) FILTER (WHERE drop_reason IS NULL) AS kept,
          count(*) FILTER (WHERE drop_reason = 'empty_mask') AS em FROM fx_images f LEFT JOIN dropped d USING (image_id) GROUP BY 1)
        SELECT count(*) AS images_total, count(*) FILTER (WHERE raw = 0) AS images_with_no_raw_annotations,
          count(*) FILTER (WHERE raw > 0 AND kept = 0) AS images_empty_after_cleaning, CAST(0 AS BIGINT) AS images_skipped_no_raw_annotations,
          CAST(0 AS BIGINT) AS images_skipped_empty_after_cleaning, count(*) FILTER (WHERE kept = 0) AS images_retained_empty,
          count(*) AS images_exported, CAST(sum(em) AS BIGINT) AS dropped_annotations_empty_mask FROM i""", "fx_payload", "fx_images")),
    "cln8_category_table": (categories, _o("""SELECT CAST(id AS BIGINT) AS id, CASE WHEN id = 1 THEN 'tree' ELSE concat('category_', CAST(id AS STRING)) END AS name
        FROM (SELECT orig AS id FROM dropped WHERE drop_reason IS NULL UNION SELECT 1) q""")),
    "cln9_image_size": (sizes, """SELECT p_partkey AS image_id, CAST(CASE WHEN p_partkey % 5 <> 0 THEN p_size ELSE 2048 END AS BIGINT) AS width,
        CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_size ELSE 2048 END AS BIGINT) AS height FROM part"""),
    "flt1_no_crowds": (no_crowds, oracle("SELECT ann_id, image_id FROM fx_gt WHERE iscrowd = 0", "fx_gt")),
    "flt2_few_objects": (few_objects, oracle("""SELECT ann_id, image_id FROM fx_gt QUALIFY
        count(*) OVER (PARTITION BY image_id, original_category_id) <= 20""", "fx_gt")),
    "flt4_scored_predictions": (scored, oracle("SELECT pred_id, image_id FROM fx_pred WHERE score >= 0.5 AND w * h >= 400", "fx_pred")),
}
