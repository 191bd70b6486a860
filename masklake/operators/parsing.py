"""Reading annotation payloads of mixed shape.

A payload is JSON text whose shape differs from row to row, so it is read as VARIANT and only then
cast to fixed columns; no schema is inferred over mixed shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masklake.functions.bind import let

DEFAULT_SIZE = 2048

# Normalised segmentation: kind is missing, malformed, polygons or rle.
SEGMENTATION = ("STRUCT<kind STRING, polygons ARRAY<STRUCT<n INT, numeric BOOLEAN, points ARRAY<DOUBLE>>>, "
                "size ARRAY<BIGINT>, has_counts BOOLEAN, counts STRING, runs ARRAY<BIGINT>>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def is_number(v: Column) -> Column:
    """A JSON number (not a boolean, not text)."""
    # BIGINT, DECIMAL(p,s) or DOUBLE; the kind is named once, since lambdas share no common parts
    return F.coalesce(F.substring(F.schema_of_variant(v), 1, 3).isin("BIG", "DEC", "DOU"), F.lit(False))


def _all_objects(items: Column) -> Column:
    return F.forall(items, lambda v: as_map(v).isNotNull())


def _has(m: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False))


def _unwrap(text: Column) -> Column:
    """Text of a nested `coco_annotations` payload, or the text itself."""
    return let(text, lambda t: let(as_map(F.try_parse_json(t)), lambda m: F.when(
        _has(m, "coco_annotations") & ~_has(m, "annotations"),
        F.try_variant_get(F.element_at(m, F.lit("coco_annotations")), "$", "string")).otherwise(t)))


def _innermost(text: Column) -> Column:
    """The payload inside all nested ones.

    A nested payload needs a key of its own, spelt out or with an escape, and some twenty characters, so the text bounds
    the depth; a row stops being parsed at its first level that is not nested.
    """
    spelt = (F.length(text) - F.length(F.replace(text, F.lit("coco_annotations"), F.lit("")))) / 16
    depth = F.coalesce(F.when(text.contains("\\u"), F.length(text) / 20).otherwise(spelt), F.lit(0)).cast("int")
    start = F.struct(text.alias("text"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        inner = let(_unwrap(acc["text"]), lambda t: F.struct(t.alias("text"), t.eqNullSafe(acc["text"]).alias("done")))
        return F.when(acc["done"], acc).otherwise(inner)

    return F.when(depth == 0, text).otherwise(F.aggregate(F.sequence(F.lit(1), depth), start, step, lambda acc: acc["text"]))


def _classify(text: Column, v: Column, m: Column, items: Column) -> Column:
    inner = F.element_at(m, F.lit("annotations"))
    blank = text.isNull() | F.trim(text).isin("", "null")
    none = F.lit(None).cast("array<variant>")
    listed = F.when(F.is_variant_null(inner), F.expr("cast(array() as array<variant>)")).otherwise(as_list(inner))
    single = _has(m, "bbox") | _has(m, "segmentation") | _has(m, "category_id")
    found = (F.when(blank, F.expr("cast(array() as array<variant>)")).when(_has(m, "annotations"), listed)
             .when(m.isNotNull() & single, F.array(v)).when(m.isNull(), items).otherwise(none))
    return let(found, lambda f: let(_all_objects(f), lambda objects: F.struct(
        F.when(objects, f).alias("annotations"),
        F.when(blank, F.lit(None).cast("string")).when(v.isNull(), "text is not JSON")
        .when(f.isNull() & _has(m, "annotations"), "annotations must be a list")
        .when(f.isNull() & m.isNotNull(), "unsupported object keys").when(f.isNull(), "unsupported payload type")
        .when(~objects, "annotations must contain only objects").alias("error"))))


def parse_payload(samples: DataFrame, payload: str = "coco_annotations") -> DataFrame:
    """Adds `annotations ARRAY<VARIANT>` and `parse_error` (NULL when readable); drops `payload`.

    Absent text, blanks and `null` are empty samples. Accepted are an object with `annotations`, an object
    with a nested `coco_annotations` (text or decoded, to any depth), one annotation object, or a list of objects.
    """
    text = _innermost(F.col(payload))
    parsed = let(text, lambda t: let(F.try_parse_json(t), lambda v: let(
        F.struct(as_map(v).alias("m"), as_list(v).alias("l")), lambda s: _classify(t, v, s["m"], s["l"]))))
    keep = [c for c in samples.columns if c != payload]
    return (samples.select(*keep, parsed.alias("_p"))
            .select(*keep, F.col("_p.annotations").alias("annotations"), F.col("_p.error").alias("parse_error")))


def segmentation_struct(v: Column) -> Column:
    """Fixed-shape struct of a flat list, list of polygons, RLE object, or nothing; see SEGMENTATION."""
    return let(F.struct(as_list(v).alias("items"), as_map(v).alias("obj")), lambda s: _segmentation(v, s["items"], s["obj"]))


def _segmentation(v: Column, items: Column, obj: Column) -> Column:
    # only of what is neither list nor object, since naming the kind of a list reads all of it
    text = F.when(items.isNull() & obj.isNull() & (F.schema_of_variant(v) == "STRING"), F.try_variant_get(v, "$", "string"))

    def polygon(p: Column) -> Column:
        numbers = F.transform(as_list(p), lambda e: F.when(is_number(e), F.try_variant_get(e, "$", "double")))
        return let(numbers, lambda points: F.struct(
            F.size(points).alias("n"), (~F.exists(points, lambda v: v.isNull())).alias("numeric"), points.alias("points")))

    flat = F.forall(items, is_number)
    polygons = F.when(flat, F.array(polygon(v))).otherwise(
        F.transform(F.filter(items, lambda e: as_list(e).isNotNull()), polygon))
    counts = F.element_at(obj, F.lit("counts"))
    kind = (F.when(v.isNull() | F.is_variant_null(v), "missing")
            .when(text.isNotNull() & (F.trim(text) == ""), "missing")
            .when(items.isNotNull() & (F.size(items) == 0), "missing")
            .when(obj.isNotNull(), "rle").when(items.isNull(), "malformed").otherwise("polygons"))
    size = F.try_variant_get(F.element_at(obj, F.lit("size")), "$", "array<bigint>")
    return F.struct(
        kind.alias("kind"), F.when(kind == "polygons", polygons).alias("polygons"), size.alias("size"),
        F.coalesce(F.map_contains_key(obj, F.lit("counts")), F.lit(False)).alias("has_counts"),
        F.when(F.schema_of_variant(counts) == "STRING", F.try_variant_get(counts, "$", "string")).alias("counts"),
        F.try_variant_get(counts, "$", "array<bigint>").alias("runs"))


def samples_of(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per sample from `annotation_rows(..., keep_empty=True)`."""
    return rows.where("local_index IS NULL OR local_index = 0").select(*columns)


def annotation_rows(parsed: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One typed row per annotation of every readable sample.

    With `keep_empty` a sample without any, or an unreadable one, keeps one row whose `local_index` is NULL, and
    `parse_error` stays, so that one stored table serves samples and annotations alike.

    Adds `local_index, raw_id, has_category, category_text, category_id, bbox, bbox_len, bbox_numeric,
    has_area, area_number, area, iscrowd, segmentation, segmentation_is_empty_list`.
    """
    readable = parsed if keep_empty else parsed.where("parse_error IS NULL").drop("parse_error")
    exploded = (F.posexplode_outer if keep_empty else F.posexplode)("annotations").alias("local_index", "_a")
    rows = readable.select("*", exploded).drop("annotations").withColumn("_m", as_map(F.col("_a")))
    # a column of its own is computed once
    rows = rows.withColumns({"_box": as_list(F.element_at("_m", F.lit("bbox"))), "_seg": F.element_at("_m", F.lit("segmentation"))})
    field = lambda key: F.element_at("_m", F.lit(key))
    text = lambda key: F.try_variant_get(field(key), "$", "string")
    present = lambda key: F.map_contains_key("_m", F.lit(key))
    to_int = lambda key: F.when(is_number(field(key)), F.try_variant_get(field(key), "$", "double").cast("bigint")) \
        .otherwise(text(key).try_cast("bigint"))
    crowd_key = F.when(present("iscrowd"), field("iscrowd")).otherwise(field("is_crowd"))
    crowd_text = F.try_variant_get(crowd_key, "$", "string")
    crowd = (F.when(F.schema_of_variant(crowd_key) == "BOOLEAN", (crowd_text == "true").cast("bigint"))
             .when(is_number(crowd_key), F.try_variant_get(crowd_key, "$", "double").cast("bigint"))
             .otherwise(F.coalesce(crowd_text.try_cast("bigint"), F.lit(0))))
    box, seg = F.col("_box"), F.col("_seg")
    numbers = F.transform(box, lambda e: F.when(is_number(e), F.try_variant_get(e, "$", "double")))
    return rows.select(
        *[c for c in rows.columns if c not in ("_a", "_m", "_box", "_seg")],
        F.when(present("id"), to_int("id")).otherwise(F.col("local_index").cast("bigint")).alias("raw_id"),
        present("category_id").alias("has_category"),
        F.when(present("category_id"), F.coalesce(text("category_id"), F.lit("None"))).otherwise("missing").alias("category_text"),
        to_int("category_id").alias("category_id"),
        numbers.alias("bbox"), F.coalesce(F.size(box), F.lit(-1)).alias("bbox_len"),
        F.coalesce(F.forall(box, is_number), F.lit(False)).alias("bbox_numeric"),
        F.coalesce(present("area") & ~F.is_variant_null(field("area")), F.lit(False)).alias("has_area"),
        is_number(field("area")).alias("area_number"),
        F.when(is_number(field("area")), F.try_variant_get(field("area"), "$", "double")).alias("area"),
        crowd.alias("iscrowd"), let(seg, segmentation_struct).alias("segmentation"),
        F.coalesce(F.size(as_list(seg)) == 0, F.lit(False)).alias("segmentation_is_empty_list"))
