"""Reading datasets, annotation documents, prediction dumps, logs and run records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masklake.session import materialize

DOCUMENT = ("info MAP<STRING,STRING>, "
            "images ARRAY<STRUCT<id BIGINT, file_name STRING, width BIGINT, height BIGINT, source_split STRING, source_index BIGINT>>, "
            "annotations ARRAY<STRUCT<id BIGINT, image_id BIGINT, category_id BIGINT, original_category_id BIGINT, bbox ARRAY<DOUBLE>, "
            "segmentation STRING, area DOUBLE, iscrowd BIGINT>>, "
            "categories ARRAY<STRUCT<id BIGINT, name STRING>>")
PREDICTION = ("image_id BIGINT, category_id BIGINT, score DOUBLE, bbox ARRAY<DOUBLE>, segmentation STRUCT<size ARRAY<BIGINT>, counts STRING>")
RAW_INSTANCE = PREDICTION + ", area BIGINT, tile_id STRING, tile_row BIGINT, tile_col BIGINT, edge_touch BOOLEAN, tile_pred_index BIGINT"


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Samples of one split; the error for an unknown split names the ones there are."""
    samples = spark.read.parquet(path)
    chosen = samples.where(F.col("split") == split)
    if chosen.isEmpty():
        names = samples.select("split").distinct()
        known, n = [r[0] for r in names.orderBy("split").limit(100).collect()], names.count()
        raise ValueError(f"no split {split!r}; available: {known}" + (f" and {n - len(known)} more" if n > len(known) else ""))
    return chosen


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An annotation document as tables `images`, `annotations`, `categories`, `info`.

    One document is one JSON value and cannot be split while it is parsed, so large datasets should be kept
    as the tables that `write_coco` writes; `segmentation` stays JSON text for `parse_payload`.
    """
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = {n: doc.select(F.inline(n)) for n in ("images", "annotations", "categories")}
    out["info"] = doc.select("info")
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds `pred_id`: the file's place among the sorted paths times 2 ** 40, plus the row's position in its file.

    Rows of one block of a file come in order, so a row's position is its distance from the block's first row plus the rows of
    earlier blocks. Only files and blocks are numbered against each other, and the ids do not depend on how files are split.
    """
    read = materialize(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                   F.monotonically_increasing_id().alias("_at")), "dump")
    blocks = read.groupBy("_file", "_block").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
                                 "_place": F.dense_rank().over(Window.orderBy("_file")) - 1})
    position = F.col("_at") - F.col("_from") + F.col("_before")
    return (read.join(placed, ["_file", "_block"]).withColumn("pred_id", F.col("_place").cast("bigint") * F.lit(1 << 40) + position)
            .drop("_file", "_block", "_at", "_from", "_n", "_before", "_place"))


def read_predictions(spark: SparkSession, path: str | list[str], images: DataFrame | None = None, schema: str = PREDICTION) -> DataFrame:
    """A dump of one or more files as rows with `pred_id` in dump order, optionally of the listed images only.

    Parquet dumps written by `write_predictions` keep their ids. JSON arrays are read element by element and JSON lines line by
    line; ids tell files apart and are the same in every run.
    """
    first = (path if isinstance(path, str) else path[0]).rstrip("/")
    if first.endswith(".json"):
        preds = _numbered(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path))
    elif first.endswith(".jsonl"):
        preds = _numbered(spark.read.schema(schema).json(path))
    else:
        preds = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return preds if images is None else preds.join(images.select("image_id"), "image_id", "left_semi")


def schema_fields(ddl: str) -> str:
    """Column list of a table schema in the form struct types use."""
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def read_raw_instances(spark: SparkSession, path: str | list[str], images: DataFrame | None = None) -> DataFrame:
    """Raw instances from `{"instances": [...]}` documents or bare lists, numbered in file order.

    A bare list is read element by element; a document with the key is one value and is parsed by one task.
    """
    nested = f"instances ARRAY<STRUCT<{schema_fields(RAW_INSTANCE)}>>, {RAW_INSTANCE}"
    doc = spark.read.schema(nested).option("multiLine", True).json(path)
    flat = [f.name for f in doc.schema.fields if f.name != "instances"]
    one = F.array(F.struct(*flat))
    items = doc.select(F.inline(F.when(F.col("instances").isNotNull(), F.col("instances")).otherwise(one)), F.col("_metadata"))
    rows = _numbered(items)
    return rows if images is None else rows.join(images.select("image_id"), "image_id", "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """`(rows, rejected)` of a JSON-lines log; unreadable lines (a cut-off tail) are set apart, an absent file is empty."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if not exists:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line STRING")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.where("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")
    return good, parsed.where("r IS NULL OR r._bad IS NOT NULL").select(F.col("value").alias("line"))


def read_runs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """One row per run record with the folder it came from as `run`."""
    return (spark.read.schema(schema).option("multiLine", True).json(paths)
            .withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))


def first_images(images: DataFrame, n: int, order: str = "image_id") -> DataFrame:
    """The first `n` images of the list."""
    return images.orderBy(order).limit(n)


#: Bytes from which on a file is read in pieces: a row holds 2 GB at most, and a task several copies of it.
PIECEWISE = 1 << 28


def file_identity(spark: SparkSession, path: str, prefix_bytes: int = 64 << 20, piecewise: int = PIECEWISE) -> DataFrame:
    """Size, SHA-256 and SHA-256 of the first `prefix_bytes` of every file below `path`.

    Files of more than `piecewise` bytes are read by many tasks and hashed piece by piece, each by one task, which never holds the whole of it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    whole = lambda df: df.select("path", "length", F.sha2("content", 256).alias("sha256"),
                                 F.sha2(F.substring("content", 1, prefix_bytes), 256).alias("prefix_sha256"))
    # The condition on the length is settled before a file is opened.
    large = [r.path for r in files.where(F.col("length") > piecewise).select("path").collect()]
    if not large:
        return whole(files)
    return whole(files.where(F.col("length") <= piecewise)).unionByName(_piecewise(spark, large, prefix_bytes))


def _piecewise(spark: SparkSession, paths: list[str], prefix_bytes: int) -> DataFrame:
    """The same for large files, as the lines between their bytes 10: rows of any file, also of one without text."""
    names = {spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString(): p for p in paths}  # a row names its file as an encoded URI
    pieces = (spark.read.option("lineSep", "\n").text([re.sub(r"([\[\]{}*?\\,])", r"\\\1", p) for p in paths])  # a path is no pattern
              .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
                      F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
                      F.col("value").cast("binary").alias("_piece")))
    # Rows of a block come in order; blocks are put in order by their place in the file.
    ordered = pieces.withColumn("_first", F.row_number().over(Window.partitionBy("path").orderBy("_block", "_row")) == 1)
    return (ordered.select("path", "length", "_piece", "_first")
            .mapInArrow(lambda batches: _hashed(batches, names, prefix_bytes), "path string, length bigint, sha256 string, prefix_sha256 string"))


def _hashed(batches, names: dict[str, str], prefix_bytes: int):
    import hashlib

    import pyarrow as pa

    path, length, seen = None, 0, 0
    whole = head = None

    def add(data) -> None:
        nonlocal seen
        whole.update(data)
        if seen < prefix_bytes:
            head.update(memoryview(data)[:prefix_bytes - seen])
        seen += len(data)

    def close():
        if seen == length - 1:  # a last byte 10 ends a line and begins none
            add(b"\n")
        if seen != length:
            raise ValueError(f"{path}: {seen} of {length} bytes were read; a file that Spark unpacks or that begins with a byte order mark has no identity in pieces")
        values = ([path], [length], [whole.hexdigest()], [head.hexdigest()])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.string(), pa.string()))],
                                          ["path", "length", "sha256", "prefix_sha256"])

    for batch in batches:
        first = batch.column("_first").to_numpy(zero_copy_only=False).nonzero()[0].tolist()
        lines = batch.column("_piece").to_pylist()
        for a, z in zip([0, *(c for c in first if c)], [*(c for c in first if c), len(lines)]):
            if a in first:
                if whole is not None:
                    yield close()
                path, length, seen, whole, head = names[batch.column("path")[a].as_py()], batch.column("length")[a].as_py(), 0, hashlib.sha256(), hashlib.sha256()
                add(b"\n".join(lines[a:z]))
            else:
                add(b"\n" + b"\n".join(lines[a:z]))
    if whole is not None:
        yield close()
