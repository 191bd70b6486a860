"""Writing datasets, dumps, reports and ledgers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masklake.operators.views import ContractError, content_digest


def write_coco(tables: dict[str, DataFrame], path: str) -> None:
    """Images, annotations and categories as tables; annotations are laid out by image for later joins."""
    tables["images"].write.mode("errorifexists").parquet(f"{path}/images")
    (tables["annotations"].repartition("image_id", "id").sortWithinPartitions("image_id", "id")
     .write.mode("errorifexists").parquet(f"{path}/annotations"))
    tables["categories"].coalesce(1).write.mode("errorifexists").parquet(f"{path}/categories")


def write_predictions(preds: DataFrame, path: str, run: str) -> None:
    """A dump as Parquet partitioned by run, in image and score order within files."""
    (preds.withColumn("run", F.lit(run)).sortWithinPartitions("image_id", F.col("score").desc(), "pred_id")
     .write.mode("append").partitionBy("run").parquet(path))


def write_provenance(spark: SparkSession, path: str, record: dict, preds: DataFrame, images: DataFrame) -> None:
    """Appends one row describing a run: what the caller knows plus the counts."""
    n_pred = preds.agg(F.count(F.lit(1)).alias("n_predictions"))
    n_img = images.agg(F.count(F.lit(1)).alias("n_images"))
    row = n_pred.join(n_img.hint("broadcast")).select(
        *[F.lit(v).alias(k) for k, v in sorted(record.items())], "n_images", "n_predictions", F.current_timestamp().alias("created_utc"))
    row.coalesce(1).write.mode("append").parquet(path)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts a complete file in the place of another by one rename."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(fresh), hadoop.Path(path)
    how = getattr(hadoop, "Options$Rename")
    flags = spark.sparkContext._gateway.new_array(how, 1)
    flags[0] = how.OVERWRITE
    source = source.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(source)
    hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(
        source, target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target), flags)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_report(df: DataFrame, path: str) -> None:
    """Replaces a report: its rows become a new version's folder, then the file that names the version is swapped by one rename.

    A failure at any step leaves the old version in place. The version before stays for readers that opened it; older ones go.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    before = _current(spark, root)
    df.write.mode("errorifexists").json(f"{root}/{version}")
    fs, fresh = _file_system(spark, f"{root}/_{version}")
    out = fs.create(fresh, False)
    out.write(bytearray(version.encode()))
    out.close()
    _swap(spark, f"{root}/_{version}", f"{root}/_current")
    for status in fs.listStatus(_file_system(spark, root)[1]):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def _current(spark: SparkSession, root: str) -> str | None:
    """Name of a report's present version."""
    if not path_exists(spark, f"{root}/_current"):
        return None
    # read through the file system: Spark does not list names with an underscore
    fs, pointer = _file_system(spark, f"{root}/_current")
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The present version of a report that `write_report` wrote."""
    root = path.rstrip("/")
    version = _current(spark, root)
    if version is None:
        raise ContractError(f"{path} holds no report")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{root}/{version}")


def document_rows(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of `export_tables` with the names and shapes of a COCO document."""
    images = tables["images"].withColumnsRenamed({"image_id": "id", "split": "source_split"})
    a = tables["annotations"]
    box = F.array(*[F.col(c).cast("double") for c in ("x", "y", "w", "h")])
    annotations = a.select("id", "image_id", "category_id", "original_category_id", box.alias("bbox"), F.col("polygons").alias("segmentation"),
                           F.col("area").cast("double").alias("area"), "iscrowd")
    return {"images": images, "annotations": annotations, "categories": tables["categories"].select("id", "name")}


def write_coco_document(rows: dict[str, DataFrame], path: str, info: dict | None = None, outcomes: DataFrame | None = None) -> None:
    """One COCO document of `images`, `annotations` and `categories`, each in the order of `id`.

    Every section is sorted by ranges and written as parts by all tasks; the parts are then put together byte by byte through a buffer of
    64 KB. `info` holds what the caller gives and the columns of `outcomes`, a report of one row. The document appears under its name only
    when it is complete.
    """
    spark = rows["images"].sparkSession
    facts = dict(info or {}) | (outcomes.first().asDict() if outcomes is not None else {})
    build = f"{path}.{uuid.uuid4().hex}"
    sections = ("images", "annotations", "categories")
    for name in sections:
        # each line begins with the comma that parts it from the one before; the section's first is skipped below
        line = F.concat(F.lit(","), F.to_json(F.struct(*rows[name].columns)))
        placed = rows[name].repartitionByRange("id").sortWithinPartitions("id")
        placed.select(line.alias("value")).write.mode("errorifexists").text(f"{build}/{name}")
    fs, whole = _file_system(spark, f"{build}/document")
    out = fs.create(whole, False)
    say = lambda text: out.write(bytearray(text.encode()))
    try:
        say('{"info":' + json.dumps(facts, default=str))
        for name in sections:
            say(f',"{name}":[')
            parts = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(_file_system(spark, f"{build}/{name}")[1]))
            first = True
            for part, length in parts:
                if not part.startswith("part-") or not length:
                    continue
                stream = fs.open(_file_system(spark, f"{build}/{name}/{part}")[1])
                if first:
                    stream.read()
                    first = False
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                stream.close()
            say("]")
        say("}")
    finally:
        out.close()
    _swap(spark, f"{build}/document", path)
    fs.delete(_file_system(spark, build)[1], True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_once(df: DataFrame, path: str) -> bool:
    """Writes a table that is not there yet; the same content again is accepted, other content refused."""
    spark = df.sparkSession
    if path_exists(spark, path):
        old, new = (content_digest(t).first() for t in (spark.read.parquet(path), df))
        if old != new:
            raise ContractError(f"{path} already holds different content")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def append_ledger(df: DataFrame, path: str) -> None:
    """Appends rows with the time they were written."""
    df.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def latest_change(spark: SparkSession, path: str, fmt: str = "parquet"):
    """Time of the newest file of a table."""
    return spark.read.format(fmt).load(path).select(F.max("_metadata.file_modification_time")).first()[0]


def reusable(spark: SparkSession, output: str, inputs: list[str], checks: DataFrame | None = None) -> bool:
    """Whether an output may be reused: present, valid, and not older than its inputs.

    A stale or invalid output raises instead of being recomputed silently.
    """
    if not path_exists(spark, output):
        return False
    if checks is not None and not checks.where("NOT ok").isEmpty():
        raise ContractError(f"{output} is not a valid result")
    made = latest_change(spark, output)
    for source in inputs:
        if path_exists(spark, source) and latest_change(spark, source) > made:
            raise ContractError(f"{output} is older than {source}")
    return True
