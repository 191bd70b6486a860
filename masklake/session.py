"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "masklake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned under; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def compile_all(spark: SparkSession) -> None:
    """Let a stage whose one generated method is too long for the JVM's compiler run as split methods, which it compiles."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's `spark.checkpoint.dir` when it names one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    already_set = spark.sparkContext._jsc.sc().getCheckpointDir()
    if already_set.isDefined():
        return already_set.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="masklake-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet under the checkpoint folder and read it back.

    A written table survives executor loss, is columnar, and gives the optimizer its true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _written.append((spark.sparkContext.applicationId, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def written_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table that `materialize` returned."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


#: Tables that `materialize` wrote and nobody discarded yet: (application, path).
_written: list[tuple[str, str]] = []


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared file system."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage: Spark removes a finished job's shuffle files only once the driver has forgotten it."""
    gc.collect()
    spark._jvm.System.gc()


def cleaned(table: DataFrame) -> DataFrame:
    """A table that `materialize` returned; the shuffle files that writing it took go before the next step makes its own."""
    forget(table.sparkSession)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned and that no later result reads any more, and `forget` finished jobs."""
    paths = [t._written_path for t in tables]
    for spark in {t.sparkSession for t in tables}:
        delete(spark, paths)
    _written[:] = [w for w in _written if w[1] not in paths]
    for spark in {t.sparkSession for t in tables}:
        forget(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owner of one query's intermediate tables: those written inside are deleted at the end.

    The query's result must be read or written before the block ends.
    """
    before = set(_written)
    try:
        yield
    finally:
        mine = [w for w in _written if w not in before and w[0] == spark.sparkContext.applicationId]
        delete(spark, [path for _, path in mine])
        _written[:] = [w for w in _written if w not in mine]
