"""Running sums and maxima over one global order without one global task.

Rows are range-partitioned by the order, so a hot key or a hot score is split like any other. Each
range then needs only the totals of the ranges before it, a table of `ranges x keys` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masklake.session import cleaned, materialize


def ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """`df` with `_part`, the index of its range in `order`; written once so that it stays fixed."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cleaned(materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged"))


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column],
                 parts: int | None = None) -> DataFrame:
    """Adds `name` = sum of the expression over all rows of the same keys up to and including this one."""
    fixed = ranged(df, order, parts)
    totals = fixed.groupBy("_part", *keys).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *keys, *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_b_" + n) for n in sums])
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = fixed.select("*", *[F.sum(e).over(inside).alias(n) for n, e in sums.items()])
    return (local.join(offsets, ["_part", *keys])
            .select(*df.columns, *[(F.col(n) + F.col("_b_" + n)).alias(n) for n in sums]))


def row_numbers(df: DataFrame, order: list[Column], name: str = "rn", parts: int | None = None) -> DataFrame:
    """Global 1-based row number in `order`."""
    return running_sums(df.withColumn("_all", F.lit(0)), ["_all"], order,
                        {name: F.lit(1).cast("bigint")}, parts).drop("_all")


def best_before(df: DataFrame, keys: list[str], order: list[Column], segment: Column, value: Column, name: str,
                parts: int | None = None) -> DataFrame:
    """Adds `name` = largest `value` of the earlier rows, in `order`, of the same keys and the current stretch of equal `segment`.

    It is NULL where a stretch begins. Rows are range-partitioned by (keys, order), so one key may span all ranges. A range hands on,
    for each key, its first and last segment, whether it is a single stretch, and the best of its last stretch; what a range receives is
    a scan over these few rows. The carry is no sum: a range that changes the segment forgets what came before it.
    """
    fixed = ranged(df.withColumns({"_seg": segment, "_val": value}), [*[F.col(k) for k in keys], *order], parts)
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    turn = F.when(F.row_number().over(inside) == 1, 0).otherwise((~F.col("_seg").eqNullSafe(F.lag("_seg").over(inside))).cast("int"))
    local = fixed.withColumn("_turn", turn).withColumn("_stretch", F.sum("_turn").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = local.groupBy("_part", *keys, "_stretch").agg(F.first("_seg").alias("_seg"), F.max("_val").alias("_val"))
    ends = stretches.groupBy("_part", *keys).agg(
        F.min(F.struct("_stretch", "_seg"))["_seg"].alias("_head"), F.max(F.struct("_stretch", "_seg"))["_seg"].alias("_tail"),
        (F.max("_stretch") == 0).alias("_whole"), F.max_by("_val", "_stretch").alias("_tail_best"))
    ranges = Window.partitionBy(*keys).orderBy("_part")  # over a row for each range
    joined = F.col("_whole") & F.col("_head").eqNullSafe(F.lag("_tail").over(ranges)) & (F.row_number().over(ranges) > 1)
    chained = ends.withColumn("_cut", (~joined).cast("int")).withColumn("_chain", F.sum("_cut").over(ranges.rowsBetween(Window.unboundedPreceding, 0)))
    upto = Window.partitionBy(*keys, "_chain").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    carried = chained.withColumn("_run_best", F.max("_tail_best").over(upto)).select(
        "_part", *keys, F.lag("_run_best").over(ranges).alias("_carry"), F.lag("_tail").over(ranges).alias("_carry_seg"),
        (F.row_number().over(ranges) > 1).alias("_has_carry"))
    earlier = Window.partitionBy("_part", *keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = local.withColumn("_own", F.max("_val").over(earlier))
    reaches = (F.col("_stretch") == 0) & F.col("_has_carry") & F.col("_seg").eqNullSafe(F.col("_carry_seg"))
    best = F.when(reaches, F.greatest("_own", "_carry")).otherwise(F.col("_own"))
    return own.join(carried, ["_part", *keys]).select(*df.columns, best.alias(name))
