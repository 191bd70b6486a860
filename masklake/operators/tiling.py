"""Tile plans and lifting of window masks to image coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from masklake.operators import masks, pairs, sweep
from masklake.session import materialize


def tile_starts(dim: Column, tile: Column, overlap: int) -> Column:
    """First pixels of the tiles along one side; the last tile ends with the image."""
    last = dim - tile
    step = tile - F.lit(overlap)
    return F.when(last <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array_union(F.sequence(F.lit(0).cast("bigint"), last, step), F.array(last)))


def tile_grid(images: DataFrame, tile: int, overlap: int, whole: Column | None = None) -> DataFrame:
    """One row per window `(image_id, window_id, tile_row, tile_col, x0, y0, w, h)`.

    Where `whole` holds, the image is a single window.
    """
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be smaller than the tile")
    whole = F.lit(False) if whole is None else whole
    side = F.least(F.lit(tile).cast("bigint"), "width", "height")
    one = F.array(F.lit(0).cast("bigint"))
    grid = (images.withColumns({
        "_whole": whole, "_side": side,
        "_xs": F.when(whole, one).otherwise(tile_starts(F.col("width"), side, overlap)),
        "_ys": F.when(whole, one).otherwise(tile_starts(F.col("height"), side, overlap))})
        .select("*", F.posexplode("_ys").alias("tile_row", "y0")).select("*", F.posexplode("_xs").alias("tile_col", "x0")))
    return grid.select(
        "image_id", F.format_string("r%d_c%d", "tile_row", "tile_col").alias("window_id"),
        F.col("tile_row").cast("bigint").alias("tile_row"), F.col("tile_col").cast("bigint").alias("tile_col"), "x0", "y0",
        F.when(F.col("_whole"), F.col("width")).otherwise(F.col("_side")).alias("w"),
        F.when(F.col("_whole"), F.col("height")).otherwise(F.col("_side")).alias("h"))


def assign_to_tiles(objects: DataFrame, tiles: DataFrame, key: str, extent: int | None = None) -> DataFrame:
    """Object/tile pairs whose boxes intersect; both sides are slab tables, tiles carry `window_id`."""
    met = pairs.overlap_join(objects.select("image_id", key, *masks.SLAB), tiles.select("image_id", "window_id", *masks.SLAB),
                             ["image_id"], extent=extent)
    return met.select("image_id", F.col("l_" + key).alias(key), F.col("r_window_id").alias("window_id"))


def edge_touch(margin: int) -> Column:
    """Whether a local box `(lx0, ly0, lx1, ly1)` comes within `margin` of its window `(w, h)`."""
    return ((F.col("lx0") <= margin) | (F.col("ly0") <= margin)
            | (F.col("lx1") >= F.col("w") - margin) | (F.col("ly1") >= F.col("h") - margin))


def lift(slabs: DataFrame, keys: list[str], *, min_area: int, margin: int) -> tuple[DataFrame, DataFrame]:
    """Window masks in image coordinates: `(instances, slabs)`.

    `slabs(keys..., mw, mh, x0, y0, w, h, slab)` holds masks on an mw x mh grid that covers the window
    (x0, y0, w, h). The tight box of a mask is scaled outwards (floor, ceil) and its content resized to that
    box by nearest neighbour; instances below `min_area` pixels are dropped. Instances get `area`, global and local box,
    and `edge_touch`.
    """
    attrs = [*keys, "mw", "mh", "x0", "y0", "w", "h"]
    tight = masks.mask_stats(slabs.select(*keys, *masks.SLAB), keys).select(
        *keys, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    first = lambda b, size, grid: F.greatest(F.lit(0), F.floor(F.col(b) * F.col(size) / F.col(grid)))
    last = lambda b, n, size, grid: F.least(F.col(size), F.ceil((F.col(b) + F.col(n)) * F.col(size) / F.col(grid)))
    placed = (slabs.select(*attrs, *masks.SLAB).join(tight, keys)
              .withColumns({"lx0": first("bx", "w", "mw"), "ly0": first("by", "h", "mh"),
                            "lx1": last("bx", "bw", "w", "mw"), "ly1": last("by", "bh", "h", "mh")})
              .where("lx1 > lx0 AND ly1 > ly0")
              .withColumns({"c0": F.col("c0") - F.col("bx"), "c1": F.col("c1") - F.col("bx"),
                            "r0": F.col("r0") - F.col("by"), "r1": F.col("r1") - F.col("by")}))
    resized = masks.nearest_resize(placed, F.col("bw"), F.col("bh"), F.col("lx1") - F.col("lx0"), F.col("ly1") - F.col("ly0"))
    moved = resized.withColumns({
        "c0": F.col("c0") + F.col("lx0") + F.col("x0"), "c1": F.col("c1") + F.col("lx0") + F.col("x0"),
        "r0": F.col("r0") + F.col("ly0") + F.col("y0"), "r1": F.col("r1") + F.col("ly0") + F.col("y0")})
    info = ["x0", "y0", "w", "h", "lx0", "ly0", "lx1", "ly1"]
    instances = (moved.groupBy(*keys, *info).agg(F.sum(masks.slab_pixels()).alias("area"))
                 .where(F.col("area") >= min_area).withColumn("edge_touch", edge_touch(margin))
                 .select(*keys, "area", (F.col("x0") + F.col("lx0")).alias("gx"), (F.col("y0") + F.col("ly0")).alias("gy"),
                         (F.col("lx1") - F.col("lx0")).alias("gw"), (F.col("ly1") - F.col("ly0")).alias("gh"),
                         "lx0", "ly0", "edge_touch"))
    kept = moved.select(*keys, *masks.SLAB).join(instances.select(*keys), keys, "left_semi")
    return instances, kept


WINDOW_SCHEMA = "image_id bigint, window_id string, pred_index bigint, score double, mh bigint, mw bigint, runs array<bigint>"


def predict_windows(windows: DataFrame, backend: Callable[[pd.DataFrame], pd.DataFrame], partitions: int | None = None) -> DataFrame:
    """Runs a user's model over window rows batch by batch.

    `backend` maps a batch of windows to rows of WINDOW_SCHEMA (masks as run lengths). It is loaded per task.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield backend(batch)

    spread = windows.repartition(partitions) if partitions else windows
    return spread.mapInPandas(run, WINDOW_SCHEMA)


def check_inside(slabs: DataFrame) -> DataFrame:
    """Slabs that leave their `width` x `height` image; must be empty before encoding."""
    return slabs.where("c0 < 0 OR r0 < 0 OR c1 > width OR r1 > height")


#: Slabs of a mask up to which its components are found in one task.
WHOLE_MASK = 1 << 18


def components(slabs: DataFrame, keys: list[str], min_area: int = 25, limit: int = WHOLE_MASK) -> DataFrame:
    """4-connected components of masks: slabs with `component`, small components dropped.

    A mask of at most `limit` slabs is labelled in a task, larger ones in rounds of joins. Both name a component by the least hash
    of its slabs. Masks with a NULL key are left out.
    """
    runs = masks.union(slabs.dropna(subset=keys), keys)
    place = F.struct("c0", "r0", "c1", "r1")
    nodes = materialize(runs.withColumn("node", F.xxhash64(*keys, place)), "nodes")
    large = materialize(nodes.groupBy(*keys).count().where(F.col("count") > limit).select(*keys), "large-masks")
    if large.isEmpty():
        return _labelled(nodes, keys, min_area)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    small, rest = (nodes.alias("n").join(large.alias("m"), same, how) for how in ("left_anti", "left_semi"))
    return _labelled(small, keys, min_area).unionByName(_linked(materialize(rest, "nodes"), keys, min_area))


def _labelled(nodes: DataFrame, keys: list[str], min_area: int) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("c0", "r0")) == 1
    rows = nodes.select(*keys, *masks.SLAB, "node").withColumn("_first", first)
    long = [T.StructField(c, T.LongType()) for c in ("component", *masks.SLAB, "area")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sweep.whole_groups(batches, 4096):
            c0, c1, r0, r1, node = (table.column(c).to_numpy() for c in (*masks.SLAB, "node"))
            label = sweep.regions(np.cumsum(table.column("_first").to_numpy()) - 1, c0, c1, r0, r1)
            area, name = np.zeros(len(label), np.int64), np.full(len(label), np.iinfo(np.int64).max)
            np.add.at(area, label, (c1 - c0) * (r1 - r0))
            np.minimum.at(name, label, node)
            kept = np.flatnonzero(area[label] >= min_area)
            named = table.select(keys).take(pa.array(kept)).combine_chunks()
            values = [name[label], c0, c1, r0, r1, area[label]]
            for batch in named.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v[kept], pa.int64()) for v in values]],
                                                 [*keys, "component", *masks.SLAB, "area"])

    return rows.mapInArrow(run, T.StructType([*[nodes.schema[k] for k in keys], *long]))


def _linked(nodes: DataFrame, keys: list[str], min_area: int) -> DataFrame:
    """Slabs touching along an edge are linked; every slab takes the smallest label in reach, with pointer
    jumping, until nothing changes.
    """
    grown = nodes.select(*keys, "node", *masks.SLAB)
    # Growing one side by a pixel in each direction makes edge contact an overlap; corners alone do not count.
    met = pairs.overlap_join(
        grown.withColumns({"c0": F.col("c0") - 1, "c1": F.col("c1") + 1, "r0": F.col("r0") - 1, "r1": F.col("r1") + 1}),
        grown, keys, where=lambda: F.col("l_node") != F.col("r_node"))
    share_c = F.least(F.col("l_c1") - 1, "r_c1") > F.greatest(F.col("l_c0") + 1, "r_c0")
    share_r = F.least(F.col("l_r1") - 1, "r_r1") > F.greatest(F.col("l_r0") + 1, "r_r0")
    links = materialize(met.where(share_c | share_r).select(F.col("l_node").alias("a"), F.col("r_node").alias("b")), "links")
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = (links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        after = materialize(step.join(jump, "new", "left").select(
            "node", "label", F.least("new", F.coalesce("up", "new")).alias("new")), "labels")
        changed = not after.where("new <> label").isEmpty()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            break
    out = nodes.join(labels, "node").withColumn("component", F.col("label")).drop("label", "node")
    big = out.groupBy(*keys, "component").agg(F.sum(masks.slab_pixels()).alias("area")).where(F.col("area") >= min_area)
    return out.join(big, [*keys, "component"]).select(*keys, "component", *masks.SLAB, "area")
