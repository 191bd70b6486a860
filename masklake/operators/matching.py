"""Matching predictions to annotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from masklake.functions.geometry import LARGE_LIMIT, MEDIUM_AREA, SMALL_AREA
from masklake.operators import greedy, pairs
from masklake.session import materialize

# Fixed values of the evaluation protocol: IoU thresholds, closed area ranges, ranks for recall.
IOU_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
AREA_RANGES = {"all": (0, LARGE_LIMIT), "small": (0, SMALL_AREA),
               "medium": (SMALL_AREA, MEDIUM_AREA), "large": (MEDIUM_AREA, LARGE_LIMIT)}
AREA_NAMES = list(AREA_RANGES)
MAX_DETS = 512
GROUP = ["image_id", "category_id"]


def combo(area: int, threshold: int) -> int:
    """Bit position of an (area range, IoU threshold) pair."""
    return area * len(IOU_THRESHOLDS) + threshold


def outside(area: Column, name: str) -> Column:
    low, high = AREA_RANGES[name]
    return (area < low) | (area > high)


def top_per_image(preds: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """The `k` best-scored predictions of every group with their `rank`; ties to the lower id.

    `rank <= k` on `row_number` lets Spark keep only `k` rows per group before the shuffle.
    """
    order = Window.partitionBy(*(group or GROUP)).orderBy(F.col("score").desc(), "pred_id")
    return preds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def of_ranked(preds: DataFrame, ranked: DataFrame, most: int | None = None) -> DataFrame:
    """Slabs of the ranked predictions. When `ranked` holds the `most` best of every group, only larger groups are joined with it."""
    ids, keys = ranked.select(*GROUP, "pred_id"), [*GROUP, "pred_id"]
    if most is None:
        return preds.join(ids, keys, "left_semi")
    named = preds.dropna(subset=keys)
    crowded = materialize(named.groupBy(*GROUP).count().where(F.col("count") > most).select(*GROUP), "crowded")
    if crowded.isEmpty():
        return named
    return named.join(crowded, GROUP, "left_anti").unionByName(named.join(crowded, GROUP, "left_semi").join(ids, keys, "left_semi"))


def similarity(inter: Column, pred_area: Column, gt_area: Column, crowd: Column) -> Column:
    """IoU; against a crowd annotation the denominator is the prediction alone."""
    return F.try_divide(inter, F.when(crowd == 1, pred_area).otherwise(pred_area + gt_area - inter))


def mask_pairs(preds: DataFrame, gts: DataFrame, *, floor: float, use_crowd: bool = True,
               group: list[str] | None = None, cell: int = 128, extent: int | None = None) -> DataFrame:
    """Mask IoU of every prediction/annotation pair that can reach `floor`.

    `preds(group, pred_id, score, area, slab)` and `gts(group, gt_id, iscrowd, area_mask, area_meta, slab)`
    are slab tables that repeat the mask's attributes on each slab. `greedy.CUT` tells whether the overlap join cut the pair's group.
    """
    group = group or GROUP
    bound = F.least("l_area", "r_area_mask") >= F.greatest("l_area", "r_area_mask") * (floor - 1e-4)
    possible = (bound | (F.col("r_iscrowd") == 1)) if use_crowd else bound
    met = pairs.intersections(preds, gts, group, "pred_id", "gt_id", ["score", "area"],
                              ["iscrowd", "area_mask", "area_meta"], cell, extent, lambda: possible, cut=greedy.CUT)
    crowd = F.col("r_iscrowd") if use_crowd else F.lit(0)
    iou = similarity(F.col("inter"), F.col("l_area"), F.col("r_area_mask"), crowd)
    return (met.withColumn("iou", iou).where(F.col("iou") >= floor)
            .select(*group, F.col("l_pred_id").alias("pred_id"), F.col("r_gt_id").alias("gt_id"),
                    F.col("l_score").alias("score"), F.col("r_iscrowd").alias("iscrowd"),
                    F.col("r_area_meta").alias("gt_area"), "iou", "inter", greedy.CUT))


def _pass_rows(edges: DataFrame, group: list[str]) -> DataFrame:
    """Pairs as the pass takes them: `ig` and `reached` say in one bit for each area range, or threshold, where a pair is ignored, or reaches."""
    ignored = F.lit(0)
    for i, name in enumerate(AREA_NAMES):
        ignored = ignored + F.when((F.col("iscrowd") == 1) | outside(F.col("gt_area"), name), 1 << i).otherwise(0)
    reached = F.lit(0)
    for t, value in enumerate(IOU_THRESHOLDS):
        reached = reached + F.when(F.col("iou") >= value, 1 << t).otherwise(0)
    return edges.select(
        *group, F.col("pred_id").alias("a"), F.col("gt_id").alias("b"), (F.col("iscrowd") == 1).alias("reuse"),
        (-F.col("score")).alias("ns"), F.col("iou"), ignored.alias("ig"), reached.alias("reached"))


def coco_match(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """COCO matching for all area ranges and thresholds at once.

    `edges(image_id, category_id, pred_id, gt_id, score, iscrowd, gt_area, iou)` holds only the ranked
    predictions. Each prediction, best score first, takes the free annotation it overlaps most, ignored
    ones only when no counted one is left; equal overlap goes to the later annotation; crowd annotations
    can be taken again. Returns `(image_id, category_id, area, pred_id, gt_id, ignored, bits)`; bit t of
    `bits` says that the pair is matched at threshold t.

    A pass over the ordered pairs of an image holds one prediction's pairs and what is taken, however many pairs come. With
    `limit`, images with more pairs go through rounds instead.
    """
    rows = _pass_rows(edges, GROUP)
    if limit is None:
        return _fold_thresholds(rows)
    small, big = greedy._split(materialize(rows, "candidates"), GROUP, limit)
    out = _fold_thresholds(small)
    if big is not None:
        out = out.unionByName(_match_large(big, limit))
    return out


def coco_hits(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The same matching as what every matched prediction took: `(group, pred_id, tp, ig)`, with one bit for each (area range, threshold).

    A prediction whose pairs the pass meets in several places has several rows.
    """
    group = group or GROUP
    rows = _ordered(_pass_rows(edges, group), group)
    schema = StructType([*[rows.schema[c] for c in group], *[StructField(c, LongType()) for c in ("pred_id", "tp", "ig")]])
    return rows.mapInArrow(lambda batches: _fold_batches(batches, group, False), schema)


def _ordered(rows: DataFrame, group: list[str]) -> DataFrame:
    # The window brings an image's pairs into one partition and in order, and tells where an image begins.
    order = Window.partitionBy(*group).orderBy("ns", "a", -F.col("iou"), -F.col("b"), F.col("reuse").cast("int"), "ig", "reached")
    return rows.withColumn("_first", F.row_number().over(order) == 1).select(*group, "a", "b", "reuse", "ig", "reached", "_first")


def _fold_thresholds(rows: DataFrame) -> DataFrame:
    """One ordered pass per image; a bit mask carries all area ranges and thresholds through it together."""
    taken = _ordered(rows, GROUP).mapInArrow(lambda batches: _fold_batches(batches, GROUP, True),
                                             "image_id bigint, category_id bigint, pred_id bigint, gt_id bigint, ignored int, bits bigint")
    n = len(IOU_THRESHOLDS)
    ranges = F.array(*[F.struct(F.lit(a).alias("area"), F.call_function("shiftright", F.col("bits"), F.lit(a * n)).bitwiseAND((1 << n) - 1).cast("int").alias("bits"))
                       for a in range(len(AREA_NAMES))])
    return (taken.withColumn("_r", F.explode(F.filter(ranges, lambda r: r["bits"] != 0)))
            .select(*GROUP, "_r.area", "pred_id", "gt_id", "ignored", "_r.bits"))


def _fold_batches(batches, group: list[str], by_pair: bool):
    """Pairs taken `(group, pred_id, gt_id, ignored, bits)`, or without `by_pair` what each prediction took, `(group, pred_id, tp, ig)`."""
    n, areas = len(IOU_THRESHOLDS), range(len(AREA_NAMES))
    spread = sum(1 << combo(a, 0) for a in areas)  # one bit for each area range
    in_range = np.array([sum(((1 << n) - 1) << combo(a, 0) for a in areas if flags >> a & 1) for flags in range(1 << len(AREA_NAMES))], np.int64)
    names = [*group, "pred_id", *(["gt_id", "ignored", "bits"] if by_pair else ["tp", "ig"])]
    types = [pa.int64()] * len(names)
    if by_pair:
        types[-2] = pa.int32()
    pred_used, gt_used = {}, {}  # what is taken in the image
    held = []  # pairs of one prediction
    where = pred = None
    out = []

    def settle():
        mine = pred_used.get(pred, 0)
        took = [0, 0]
        for ignored in (0, 1):
            for pair in held:
                free = pair[2 + ignored] & ~mine
                if free and not pair[1]:
                    free &= ~gt_used.get(pair[0], 0)
                if free:
                    mine |= free
                    gt_used[pair[0]] = gt_used.get(pair[0], 0) | free
                    took[ignored] |= free
                    if by_pair:
                        out.append((*where, pred, pair[0], ignored, free))
        if mine:
            pred_used[pred] = mine
        if not by_pair and (took[0] or took[1]):
            out.append((*where, pred, *took))
        held.clear()

    def flush():
        columns = list(zip(*out)) if out else [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        out.clear()
        return batch

    for batch in batches:
        k = len(group)
        first, ids = batch.column("_first").to_pylist(), batch.column(k).to_pylist()
        groups = list(zip(*(batch.column(i).to_pylist() for i in range(k))))
        ig, reached = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ig", "reached"))
        reached, ig = reached * spread, in_range[ig]
        pairs_ = zip(batch.column("b").to_pylist(), batch.column("reuse").to_pylist(), (reached & ~ig).tolist(), (reached & ig).tolist())
        for place, begins, a, pair in zip(groups, first, ids, pairs_):
            if begins or a != pred:
                if held:
                    settle()
                pred = a
                if begins:
                    where = place
                    pred_used.clear()
                    gt_used.clear()
            held.append(pair)
        if len(out) > 10_000:
            yield flush()
    if held:
        settle()
    yield flush()


def _match_large(rows: DataFrame, limit: int) -> DataFrame:
    """The same matching for large groups: one greedy selection per (group, area range, threshold)."""
    combos = F.array(*[
        F.struct(F.lit(a).alias("area"), F.lit(t).alias("thr"))
        for a in range(len(AREA_NAMES)) for t in range(len(IOU_THRESHOLDS))])
    bit = lambda col, i: F.call_function("shiftright", col, i).bitwiseAND(1)
    per_combo = (rows.withColumn("_c", F.explode(combos)).where(bit(F.col("reached"), F.col("_c.thr")) == 1)
                 .select(*GROUP, "_c.area", "_c.thr", "a", "b", "reuse", "ns", "iou",
                         bit(F.col("ig"), F.col("_c.area")).alias("ig")))
    per_combo = materialize(per_combo, "combos")
    keys = [*GROUP, "area", "thr"]
    won = greedy.greedy_match(per_combo, keys, [F.col("ns"), F.col("a"), F.col("ig"), -F.col("iou"), -F.col("b")], limit)
    return (won.join(per_combo.select(*keys, "a", "b", "ig"), [*keys, "a", "b"])
            .groupBy(*GROUP, "area", "a", "b", "ig")
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("thr"))).alias("bits"))
            .select(*GROUP, "area", F.col("a").alias("pred_id"), F.col("b").alias("gt_id"),
                    F.col("ig").alias("ignored"), "bits"))


def cap_copies(preds: DataFrame, gts: DataFrame, geometry: list[str], group: list[str]) -> DataFrame:
    """Leaves out prediction copies that cannot match in one-to-one matching.

    Copies of one prediction compete for the same annotations, so only as many of them as their own group has
    annotations can ever match; the rest stay unmatched whatever happens. A copy is a mask that is equal as a whole: `geometry`
    names the columns of a slab, and a mask is the set of its slabs. The result feeds candidate search only, counts are still
    taken over all predictions.
    """
    whole = F.array_sort(F.collect_set(F.struct(*geometry))).alias("_mask")
    masks = preds.groupBy(*group, "pred_id").agg(F.first("score").alias("score"), whole)
    order = Window.partitionBy(*group, "_mask").orderBy(F.col("score").desc(), "pred_id")
    room = gts.groupBy(*group).agg(F.count_distinct("gt_id").alias("_room"))
    able = (masks.withColumn("_copy", F.row_number().over(order)).join(room, group)
            .where(F.col("_copy") <= F.col("_room")).select(*group, "pred_id"))
    return preds.join(able, [*group, "pred_id"], "left_semi")


def _cut(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c == greedy.CUT]


def score_greedy_match(edges: DataFrame, group: list[str], limit: int = greedy.FOLD_LIMIT) -> DataFrame:
    """One-to-one matching in score order: each prediction takes its best free annotation.

    `edges(group, pred_id, gt_id, score, iou)` holds only pairs at or above the threshold; equal IoU
    goes to the earlier annotation. Returns `(group, pred_id, gt_id)`.
    """
    rows = edges.select(*group, F.col("pred_id").alias("a"), F.col("gt_id").alias("b"),
                        F.lit(False).alias("reuse"), "score", "iou", *_cut(edges))
    won = greedy.greedy_match(rows, group, [-F.col("score"), F.col("a"), -F.col("iou"), F.col("b")], limit)
    return won.withColumnsRenamed({"a": "pred_id", "b": "gt_id"})


def overlap_greedy_match(edges: DataFrame, group: list[str], limit: int = greedy.FOLD_LIMIT) -> DataFrame:
    """One-to-one matching by descending IoU over all pairs, ties by prediction then annotation id."""
    rows = edges.select(*group, F.col("pred_id").alias("a"), F.col("gt_id").alias("b"),
                        F.lit(False).alias("reuse"), "iou", *_cut(edges))
    won = greedy.greedy_match(rows, group, [-F.col("iou"), F.col("a"), F.col("b")], limit)
    return won.withColumnsRenamed({"a": "pred_id", "b": "gt_id"})
