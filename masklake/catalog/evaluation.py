"""Registered queries: suppression, matching, average precision, boundary metrics, recall."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masklake.catalog import inputs
from masklake.catalog.fixtures import CANVAS, oracle, spark_view
from masklake.functions import rle
from masklake.functions.geometry import image_band
from masklake.operators import boundary, masks, matching, pairs, precision, prefix, ranking, recall, suppression
from masklake.operators.matching import GROUP, IOU_THRESHOLDS
from masklake.plans import evaluate, merge
from masklake.session import cleaned, materialize

# ---------------------------------------------------------------- shared oracle texts

OVERLAP = ("(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))")
TOUCH = ("least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)")


BOX_MET = f"""SELECT a.image_id, a.rn AS hi, b.rn AS lo, {OVERLAP} AS inter, a.w * a.h + b.w * b.h AS s
          FROM ranked a JOIN ranked b ON a.image_id = b.image_id AND a.rn < b.rn AND {TOUCH}"""
# The pieces of a shape are disjoint, so pixels shared by two shapes are the sum over their pieces.
SHAPE_SLABS = "(SELECT image_id, {key}, b[1] AS x, b[2] AS y, b[3] AS w, b[4] AS h, sum(b[3] * b[4]) OVER (PARTITION BY image_id, {key}) AS area FROM {rows} q)"
PRED_SHAPES = SHAPE_SLABS.format(key="pred_id", rows=inputs.shapes_sql("fx_pred", "pred_id"))
GT_SHAPES = SHAPE_SLABS.format(key="ann_id", rows=inputs.shapes_sql("fx_gt", "ann_id"))
SHAPE_MET = f"""SELECT a.image_id, a.rn AS hi, b.rn AS lo, sum({OVERLAP}) AS inter, any_value(a.area + b.area) AS s
          FROM shaped a JOIN shaped b ON a.image_id = b.image_id AND a.rn < b.rn AND {TOUCH} GROUP BY 1, 2, 3"""
SHAPED = f"shaped AS MATERIALIZED (SELECT r.rn, s.* FROM ranked r JOIN {PRED_SHAPES} s ON r.image_id = s.image_id AND r.pred_id = s.pred_id),"


def nms_oracle(threshold: float, compare: str, tie: str, maxdets: int = 0, met: str = BOX_MET, tables: str = "") -> str:
    cap = f"WHERE pos <= {maxdets}" if maxdets else ""
    return oracle(f"""
      WITH RECURSIVE ranked AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id {tie}) AS rn FROM fx_pred),
      {tables}
      conflicts AS MATERIALIZED (
        SELECT image_id, lo, list(hi) AS his FROM ({met}) c
        WHERE CAST(CAST(inter AS DOUBLE) / (s - inter) AS FLOAT) {compare} CAST({threshold} AS FLOAT)
        GROUP BY image_id, lo),
      steps AS (
        SELECT image_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id FROM ranked) d
        UNION ALL
        SELECT s.image_id, s.i + 1,
               CASE WHEN list_has_any(s.kept, coalesce(c.his, CAST([] AS BIGINT[]))) THEN s.kept
                    ELSE list_append(s.kept, s.i + 1) END
        FROM steps s JOIN ranked r ON r.image_id = s.image_id AND r.rn = s.i + 1
        LEFT JOIN conflicts c ON c.image_id = s.image_id AND c.lo = s.i + 1),
      kept AS (SELECT image_id, unnest(arg_max(kept, i)) AS rn FROM steps GROUP BY image_id),
      numbered AS (SELECT k.image_id, r.pred_id, r.score,
                          row_number() OVER (PARTITION BY k.image_id ORDER BY k.rn) AS pos
                   FROM kept k JOIN ranked r USING (image_id, rn))
      SELECT image_id, pred_id, round(score, 9) AS score FROM numbered {cap}""", "fx_pred")


# Similarities as rectangle arithmetic: sims(image_id, pred_id, gt_id, sim, ...).
GT_VIEW = """gts AS MATERIALIZED (
        SELECT *, ann_id AS gt_id, CASE WHEN {keep} THEN iscrowd ELSE 1 END AS crowd FROM fx_gt)"""


def _inner(t: str, d: str) -> str:
    return f"{t}.x + {d} AS x{t}, {t}.y + {d} AS y{t}, {t}.w - 2 * {d} AS w{t}, {t}.h - 2 * {d} AS h{t}"


MASK_SIM = "sims AS MATERIALIZED (SELECT image_id, pred_id, gt_id, crowd, gt_area, {iou} AS sim FROM met WHERE {iou} >= 0.5)"
MASK_IOU = "CASE WHEN crowd = 1 THEN CAST(n AS DOUBLE) / pa ELSE CAST(n AS DOUBLE) / (pa + ga - n) END"
MET = f"""met AS MATERIALIZED (
        SELECT a.image_id, a.pred_id, b.gt_id, b.crowd, b.w * b.h AS gt_area, {OVERLAP} AS n,
               a.w * a.h AS pa, b.w * b.h AS ga, a.x, a.y, a.w, a.h, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh
        FROM fx_pred a JOIN gts b ON a.image_id = b.image_id AND {TOUCH})"""


def _shared(ax, aw, bx, bw) -> str:
    return f"greatest(least({ax} + {aw}, {bx} + {bw}) - greatest({ax}, {bx}), 0)"


def band_sims(pred_d: str, gt_d: str, extra: str = "", source: str = "met") -> str:
    """Mask IoU and band IoU from the four rectangle intersections of bodies and cores."""
    def area(pw, ph):
        return f"greatest({pw}, 0) * greatest({ph}, 0)"

    def core(x, w, d):
        return f"({x} + {d})", f"greatest({w} - 2 * {d}, 0)"
    pd, gd = "pd", "gd"
    pcx, pcw = core("x", "w", pd); pcy, pch = core("y", "h", pd)
    gcx, gcw = core("bx", "bw", gd); gcy, gch = core("by_", "bh", gd)
    ab = "n"
    eb = f"({_shared(pcx, pcw, 'bx', 'bw')} * {_shared(pcy, pch, 'by_', 'bh')})"
    ae = f"({_shared('x', 'w', gcx, gcw)} * {_shared('y', 'h', gcy, gch)})"
    ee = f"({_shared(pcx, pcw, gcx, gcw)} * {_shared(pcy, pch, gcy, gch)})"
    return f"""wide AS MATERIALIZED (SELECT *, {pred_d} AS pd, {gt_d} AS gd FROM {source}),
      bands AS MATERIALIZED (
        SELECT *, {ab} - {eb} - {ae} + {ee} AS nb, pa - {pcw} * {pch} AS pb, ga - {gcw} * {gch} AS gb FROM wide),
      sims AS MATERIALIZED (
        SELECT * FROM (
          SELECT image_id, pred_id, gt_id, crowd, gt_area, {extra}
                 least({MASK_IOU}, CASE WHEN crowd = 1 THEN CAST(nb AS DOUBLE) / pb
                                        ELSE CAST(nb AS DOUBLE) / (pb + gb - nb) END) AS sim FROM bands) q
        WHERE sim >= 0.5)"""


THRS = "(SELECT unnest([{}]) AS thr, unnest(range(10)) AS ti)".format(", ".join(f"{t}::DOUBLE" for t in IOU_THRESHOLDS))
AREAS = ("(VALUES (0, 'all', 0, 10000000000), (1, 'small', 0, 1024), (2, 'medium', 1024, 9216), "
         "(3, 'large', 9216, 10000000000)) ar(ai, aname, lo, hi)")

# Sequential matching, one prediction rank per recursion step.
MATCHING = f"""
      top AS MATERIALIZED (SELECT * FROM (
        SELECT image_id, pred_id, score, w * h AS pa,
               row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS rk FROM fx_pred) q WHERE rk <= 512),
      busy AS MATERIALIZED (
        SELECT image_id, pred_id, row_number() OVER (PARTITION BY image_id ORDER BY rk) AS i
        FROM top SEMI JOIN sims USING (image_id, pred_id)),
      cand AS MATERIALIZED (
        SELECT b.image_id, b.i, ai, list({{'gt': gt_id, 'iou': sim, 'crowd': crowd, 'ign': ign}}
                                         ORDER BY ign, sim DESC, gt_id DESC) AS cs
        FROM (SELECT s.*, ai, CASE WHEN crowd = 1 OR gt_area < lo OR gt_area > hi THEN 1 ELSE 0 END AS ign
              FROM sims s CROSS JOIN {AREAS}) s JOIN busy b USING (image_id, pred_id)
        GROUP BY b.image_id, b.i, ai),
      st AS (
        SELECT image_id, ai, thr, ti, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used,
               CAST(NULL AS BIGINT) AS gt, CAST(NULL AS INTEGER) AS ign
        FROM (SELECT DISTINCT image_id FROM busy) d CROSS JOIN {AREAS} CROSS JOIN {THRS} t
        UNION ALL
        SELECT image_id, ai, thr, ti, i + 1,
               CASE WHEN p.gt IS NULL OR p.crowd = 1 THEN used ELSE list_append(used, p.gt) END, p.gt, p.ign
        FROM (SELECT s.image_id, s.ai, s.thr, s.ti, s.i, s.used,
                     list_filter(c.cs, lambda k: k.iou >= s.thr AND (k.crowd = 1 OR NOT list_contains(s.used, k.gt)))[1] AS p
              FROM st s JOIN cand c ON c.image_id = s.image_id AND c.ai = s.ai AND c.i = s.i + 1) q),
      won AS MATERIALIZED (SELECT st.image_id, ai, ti, b.pred_id, st.gt AS gt_id, st.ign FROM st JOIN busy b
                           ON b.image_id = st.image_id AND b.i = st.i WHERE st.gt IS NOT NULL)"""

CURVE = f"""
      npig AS MATERIALIZED (SELECT ai, count(*) FILTER (WHERE crowd = 0 AND w * h >= lo AND w * h <= hi) AS n
                            FROM gts CROSS JOIN {AREAS} GROUP BY ai),
      outcome AS MATERIALIZED (
        SELECT t.image_id, t.rk, t.score, ar.ai, th.ti,
               CASE WHEN w.gt_id IS NOT NULL AND w.ign = 0 THEN 1 ELSE 0 END AS tp,
               CASE WHEN w.ign = 1 OR (w.gt_id IS NULL AND (t.pa < lo OR t.pa > hi)) THEN 1 ELSE 0 END AS ig
        FROM top t CROSS JOIN {AREAS} CROSS JOIN {THRS} th
        LEFT JOIN won w ON w.image_id = t.image_id AND w.pred_id = t.pred_id AND w.ai = ar.ai AND w.ti = th.ti),
      run AS MATERIALIZED (
        SELECT ai, ti, tp, sum(tp) OVER o AS t, sum(1 - tp - ig) OVER o AS f FROM outcome
        WINDOW o AS (PARTITION BY ai, ti ORDER BY score DESC, image_id, rk ROWS UNBOUNDED PRECEDING)),
      pts AS MATERIALIZED (SELECT ai, ti, CAST(t AS DOUBLE) / n AS rc,
                     CAST(t AS DOUBLE) / (CAST(t + f AS DOUBLE) + 2.220446049250313e-16) AS pr
              FROM run JOIN npig USING (ai) WHERE tp = 1 AND n > 0),
      lvl AS (SELECT ai, ti, lv, coalesce(max(best), 0.0) AS pr FROM (
                SELECT g.ai, g.ti, g.lv, q.best FROM
                  (SELECT ai, ti, lv FROM npig CROSS JOIN {THRS} t CROSS JOIN (SELECT unnest(range(101)) AS lv) l WHERE n > 0) g
                LEFT JOIN (SELECT ai, ti, CAST(floor(rc * 100 + 1e-9) AS BIGINT) AS reach, max(pr) AS best,
                                  min(rc) AS rc FROM pts GROUP BY 1, 2, 3) q
                ON q.ai = g.ai AND q.ti = g.ti AND q.reach >= g.lv) z GROUP BY ai, ti, lv)"""

AP_ROWS = """
        SELECT 'AP' AS metric, avg(pr) FILTER (WHERE ai = 0) AS value FROM lvl
        UNION ALL SELECT 'AP50', avg(pr) FILTER (WHERE ai = 0 AND ti = 0) FROM lvl
        UNION ALL SELECT 'AP75', avg(pr) FILTER (WHERE ai = 0 AND ti = 5) FROM lvl
        UNION ALL SELECT 'AP_small', avg(pr) FILTER (WHERE ai = 1) FROM lvl
        UNION ALL SELECT 'AP_medium', avg(pr) FILTER (WHERE ai = 2) FROM lvl
        UNION ALL SELECT 'AP_large', avg(pr) FILTER (WHERE ai = 3) FROM lvl"""


def _ar(name: str, ai: int, k: int) -> str:
    return (f"SELECT '{name}' AS metric, coalesce(max(v), -1.0) AS value FROM (SELECT CAST(sum(tp) FILTER (WHERE rk <= {k}) AS DOUBLE)"
            f" / (max(n) * 10) AS v FROM outcome JOIN npig USING (ai) WHERE ai = {ai} AND n > 0) q")


AR_ROWS = " UNION ALL ".join([_ar("AR@1", 0, 1), _ar("AR@10", 0, 10), _ar("AR@512", 0, 512),
                              _ar("AR_small", 1, 512), _ar("AR_medium", 2, 512), _ar("AR_large", 3, 512)])
HEAD = "WITH RECURSIVE " + GT_VIEW.format(keep="original_category_id = 1") + ",\n" + MET + ",\n"
MASK_SIMS = MASK_SIM.format(iou=MASK_IOU)
DIAG14 = "CAST(14 AS BIGINT)"


def _round_even(area: str) -> str:
    return f"greatest(1, CAST(round_even(0.19 * (2 * sqrt(CAST({area} AS DOUBLE) / pi())), 0) AS BIGINT))"


def ap_oracle(sims: str, with_recall: bool = False, rename: str = "") -> str:
    rows = AP_ROWS + (" UNION ALL " + AR_ROWS if with_recall else "")
    return oracle(f"{HEAD}{sims},{MATCHING},{CURVE}\n SELECT {rename or 'metric'} AS metric, "
                  f"round(coalesce(value, -1.0), 9) AS value FROM ({rows}) r", "fx_pred", "fx_gt")


def _ap_only(sims: str) -> str:
    """Unrounded mask or band AP as a query that can stand inside another one."""
    return oracle(f"{HEAD}{sims},{MATCHING},{CURVE}\n SELECT coalesce(avg(pr) FILTER (WHERE ai = 0), -1.0) AS v FROM lvl", "fx_pred", "fx_gt")


BAND_SWEEP_SQL = "SELECT band_px, round(v, 9) AS boundary_ap, round(CASE WHEN m > 0 THEN v / m ELSE 'NaN'::DOUBLE END, 9) AS ratio_to_mask_ap FROM (" + \
    " UNION ALL ".join(f"SELECT CAST({b} AS BIGINT) AS band_px, v FROM ({_ap_only(band_sims(f'CAST({b} AS BIGINT)', f'CAST({b} AS BIGINT)'))}) q{b}"
                       for b in boundary.SWEEP_BANDS) + f") b CROSS JOIN (SELECT v AS m FROM ({_ap_only(MASK_SIMS)}) q) w"


# ---------------------------------------------------------------- queries

def _boxes(spark, sf):
    return inputs.pred_slabs(spark, sf).select("image_id", "pred_id", "score", "c0", "c1", "r0", "r1")


def _kept(df):
    return df.select("image_id", "pred_id", F.round("score", 9).alias("score"))


def nms_mask(spark, sf):
    p = _boxes(spark, sf)
    return _kept(suppression.suppress(p, 0.3, slabs=p, extent=CANVAS, maxdets=512))


def nms_box(spark, sf):
    return _kept(suppression.suppress(_boxes(spark, sf), 0.3, extent=CANVAS))


def nms_capped(spark, sf):
    return _kept(suppression.suppress(_boxes(spark, sf), 0.5, extent=CANVAS, maxdets=10))


def _shapes(slabs, key):
    """L-shapes and rings with their own area on every piece."""
    own = Window.partitionBy("image_id", key)
    shaped = inputs.shaped_slabs(slabs, key)
    pixels = F.sum((F.col("c1") - F.col("c0")) * (F.col("r1") - F.col("r0"))).over(own)
    return shaped.withColumn("area" if key == "pred_id" else "area_mask", pixels)


def nms_shapes(spark, sf):
    """Mask suppression of L-shapes and rings."""
    p = inputs.pred_slabs(spark, sf)
    whole = p.select("image_id", "pred_id", "score", "c0", "c1", "r0", "r1", F.pmod("pred_id", F.lit(3)).alias("kind"))
    return _kept(suppression.suppress(whole, 0.3, slabs=inputs.shaped_slabs(p, "pred_id"), geometry=["c0", "c1", "r0", "r1", "kind"], extent=CANVAS))


def _dumped(spark, sf):
    """Raw instances as a dump holds them: boxes, and L-shapes and rings as run-length text."""
    p = inputs.pred_slabs(spark, sf)
    side = F.lit(CANVAS).cast("bigint")
    runs = masks.slabs_to_runs(inputs.shaped_slabs(p, "pred_id").select("image_id", "pred_id", *masks.SLAB).withColumns({"width": side, "height": side}),
                               ["image_id", "pred_id", "width", "height"], "height")
    coded = runs.select("image_id", "pred_id", F.struct(rle.encode_counts(F.col("runs")).alias("counts"), F.array("height", "width").alias("size")).alias("segmentation"))
    return cleaned(materialize(_boxed(p).join(coded, ["image_id", "pred_id"]), "dump"))


def _boxed(p):
    box = F.array("c0", "r0", F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0"))
    return p.select("image_id", "pred_id", "score", box.alias("bbox"))


def merged_masks(spark, sf):
    return _kept(merge.merge_raw_instances(_dumped(spark, sf), spark_view(spark, sf, "fx_images"), dedup_iou=0.3, maxdets=512, extent=CANVAS))


def merged_boxes(spark, sf):
    return _kept(merge.merge_raw_instances(_boxed(inputs.pred_slabs(spark, sf)), spark_view(spark, sf, "fx_images"), dedup_iou=0.5, maxdets=10, method="box-nms", extent=CANVAS))


def shape_iou_pairs(spark, sf):
    """Pairs of L-shapes and rings with a mask IoU of one half or more."""
    met = matching.mask_pairs(_shapes(inputs.pred_slabs(spark, sf), "pred_id"), _shapes(inputs.gt_slabs(spark, sf), "gt_id"), floor=0.5, extent=CANVAS)
    return met.select("image_id", "pred_id", "gt_id", "inter", F.round("iou", 9).alias("iou"))


def nms_chains(spark, sf):
    """Three images whose annotations form chains of thousands of boxes, each overlapping only the next."""
    g = spark_view(spark, sf, "fx_gt").select(F.col("ann_id").alias("pred_id"), F.pmod("image_id", F.lit(3)).alias("image_id"))
    step = F.when(F.pmod("pred_id", F.lit(4999)) == 0, 20).otherwise(10).cast("bigint")
    at = F.col("c0")
    p = prefix.running_sums(g, ["image_id"], [F.col("pred_id")], {"c0": step}).select(
        "image_id", "pred_id", (-at).cast("double").alias("score"), "c0", (at + 16).alias("c1"),
        F.lit(0).cast("bigint").alias("r0"), F.lit(8).cast("bigint").alias("r1"))
    return _kept(suppression.suppress(p, 0.2, extent=16))


def hot_cell(spark, sf):
    """All parts as small boxes in a single grid cell: how many others each one overlaps, and by how many pixels."""
    key = F.col("p_partkey")
    c0, r0 = F.pmod(key * 7919, F.lit(125)), F.pmod(F.floor(key * 104729 / 1000), F.lit(121))
    p = spark_view(spark, sf, "part").select(F.lit(0).alias("image_id"), key.alias("part_id"), c0.alias("c0"), (c0 + 3).alias("c1"),
                                             r0.alias("r0"), (r0 + 2 + F.pmod(key, F.lit(5))).alias("r1"))
    met = pairs.overlap_join(p, p, ["image_id"], extent=CANVAS, where=lambda: F.col("l_part_id") != F.col("r_part_id"), hot=100_000)
    return met.groupBy(F.col("l_part_id").alias("part_id")).agg(F.count(F.lit(1)).alias("others"), F.sum("overlap").alias("pixels"))


def nms_strict(spark, sf):
    return _kept(suppression.suppress(_boxes(spark, sf), 0.5, extent=CANVAS, strict=True, later_first=True))


def mask_iou_pairs(spark, sf):
    met = matching.mask_pairs(inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf), floor=0.0, extent=CANVAS)
    return met.select("image_id", "pred_id", "gt_id", "inter", F.round("iou", 9).alias("iou"))


def box_iou_pairs(spark, sf):
    met = pairs.overlap_join(inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf), ["image_id"], extent=CANVAS)
    iou = F.try_divide("overlap", F.col("l_area") + F.col("r_area_mask") - F.col("overlap"))
    return met.select("image_id", F.col("l_pred_id").alias("pred_id"), F.col("r_gt_id").alias("gt_id"),
                      F.round(iou, 9).alias("iou"))


def _tree_inputs(spark, sf):
    preds, gts = inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf, crowd_others=1)
    ranked = matching.top_per_image(inputs.as_ranked_rows(preds), matching.MAX_DETS)
    return preds, gts, ranked


def coco_matches(spark, sf):
    preds, gts, ranked = _tree_inputs(spark, sf)
    won = matching.coco_match(evaluate.mask_edges(preds, gts, ranked=ranked, extent=CANVAS, max_dets=matching.MAX_DETS))
    reached = F.filter(F.sequence(F.lit(0), F.lit(len(matching.IOU_THRESHOLDS) - 1)),
                       lambda t: F.call_function("shiftright", "bits", t).bitwiseAND(1) == 1)
    return won.withColumn("thr", F.explode(reached)).select(
        "image_id", *[F.col(c).cast("bigint").alias(c) for c in ("area", "thr")], "pred_id", "gt_id",
        F.col("ignored").cast("bigint").alias("ignored"))


def score_matches(spark, sf):
    preds, gts = inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf)
    edges = matching.mask_pairs(preds, gts, floor=0.5, use_crowd=False, group=["image_id"], extent=CANVAS)
    return matching.score_greedy_match(edges, ["image_id"]).select("image_id", "pred_id", "gt_id")


def overlap_matches(spark, sf):
    preds, gts = inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf)
    edges = matching.mask_pairs(preds, gts, floor=0.5, use_crowd=False, group=["image_id"], extent=CANVAS)
    return matching.overlap_greedy_match(edges, ["image_id"]).select("image_id", "pred_id", "gt_id")


def _table(spark, sf):
    preds, gts, ranked = _tree_inputs(spark, sf)
    bits, npig = evaluate.evaluate_masks(ranked, evaluate.mask_edges(preds, gts, ranked=ranked, extent=CANVAS, max_dets=matching.MAX_DETS), gts)
    return precision.precision_table(precision.precision_steps(bits, npig), npig)


def precision_curve(spark, sf):
    return _table(spark, sf).select(
        F.floor(F.col("combo") / 10).cast("bigint").alias("area"), (F.col("combo") % 10).cast("bigint").alias("thr"),
        "level", F.round("precision", 9).alias("precision"))


def mask_ap(spark, sf):
    preds, gts, ranked = _tree_inputs(spark, sf)
    out = evaluate.coco_metrics(ranked, evaluate.mask_edges(preds, gts, ranked=ranked, extent=CANVAS, max_dets=matching.MAX_DETS), gts)
    return out.select("metric", F.round("value", 9).alias("value"))


def _boundary_ap(spark, sf, pred_width, gt_width):
    preds, gts, ranked = _tree_inputs(spark, sf)
    one = lambda df: df.withColumn("n_slabs", F.lit(1))
    edges = boundary.boundary_edges(one(preds), one(gts), pred_width, gt_width, floor=0.5, extent=CANVAS)
    bits, npig = evaluate.evaluate_masks(ranked, edges, gts)
    table = precision.precision_table(precision.precision_steps(bits, npig), npig)
    return precision.average_precision(table).select("metric", F.round("value", 9).alias("value"))


def boundary_ap_image(spark, sf):
    width = image_band(F.lit(CANVAS), F.lit(CANVAS), 0.02)
    return _boundary_ap(spark, sf, width, width)


def boundary_ap_instance(spark, sf):
    return _boundary_ap(spark, sf, boundary.instance_width(), boundary.instance_width(area="area_mask"))


def _by_band(spark, sf, bands, combos=None):
    preds, gts, ranked = _tree_inputs(spark, sf)
    one = lambda df: df.withColumn("n_slabs", F.lit(1))
    return boundary.ap_by_band(ranked, one(preds), one(gts), [boundary.WHOLE_MASK, *bands], extent=CANVAS, combos=combos)


def boundary_ap_sweep(spark, sf):
    """Boundary AP and its share of mask AP at each band width of the sweep."""
    table = _by_band(spark, sf, boundary.SWEEP_BANDS, list(range(10))).where("metric = 'AP'")
    whole = F.max(F.when(F.col("band_px") == boundary.WHOLE_MASK, F.col("value"))).over(Window.partitionBy("metric"))
    rows = table.withColumn("mask_ap", whole).where(F.col("band_px") != boundary.WHOLE_MASK)
    ratio = F.when(F.col("mask_ap") > 0, F.try_divide("value", "mask_ap")).otherwise(F.lit(float("nan")))
    return rows.select("band_px", F.round("value", 9).alias("boundary_ap"), F.round(ratio, 9).alias("ratio_to_mask_ap"))


def retention(spark, sf):
    """Boundary over mask AP by size for the fixed 8 px band."""
    table = _by_band(spark, sf, [8])
    tag = F.when(F.col("band_px") == 8, F.concat(F.lit("B_"), "metric")).otherwise(F.col("metric"))
    names = {"all": "AP", "small": "AP_small", "medium": "AP_medium", "large": "AP_large"}
    out = boundary.retention_ratios(table.select(tag.alias("metric"), "value"), names, {k: "B_" + v for k, v in names.items()})
    return out.select("size", F.round("retention", 6).alias("retention"))


def band_ratio(spark, sf):
    """Image diagonal and the pixel band widths as shares of it."""
    diagonal = boundary.image_diagonal(spark_view(spark, sf, "fx_images"))
    return (diagonal.select("width", "height", "consistent", F.round("diagonal", 9).alias("diagonal"),
                            F.explode(F.array(*[F.lit(b).cast("bigint") for b in boundary.SWEEP_BANDS])).alias("band_px"))
            .withColumn("ratio", F.round(F.col("band_px") / F.col("diagonal"), 9)))


def instance_biou(spark, sf):
    one = lambda df: df.withColumn("n_slabs", F.lit(1))
    out = boundary.instance_boundary_iou(one(inputs.pred_slabs(spark, sf)), one(inputs.gt_slabs(spark, sf)), extent=CANVAS)
    return out.select("image_id", "pred_id", "gt_id", F.round("boundary_iou", 9).alias("boundary_iou"))


def union_biou(spark, sf):
    out = boundary.union_boundary_iou(spark_view(spark, sf, "fx_images"), inputs.pred_slabs(spark, sf),
                                      inputs.gt_slabs(spark, sf))
    return out.select("image_id", "pred_px", "gt_px", F.round("biou", 9).alias("biou"))


def _shape_biou(spark, sf):
    return boundary.union_boundary_iou(spark_view(spark, sf, "fx_images"), inputs.shaped_slabs(inputs.pred_slabs(spark, sf), "pred_id"),
                                       inputs.shaped_slabs(inputs.gt_slabs(spark, sf), "gt_id"))


def shape_biou(spark, sf):
    """Union boundary IoU of L-shapes and rings."""
    return _shape_biou(spark, sf).select("image_id", "pred_px", "gt_px", F.round("biou", 9).alias("biou"))


def mean_biou(spark, sf):
    out = boundary.mean_boundary_iou(_shape_biou(spark, sf))
    return out.select("images", "scored", F.round("mean_biou", 9).alias("mean_biou"), F.round("area_biou", 9).alias("area_biou"))


def f1_best(spark, sf):
    preds, gts = inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf)
    curve = recall.f1_sweep(preds, preds, gts, spark_view(spark, sf, "fx_images"),
                            geometry=["c0", "c1", "r0", "r1"], extent=CANVAS)
    best = recall.best_f1(curve)
    return best.select(*[F.round(c, 9).alias(c) for c in ("best_f1", "threshold", "precision", "recall")],
                       *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "total_gt")])


def _recall_inputs(spark, sf):
    preds, gts = inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf)
    return spark_view(spark, sf, "fx_images"), preds, gts


def recall_diagnostics(spark, sf):
    images, preds, gts = _recall_inputs(spark, sf)
    edges = matching.mask_pairs(preds, gts, floor=0.49, group=["image_id"], extent=CANVAS)
    facts = recall.recall_facts(images, preds, gts, edges, threshold=0.315, match_iou=0.5)
    out = recall.recall_report(images, preds, facts, threshold=0.315, budget=30)
    return out.select("section", "bin", "metric", F.round("value", 9).alias("value"))


RECALL_IOUS = [0.3, 0.5, 0.75]


def _coverage(spark, sf):
    _, preds, gts = _recall_inputs(spark, sf)
    # Predictions below the threshold cover nothing, so they are no candidates.
    able = recall.scored_from(preds, 0.315)
    edges = matching.mask_pairs(able, gts, floor=0.29, group=["image_id"], extent=CANVAS)
    return recall.coverage_by_iou(gts, edges, RECALL_IOUS, threshold=0.315)


def coverage_by_iou(spark, sf):
    return _coverage(spark, sf).select("match_iou", "covered", "total_gt", F.round("coverage", 9).alias("coverage"))


def localization_split(spark, sf):
    """Coverage at a loose and a strict IoU: what is never proposed and what is only imprecise."""
    out = recall.localization_split(_coverage(spark, sf), 0.3, 0.75)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def gated(spark, sf):
    preds, gts, images = inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf), spark_view(spark, sf, "fx_images")
    edges = matching.mask_pairs(preds, gts, floor=0.5, use_crowd=False, group=["image_id"], extent=CANVAS)
    out = recall.gated_f1(images, preds, gts, edges)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
                      *[F.round(c, 9).alias(c) for c in ("il_mcc", "il_f1", "il_precision", "il_recall",
                                                         "positive_micro_f1", "cg_f1")])


def document_gate(spark, sf):
    """Image-level confusion scores on the labelled documents: a marked quality against a short-text guess."""
    labels, docs = spark_view(spark, sf, "labels"), spark_view(spark, sf, "documents")
    flags = labels.join(docs, "doc_id").select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 400).alias("guess"))
    out = recall.image_level_scores(flags)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
                      *[F.round(c, 9).alias(c) for c in ("il_mcc", "il_f1", "il_precision", "il_recall")])


def top_merged(spark, sf):
    p = spark_view(spark, sf, "fx_pred").select("image_id", "pred_id", "score", "tile_idx")
    out = ranking.merge_top([p.where("tile_idx = 0"), p.where("tile_idx = 1")], 10, ["image_id"])
    return out.select("image_id", "pred_id", F.col("rank").cast("bigint").alias("rank"))


def top_dense(spark, sf):
    return ranking.densest_images(spark_view(spark, sf, "fx_images"), spark_view(spark, sf, "fx_gt"), 20)


def top_boundary(spark, sf):
    out = ranking.best_boundary_images(
        spark_view(spark, sf, "fx_images"), inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf), 10,
        score=0.315)
    return out.select("image_id", F.round("biou", 9).alias("biou"))


def top_boundary_buckets(spark, sf):
    out = ranking.best_per_density(
        spark_view(spark, sf, "fx_images"), inputs.pred_slabs(spark, sf), inputs.gt_slabs(spark, sf),
        [(1, 25), (25, 35), (35, None)], 5, score=0.315)
    return out.select("bucket", F.col("pos").cast("bigint").alias("pos"), "image_id", "n_gt", F.round("biou", 9).alias("biou"))


def top_shown(spark, sf):
    """Instances shown per image: score filter, then the best `n`."""
    p = spark_view(spark, sf, "fx_pred").where("score >= 0.5")
    out = matching.top_per_image(p.select("image_id", "pred_id", "score"), 15, ["image_id"])
    return out.select("image_id", "pred_id", F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- remaining oracle texts

PLAIN_MET = f"""met AS MATERIALIZED (
        SELECT a.image_id, a.pred_id, a.score, b.ann_id AS gt_id, b.iscrowd AS crowd, {OVERLAP} AS n, a.w * a.h AS pa, b.w * b.h AS ga,
               b.w * b.h AS gt_area, a.x, a.y, a.w, a.h, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh
        FROM fx_pred a JOIN fx_gt b ON a.image_id = b.image_id AND {TOUCH})"""
PLAIN_IOU = "CAST(n AS DOUBLE) / (pa + ga - n)"


def greedy_steps(edges: str, order: str, groups: str = "image_id") -> str:
    """Sequential one-to-one selection over `edges(image_id, pred_id, gt_id, ...)` in `order`."""
    g = groups
    on = " AND ".join(f"n.{c.strip()} = s.{c.strip()}" for c in g.split(","))
    sg = ", ".join(f"s.{c.strip()}" for c in g.split(","))
    return f"""
      seq AS MATERIALIZED (SELECT {g}, pred_id, gt_id, row_number() OVER (PARTITION BY {g} ORDER BY {order}) AS i FROM {edges}),
      walk AS (
        SELECT {g}, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs FROM (SELECT DISTINCT {g} FROM seq) d
        UNION ALL
        SELECT {sg}, s.i + 1,
               CASE WHEN list_contains(s.ps, n.pred_id) OR list_contains(s.gs, n.gt_id) THEN s.ps ELSE list_append(s.ps, n.pred_id) END,
               CASE WHEN list_contains(s.ps, n.pred_id) OR list_contains(s.gs, n.gt_id) THEN s.gs ELSE list_append(s.gs, n.gt_id) END
        FROM walk s JOIN seq n ON {on} AND n.i = s.i + 1),
      ends AS (SELECT {g}, arg_max(ps, i) AS ps, arg_max(gs, i) AS gs FROM walk GROUP BY {g}),
      won AS MATERIALIZED (SELECT {g}, unnest(ps) AS pred_id, unnest(gs) AS gt_id FROM ends)"""


HALF = f"half AS MATERIALIZED (SELECT image_id, pred_id, gt_id, score, {PLAIN_IOU} AS iou FROM met WHERE {PLAIN_IOU} >= 0.5)"
SCORE_WON = f"WITH RECURSIVE {PLAIN_MET}, {HALF}, " + greedy_steps("half", "score DESC, pred_id, iou DESC, gt_id")
IOU_WON = f"WITH RECURSIVE {PLAIN_MET}, {HALF}, " + greedy_steps("half", "iou DESC, pred_id, gt_id")
IMG_LEVEL = """
        round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0.0 ELSE (CAST(tp AS DOUBLE)*tn - CAST(fp AS DOUBLE)*fn)
          / (sqrt(CAST(tp+fp AS DOUBLE)) * sqrt(CAST(tp+fn AS DOUBLE)) * sqrt(CAST(tn+fp AS DOUBLE)) * sqrt(CAST(tn+fn AS DOUBLE))) END, 9) AS il_mcc,
        round(CAST(2*tp AS DOUBLE) / greatest(2*tp+fp+fn, 1), 9) AS il_f1,
        round(CAST(tp AS DOUBLE) / greatest(tp+fp, 1), 9) AS il_precision, round(CAST(tp AS DOUBLE) / greatest(tp+fn, 1), 9) AS il_recall"""

# Union masks as one 512-bit string per image column; erosion by shifting bits and by a window over columns.
BITS = """
      z AS (SELECT CAST(repeat('0', 512) AS BIT) AS zero),
      cols AS MATERIALIZED (SELECT DISTINCT side, image_id, y, h, unnest(range(x, x + w)) AS col FROM boxes),
      words AS MATERIALIZED (SELECT y, h, CAST(repeat('0', y) || repeat('1', h) || repeat('0', 512 - y - h) AS BIT) AS b
                             FROM (SELECT DISTINCT y, h FROM boxes) q),
      filled AS MATERIALIZED (SELECT side, image_id, col, bit_or(b) AS b FROM cols JOIN words USING (y, h) GROUP BY 1, 2, 3),
      dense AS MATERIALIZED (
        SELECT s.side, i.image_id, c.col, coalesce(f.b, CAST(repeat('0', 512) AS BIT)) AS b
        FROM {images} i CROSS JOIN (SELECT unnest(['p', 'g']) AS side) s CROSS JOIN (SELECT unnest(range(512)) AS col) c
        LEFT JOIN filled f ON f.side = s.side AND f.image_id = i.image_id AND f.col = c.col),
      t2 AS (SELECT *, b & (b << 1) AS v2 FROM dense), t4 AS (SELECT *, v2 & (v2 << 2) AS v4 FROM t2),
      t8 AS (SELECT *, v4 & (v4 << 4) AS v8 FROM t4), t16 AS (SELECT *, v8 & (v8 << 8) AS v16 FROM t8),
      tall AS MATERIALIZED (SELECT side, image_id, col, b, (v16 & (v16 << 13)) >> 14 AS v FROM t16),
      w2 AS MATERIALIZED (SELECT side, image_id, col, b, v & lead(v, 1, zero) OVER o AS v FROM tall CROSS JOIN z WINDOW o AS (PARTITION BY side, image_id ORDER BY col)),
      w4 AS MATERIALIZED (SELECT side, image_id, col, b, v & lead(v, 2, zero) OVER o AS v FROM w2 CROSS JOIN z WINDOW o AS (PARTITION BY side, image_id ORDER BY col)),
      w8 AS MATERIALIZED (SELECT side, image_id, col, b, v & lead(v, 4, zero) OVER o AS v FROM w4 CROSS JOIN z WINDOW o AS (PARTITION BY side, image_id ORDER BY col)),
      w16 AS MATERIALIZED (SELECT side, image_id, col, b, v & lead(v, 8, zero) OVER o AS v FROM w8 CROSS JOIN z WINDOW o AS (PARTITION BY side, image_id ORDER BY col)),
      w29 AS MATERIALIZED (SELECT side, image_id, col, b, v & lead(v, 13, zero) OVER o AS v FROM w16 CROSS JOIN z WINDOW o AS (PARTITION BY side, image_id ORDER BY col)),
      core AS MATERIALIZED (SELECT side, image_id, col, b, lag(v, 14, zero) OVER o AS e FROM w29 CROSS JOIN z WINDOW o AS (PARTITION BY side, image_id ORDER BY col)),
      band AS MATERIALIZED (SELECT side, image_id, col, b, xor(b, e) AS r FROM core),
      biou AS MATERIALIZED (
        SELECT p.image_id, CAST(sum(bit_count(p.b)) AS BIGINT) AS pred_px, CAST(sum(bit_count(g.b)) AS BIGINT) AS gt_px,
               CASE WHEN sum(bit_count(p.b)) = 0 AND sum(bit_count(g.b)) = 0 THEN 1.0
                    WHEN sum(bit_count(p.r | g.r)) = 0 THEN CASE WHEN sum(bit_count(xor(p.b, g.b))) = 0 THEN 1.0 ELSE 0.0 END
                    ELSE CAST(sum(bit_count(p.r & g.r)) AS DOUBLE) / sum(bit_count(p.r | g.r)) END AS biou
        FROM band p JOIN band g ON p.side = 'p' AND g.side = 'g' AND p.image_id = g.image_id AND p.col = g.col
        GROUP BY p.image_id)"""


def biou_ctes(images: str = "fx_images", score: float | None = None) -> str:
    keep = f"WHERE score >= {score}" if score is not None else ""
    scope = f"SEMI JOIN {images} USING (image_id)"
    return (f"boxes AS MATERIALIZED (SELECT 'p' AS side, image_id, x, y, w, h FROM (SELECT * FROM fx_pred {keep}) q {scope} "
            f"UNION ALL SELECT 'g', image_id, x, y, w, h FROM fx_gt {scope}),"
            + BITS.replace("{images}", images))


SHAPE_BIOU = (f"shape_boxes AS MATERIALIZED (SELECT 'p' AS side, image_id, b FROM {inputs.shapes_sql('fx_pred', 'pred_id')} q SEMI JOIN fx_images USING (image_id) UNION ALL "
              f"SELECT 'g', image_id, b FROM {inputs.shapes_sql('fx_gt', 'ann_id')} q SEMI JOIN fx_images USING (image_id)),"
              "boxes AS MATERIALIZED (SELECT side, image_id, b[1] AS x, b[2] AS y, b[3] AS w, b[4] AS h FROM shape_boxes)," + BITS.replace("{images}", "fx_images"))
DENSE = "(SELECT image_id, count(*) AS n_gt FROM fx_gt GROUP BY 1 HAVING count(*) >= 5)"
SWEEP = " UNION ALL ".join(f"SELECT CAST({b} AS BIGINT) AS band" for b in boundary.SWEEP_BANDS)
REC_WON = (f"WITH RECURSIVE {PLAIN_MET}, half AS MATERIALIZED (SELECT image_id, pred_id, gt_id, CAST(score AS FLOAT) AS score, score AS exact, iou FROM ("
           f"SELECT *, CAST({MASK_IOU} AS FLOAT) AS iou FROM met) q WHERE iou >= CAST(0.5 AS FLOAT) AND CAST(score AS FLOAT) >= CAST(0.315 AS FLOAT)), "
           + greedy_steps("half", "exact DESC, pred_id, iou DESC, gt_id"))
REC_FACTS = """,
      facts AS MATERIALIZED (SELECT g.image_id, g.ann_id AS gt_id, g.w * g.h AS area, CASE WHEN w.gt_id IS NULL THEN 0 ELSE 1 END AS m,
                       coalesce(h.hits, 0) AS hits
                FROM fx_gt g LEFT JOIN won w ON w.image_id = g.image_id AND w.gt_id = g.ann_id
                LEFT JOIN (SELECT image_id, gt_id, count(*) AS hits FROM half GROUP BY 1, 2) h
                  ON h.image_id = g.image_id AND h.gt_id = g.ann_id),
      img AS MATERIALIZED (SELECT i.image_id, coalesce(np, 0) AS np, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(c, 0) AS c,
                     CASE WHEN coalesce(n, 0) > 0 THEN coalesce(nk, 0) ELSE 0 END AS nk,
                     CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < 30 THEN 'under_budget(<30)' ELSE 'at_or_over_budget(>=30)' END AS bin
              FROM fx_images i
              LEFT JOIN (SELECT image_id, count(*) AS np, count(*) FILTER (WHERE CAST(score AS FLOAT) >= CAST(0.315 AS FLOAT)) AS nk
                         FROM fx_pred GROUP BY 1) p USING (image_id)
              LEFT JOIN (SELECT image_id, count(*) AS n, sum(m) AS m, count(*) FILTER (WHERE hits > 0) AS c FROM facts GROUP BY 1) g USING (image_id))
      SELECT section, bin, metric, round(CAST(value AS DOUBLE), 9) AS value FROM (
        SELECT 'overall' AS section, 'all' AS bin, unnest(['n_images', 'total_gt', 'total_pred_kept', 'matched_gt', 'covered_gt',
                 'preds_min', 'preds_mean', 'preds_max', 'saturated_frac', 'matched_recall', 'coverage_recall', 'redundancy_gap']) AS metric,
               unnest([count(*)::DOUBLE, sum(n)::DOUBLE, sum(nk)::DOUBLE, sum(m)::DOUBLE, sum(c)::DOUBLE, min(np)::DOUBLE, avg(np), max(np)::DOUBLE,
                       avg(CASE WHEN np >= 30 THEN 1.0 ELSE 0.0 END)::DOUBLE, sum(m)::DOUBLE / sum(n), sum(c)::DOUBLE / sum(n),
                       (sum(c) - sum(m))::DOUBLE / sum(n)]) AS value FROM img
        UNION ALL SELECT 'gt_count', bin, unnest(['n_images', 'n_gt', 'matched_recall', 'coverage_recall', 'mean_pred_kept']),
               unnest([count(*)::DOUBLE, sum(n)::DOUBLE, coalesce(sum(m)::DOUBLE / nullif(sum(n), 0), 0), coalesce(sum(c)::DOUBLE / nullif(sum(n), 0), 0),
                       sum(nk)::DOUBLE / count(*)]) FROM img GROUP BY bin
        UNION ALL SELECT 'gt_size', CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS bin,
               unnest(['n_gt', 'matched_recall', 'coverage_recall']),
               unnest([count(*)::DOUBLE, sum(m)::DOUBLE / count(*), count(*) FILTER (WHERE hits > 0)::DOUBLE / count(*)]) FROM facts GROUP BY 2
        UNION ALL SELECT 'duplication', 'all', unnest(['covered_gt', 'mean', 'median', 'max']),
               unnest([count(*)::DOUBLE, avg(hits), quantile_cont(hits, 0.5), max(hits)::DOUBLE]) FROM facts WHERE hits > 0) r"""

def retention_oracle() -> str:
    """Two full evaluations side by side: tables of the second one carry the suffix `_b`."""
    eight = "CAST(8 AS BIGINT)"
    first = f"{MASK_SIMS},{MATCHING},{CURVE}"
    second = f"{band_sims(eight, eight)},{MATCHING},{CURVE}"
    for name in ("wide", "bands", "sims", "top", "busy", "cand", "st", "won", "npig", "outcome", "run", "pts", "lvl"):
        second = re.sub(rf"(?<![\w.']){name}(?!\w)", name + "_b", second)
    pick = lambda t: f"(SELECT avg(pr) FILTER (WHERE ai = k) FROM {t} WHERE ai = k)"
    return oracle(f"""{HEAD}{first},{second}
      SELECT n AS size, round({pick('lvl_b')} / {pick('lvl')}, 6) AS retention
      FROM (VALUES ('all', 0), ('small', 1), ('medium', 2), ('large', 3)) v(n, k)""", "fx_pred", "fx_gt")


RETENTION_SQL = retention_oracle()

CASES = {
    "nms1_mask_greedy": (nms_mask, nms_oracle(0.3, ">=", "", 512)),
    "nms2_box_greedy": (nms_box, nms_oracle(0.3, ">=", "")),
    "nms1_early_stop": (nms_capped, nms_oracle(0.5, ">=", "", 10)),
    "nms1_of_shapes": (nms_shapes, nms_oracle(0.3, ">=", "", met=SHAPE_MET, tables=SHAPED)),
    "nms4_merged_masks": (merged_masks, nms_oracle(0.3, ">=", "", 512, met=SHAPE_MET, tables=SHAPED)),
    "nms4_merged_boxes": (merged_boxes, nms_oracle(0.5, ">=", "", 10)),
    "msk8_of_shapes": (shape_iou_pairs, oracle(f"""WITH p AS MATERIALIZED {PRED_SHAPES}, g AS MATERIALIZED {GT_SHAPES},
        met AS (SELECT a.image_id, a.pred_id, b.ann_id AS gt_id, sum({OVERLAP}) AS n, any_value(a.area) AS pa, any_value(b.area) AS ga
                FROM p a JOIN g b ON a.image_id = b.image_id AND {TOUCH} GROUP BY 1, 2, 3),
        scored AS (SELECT met.image_id, pred_id, gt_id, CAST(n AS BIGINT) AS inter, {MASK_IOU.replace("crowd", "iscrowd")} AS iou FROM met JOIN fx_gt ON ann_id = gt_id)
        SELECT image_id, pred_id, gt_id, inter, round(iou, 9) AS iou FROM scored WHERE iou >= 0.5""", "fx_pred", "fx_gt")),
    "nms2_long_chains": (nms_chains, oracle("""WITH placed AS (SELECT ann_id AS pred_id, image_id % 3 AS image_id,
          CASE WHEN ann_id % 4999 = 0 THEN 1 ELSE 0 END AS gap FROM fx_gt),
        runs AS (SELECT *, sum(gap) OVER w AS run, -sum(10 + 10 * gap) OVER w AS score FROM placed
                 WINDOW w AS (PARTITION BY image_id ORDER BY pred_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY image_id, run ORDER BY pred_id) AS pos FROM runs)
        SELECT image_id, pred_id, CAST(score AS DOUBLE) AS score FROM r WHERE pos % 2 = 1""", "fx_gt")),
    "join3_hot_cell": (hot_cell, oracle("""WITH b AS (SELECT p_partkey AS id, (p_partkey * 7919) % 125 AS x, ((p_partkey * 104729) // 1000) % 121 AS y,
          3 AS w, 2 + p_partkey % 5 AS h FROM part),
        met AS (SELECT a.id, (least(a.x, b.x) + 3 - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS px
                FROM (SELECT *, unnest(range(x - 2, x + 3)) AS at FROM b) a JOIN b ON b.x = a.at AND b.id <> a.id
                WHERE least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y))
        SELECT id AS part_id, count(*) AS others, CAST(sum(px) AS BIGINT) AS pixels FROM met GROUP BY id""")),
    "nms3_strict": (nms_strict, nms_oracle(0.5, ">", "DESC")),
    "msk8_mask_iou_pairs": (mask_iou_pairs, oracle(
        f"WITH {PLAIN_MET} SELECT image_id, pred_id, gt_id, n AS inter, round({MASK_IOU}, 9) AS iou FROM met", "fx_pred", "fx_gt")),
    "msk9_box_iou_pairs": (box_iou_pairs, oracle(
        f"WITH {PLAIN_MET} SELECT image_id, pred_id, gt_id, round({PLAIN_IOU}, 9) AS iou FROM met", "fx_pred", "fx_gt")),
    "mat1_coco_matching": (coco_matches, oracle(
        f"{HEAD}{MASK_SIMS},{MATCHING} SELECT image_id, CAST(ai AS BIGINT) AS area, CAST(ti AS BIGINT) AS thr, pred_id, gt_id, "
        "CAST(ign AS BIGINT) AS ignored FROM won",
        "fx_pred", "fx_gt")),
    "mat2_score_matching": (score_matches, oracle(f"{SCORE_WON} SELECT image_id, pred_id, gt_id FROM won", "fx_pred", "fx_gt")),
    "mat3_overlap_matching": (overlap_matches, oracle(f"{IOU_WON} SELECT image_id, pred_id, gt_id FROM won", "fx_pred", "fx_gt")),
    "agg1_precision_curve": (precision_curve, oracle(
        f"{HEAD}{MASK_SIMS},{MATCHING},{CURVE} SELECT CAST(ai AS BIGINT) AS area, CAST(ti AS BIGINT) AS thr, CAST(lv AS BIGINT) AS level, "
        "round(pr, 9) AS precision FROM lvl", "fx_pred", "fx_gt")),
    "agg2_mask_ap": (mask_ap, ap_oracle(MASK_SIMS, with_recall=True)),
    "agg3_boundary_ap_image": (boundary_ap_image, ap_oracle(band_sims(DIAG14, DIAG14))),
    "agg4_boundary_ap_instance": (boundary_ap_instance, ap_oracle(band_sims(_round_even("pa"), _round_even("ga")))),
    "agg5_band_ratio": (band_ratio, oracle(
        f"""SELECT max(width) AS width, max(height) AS height, count(DISTINCT width * 100000 + height) = 1 AS consistent,
            round(sqrt(CAST(max(width) * max(width) + max(height) * max(height) AS DOUBLE)), 9) AS diagonal, band AS band_px,
            round(band / sqrt(CAST(max(width) * max(width) + max(height) * max(height) AS DOUBLE)), 9) AS ratio
            FROM fx_images CROSS JOIN ({SWEEP}) b GROUP BY band""", "fx_images")),
    "agg6_band_sweep": (boundary_ap_sweep, BAND_SWEEP_SQL),
    "agg7_retention": (retention, RETENTION_SQL),
    "bio1_instance_boundary_iou": (instance_biou, oracle(
        f"""{IOU_WON}, wide AS (SELECT m.*, {_round_even('pa')} AS pd, {_round_even('ga')} AS gd FROM met m JOIN won USING (image_id, pred_id, gt_id)),
        """ + band_sims("pd", "gd").split("bands AS", 1)[1].split("sims AS", 1)[0].join(["bands AS", ""]).rstrip().rstrip(",") +
        """ SELECT p.image_id, p.pred_id, b.gt_id, round(CAST(nb AS DOUBLE) / (pb + gb - nb), 9) AS boundary_iou
        FROM fx_pred p LEFT JOIN bands b ON b.image_id = p.image_id AND b.pred_id = p.pred_id""", "fx_pred", "fx_gt")),
    "bio2_union_boundary_iou": (union_biou, oracle(
        f"WITH {biou_ctes()} SELECT image_id, pred_px, gt_px, round(biou, 9) AS biou FROM biou", "fx_images", "fx_pred", "fx_gt")),
    "bio2_union_of_shapes": (shape_biou, oracle(
        f"WITH {SHAPE_BIOU} SELECT image_id, pred_px, gt_px, round(biou, 9) AS biou FROM biou", "fx_images", "fx_pred", "fx_gt")),
    "bio2_mean": (mean_biou, oracle(f"""WITH {SHAPE_BIOU} SELECT count(*) AS images, count(*) FILTER (WHERE pred_px + gt_px > 0) AS scored,
        round(avg(biou), 9) AS mean_biou, round(avg(biou) FILTER (WHERE pred_px + gt_px > 0), 9) AS area_biou FROM biou""", "fx_images", "fx_pred", "fx_gt")),
    "f1s_best_threshold": (f1_best, oracle(f"""{SCORE_WON},
        rows_ AS (SELECT p.score, CASE WHEN w.pred_id IS NULL THEN 0 ELSE 1 END AS hit FROM fx_pred p LEFT JOIN won w
                  ON w.image_id = p.image_id AND w.pred_id = p.pred_id SEMI JOIN fx_images i ON i.image_id = p.image_id),
        grid AS (SELECT k, k * 0.005::DOUBLE AS threshold, count(r.score) AS kept, coalesce(sum(hit), 0) AS tp
                 FROM (SELECT unnest(range(200)) AS k) g LEFT JOIN rows_ r ON r.score >= k * 0.005::DOUBLE GROUP BY k),
        f AS (SELECT *, CAST(tp AS DOUBLE) / greatest(kept, 1) AS p, CAST(tp AS DOUBLE) / greatest(n, 1) AS r, n
              FROM grid CROSS JOIN (SELECT count(*) AS n FROM fx_gt) t),
        s AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / greatest(p + r, 1e-12) ELSE 0 END AS f1 FROM f)
        SELECT round(f1, 9) AS best_f1, round(threshold, 9) AS threshold, round(p, 9) AS precision, round(r, 9) AS recall,
               CAST(tp AS BIGINT) AS tp, CAST(kept - tp AS BIGINT) AS fp, CAST(n - tp AS BIGINT) AS fn, CAST(n AS BIGINT) AS total_gt
        FROM s ORDER BY f1 DESC, k LIMIT 1""", "fx_pred", "fx_gt", "fx_images")),
    "rec1_recall_diagnostics": (recall_diagnostics, oracle(REC_WON + REC_FACTS, "fx_pred", "fx_gt", "fx_images")),
    "rec2_coverage_by_iou": (coverage_by_iou, oracle(f"""WITH {PLAIN_MET},
        best AS (SELECT image_id, gt_id, max(CAST({MASK_IOU} AS FLOAT)) AS b FROM met WHERE CAST(score AS FLOAT) >= CAST(0.315 AS FLOAT) GROUP BY 1, 2),
        n AS (SELECT count(*) AS n FROM fx_gt)
        SELECT t AS match_iou, (SELECT count(*) FROM best WHERE b >= CAST(t AS FLOAT)) AS covered, n AS total_gt,
          round((SELECT count(*) FROM best WHERE b >= CAST(t AS FLOAT)) / CAST(n AS DOUBLE), 9) AS coverage
        FROM n CROSS JOIN (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in RECALL_IOUS)}]) AS t) i""", "fx_pred", "fx_gt")),
    "rec2_localization_split": (localization_split, oracle(f"""WITH {PLAIN_MET},
        best AS (SELECT image_id, gt_id, max(CAST({MASK_IOU} AS FLOAT)) AS b FROM met WHERE CAST(score AS FLOAT) >= CAST(0.315 AS FLOAT) GROUP BY 1, 2),
        c AS (SELECT count(*) FILTER (WHERE b >= CAST(0.3 AS FLOAT)) AS lo, count(*) FILTER (WHERE b >= CAST(0.75 AS FLOAT)) AS hi FROM best),
        n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM fx_gt)
        SELECT round(lo / n, 9) AS coverage_low, round(hi / n, 9) AS coverage_primary, round(lo / n - hi / n, 9) AS localization_loss,
               round(1 - lo / n, 9) AS non_proposal_floor FROM c CROSS JOIN n""", "fx_pred", "fx_gt")),
    "cgf1_gated_f1": (gated, oracle(f"""WITH RECURSIVE {PLAIN_MET},
        half AS MATERIALIZED (SELECT image_id, ti, pred_id, gt_id, score, iou FROM (SELECT *, {PLAIN_IOU} AS iou FROM met WHERE score >= 0.315) q
                 JOIN {THRS} t ON iou >= thr), {greedy_steps('half', 'score DESC, pred_id, iou DESC, gt_id', 'image_id, ti')},
        flags AS (SELECT image_id, image_id IN (SELECT image_id FROM fx_gt) AS t, image_id IN (SELECT image_id FROM fx_pred WHERE score >= 0.315) AS g FROM fx_images),
        c AS (SELECT count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn,
                     count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM flags),
        micro AS (SELECT avg(f) AS f FROM (SELECT ti, 2.0 * coalesce(k, 0) / ((SELECT count(*) FROM fx_gt)
                     + (SELECT count(*) FROM fx_pred WHERE score >= 0.315 AND image_id IN (SELECT image_id FROM fx_gt)))::DOUBLE AS f
                   FROM {THRS} t LEFT JOIN (SELECT ti, count(*) AS k FROM won GROUP BY ti) w USING (ti)) q)
        SELECT tp, fp, fn, tn, {IMG_LEVEL}, round(f, 9) AS positive_micro_f1,
               round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0.0 ELSE (CAST(tp AS DOUBLE)*tn - CAST(fp AS DOUBLE)*fn)
          / (sqrt(CAST(tp+fp AS DOUBLE)) * sqrt(CAST(tp+fn AS DOUBLE)) * sqrt(CAST(tn+fp AS DOUBLE)) * sqrt(CAST(tn+fn AS DOUBLE))) END * f, 9) AS cg_f1
        FROM c CROSS JOIN micro""", "fx_pred", "fx_gt", "fx_images")),
    "cgf1_image_level": (document_gate, f"""WITH c AS (
        SELECT count(*) FILTER (WHERE quality = 1 AND n_chars > 400) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars > 400) AS fp,
               count(*) FILTER (WHERE quality = 1 AND n_chars <= 400) AS fn, count(*) FILTER (WHERE quality <> 1 AND n_chars <= 400) AS tn
        FROM labels JOIN documents USING (doc_id)) SELECT tp, fp, fn, tn, {IMG_LEVEL} FROM c"""),
    "top1_merged_topk": (top_merged, oracle("""SELECT * FROM (SELECT image_id, pred_id,
        row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS rank FROM fx_pred) q WHERE rank <= 10""", "fx_pred")),
    "top2_densest_images": (top_dense, oracle(f"""SELECT image_id, n_gt FROM {DENSE} d SEMI JOIN fx_images USING (image_id)
        ORDER BY n_gt DESC, image_id LIMIT 20""", "fx_images", "fx_gt")),
    "top3_best_boundary_images": (top_boundary, oracle(f"""WITH pool AS MATERIALIZED (SELECT image_id FROM {DENSE} d
        ORDER BY n_gt DESC, image_id LIMIT 64), {biou_ctes('pool', 0.315)}
        SELECT image_id, round(biou, 9) AS biou FROM biou WHERE pred_px > 0 ORDER BY biou.biou DESC, image_id LIMIT 10""", "fx_images", "fx_pred", "fx_gt")),
    "top3_boundary_by_density": (top_boundary_buckets, oracle(f"""WITH {biou_ctes('fx_images', 0.315)},
        placed AS (SELECT image_id, count(*) AS n_gt, CASE WHEN count(*) < 25 THEN '1-25' WHEN count(*) < 35 THEN '25-35' ELSE '35-+' END AS bucket
                   FROM fx_gt GROUP BY 1),
        r AS (SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY b.biou DESC, image_id) AS pos, image_id, n_gt, round(b.biou, 9) AS biou
              FROM placed JOIN biou b USING (image_id) WHERE pred_px > 0)
        SELECT * FROM r WHERE pos <= 5""", "fx_images", "fx_pred", "fx_gt")),
    "top4_shown_instances": (top_shown, oracle("""SELECT * FROM (SELECT image_id, pred_id,
        row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS rank FROM fx_pred WHERE score >= 0.5) q WHERE rank <= 15""", "fx_pred")),
}
