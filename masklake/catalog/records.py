"""Registered queries: run comparison, gates, metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from masklake.catalog.fixtures import oracle, spark_view
from masklake.operators import runs, views

NAMES = ["Mask AP", "Mask AP50", "Mask AP_small", "Bnd AP instance", "Mask AR@512", "Bnd AP_small", "Bnd AP 8px"]
r9 = lambda c: F.round(c, 9).alias(c)
plain = lambda n: n.replace(" ", "_").replace("@", "_at_")


def wide_rows(spark, sf):
    out = runs.metric_rows(spark_view(spark, sf, "fx_metrics"), NAMES)
    return out.select("run", *[F.col(f"`{n}`").alias(plain(n)) for n in NAMES])


def delta_table(spark, sf):
    out = runs.deltas(spark_view(spark, sf, "fx_metrics"), "run_1")
    return out.select("run", "metric", r9("value"), r9("delta"))


def nearest(spark, sf):
    m = spark_view(spark, sf, "fx_metrics").where(F.col("metric").startswith("Mask"))
    return runs.nearest_view(m.select("run", F.col("metric").alias("view"), "value"), 0.5).select("run", "view", r9("value"), r9("delta"))


def comparable(spark, sf):
    return runs.disagreements(spark_view(spark, sf, "fx_runs"), ["tile_policy"])


def _payload(spark, sf):
    m = spark_view(spark, sf, "fx_metrics")
    pick = lambda n: F.max(F.when(F.col("metric") == n, F.col("value")))
    return m.groupBy("run", "run_pos").agg((pick("Mask AP") * 2).alias("mask_ap"), pick("Bnd AP instance").alias("boundary_ap")).select(
        "run", "mask_ap", "boundary_ap", F.lit("instance_relative").alias("band_mode"),
        F.when(F.col("run_pos") % 5 == 0, 0.2).otherwise(0.19).alias("band_k"),
        F.when(F.col("run_pos") % 7 == 0, 100).otherwise(512).alias("max_dets"), F.lit("tree").alias("class_split"),
        F.when(F.col("run_pos") % 3 == 0, "canopy").when(F.col("run_pos") % 3 == 1, "tree").alias("wanted_split"))


def payload_rules(spark, sf):
    return runs.payload_checks(_payload(spark, sf))


def _criteria(spark, sf):
    """A declaration per supplier: three criteria, damaged by rule."""
    s = spark_view(spark, sf, "supplier").select(F.col("s_suppkey").alias("declaration"))
    k = F.col("declaration")
    rows = F.array(
        F.struct(F.when(k % 5 == 0, "non_regression").otherwise("primary_effect").alias("role"), F.lit("Mask AP").alias("metric"),
                 F.when(k % 7 == 0, 0.0).when(k % 5 == 0, -0.01).otherwise(0.01).alias("minimum_delta")),
        F.struct(F.lit("non_regression").alias("role"), F.when(k % 11 == 0, "Mask AP").otherwise("Bnd AP instance").alias("metric"),
                 F.when(k % 13 == 0, 0.1).otherwise(-0.003).alias("minimum_delta")),
        F.struct(F.lit("non_regression").alias("role"), F.when(k % 17 == 0, "Speed").otherwise("Mask AP_small").alias("metric"),
                 F.when(k % 19 == 0, float("nan")).otherwise(-0.003).alias("minimum_delta")))
    return s.select("declaration", F.inline(rows))


def criteria_rules(spark, sf):
    return runs.criteria_checks(_criteria(spark, sf))


def declaration_rules(spark, sf):
    """Declaration headers derived from orders, damaged by rule."""
    o = spark_view(spark, sf, "orders")
    k = F.col("o_orderkey")
    d = o.select(k.alias("declaration"), F.when(k % 3 == 0, "draft").otherwise("approved").alias("status"),
                 F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 5 == 0, "T00:00:00").when(k % 7 == 0, "T25:00:00Z").otherwise("T00:00:00Z"))
                 .alias("approved_utc"), F.when(k % 11 == 0, "xyz").otherwise(F.sha2(k.cast("string"), 256)).alias("eval_sha256"))
    return runs.declaration_checks(d, {"status": "approved"})


def gate_verdicts(spark, sf):
    m = spark_view(spark, sf, "fx_metrics")
    criteria = _criteria(spark, sf).where("declaration = 1").drop("declaration")
    out = runs.verdicts(runs.deltas(m, "run_1"), criteria)
    return out.select("run", "role", "metric", r9("delta"), "minimum_delta", "passed")


def _judged(spark, sf):
    """Each declaration judges the run of its number."""
    c = _criteria(spark, sf).withColumns({"run": F.concat(F.lit("run_"), F.col("declaration").cast("string")),
                                          "minimum_delta": F.when(~F.isnan("minimum_delta"), F.col("minimum_delta"))})
    return runs.judged(runs.deltas(spark_view(spark, sf, "fx_metrics"), "run_1"), c)


def all_verdicts(spark, sf):
    return _judged(spark, sf).select("declaration", "run", "role", "metric", r9("delta"), "minimum_delta", "passed")


def all_decisions(spark, sf):
    return runs.decisions(_judged(spark, sf))


def _log(spark, sf):
    return spark_view(spark, sf, "fx_metric_log")


def merged_log(spark, sf):
    return runs.merge_logs(_log(spark, sf), ["run", "name"]).select("run", "name", "epoch", "source_priority", "value", "conflict")


def ledger(spark, sf):
    e = spark_view(spark, sf, "events").select(F.col("event_type").alias("action"), F.dayofmonth("ts").cast("bigint").alias("epoch"))
    return runs.ledger_summary(e)


def _merged(spark, sf):
    return runs.merge_logs(_log(spark, sf), ["run", "name"])


def _priorities(spark):
    return spark.createDataFrame([("purchase", 0, "max"), ("view", 1, "max"), ("error", 2, "min")], "name string, priority int, mode string")


def primary(spark, sf):
    rows = _merged(spark, sf).where("NOT (name = 'purchase' AND epoch % 2 = 0)")
    return runs.primary_metric(rows, _priorities(spark), ["run", "epoch"])


def improvements(spark, sf):
    series = primary(spark, sf)
    return runs.best_so_far(series, ["run"]).select("run", "epoch", "name", "value", "improved")


def _long_series(spark, sf):
    """Two runs with every event as an epoch; the watched metric changes now and then, one run holds most rows."""
    e = spark_view(spark, sf, "events")
    return e.select(F.when(F.col("user_id") % 5 == 0, "b").otherwise("a").alias("run"), F.col("event_id").alias("epoch"),
                    F.concat(F.lit("m"), F.floor(F.col("event_id") / 1300) % 4).alias("name"), F.floor(F.col("value") * 10).alias("value"),
                    F.when(F.floor(F.col("event_id") / 1300) % 4 == 2, "min").otherwise("max").alias("mode"))


def long_improvements(spark, sf):
    return runs.best_so_far(_long_series(spark, sf), ["run"]).select("run", "epoch", "name", "value", "improved")


def forward(spark, sf):
    log = spark_view(spark, sf, "events").select(F.col("event_type").alias("run"), "event_id", F.floor(F.col("value") * 100).alias("epoch"))
    return runs.forward_rows(log, ["run"], ["event_id"])


def renamed(spark, sf):
    names = spark.createDataFrame([("purchase", "val_AP", 0), ("error", "val_loss", 1)], "name string, display string, position int")
    rows = _log(spark, sf).withColumn("value", F.when(F.col("epoch") % 9 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")))
    return runs.rename_metrics(rows, names).select("run", "source_priority", "epoch", "name", "value", F.col("position").cast("bigint").alias("position"))


def summary(spark, sf):
    return runs.run_summary(_merged(spark, sf), ["run", "name"])


def nonfinite(spark, sf):
    v = F.col("value")
    rows = spark_view(spark, sf, "events").select(F.col("event_type").alias("name"), F.when(F.col("event_id") % 97 == 0, float("nan"))
                                                  .when(F.col("event_id") % 89 == 0, float("inf")).otherwise(v).alias("value"))
    return runs.nonfinite_summary(rows)


CRIT = """crit AS (SELECT k AS declaration, unnest([CASE WHEN k % 5 = 0 THEN 'non_regression' ELSE 'primary_effect' END, 'non_regression', 'non_regression']) AS role,
      unnest(['Mask AP', CASE WHEN k % 11 = 0 THEN 'Mask AP' ELSE 'Bnd AP instance' END, CASE WHEN k % 17 = 0 THEN 'Speed' ELSE 'Mask AP_small' END]) AS metric,
      unnest([CASE WHEN k % 7 = 0 THEN 0.0 WHEN k % 5 = 0 THEN -0.01 ELSE 0.01 END::DOUBLE, CASE WHEN k % 13 = 0 THEN 0.1 ELSE -0.003 END::DOUBLE, -0.003::DOUBLE]) AS minimum_delta
      FROM (SELECT s_suppkey AS k FROM supplier) s)"""
JUDGED = CRIT.replace("-0.003::DOUBLE])", "CASE WHEN k % 19 = 0 THEN NULL ELSE -0.003 END::DOUBLE])") + """, d AS (SELECT m.run, m.metric, m.value - b.value AS delta
      FROM fx_metrics m JOIN fx_metrics b ON b.run = 'run_1' AND b.metric = m.metric), j AS (SELECT declaration, 'run_' || declaration AS run, role, crit.metric, delta, minimum_delta,
      coalesce(delta >= minimum_delta, false) AS passed FROM crit LEFT JOIN d ON d.run = 'run_' || declaration AND d.metric = crit.metric)"""
MERGED = """merged AS MATERIALIZED (SELECT run, name, epoch, max(source_priority) AS source_priority, arg_max(value, source_priority) AS value,
      count(DISTINCT value) > 1 AS conflict FROM fx_metric_log GROUP BY 1, 2, 3)"""
PRIMARY = MERGED + """, prim AS MATERIALIZED (SELECT run, epoch, arg_min(name, p) AS name, arg_min(value, p) AS value, arg_min(mode, p) AS mode FROM (
      SELECT * FROM merged JOIN (VALUES ('purchase', 0, 'max'), ('view', 1, 'max'), ('error', 2, 'min')) v(name, p, mode) USING (name)
      WHERE NOT (name = 'purchase' AND epoch % 2 = 0) AND (mode = 'max' OR value <> 0)) q GROUP BY 1, 2)"""
FIELDS = [f for f in runs.COMPARABILITY_FIELDS if f != "tile_policy"]
CASES = {
    "cmp1_metric_rows": (wide_rows, oracle("SELECT run, " + ", ".join(
        f"max(value) FILTER (WHERE metric = '{n}') AS {plain(n)}" for n in NAMES) + " FROM fx_metrics GROUP BY run", "fx_metrics")),
    "cmp2_baseline_deltas": (delta_table, oracle("""SELECT m.run, m.metric, round(m.value, 9) AS value, round(m.value - b.value, 9) AS delta
        FROM fx_metrics m JOIN fx_metrics b ON b.run = 'run_1' AND b.metric = m.metric""", "fx_metrics")),
    "cmp3_nearest_view": (nearest, oracle("""SELECT run, metric AS view, round(value, 9) AS value, round(value - 0.5::DOUBLE, 9) AS delta FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(value - 0.5::DOUBLE), metric) AS k FROM fx_metrics WHERE metric LIKE 'Mask%') q WHERE k = 1""", "fx_metrics")),
    "gate1_comparability": (comparable, oracle("""WITH l AS (""" + " UNION ALL ".join(
        f"SELECT run, run_pos, '{f}' AS field, coalesce({f}, '<missing>') AS value FROM fx_runs" for f in FIELDS)
        + """) SELECT l.run, l.field, b.value AS base_value, l.value FROM l JOIN l b ON b.field = l.field AND b.run_pos = (SELECT min(run_pos) FROM l)
        WHERE l.value <> b.value""", "fx_runs")),
    "gate2_payload_rules": (payload_rules, oracle("""WITH p AS (SELECT run, run_pos, 2 * max(value) FILTER (WHERE metric = 'Mask AP') AS m,
        max(value) FILTER (WHERE metric = 'Bnd AP instance') AS b FROM fx_metrics GROUP BY 1, 2)
        SELECT run, unnest(['instance band is present', 'band rule', 'mask AP is a share', 'boundary AP is a share', 'detection limit', 'class split']) AS "check",
        unnest([b IS NOT NULL, run_pos % 5 <> 0, coalesce(m BETWEEN 0 AND 1, false), coalesce(b BETWEEN 0 AND 1, false), run_pos % 7 <> 0, run_pos % 3 <> 0]) AS ok FROM p""", "fx_metrics")),
    "gate3_criteria_rules": (criteria_rules, """SELECT s_suppkey AS declaration, unnest(['roles and metrics are known', 'margins are finite', 'primary margin is positive',
        'guard margins are not positive', 'exactly one primary effect', 'at least one guard', 'metrics are distinct']) AS "check",
        unnest([s_suppkey % 17 <> 0, s_suppkey % 19 <> 0, NOT (s_suppkey % 7 = 0 AND s_suppkey % 5 <> 0), s_suppkey % 13 <> 0 AND (s_suppkey % 19 <> 0),
                s_suppkey % 5 <> 0, true, s_suppkey % 11 <> 0]) AS ok FROM supplier"""),
    "gate3_declaration_rules": (declaration_rules, """SELECT o_orderkey AS declaration, unnest(['status is as declared', 'approval time is valid', 'eval_sha256 is SHA-256']) AS "check",
        unnest([o_orderkey % 3 <> 0, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0, o_orderkey % 11 <> 0]) AS ok FROM orders"""),
    "gate4_verdicts": (gate_verdicts, oracle("WITH " + CRIT + """ SELECT m.run, role, m.metric, round(m.value - b.value, 9) AS delta, minimum_delta,
        m.value - b.value >= minimum_delta AS passed FROM fx_metrics m JOIN fx_metrics b ON b.run = 'run_1' AND b.metric = m.metric
        JOIN crit ON crit.metric = m.metric AND declaration = 1""", "fx_metrics")),
    "gate4_all_declarations": (all_verdicts, oracle("WITH " + JUDGED + " SELECT declaration, run, role, metric, round(delta, 9) AS delta, minimum_delta, passed FROM j", "fx_metrics")),
    "gate4_decisions": (all_decisions, oracle("WITH " + JUDGED + """ SELECT declaration, run, count(*) AS criteria, count(*) FILTER (WHERE NOT passed) AS failed,
        bool_and(passed) AS accepted FROM j GROUP BY 1, 2""", "fx_metrics")),
    "log1_merged_logs": (merged_log, oracle("WITH " + MERGED + " SELECT run, name, epoch, source_priority, value, conflict FROM merged", "fx_metric_log")),
    "log2_ledger_summary": (ledger, """SELECT event_type AS action, count(*) AS entries, count(DISTINCT day(ts)) AS epochs, CAST(max(day(ts)) AS BIGINT) AS highest_epoch
        FROM events GROUP BY 1"""),
    "log3_primary_metric": (primary, oracle("WITH " + PRIMARY + " SELECT run, epoch, name, value, mode FROM prim", "fx_metric_log")),
    "log4_best_so_far": (improvements, oracle("WITH " + PRIMARY + """, s AS (SELECT *, sum(n) OVER (PARTITION BY run ORDER BY epoch) AS g FROM (
        SELECT *, CASE WHEN name IS DISTINCT FROM lag(name) OVER (PARTITION BY run ORDER BY epoch) THEN 1 ELSE 0 END AS n FROM prim) q)
        SELECT run, epoch, name, value, coalesce(CASE WHEN mode = 'min' THEN value < min(value) OVER w ELSE value > max(value) OVER w END, true) AS improved
        FROM s WINDOW w AS (PARTITION BY run, g ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "fx_metric_log")),
    "log4_long_runs": (long_improvements, """WITH s AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'b' ELSE 'a' END AS run, event_id AS epoch,
        event_id // 1300 % 4 AS k, CAST(floor(value * 10) AS BIGINT) AS value FROM events),
        t AS (SELECT *, sum(n) OVER (PARTITION BY run ORDER BY epoch) AS g FROM (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY run ORDER BY epoch) THEN 1 ELSE 0 END AS n FROM s) q)
        SELECT run, epoch, 'm' || k AS name, value, coalesce(CASE WHEN k = 2 THEN value < min(value) OVER w ELSE value > max(value) OVER w END, true) AS improved
        FROM t WINDOW w AS (PARTITION BY run, g ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "log4_forward_rows": (forward, """SELECT run, event_id, epoch FROM (SELECT *, max(epoch) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
        FROM (SELECT event_type AS run, event_id, CAST(floor(value * 100) AS BIGINT) AS epoch FROM events) e) q WHERE high IS NULL OR epoch > high"""),
    "log5_renamed_metrics": (renamed, oracle("""SELECT run, source_priority, epoch, CASE name WHEN 'purchase' THEN 'val_AP' ELSE 'val_loss' END AS name, value,
        CAST(CASE name WHEN 'purchase' THEN 0 ELSE 1 END AS BIGINT) AS position FROM fx_metric_log WHERE name IN ('purchase', 'error') AND epoch % 9 <> 0""", "fx_metric_log")),
    "log6_run_summary": (summary, oracle("WITH " + MERGED + """ SELECT run, name, count(*) AS entries, max(epoch) AS latest_epoch, arg_max(value, epoch) AS latest_value,
        max(value) AS best_value, (SELECT min(epoch) FROM merged b WHERE b.run = m.run AND b.name = m.name AND b.value = max(m.value)) AS best_epoch
        FROM merged m GROUP BY run, name""", "fx_metric_log")),
    "log8_nonfinite_summary": (nonfinite, """SELECT event_type AS name, count(*) AS total, count(*) FILTER (WHERE event_id % 97 = 0 OR event_id % 89 = 0) AS nonfinite,
        min(value) FILTER (WHERE event_id % 97 <> 0 AND event_id % 89 <> 0) AS finite_min, max(value) FILTER (WHERE event_id % 97 <> 0 AND event_id % 89 <> 0) AS finite_max
        FROM events GROUP BY 1"""),
}
