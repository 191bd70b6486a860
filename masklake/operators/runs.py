"""Run records: comparison tables, gates, and metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from masklake.operators.prefix import best_before

# Provenance fields that two comparable runs must share.
COMPARABILITY_FIELDS = ["device_name", "amp_dtype", "bf16_supported", "tile_policy", "tile_px", "overlap_px", "resolution",
                        "merge_method", "dedup_iou", "maxdets", "score_thresh", "min_area", "hflip", "multi_scale"]
# Columns of the comparison table, in order.
METRIC_COLUMNS = ["Mask AP", "Mask AP50", "Mask AP75", "Mask AP_small", "Mask AP_medium", "Mask AP_large", "Mask AR@512",
                  "Bnd AP instance", "Bnd AP50 instance", "Bnd AP75 instance", "Bnd AP_small", "Bnd AP_medium", "Bnd AP_large",
                  "Bnd AP 8px", "Bnd AP lit"]
# Metrics an efficacy criterion may name.
EFFECT_METRICS = ["Mask AP", "Mask AP50", "Mask AP75", "Mask AP_small", "Mask AP_medium", "Mask AP_large", "Mask AR@512",
                  "Bnd AP instance", "Bnd AP_small", "Bnd AP_medium", "Bnd AP_large"]
MISSING = "<missing>"


def metric_rows(metrics: DataFrame, columns: list[str] = METRIC_COLUMNS) -> DataFrame:
    """One wide row per run from `(run, metric, value)`."""
    return metrics.groupBy("run").pivot("metric", columns).agg(F.max("value"))


def deltas(metrics: DataFrame, baseline: str) -> DataFrame:
    """Every metric of every run next to the baseline's, `(run, metric, value, delta)`."""
    base = metrics.where(F.col("run") == baseline).select("metric", F.col("value").alias("base"))
    return metrics.join(base, "metric").select("run", "metric", "value", (F.col("value") - F.col("base")).alias("delta"))


def nearest_view(metrics: DataFrame, published: float) -> DataFrame:
    """Per run the view whose value lies closest to a published one, `(run, view, value, delta)`."""
    delta = F.col("value") - F.lit(published)
    best = F.min_by(F.struct("view", "value", delta.alias("delta")), F.struct(F.abs(delta).alias("d"), F.col("view").alias("v")))
    return metrics.groupBy("run").agg(best.alias("b")).select("run", "b.*")


def field_table(runs: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """`(run, run_pos, field, value)` with absent values spelled out."""
    fields = [f for f in COMPARABILITY_FIELDS if f not in ignore]
    return runs.select("run", "run_pos", *[F.coalesce(F.col(f).cast("string"), F.lit(MISSING)).alias(f) for f in fields]).unpivot(
        ["run", "run_pos"], fields, "field", "value")


def disagreements(runs: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Fields in which a run differs from the first one, `(run, field, base_value, value)`."""
    table = field_table(runs, ignore)
    base = (table.groupBy("field").agg(F.min_by("value", "run_pos").alias("base_value")))
    return table.join(base, "field").where(~F.col("value").eqNullSafe(F.col("base_value"))).select("run", "field", "base_value", "value")


def payload_checks(payload: DataFrame, *, factor: float = 0.19, max_dets: int = 512) -> DataFrame:
    """Rules an evaluation payload must satisfy, `(run, check, ok)`.

    `payload(run, mask_ap, boundary_ap, band_mode, band_k, max_dets, class_split, wanted_split)`.
    """
    unit = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0.0, 1.0)
    rules = {"instance band is present": F.col("boundary_ap").isNotNull(),
             "band rule": (F.col("band_mode") == "instance_relative") & (F.col("band_k") == factor),
             "mask AP is a share": unit("mask_ap"), "boundary AP is a share": unit("boundary_ap"),
             "detection limit": F.col("max_dets") == max_dets,
             "class split": F.col("wanted_split").isNull() | F.col("class_split").eqNullSafe(F.col("wanted_split"))}
    return payload.select("run", F.inline(F.array(*[
        F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules.items()])))


def timestamp_ok(text: Column) -> Column:
    """ISO-8601 text with a zone that lies at most five minutes ahead."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(zoned & (F.try_to_timestamp(text) <= F.current_timestamp() + F.expr("INTERVAL 5 MINUTES")), F.lit(False))


def criteria_checks(criteria: DataFrame) -> DataFrame:
    """Rules for declared criteria `(declaration, role, metric, minimum_delta)`, as `(declaration, check, ok)`."""
    role, value = F.col("role"), F.col("minimum_delta")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    agg = criteria.groupBy("declaration").agg(
        F.count_if(~role.isin("primary_effect", "non_regression") | ~F.col("metric").isin(EFFECT_METRICS)).alias("unknown"),
        F.count_if(~finite).alias("infinite"), F.count_if((role == "primary_effect") & ~(value > 0)).alias("weak"),
        F.count_if((role == "non_regression") & (value > 0)).alias("strict"), F.count_if(role == "primary_effect").alias("primary"),
        F.count_if(role == "non_regression").alias("guards"), (F.count("metric") - F.count_distinct("metric")).alias("repeated"))
    rules = {"roles and metrics are known": F.col("unknown") == 0, "margins are finite": F.col("infinite") == 0,
             "primary margin is positive": F.col("weak") == 0, "guard margins are not positive": F.col("strict") == 0,
             "exactly one primary effect": F.col("primary") == 1, "at least one guard": F.col("guards") > 0,
             "metrics are distinct": F.col("repeated") == 0}
    return agg.select("declaration", F.inline(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in rules.items()])))


def declaration_checks(declarations: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Header rules of a declaration table: fixed fields, approval time, hash formats."""
    rules = {f"{k} is as declared": F.col(k).cast("string").eqNullSafe(F.lit(v)) for k, v in expected.items()}
    rules["approval time is valid"] = timestamp_ok(F.col("approved_utc"))
    for c in (c for c in declarations.columns if c.endswith("sha256")):
        rules[f"{c} is SHA-256"] = F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    return declarations.select("declaration", F.inline(F.array(*[
        F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in rules.items()])))


def verdicts(delta: DataFrame, criteria: DataFrame) -> DataFrame:
    """Observed change against the declared minimum, `(run, role, metric, delta, minimum_delta, passed)`."""
    return (delta.join(criteria, "metric").select(
        "run", "role", "metric", "delta", "minimum_delta",
        F.coalesce(F.col("delta") >= F.col("minimum_delta"), F.lit(False)).alias("passed")))


def judged(delta: DataFrame, criteria: DataFrame) -> DataFrame:
    """Every criterion of every declaration against the run that it names: `(declaration, run, role, metric, delta, minimum_delta, passed)`.

    `criteria(declaration, run, role, metric, minimum_delta)`. A metric that the run or its baseline lacks has no delta and fails, and so does a
    criterion without a minimum.
    """
    known = delta.select("run", "metric", "delta")
    return criteria.join(known, ["run", "metric"], "left").select(
        "declaration", "run", "role", "metric", "delta", "minimum_delta",
        F.coalesce(F.col("delta") >= F.col("minimum_delta"), F.lit(False)).alias("passed"))


def decisions(judgements: DataFrame) -> DataFrame:
    """One row for each declaration: `(declaration, run, criteria, failed, accepted)`; accepted when no criterion fails."""
    return judgements.groupBy("declaration", "run").agg(
        F.count(F.lit(1)).alias("criteria"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("accepted"))


def merge_logs(log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of several attempts merged by epoch: the highest `source_priority` wins, differing rows are flagged.

    A maximum per key combines before the shuffle, so repeated attempts never meet in one sort.
    """
    if not log.where("epoch IS NULL").isEmpty():
        raise ValueError("a log row has no epoch")
    rest = [c for c in log.columns if c not in (*keys, "epoch", "source_priority")]
    row = F.struct("source_priority", *rest)
    digest = F.xxhash64(*rest)
    return (log.groupBy(*keys, "epoch").agg(F.max(row).alias("_r"), (F.min(digest) != F.max(digest)).alias("conflict"))
            .select(*keys, "epoch", *[F.col("_r." + c).alias(c) for c in ("source_priority", *rest)], "conflict"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Rows per action with distinct and highest epochs."""
    return ledger.groupBy("action").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("epoch").alias("epochs"),
                                        F.max("epoch").alias("highest_epoch"))


def primary_metric(metrics: DataFrame, priorities: DataFrame, keys: list[str]) -> DataFrame:
    """The metric that decides per key: lowest `priority` among finite values; losses need a non-zero value.

    `metrics(keys, name, value)`, `priorities(name, priority, mode)`.
    """
    usable = metrics.join(priorities, "name").where(
        "value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity') AND (mode = 'max' OR value <> 0)")
    best = F.min_by(F.struct("name", "value", "mode"), F.struct("priority", "name"))
    return usable.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def best_so_far(series: DataFrame, keys: list[str]) -> DataFrame:
    """Marks rows that improve strictly on all earlier ones of the same metric; a changed metric starts anew.

    `series(keys, epoch, name, value, mode)`; one run may be spread over all ranges of its epochs.
    """
    signed = F.when(F.col("mode") == "min", -F.col("value")).otherwise(F.col("value"))
    scanned = best_before(series, keys, [F.col("epoch")], F.col("name"), signed, "_best")
    return scanned.withColumn("improved", F.col("_best").isNull() | (signed > F.col("_best"))).drop("_best")


def forward_rows(log: DataFrame, keys: list[str], arrival: list[str], epoch: str = "epoch") -> DataFrame:
    """Rows whose epoch exceeds every earlier one of the same keys, in the order of arrival; repeats and regressions go.

    The batch form of `streaming.forward_progress` with one row to a batch; rows without an epoch go.
    """
    some = log.where(F.col(epoch).isNotNull())
    scanned = best_before(some, keys, [F.col(c) for c in arrival], F.lit(0), F.col(epoch), "_high")
    return scanned.where(F.col("_high").isNull() | (F.col(epoch) > F.col("_high"))).drop("_high")


def rename_metrics(metrics: DataFrame, names: DataFrame) -> DataFrame:
    """Whitelisted metrics under their configured names, finite numbers only; `names(name, display, position)`."""
    number = F.col("value").try_cast("double")
    return (metrics.withColumn("value", number).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
            .join(names, "name").drop("name").withColumnRenamed("display", "name"))


def run_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, latest epoch with its value, and best value per key."""
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.max("epoch").alias("latest_epoch"), F.max_by("value", "epoch").alias("latest_value"),
        F.max("value").alias("best_value"), F.min_by("epoch", F.struct((-F.col("value")).alias("v"), F.col("epoch").alias("e"))).alias("best_epoch"))


def nonfinite_summary(series: DataFrame, key: str = "name") -> DataFrame:
    """Per series how many values are not finite, and the range of those that are."""
    v = F.col("value")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return series.groupBy(key).agg(
        F.count("value").alias("total"), F.count_if(v.isNotNull() & ~finite).alias("nonfinite"),
        F.min(F.when(finite, v)).alias("finite_min"), F.max(F.when(finite, v)).alias("finite_max"))
