"""Scores, measures and changes from scan to scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import escape_like
from ..session import instant
from .profile import QUANTILE_NAMES

DEFAULT_POINTS = 30
MAX_POINTS = 100
PLAIN_MEASURES = ("mean", "stddev", "mean_length", *QUANTILE_NAMES)


def score_records(scores: DataFrame, scan_id: str, measured_at: datetime) -> DataFrame:
    """One row per scan for the store and each table: overall score, bounds, checks, dimensions."""
    rows = scores.filter("level <> 'column'")
    dims = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("dimension") != "overall", F.struct("dimension", F.struct("value", "low", "high", "checks")))))
    )
    overall = lambda c: F.max(F.when(F.col("dimension") == "overall", F.col(c))).alias(c)
    return rows.groupBy("level", "asset").agg(
        overall("value"), overall("low"), overall("high"), overall("checks"), dims.alias("dimensions")
    ).select(
        F.lit(scan_id).alias("scan_id"), instant(measured_at).alias("measured_at"), "asset",
        F.col("value").alias("overall"), "low", "high", "checks", "dimensions",
    )


def _last_points(rows: DataFrame, scans: DataFrame, limit: int, until_scan: str | None) -> DataFrame:
    if not 1 <= limit <= MAX_POINTS:
        raise ValueError(f"ask for 1 to {MAX_POINTS} points, not {limit}")
    if until_scan is not None:
        end = rows.filter(F.col("scan_id") == until_scan).select("measured_at").first()
        if end is None:
            rows = rows.limit(0)
        else:
            at, last = F.col("measured_at"), instant(end.measured_at)
            rows = rows.filter((at < last) | ((at == last) & (F.col("scan_id") <= until_scan)))
    newest = rows.orderBy(F.desc("measured_at"), F.desc("scan_id")).limit(limit)
    return newest.join(scans.select("scan_id", "trigger"), "scan_id").orderBy("measured_at", "scan_id")


def score_history(records: DataFrame, scans: DataFrame, asset: str | None = None, limit: int = DEFAULT_POINTS, until_scan: str | None = None) -> DataFrame:
    """The last scores of the store (`asset` None) or a table, oldest first, with each scan's trigger."""
    level = F.col("asset").isNull() if asset is None else F.col("asset") == asset
    return _last_points(records.filter(level), scans, limit, until_scan)


def measure_history(measures: DataFrame, scans: DataFrame, asset: str, column: str, limit: int = DEFAULT_POINTS, until_scan: str | None = None) -> DataFrame:
    """The last measures of one column, oldest first."""
    return _last_points(measures.filter((F.col("asset") == asset) & (F.col("column") == column)), scans, limit, until_scan)


def score_changes(records: DataFrame) -> DataFrame:
    """Each score against the nearest earlier one that exists, and whether the two intervals overlap.

    A change within overlapping intervals may be sampling noise."""
    before = Window.partitionBy("asset").orderBy("measured_at", "scan_id").rowsBetween(Window.unboundedPreceding, -1)
    point = F.when(F.col("overall").isNotNull(), F.struct("scan_id", "overall", "low", "high"))
    rows = records.withColumn("_b", F.last(point, ignorenulls=True).over(before))
    b = F.col("_b")
    overlap = (b["low"] <= F.col("high")) & (F.col("low") <= b["high"])
    return rows.select(
        "asset", "scan_id", "overall", b["scan_id"].alias("since_scan"), b["overall"].alias("since"),
        F.round(F.col("overall") - b["overall"], 1).alias("delta"), F.when(b.isNotNull(), F.coalesce(overlap, F.lit(False))).alias("within"),
    )


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def measures(profile: DataFrame, assets: DataFrame, scan_id: str, measured_at: datetime) -> DataFrame:
    """One row per column with its measures by name; a measure the column lacks is absent, never null."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    values = {
        "null_share": share("nulls", "rows"),
        "distinct_share": share("distinct", "non_null"),
        "blank_share": share("blanks", "rows"),
        "min": F.col("min_number"),
        "max": F.col("max_number"),
        **{m: F.col(m) for m in PLAIN_MEASURES},
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), _finite(v).cast("double").alias("value")) for k, v in values.items()])
    named = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return profile.join(assets.select("asset", "population", "sampled"), "asset").select(
        F.lit(scan_id).alias("scan_id"), instant(measured_at).alias("measured_at"), "asset", "column",
        "rows", "population", "sampled", named.alias("measures"),
    )


def measure_series(measures_table: DataFrame) -> DataFrame:
    """Per column and measure over the scans: points, first, newest, lowest and highest value."""
    points = measures_table.select("asset", "column", "measured_at", "scan_id", F.explode("measures").alias("measure", "value"))
    at = F.struct("measured_at", "scan_id")
    return points.groupBy("asset", "column", "measure").agg(
        F.count(F.lit(1)).alias("points"), F.min_by("value", at).alias("first"), F.max_by("value", at).alias("newest"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
    )


def change_log(
    events: DataFrame, action: str | None = None, actor: str | None = None, object_type: str | None = None,
    object_id: str | None = None, since: datetime | None = None, until: datetime | None = None,
    after: tuple[datetime, str] | None = None, limit: int = 50,
) -> DataFrame:
    """A page of the change log, newest first.

    `action` is exact, or a prefix when it ends in a dot; `actor` is a part of the name, in any case."""
    rows = events
    if action:
        rows = rows.filter(F.col("action").startswith(action) if action.endswith(".") else F.col("action") == action)
    if actor:
        rows = rows.filter(F.col("actor").ilike(f"%{escape_like(actor)}%"))
    if object_type:
        rows = rows.filter(F.col("object_type") == object_type)
    if object_id:
        rows = rows.filter(F.col("object_id") == object_id)
    if since is not None:
        rows = rows.filter(F.col("at") >= instant(since))
    if until is not None:
        rows = rows.filter(F.col("at") < instant(until))
    if after is not None:
        at, last = instant(after[0]), after[1]
        rows = rows.filter((F.col("at") < at) | ((F.col("at") == at) & (F.col("event_id") < last)))
    return rows.orderBy(F.desc("at"), F.desc("event_id")).limit(limit)


def changed_fields(before: Column, after: Column) -> tuple[Column, Column]:
    """Of two maps, the entries of `after` that differ and what they were; everything when there was nothing."""
    keys = F.map_keys(F.map_filter(after, lambda k, v: ~v.eqNullSafe(before[k])))
    was = F.when(before.isNotNull(), F.map_from_arrays(keys, F.transform(keys, lambda k: before[k])))
    now = F.when(before.isNull(), after).otherwise(F.map_filter(after, lambda k, v: ~v.eqNullSafe(before[k])))
    return was, now
