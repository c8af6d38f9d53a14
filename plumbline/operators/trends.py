"""Series over time: row volume per day, anomalies of measures, and ordered series for other tools."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running


def volume_trend(df: DataFrame, time: str, series: str | None = None, weeks: int = 4, least_share: float = 0.5, until: date | None = None) -> DataFrame:
    """series, day, n, expected, state: one row per day of each series, days without a row included.

    A series runs from its first day to the last day of the table, or to `until` (the scan's day), so a load that is late shows as
    missing days at the end. `expected` is the median of the same weekday in up to `weeks` weeks before (null in the first week).
    State: `missing` (no rows where some were expected), `low` (fewer than `least_share` of them), `new` (nothing to compare
    with) or `ok`. Rows without a time are not counted; without `series` the table is one series named `all`.
    """
    key = F.coalesce(F.col(series).cast("string"), F.lit("null")) if series else F.lit("all")
    days = df.where(F.col(time).isNotNull()).groupBy(key.alias("series"), F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    last = F.lit(until).cast("date") if until else F.max("day")
    end = days.agg(last.alias("end"))
    spans = days.groupBy("series").agg(F.min("day").alias("start")).join(F.broadcast(end)).where("start <= end")
    calendar = spans.select("series", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("day"))
    full = calendar.join(days, ["series", "day"], "left").select("series", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    same_weekday = Window.partitionBy("series", F.dayofweek("day")).orderBy("day").rowsBetween(-weeks, -1)
    out = full.withColumn("expected", F.percentile("n", F.lit(0.5)).over(same_weekday))
    state = F.when(F.col("expected").isNull(), "new").when((F.col("n") == 0) & (F.col("expected") > 0), "missing")
    return out.withColumn("state", state.when(F.col("n") < least_share * F.col("expected"), "low").otherwise("ok"))


def metric_anomaly(history: DataFrame, period: int = 7, alpha: float = 0.05, calibration: int | None = None) -> DataFrame:
    """series, at, value, baseline, residual, p_value, anomaly of a measure history (series, at, value).

    The baseline of a point is a trend, the mean of the `period` values before it, plus a season, the median of how values of the
    same place in the period stood off their trend before. The residual is what is left. Its conformal p-value is the share of
    earlier residuals at least as large, itself counted in: where residuals are exchangeable, at most `alpha` of clean points
    are reported, whatever their distribution. `calibration` earlier residuals are needed (by default as many as make a p-value of
    `alpha` possible); before, p_value is null and nothing is reported. Null values are left out and take no place in the period;
    points of equal `at` are ordered by value.

    A history has one row per scan and series; a series is ordered in one task.
    """
    needed = calibration if calibration is not None else max(1, int(1 / alpha + 0.999999) - 1)
    order = Window.partitionBy("series").orderBy("at", "value")
    rows = history.where(F.col("value").isNotNull()).select("series", "at", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("place", F.row_number().over(order))
    by_place = Window.partitionBy("series").orderBy("place")
    rows = rows.withColumn("trend", F.when(F.col("place") > period, F.avg("value").over(by_place.rowsBetween(-period, -1))))
    rows = rows.withColumn("off", F.col("value") - F.col("trend"))
    season = Window.partitionBy("series", F.col("place") % period).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("baseline", F.col("trend") + F.coalesce(F.percentile("off", F.lit(0.5)).over(season), F.lit(0.0)))
    rows = rows.withColumn("residual", F.col("value") - F.col("baseline")).withColumn("size", F.abs("residual"))
    rows = rows.withColumn("earlier", F.collect_list("size").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
    at_least = F.size(F.filter("earlier", lambda x: x >= F.col("size")))
    p = F.when(F.col("size").isNotNull() & (F.size("earlier") >= needed), (at_least + 1) / (F.size("earlier") + 1))
    return rows.withColumn("p_value", p).select("series", "at", "value", "baseline", "residual", "p_value", F.coalesce(F.col("p_value") <= alpha, F.lit(False)).alias("anomaly"))


def time_series(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """series, at, value, place: each series in order of time, places from 1, in files that follow one another.

    Rows are range-partitioned by series and time: a series that holds a third of all rows is split over partitions and still in
    order, and reading the partitions one after the other gives every series whole. Rows without a time are left out; equal times
    are ordered by value, a null value first; a null key is a series of its own.
    """
    rows = df.where(F.col(time).isNotNull()).select(F.col(key).alias("series"), F.col(time).alias("at"), F.col(value).cast("double").alias("value"))
    placed = running(rows, ["series"], ["at", "value"], {"place": F.lit(1)})
    return placed.repartitionByRange("series", "at", "value").sortWithinPartitions("series", "at", "value", "place")
