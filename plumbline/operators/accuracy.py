"""How well checks find known faults: results of scans against a labelled fault list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CheckSpec
from .evaluate import is_finding

KEY = ["type", "asset", "column"]


def _keyed(results: DataFrame) -> DataFrame:
    """Results by check type, table and column; table-level checks have no column."""
    return results.withColumn("column", F.coalesce(F.when(F.col("level") == "column", F.col("column")), F.lit("")))


def detection(faults: DataFrame, results: DataFrame) -> DataFrame:
    """Per check type: fault groups, rows, detected, counted exactly, and failures nobody put in.

    `faults`: `(type, asset, column, rows)`, column null for table-level checks."""
    f = faults.withColumn("column", F.coalesce("column", F.lit("")))
    r = _keyed(results).select(*KEY, "failed")
    both = f.withColumn("expected", F.lit(True)).join(r, KEY, "full_outer")
    hit = F.col("expected") & (F.col("failed") > 0)
    return both.groupBy("type").agg(
        F.count_if("expected").alias("groups"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("fault_rows"),
        F.count_if(hit).alias("detected"),
        F.count_if(F.col("expected") & (F.col("failed") == F.col("rows"))).alias("exact"),
        F.count_if(F.col("expected").isNull() & (F.col("failed") > 0)).alias("unexpected"),
    )


def clean_alarms(results: DataFrame) -> DataFrame:
    """Per rule: rows evaluated, rows failed and findings on data without faults."""
    return results.filter("kind = 'rule'").groupBy("type").agg(
        F.sum("evaluated").cast("bigint").alias("clean_evaluated"), F.sum("failed").cast("bigint").alias("clean_failed_rows"),
        F.count_if(is_finding()).alias("clean_findings"),
    )


def baseline_alarms(results: DataFrame) -> DataFrame:
    """Per baseline: scoring checks and findings when bounds locked on one data set meet another."""
    return results.filter("kind = 'baseline'").groupBy("type").agg(
        F.count_if("scores").alias("baseline_checks"), F.count_if(is_finding()).alias("baseline_findings")
    )


def interval_coverage(faults: DataFrame, full: DataFrame, sampled: DataFrame, sampled_assets: list[str]) -> DataFrame:
    """Per check type: faults still seen on a sample, and how often the interval holds the true share."""
    f = faults.withColumn("column", F.coalesce("column", F.lit(""))).select(*KEY)
    truth = _keyed(full).select(*KEY, F.col("ratio").alias("truth"))
    seen = _keyed(sampled).select(*KEY, "failed", "low", "high")
    rows = f.join(truth, KEY, "left").join(seen, KEY, "left")
    comparable = F.col("asset").isin(*sampled_assets) & F.col("truth").isNotNull() & F.col("low").isNotNull()
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("sampled_groups"), F.count_if(F.col("failed") > 0).alias("sampled_detected"),
        F.count_if(comparable).alias("coverage_groups"),
        F.count_if(comparable & F.col("truth").between(F.col("low"), F.col("high"))).alias("covered"),
    )


def locked_baselines(specs: list[CheckSpec]) -> list[CheckSpec]:
    """The proposed baselines of a scan as an owner who approves and locks them would keep them."""
    return [s.with_status("locked") for s in specs if s.kind == "baseline"]
