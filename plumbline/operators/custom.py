"""Checks that an owner writes: a condition under which a row fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_REPEATABLE = ("rand", "randn", "uuid", "shuffle", "random", "monotonically_increasing_id", "spark_partition_id", "input_file_name", "current_timestamp", "now", "current_date", "localtimestamp", "randstr", "uniform")


@dataclass(frozen=True)
class CustomCheck:
    """`fails` is a condition in SQL over the columns of one table."""

    id: str
    fails: str
    tolerance: float = 0.0


class RefusedCheck(ValueError):
    """The condition cannot be a check of this table."""


def refused(df: DataFrame, check: CustomCheck) -> str | None:
    """Why `check` is no check of `df`: it does not parse, names a column that is not there, is not a Boolean, aggregates, holds a
    subquery, or gives another result when run again. None if it is one. Nothing is run."""
    try:
        plan = df.select(F.expr(check.fails).alias("fails"))
        kind = plan.schema["fails"].dataType
    except (ParseException, AnalysisException) as e:
        return _reason(e)
    if not isinstance(kind, T.BooleanType):
        return f"the condition is of type {kind.simpleString()}, not boolean"
    try:
        if len(df.where(F.expr(check.fails)).columns) != len(df.columns):
            return "the condition changes the rows"
    except AnalysisException as e:
        return _reason(e)
    text = plan._jdf.queryExecution().analyzed()
    if not text.deterministic():
        return "the condition gives another result each time"
    shown = text.toString().lower()
    if any(f"{name}(" in check.fails.lower().replace(" ", "") for name in NOT_REPEATABLE):
        return "the condition depends on when or where it runs"
    if "subquery" in shown or "exists#" in shown:
        return "the condition holds a subquery"
    return None


def _reason(e: Exception) -> str:
    return next((line for line in str(e).splitlines() if line.strip()), type(e).__name__)


def custom_checks(df: DataFrame, checks: list[CustomCheck]) -> DataFrame:
    """check_id, evaluated, failed, ratio, passed of every check: all of them in one aggregation over the rows.

    Every row is evaluated; a null condition does not fail. Ratio is the share of rows that do not fail (1 without rows); a
    check passes if it is at least 1 - tolerance. RefusedCheck is raised for the first check that `refused` gives a reason for."""
    for check in checks:
        reason = refused(df, check)
        if reason:
            raise RefusedCheck(f"{check.id}: {reason}")
    counted = df.agg(F.count("*").alias("evaluated"), *[F.count_if(F.coalesce(F.expr(c.fails), F.lit(False))).alias(f"k{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c.id).alias("check_id"), F.lit(float(c.tolerance)).alias("tolerance"), F.col(f"k{i}").alias("failed")) for i, c in enumerate(checks)])
    out = counted.select("evaluated", F.explode(rows).alias("c")).select("c.check_id", "evaluated", "c.failed", "c.tolerance")
    ratio = F.when(F.col("evaluated") > 0, 1 - F.col("failed") / F.col("evaluated")).otherwise(F.lit(1.0))
    return out.select("check_id", "evaluated", "failed", ratio.alias("ratio"), (ratio >= 1 - F.col("tolerance") - 1e-12).alias("passed"))


def custom_failing_rows(df: DataFrame, check: CustomCheck) -> DataFrame:
    """The rows that fail, all columns."""
    reason = refused(df, check)
    if reason:
        raise RefusedCheck(f"{check.id}: {reason}")
    return df.where(F.coalesce(F.expr(check.fails), F.lit(False)))
