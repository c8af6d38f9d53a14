"""Scores per column, table and store, as grouped aggregates over check results.

Inputs hold one row per check, column or table, so every step here is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import FLOOR, as_score, bounded_high, bounded_low, variance_of
from ..model import ROLE_WEIGHT, SEVERITY_WEIGHT


def _lookup(weights: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[key]


def role_weight(role: Column) -> Column:
    return _lookup(ROLE_WEIGHT, role)


def severity_weight(severity: Column) -> Column:
    return _lookup(SEVERITY_WEIGHT, severity)


def table_weight(rows: Column) -> Column:
    return 1 + F.log10(1 + F.greatest(rows, F.lit(0)).cast("double"))


def products(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted geometric product of pass shares per group, with the delta-method variance."""
    p = F.greatest(F.col("ratio"), F.lit(FLOOR))
    w = severity_weight(F.col("severity"))
    terms = scored.select(
        *keys, (w * F.log(p)).alias("_l"), (w * w * variance_of(F.col("low"), F.col("high")) / (p * p)).alias("_v")
    )
    value = F.exp(F.sum("_l"))
    return terms.groupBy(*keys).agg(
        value.alias("value"), (value * value * F.sum("_v")).alias("var"), F.count(F.lit(1)).alias("checks")
    )


def weighted_means(estimates: DataFrame, keys: list[str], weight: str) -> DataFrame:
    w = F.col(weight)
    return estimates.groupBy(*keys).agg(
        (F.sum(F.col("value") * w) / F.sum(w)).alias("value"),
        (F.sum(w * w * F.col("var")) / (F.sum(w) * F.sum(w))).alias("var"),
        F.sum("checks").alias("checks"),
    )


def column_dimensions(results: DataFrame) -> DataFrame:
    """`(asset, column, dimension, value, var, checks)`. Only active and locked checks score."""
    return products(results.filter("scores AND column IS NOT NULL"), ["asset", "column", "dimension"])


def table_dimensions(results: DataFrame, roles: DataFrame) -> DataFrame:
    """Role-weighted mean of the columns, times the product of the table's own checks.

    `roles`: `(asset, column, role)`."""
    columns = column_dimensions(results).join(roles, ["asset", "column"])
    mean = weighted_means(columns.withColumn("w", role_weight(F.col("role"))), ["asset", "dimension"], "w")
    own = products(results.filter("scores AND column IS NULL"), ["asset", "dimension"])
    both = mean.select("asset", "dimension", F.struct("value", "var", "checks").alias("m")).join(
        own.select("asset", "dimension", F.struct("value", "var", "checks").alias("t")), ["asset", "dimension"], "full_outer"
    )
    m, t = F.col("m"), F.col("t")
    var = t["value"] * t["value"] * m["var"] + m["value"] * m["value"] * t["var"]
    return both.select(
        "asset",
        "dimension",
        F.coalesce(m["value"] * t["value"], m["value"], t["value"]).alias("value"),
        F.coalesce(var, m["var"], t["var"]).alias("var"),
        (F.coalesce(m["checks"], F.lit(0)) + F.coalesce(t["checks"], F.lit(0))).alias("checks"),
    )


def store_dimensions(tables: DataFrame, asset_info: DataFrame) -> DataFrame:
    """Mean of the tables, each weighted by the logarithm of its rows."""
    sized = tables.join(asset_info.select("asset", "population"), "asset")
    return weighted_means(sized.withColumn("w", table_weight(F.col("population"))), ["dimension"], "w")


def scores(results: DataFrame, roles: DataFrame, asset_info: DataFrame) -> DataFrame:
    """`(level, asset, column, dimension, value, low, high, checks)` on 0-100 with 95 % bounds.

    The `overall` dimension is the unweighted mean of the dimensions present at that place."""
    tables = table_dimensions(results, roles)
    nothing = F.lit(None).cast("string")
    place = ["level", "asset", "column"]
    estimates = reduce(
        DataFrame.unionByName,
        [
            column_dimensions(results).withColumn("level", F.lit("column")),
            tables.withColumn("level", F.lit("table")).withColumn("column", nothing),
            store_dimensions(tables, asset_info)
            .withColumn("level", F.lit("store")).withColumn("asset", nothing).withColumn("column", nothing),
        ],
    )
    overall = estimates.groupBy(*place).agg(
        F.avg("value").alias("value"),
        (F.sum("var") / (F.count(F.lit(1)) * F.count(F.lit(1)))).alias("var"),
        F.sum("checks").alias("checks"),
    )
    rows = estimates.unionByName(overall.withColumn("dimension", F.lit("overall")))
    value, var = F.col("value"), F.col("var")
    return rows.select(
        *place, "dimension", as_score(value).alias("value"), as_score(bounded_low(value, var)).alias("low"),
        as_score(bounded_high(value, var)).alias("high"), F.col("checks").cast("bigint").alias("checks"),
    )
