"""Shift of a column's distribution from one scan to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running

# The standard normal's 99 % point, for critical values.
Z99 = 2.326348


def _sides(before: DataFrame, after: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """column, value, a, b: how often each value stands before and after; nulls are left out."""
    def values(df: DataFrame, a: int) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
        return df.select(F.explode(entries).alias("e")).select("e.column", "e.value", F.lit(a).alias("a"), F.lit(1 - a).alias("b"))

    both = values(before, 1).unionByName(values(after, 0)).where("value is not null")
    if kind == "double":
        both = both.where(~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))))
    return both.groupBy("column", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def numeric_shift(before: DataFrame, after: DataFrame, columns: list[str], least_effect: float = 0.2, least_ks: float = 0.1) -> DataFrame:
    """column, n_before, n_after, wasserstein, effect, ks, shifted: one row per column with a finite value on both sides.

    The Wasserstein distance is the area between the two cumulative distributions, `ks` their greatest distance, `effect` the
    Wasserstein distance in standard deviations of the values before (the bare distance where they do not vary). Both thresholds are on
    effect size, since in a large table any difference is significant. Nulls, NaN and infinities are left out.

    Values are counted first, so a frequent one is a single row; the cumulative counts of the merged values run over range
    partitions, so no column is brought to one task.
    """
    values = _sides(before, after, columns, "double")
    totals = values.groupBy("column").agg(
        F.sum("a").alias("n_before"), F.sum("b").alias("n_after"), (F.sum(F.col("a") * F.col("value")) / F.sum("a")).alias("mean")
    ).where("n_before > 0 and n_after > 0")
    spread = values.join(F.broadcast(totals), "column").groupBy("column").agg((F.sum(F.col("a") * F.pow(F.col("value") - F.col("mean"), 2)) / F.sum("a")).alias("variance"))
    totals = totals.join(spread, "column")
    steps = running(values, ["column"], ["value"], {"upto_a": F.col("a"), "upto_b": F.col("b")}, ahead="value").join(F.broadcast(totals), "column")
    gap = F.abs(F.col("upto_a") / F.col("n_before") - F.col("upto_b") / F.col("n_after"))
    out = steps.groupBy("column").agg(
        F.first("n_before").alias("n_before"), F.first("n_after").alias("n_after"),
        F.sum(gap * F.coalesce(F.col("next") - F.col("value"), F.lit(0.0))).alias("wasserstein"),
        F.max(gap).alias("ks"), F.first("variance").alias("variance"),
    )
    deviation = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(F.lit(1.0))
    out = out.withColumn("effect", F.col("wasserstein") / deviation)
    return out.select("column", "n_before", "n_after", "wasserstein", "effect", "ks", ((F.col("effect") >= least_effect) | (F.col("ks") >= least_ks)).alias("shifted"))


def chi_square_point(degrees: Column, z: float = Z99) -> Column:
    """The point of the chi-square distribution at the normal point `z`, by Wilson and Hilferty's cube."""
    share = F.lit(2.0) / (F.lit(9.0) * degrees)
    return degrees * F.pow(F.lit(1.0) - share + F.lit(z) * F.sqrt(share), 3)


def categorical_shift(before: DataFrame, after: DataFrame, columns: list[str], least_divergence: float = 0.01, z: float = Z99) -> DataFrame:
    """column, n_before, n_after, categories, js, psi, psi_critical, shifted: one row per column with values on both sides.

    `js` is the Jensen-Shannon divergence in bits (0 to 1) of the shares as they are. The population stability index takes
    shares with half a row added to every category, so that a category of one side only stays finite; its critical value is the
    chi-square point of one less than the number of categories, times (1/n_before + 1/n_after). Shifted: beyond the critical
    value and of at least `least_divergence` bits. Nulls are left out; values are compared as text.
    """
    values = _sides(before, after, columns, "string")
    totals = values.groupBy("column").agg(F.sum("a").alias("n_before"), F.sum("b").alias("n_after"), F.count("*").alias("categories")).where("n_before > 0 and n_after > 0")
    rows = values.join(F.broadcast(totals), "column")
    p, q = F.col("a") / F.col("n_before"), F.col("b") / F.col("n_after")
    middle = (p + q) / 2
    term = lambda share: F.when(share > 0, share * F.log2(share / middle)).otherwise(F.lit(0.0))
    smooth = lambda n, total: (F.col(n) + 0.5) / (F.col(total) + 0.5 * F.col("categories"))
    sp, sq = smooth("a", "n_before"), smooth("b", "n_after")
    out = rows.groupBy("column").agg(
        F.first("n_before").alias("n_before"), F.first("n_after").alias("n_after"), F.first("categories").alias("categories"),
        F.sum((term(p) + term(q)) / 2).alias("js"), F.sum((sp - sq) * F.log(sp / sq)).alias("psi"),
    )
    degrees = F.greatest(F.col("categories") - 1, F.lit(1)).cast("double")
    out = out.withColumn("psi_critical", chi_square_point(degrees, z) * (F.lit(1.0) / F.col("n_before") + F.lit(1.0) / F.col("n_after")))
    return out.select("column", "n_before", "n_after", "categories", "js", "psi", "psi_critical", ((F.col("psi") > F.col("psi_critical")) & (F.col("js") >= least_divergence)).alias("shifted"))
